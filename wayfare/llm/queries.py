"""The operators as queries over the test tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import hyperminhash, language, pii, toxicity
from wayfare.llm.decontamination import contaminated
from wayfare.llm.jaccard import near_duplicates
from wayfare.llm.merkle import verify_documents
from wayfare.llm.oracles import MANIFEST, TRIE
from wayfare.llm.packing import added_tokens, pack_documents
from wayfare.llm.prefix_trie import ordered_turns, prefix_trie, spliced
from wayfare.llm.quality import quality_rules
from wayfare.llm.sharding import even_tree, shard_documents
from wayfare.llm.shipping import ship_package
from wayfare.llm.substrings import without_repeats
from wayfare.llm.url_filters import filter_captures, patterns
from wayfare.sources.sinks import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(key: str, sql: str | None = None):
    def add(run):
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return run(spark, folder)

        QUERIES[key] = shipped
        if sql is not None:
            ORACLES[key] = sql
        return run

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer() -> tuple[str, str, dict[str, int]]:
    """Rank file, splitting pattern and added tokens of the tokenizer that packs documents."""
    path = public_tokenizers.path
    return path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added_tokens(path("byte_bpe_50k.json"))


@_query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return pack_documents(docs, *tokenizer())


@_query("op10_sharding")
def sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(_table(spark, folder, "documents"), even_tree(8))


# Which events edit the list, and how: listed or lifted.
_LIST_EDITS = {"error": True, "signup": False}
_CRAWL_START, _CRAWL_SECONDS = "2024-01-01 00:00:00", 30 * 86_400


def _bits(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def list_edits(spark: SparkSession, folder: str) -> DataFrame:
    """A dated list about the crawled patterns: each event edits the patterns that hash to its user's slot."""
    pages, events = _table(spark, folder, "pages"), _table(spark, folder, "events")
    found = pages.select(F.explode(F.array(*patterns(F.col("url")).values())).alias("pattern"))
    slots = events.agg(F.max("user_id").alias("n")).select(F.col("n") + 1).scalar()
    crawled = found.filter("pattern IS NOT NULL").distinct()
    slotted = crawled.withColumn("slot", F.pmod(_bits(F.col("pattern")), slots))
    edits = events.filter(F.col("event_type").isin(*_LIST_EDITS)).select(
        F.col("user_id").alias("slot"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "error").alias("listed")
    )
    return edits.join(slotted, "slot").select("pattern", "at", "listed")


_URL_ORACLE = """
WITH captures AS (
  SELECT page_id, url,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(('0x' || substr(md5(url), 1, 8))::BIGINT % 2592000) AS fetched_at,
         nullif(lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#]*@)?([^/:?#@]+)', 1)), '') AS host,
         nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]+/([^/?#]+)', 1), '') AS segment
  FROM pages),
keyed AS (
  SELECT *, host || '/' || segment AS section,
         '*.' || nullif(regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1), '') AS site,
         '*.' || nullif(regexp_extract(host, '([^.]+[.][^.]+)$', 1), '') AS domain
  FROM captures),
crawled AS (
  SELECT section AS pattern FROM keyed UNION SELECT host FROM keyed UNION SELECT site FROM keyed
  UNION SELECT domain FROM keyed),
edits AS (
  SELECT pattern, ts AS edited, max(event_type = 'error') AS listed
  FROM events JOIN crawled
    ON ('0x' || substr(md5(pattern), 1, 8))::BIGINT % (SELECT max(user_id) + 1 FROM events) = user_id
  WHERE event_type IN ('error', 'signup') GROUP BY ALL),
stepped AS (
  SELECT *, lead(edited) OVER (PARTITION BY pattern ORDER BY edited) AS until FROM edits),
intervals AS (SELECT pattern, edited AS since, until FROM stepped WHERE listed)
SELECT page_id, url, CAST(fetched_at AS VARCHAR) AS fetched_at,
       coalesce(a.pattern, b.pattern, c.pattern, d.pattern) IS NOT NULL AS listed,
       coalesce(a.pattern, b.pattern, c.pattern, d.pattern) AS pattern,
       CAST(coalesce(a.since, b.since, c.since, d.since) AS VARCHAR) AS since
FROM keyed k
LEFT JOIN intervals a ON k.section = a.pattern AND fetched_at >= a.since AND (a.until IS NULL OR fetched_at < a.until)
LEFT JOIN intervals b ON k.host = b.pattern AND fetched_at >= b.since AND (b.until IS NULL OR fetched_at < b.until)
LEFT JOIN intervals c ON k.site = c.pattern AND fetched_at >= c.since AND (c.until IS NULL OR fetched_at < c.until)
LEFT JOIN intervals d ON k.domain = d.pattern AND fetched_at >= d.since AND (d.until IS NULL OR fetched_at < d.until)"""


@_query("op4_url_filters", _URL_ORACLE)
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    start = F.unix_timestamp(F.lit(_CRAWL_START))
    fetched = F.timestamp_seconds(start + F.pmod(_bits(F.col("url")), F.lit(_CRAWL_SECONDS)))
    captures = _table(spark, folder, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    judged = filter_captures(captures, list_edits(spark, folder))
    return judged.withColumns({c: F.col(c).cast("string") for c in ("fetched_at", "since")})


_QUALITY_ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS body FROM documents),
w AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i
  FROM (SELECT r, list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d)),
g AS (
  SELECT r, i, word, lead(word, 1) OVER p AS w1, lead(word, 2) OVER p AS w2, lead(word, 3) OVER p AS w3,
         lead(word, 4) OVER p AS w4
  FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (
  SELECT r, i FROM g WHERE w4 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, word, w1, w2, w3, w4) > 1),
reach AS (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS n FROM twice),
repeated AS (SELECT r, sum(n) AS n FROM reach GROUP BY r),
counted AS (SELECT r, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY r),
l AS (
  SELECT r, host, body, line, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
         trim(regexp_replace(regexp_replace(lower(trim(line)), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT r, host, body, unnest(string_split(body, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
hosts AS (SELECT host, count(DISTINCT body) AS of FROM d GROUP BY host),
frequent AS (
  SELECT host, norm FROM l JOIN hosts USING (host) GROUP BY host, norm, of
  HAVING count(DISTINCT body) >= 5 AND count(DISTINCT body) > 0.05 * of),
removed AS (SELECT r, sum(n) AS n FROM l JOIN frequent USING (host, norm) GROUP BY r),
figures AS (
  SELECT doc_id, CAST(coalesce(counted.n, 0) AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN counted USING (r) LEFT JOIN dup USING (r) LEFT JOIN repeated USING (r) LEFT JOIN removed USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM figures)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 10 AND n_words - n_removed_words >= 0.3 * n_words AS kept
FROM judged"""

@_query("op9_quality_rules", _QUALITY_ORACLE)
def quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(_table(spark, folder, "documents"))


def _held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


@_query("op6_toxicity")
def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = toxicity.fit(docs, labels, allowed=~_held_out())
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query("op7_language_id")
def document_languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = language.detect_languages(docs, language.fit(docs, allowed=~_held_out()))
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


@_query("op3_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


@_query("op5_substring_dedup")
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = without_repeats(_table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query("op2_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query("op8_pii")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return pii.find_personal_data(docs, pii.fit(docs))


@_query("op12_merkle_manifest", MANIFEST)
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return verify_documents(_table(spark, folder, "documents"), _held_out(), lowered)


@_query("op13_prefix_trie", TRIE)
def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = ordered_turns(_table(spark, folder, "conversations"))
    conversations = turns.select("conv_id").distinct()
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(5))
    keep = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    rebuilt = spliced(turns, conversations.select("conv_id", base.alias("base"), keep.alias("keep")))
    return prefix_trie(stored(rebuilt, "rebuilt"), conversations)


@_query("op11_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return hyperminhash.near_duplicates(_table(spark, folder, "documents"))
