"""Quality rules from line frequencies across documents, native DataFrame expressions only.

Lines are normalised (lower case, digits to 0, white space folded) and hashed; for each host the distinct documents
that hold a line are counted. A line in more than ``line_share`` of a host's documents, and in at least
``least_documents`` of them, is boilerplate and removed. A document is rejected when the lines left hold fewer
than ``least_words`` words or less than ``least_left`` of its own words, or when its base rules fail: too few
words, or too many of them in five-word sequences that the text repeats.

Texts are read once: a digest with a row number, the base figures and the line hashes goes to shared storage, and all
counting works on that. Distinct documents are distinct texts, so copies of one document do not make
its lines boilerplate. Hot lines and hosts are counted with partial aggregation; only counts of each
(host, line) meet. The join back to the lines is an equi-join whose hot keys adaptive execution splits.

A NULL text has no words and no lines and fails; a NULL host is one host. Repeated rows are judged alike, each
with its own result row. Lines without a word count for nothing. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.text import NOT_SPACE, SPACE, bound, words_of
from wayfare.sources.sinks import stored

LEAST_WORDS = 10
MOST_REPEATED = 0.2
LINE_SHARE = 0.05
LEAST_DOCUMENTS = 5
LEAST_LEFT = 0.3
WINDOW = 5


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many words lie in a ``size``-word window found twice or more in ``words``.

    Window hashes are sorted to see whether any repeats; only then are they sorted again with
    their places, and the places covered are added up. Time is n log n in the text's length.
    """

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(rows: Column) -> Column:
            def twin(row: Column, k: Column) -> Column:
                before = F.when(k > 0, F.get(rows, k - 1)["h"] == row["h"])
                after = F.get(rows, k + 1)["h"] == row["h"]
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

            return F.sort_array(F.transform(F.filter(rows, twin), lambda row: row["i"]))

        def total(places: Column) -> Column:
            reach = F.transform(
                places, lambda p, k: F.least(F.lit(size), F.coalesce(F.get(places, k + 1) - p, F.lit(size)))
            )
            return F.aggregate(reach, F.lit(0), lambda acc, n: acc + n)

        return bound(bound(placed, starts), total)

    def repeats(hashes: Column) -> Column:
        any_twice = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(any_twice, covered(hashes)).otherwise(F.lit(0))

    def windows(ws: Column) -> Column:
        last = F.size(ws) - size
        return F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(size)])
        )

    counted = bound(words, lambda ws: bound(windows(ws), repeats))
    return F.when(F.size(words) >= size, counted).otherwise(F.lit(0)).cast("long")


def _line_digests(lines: Column) -> Column:
    """(hash of the normalised line, its words) for each line."""

    def digest(line: Column) -> Column:
        folded = F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), "[0-9]", "0"), f"{SPACE}+", " ")
        words = F.size(F.filter(F.split(line, f"{SPACE}+"), lambda w: w != ""))
        return F.struct(F.xxhash64(F.trim(folded)).alias("line"), words.alias("words"))

    return F.transform(lines, digest)


def document_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One narrow row per document: row number, base figures and line hashes."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        F.col(key).alias("doc_id"),
        F.col(host).alias("host"),
        body.alias("body"),
        words_of(F.col(text)).alias("words"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(NOT_SPACE)).alias("lines"),
    )
    return split.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "host",
        F.xxhash64("body").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.regexp_replace("body", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        _line_digests(F.col("lines")).alias("lines"),
    )


def frequent_lines(digests: DataFrame, line_share: float, least_documents: int) -> DataFrame:
    """(host, line) in more than the allowed number of the host's distinct documents."""
    lines = digests.select("host", "text_hash", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
    held = lines.groupBy("host", "line", "text_hash").agg(F.lit(1).alias("one")).groupBy("host", "line")
    counts = held.agg(F.count(F.lit(1)).alias("documents"))
    hosts = (
        digests.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("of"))
    )
    common = counts.filter(F.col("documents") >= least_documents).alias("c")
    same = F.col("c.host").eqNullSafe(F.col("h.host"))
    above = F.col("documents") > F.lit(line_share) * F.col("of")
    return common.join(hosts.alias("h"), same).filter(above).select("c.host", "line")


def judge(
    digests: DataFrame,
    line_share: float = LINE_SHARE,
    least_documents: int = LEAST_DOCUMENTS,
    least_words: int = LEAST_WORDS,
    least_left: float = LEAST_LEFT,
    most_repeated: float = MOST_REPEATED,
) -> DataFrame:
    """The digests with ``n_removed_words``, ``base_failed`` and ``kept``."""
    removable = stored(frequent_lines(digests, line_share, least_documents), "lines").alias("f")
    lines = digests.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.*").alias("l")
    gone = lines.join(removable, F.col("l.host").eqNullSafe(F.col("f.host")) & (F.col("l.line") == F.col("f.line")))
    removed = gone.groupBy(F.col("row").alias("of_row")).agg(F.sum("words").alias("n_removed_words"))
    joined = digests.join(removed, F.col("row") == F.col("of_row"), "left")
    n = F.col("n_words")
    left = n - F.coalesce(F.col("n_removed_words"), F.lit(0))
    failed = (n < least_words) | (100 * F.col("n_repeat_words") > 100 * most_repeated * n)
    return joined.select(
        *digests.columns,
        F.coalesce(F.col("n_removed_words"), F.lit(0)).cast("long").alias("n_removed_words"),
        failed.alias("base_failed"),
        (~failed & (left >= least_words) & (left >= least_left * n)).alias("kept"),
    )


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """One row per document with its figures and verdict; ``limits`` as for :func:`judge`."""
    digests = stored(document_digests(docs), "digests")
    return judge(digests, **limits).drop("row", "host", "text_hash", "lines")


def without_frequent_lines(docs: DataFrame, lines: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` with the removable lines of its host cut from each text.

    Each document's distinct line hashes meet the host's removable lines in an equi-join; what comes
    back per document is the set of its own hashes to cut.
    """
    raw = F.split(F.col(text), "\n")
    hashed = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "texts")
    digests = hashed.select("__row", F.col(host).alias("__host"), F.explode(_line_digests(raw)).alias("__l"))
    found = digests.join(
        lines.select(F.col("host").alias("__of"), F.col("line").alias("__line")),
        F.col("__host").eqNullSafe(F.col("__of")) & (F.col("__l.line") == F.col("__line")),
    )
    cuts = found.groupBy("__row").agg(F.collect_set("__line").alias("__cut"))
    keep = F.transform(
        F.filter(
            F.arrays_zip(raw.alias("line"), _line_digests(raw).alias("digest")),
            lambda pair: ~F.array_contains(F.col("__cut"), pair["digest"]["line"]) | (pair["digest"]["words"] == 0),
        ),
        lambda pair: pair["line"],
    )
    joined = hashed.join(cuts, "__row", "left")
    text_left = F.when(F.col("__cut").isNull(), F.col(text)).otherwise(F.array_join(keep, "\n"))
    return joined.withColumn(text, text_left).drop("__row", "__cut")
