"""Word sequences that repeat across a corpus, found with one FM-index per shard, and removed.

A window is ``WINDOW`` consecutive words. Equal windows must meet in one shard without sending every text to every shard:

1. Each window is assigned its anchor, the smallest hash among its ``GRAM``-word sequences. Equal windows have equal anchors, and
   neighbouring windows mostly share one, so a text is cut into few runs of windows. A run that goes on, as in a periodic text,
   is cut into pieces of a fixed number of windows.
2. Anchors are counted over the distinct texts, twice in a run that has its anchor at several places; runs whose anchor is
   counted once hold no repeated window and go no further.
3. The words of the other runs go to the shard of their anchor, each distinct run once, with its number of occurrences. Runs of
   an anchor with more than ``HOT_RUNS`` occurrences are sent window by window, spread by their first and last words as well.
4. Every shard builds a compressed FM-index (wavelet matrix over the Burrows-Wheeler transform) of its runs, streams
   them through it by backward search, and reports the intervals of windows that occur twice or more.
5. Intervals return to the texts, and the words that they cover are removed.

The number of shards follows from the words to index, ``SHARD_WORDS`` each. Texts of equal words are one distinct text: all its
windows repeat. Windows are judged on the input. A NULL text has no words; texts shorter than a window stay whole, as do empty
ones. Repeated rows are copies of each other. Words are compared by 64-bit hashes. Empty tables give no rows. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.fetch import texts_for
from wayfare.llm.fm_index import FMIndex
from wayfare.llm.shingles import slices, word_hashes
from wayfare.llm.subwords import mixed
from wayfare.sources.sinks import stored

WINDOW = 35
GRAM = 8
HOT_RUNS = 20_000
SHARD_WORDS = 250_000

_PROFILE = "doc_id long, n_words long, t1 long, t2 long, sha string, anchors array<long>, starts array<int>, several array<boolean>"
_NOTHING = hashlib.sha256(b"").hexdigest()


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each place (wrapping past the end)."""
    weights = np.cumprod(np.full(size, 0xD1B54A32D192ED03, np.uint64))
    padded = np.concatenate([words, words[:1].repeat(size - 1)])
    rolled = np.zeros(len(words), np.uint64)
    for k in range(size):
        rolled += padded[k : k + len(words)] * weights[k]
    return mixed(rolled)


def runs_of(
    words: np.ndarray, counts: np.ndarray, window: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run in texts laid end to end: place of the first window, anchor, whether that is at several places.

    Last, the number of runs per text. Only a run that has its anchor at several places has more windows than a window has
    grams; it is cut after every twice as many windows, so that a run's count stands for its words.
    """
    n = len(words)
    grams = gram_hashes(words, gram) if n else words
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(n)
    # the place of the smallest gram among the next 1, 2, 4, ... places, then among all grams of a window
    best, reach, grams_per_window = np.arange(n), 1, window - gram + 1

    def smaller(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(grams[b] < grams[a], b, a)

    def later(places: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([places[by:], np.full(min(by, n), max(n - 1, 0))])

    while 2 * reach <= grams_per_window:
        best = smaller(best, later(best, reach))
        reach *= 2
    best = smaller(best, later(best, grams_per_window - reach))
    valid = left >= window
    anchors = grams[best] if n else grams
    moved, new = valid.copy(), valid.copy()
    moved[1:] &= best[1:] != best[:-1]
    new[1:] &= ~valid[:-1] | (anchors[1:] != anchors[:-1])
    starts = ends - counts
    new[starts[counts > 0]] = valid[starts[counts > 0]]
    at = np.flatnonzero(new)
    several = np.add.reduceat(moved & ~new, at) > 0 if len(at) else np.zeros(0, bool)
    longest = 2 * grams_per_window
    pieces = -(-np.minimum(np.append(at[1:], n) - at, left[at] - window + 1) // longest)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at, several = np.repeat(at, pieces) + nth * longest, np.repeat(several, pieces)
    return at, anchors[at], several, np.diff(np.searchsorted(at, np.append(starts, n)))


def _sequence_digests(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each text's word sequence."""
    starts = np.cumsum(counts) - counts
    place = (np.arange(len(words)) - np.repeat(starts, counts)).astype(np.uint64)
    out = []
    for seed in (np.uint64(0x1234567), np.uint64(0x89ABCDE)):
        sums = np.zeros(len(counts), np.uint64)
        some = counts > 0
        if some.any():
            sums[some] = np.add.reduceat(mixed(words + mixed(place * np.uint64(2) + seed)), starts[some])
        out.append(mixed(sums + counts.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def profiles(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Per document: number of words, fingerprints, SHA-256 of its words, and its runs."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in slices(batch.column(1)):
                words, counts = word_hashes(rows, lower=False)
                t1, t2 = _sequence_digests(words, counts)
                at, anchors, several, per = runs_of(words, counts, window, gram)
                within = at - np.repeat(np.cumsum(counts) - counts, per)
                offsets = pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32())
                shas = [hashlib.sha256(b" ".join((t.as_py() or "").encode().split())).hexdigest() for t in rows]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(first, len(rows)),
                        pa.array(counts.astype(np.int64)),
                        pa.array(t1),
                        pa.array(t2),
                        pa.array(shas, pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array(anchors.view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array(within.astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(several)),
                    ],
                    names=["doc_id", "n_words", "t1", "t2", "sha", "anchors", "starts", "several"],
                )

    return texts.select("doc_id", "text").mapInArrow(profile, _PROFILE)


def live_runs(distinct: DataFrame, window: int, hot_runs: int) -> DataFrame:
    """Per distinct text: its runs (anchor, start, windows, hot) whose anchor occurs more than once."""
    both = F.arrays_zip(F.col("anchors"), F.col("starts"), F.col("several"))
    exploded = distinct.select("row", "n_words", "starts", F.posexplode(both).alias("i", "run"))
    following = F.coalesce(F.get("starts", F.col("i") + 1).cast("long"), F.col("n_words") - (window - 1))
    runs = exploded.select(
        "row", F.col("run.anchors").alias("anchor"), F.col("run.starts").alias("start"),
        (following - F.col("run.starts")).cast("int").alias("windows"), F.col("run.several").cast("int").alias("several"),
    )
    counts = runs.groupBy("anchor").agg(F.sum(F.col("several") + 1).alias("n")).filter("n > 1")
    live = runs.join(counts, "anchor").select(
        "row", F.struct("anchor", "start", "windows", (F.col("n") > hot_runs).alias("hot")).alias("run")
    )
    return live.groupBy("row").agg(F.collect_list("run").alias("runs"))


_OCCURRENCE = "row long, copies long, key long, start int, segment string, words int"


def segments(texts: DataFrame, live: DataFrame, window: int, gram: int) -> DataFrame:
    """The words of every live run (of every window of a hot run), with the shard key."""
    found = texts_for(texts, live).select("row", "t1", "t2", "text", "runs", "copies")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in slices(batch.column(3)):
                hashes, counts = word_hashes(rows, lower=False)
                t1, t2 = _sequence_digests(hashes, counts)
                grams = gram_hashes(hashes, gram).view(np.int64) if len(hashes) else hashes
                base = np.cumsum(counts) - counts
                out = []
                for i, text in enumerate(rows):
                    at = first + i
                    if (t1[i], t2[i]) != (batch.column(1)[at].as_py(), batch.column(2)[at].as_py()):
                        continue  # another text under the same doc_id
                    row, copies = batch.column(0)[at].as_py(), batch.column(5)[at].as_py()
                    words = (text.as_py() or "").encode().split()
                    for run in batch.column(4)[at].as_py():
                        anchor, start, windows = run["anchor"], run["start"], run["windows"]
                        if not run["hot"]:
                            size = windows + window - 1
                            out.append((row, copies, anchor, start, b" ".join(words[start : start + size]), size))
                            continue
                        for k in range(start, start + windows):
                            ends = grams[[base[i] + k, base[i] + k + window - gram]].view(np.uint64)
                            spread = mixed(ends[:1] + mixed(ends[1:]) * np.uint64(3) + np.uint64(anchor % (1 << 64)))
                            out.append((row, copies, int(spread.view(np.int64)[0]), k, b" ".join(words[k : k + window]), window))
                columns = list(zip(*out)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32())
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
                arrays[4] = arrays[4].cast(pa.string())
                yield pa.record_batch(arrays, names=["row", "copies", "key", "start", "segment", "words"])

    return found.mapInArrow(cut, _OCCURRENCE)


def repeated_intervals(sharded: DataFrame, window: int) -> DataFrame:
    """(s1, s2, intervals of repeated windows) for each segment of a partition that has any.

    A partition is a shard: it is indexed whole, then all its segments are streamed through the index.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        hashes, counts = word_hashes(table.column("segment").chunk(0), lower=False)
        known, symbol = np.unique(hashes, return_inverse=True)
        text = np.zeros(len(hashes) + len(counts), np.int64)
        sequence = np.repeat(np.arange(len(counts)), counts)
        text[np.arange(len(hashes)) + sequence] = symbol + 1
        starts = np.cumsum(counts) - counts + np.arange(len(counts))
        weights = np.repeat(table.column("occurrences").to_numpy(), counts + 1)
        found = FMIndex(text, weights, window).repeated(starts, counts, text)
        edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(starts, begin, side="right") - 1
        per = np.bincount(owner, minlength=len(starts))
        some = np.flatnonzero(per)
        offsets = pa.array(np.concatenate([[0], np.cumsum(per[some])]), pa.int32())
        spans = pa.StructArray.from_arrays(
            [pa.array((begin - starts[owner]).astype(np.int32)), pa.array((end - starts[owner]).astype(np.int32))], ["first", "end"]
        )
        picked = table.select(["s1", "s2"]).take(pa.array(some))
        yield pa.record_batch(
            [picked.column(0).combine_chunks(), picked.column(1).combine_chunks(), pa.ListArray.from_arrays(offsets, spans)],
            names=["s1", "s2", "spans"],
        )

    return sharded.mapInArrow(search, "s1 long, s2 long, spans array<struct<first: int, end: int>>")


def repeats(texts: DataFrame, window: int, gram: int, hot_runs: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """(profiles with ``row`` and ``copies``, per distinct text with repeated windows: row, doc_id, t1, t2 and ``spans``)."""
    rows = stored(profiles(texts, window, gram).withColumn("row", F.monotonically_increasing_id()), "profiles")
    firsts = rows.groupBy("t1", "t2").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"))
    distinct = stored(firsts.select("row", "copies").join(rows, "row"), "distinct")
    live = live_runs(distinct, window, hot_runs)
    named = distinct.select("row", F.col("doc_id").alias("of"), "t1", "t2", "copies")
    held = stored(live.join(named, "row"), "runs")
    # Repeated rows of one document give its runs again; it has copies then, and counts as repeated either way.
    cut = segments(texts, held, window, gram)
    pieces = stored(cut.withColumns({"s1": F.xxhash64("segment"), "s2": F.xxhash64(F.lit(1), "segment")}), "segments")
    total = pieces.agg(F.sum("words")).first()[0] or 0
    unique = pieces.groupBy("s1", "s2").agg(
        F.first("key").alias("key"), F.first("segment").alias("segment"), F.sum("copies").alias("occurrences")
    )
    shards = unique.repartition(max(1, -(-total // shard_words)), "key")
    intervals = stored(repeated_intervals(shards, window), "intervals")
    hits = pieces.select("row", "start", "s1", "s2").join(intervals, ["s1", "s2"])
    moved = F.transform("spans", lambda s: F.struct((F.col("start") + s["first"]).alias("first"), (F.col("start") + s["end"]).alias("end")))
    spans = hits.groupBy("row").agg(F.flatten(F.collect_list(moved)).alias("spans"))
    return rows.join(firsts.select("t1", "t2", "copies"), ["t1", "t2"]), spans.join(named, "row")


def without_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    hot_runs: int = HOT_RUNS,
    shard_words: int = SHARD_WORDS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per document: doc_id, ``n_words``, ``n_removed``, ``kept_sha256`` and, where words were removed, the ``kept_text``.

    ``kept_text`` is NULL where the document stays as it is.
    """
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows, spans = repeats(texts, window, gram, hot_runs, shard_words)
    # texts with copies lose all their windows anyway
    own = spans.filter("copies = 1").select("of", "t1", "t2", "spans")
    found = texts_for(texts, own).select("t1", "t2", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, bodies in slices(batch.column(2)):
                t1, t2 = _sequence_digests(*word_hashes(bodies, lower=False))
                for i, body in enumerate(bodies):
                    d1, d2 = batch.column(0)[first + i].as_py(), batch.column(1)[first + i].as_py()
                    if (t1[i], t2[i]) != (d1, d2):
                        continue
                    words = (body.as_py() or "").encode().split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    for span in batch.column(3)[first + i].as_py():
                        edge[span["first"]] += 1
                        edge[span["end"] - 1 + window] -= 1
                    covered = np.cumsum(edge[:-1]) > 0
                    kept = b" ".join([w for w, gone in zip(words, covered.tolist()) if not gone])
                    out.append((d1, d2, int(covered.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["t1", "t2", "removed", "kept_sha", "kept_text"])

    # Repeated texts are not among them, so each fingerprint has one row.
    cut = found.mapInArrow(remove, "t1 long, t2 long, removed long, kept_sha string, kept_text string")
    joined = rows.join(cut, ["t1", "t2"], "left")
    all_gone = (F.col("copies") > 1) & (F.col("n_words") >= window)
    return joined.select(
        "doc_id",
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(_NOTHING)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(all_gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )
