"""Near-duplicate documents by HyperMinHash sketches, links confirmed on full shingle sets.

1. A set's shingle hashes fall into ``REGISTERS`` buckets; a bucket keeps the least of the other hash bits as a register of 16: how many
   leading zeros, and the ``MANTISSA`` bits after the first one. An empty bucket borrows the register of the first bucket with one in an order
   of its own, so that registers of any two sets agree with the chance of their Jaccard similarity, however small the sets.
2. Documents with equal sets are one class. Bands of four registers, 64 bits, are the keys under which classes meet; at similarity 0.8 the 32 bands
   miss a pair with a chance of 5e-8.
3. Each class is first held against one hub: a band's hub is the class that meets most others over all its bands, the middle of a group of near
   copies, and a class takes the hub of most of its bands. Large groups of copies need one comparison each by that. Bands whose classes
   are then still in different components are compared in full, in blocks: a band with m classes becomes pairs of blocks of
   ``BLOCK`` classes, dealt to tasks, which compare registers in numpy. No pair is written before its estimate allows a link.
4. The estimate corrects the share of equal registers by the chance that different minima share a register, given the two sizes. Pairs
   go on if it is at most four standard errors under the threshold, and if their odd sketches, ``ODD_BITS`` parity bits, differ in no more bits than
   the sets of two linked documents can differ in elements. The second filter loses nothing.
5. They are confirmed on whole sets, recomputed from the texts; links become components.

Every document is banded, and no band is capped. Documents on a template a little under the threshold cost comparisons of sketches in blocks, and a
confirmation for each pair that passes both filters; they lose nothing.

A document without words has no set, links with nothing and is its own component, even with a NULL doc_id. Repeated rows and doc_ids are separate
documents. A NULL doc_id does not count when the smallest of a component is sought. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.components import components
from wayfare.llm.shingles import shingle_sets, sliced
from wayfare.llm.spread import join_unique
from wayfare.llm.subwords import mixed
from wayfare.llm.verification import set_digests, verified
from wayfare.sources.sinks import stored

SHINGLE_WORDS = 4
PERCENT = 80
REGISTERS = 128
MANTISSA = 10
BLOCK = 512
ODD_BITS = 2048
_BUCKET_BITS = REGISTERS.bit_length() - 1
_REST = 64 - _BUCKET_BITS  # hash bits from which a register is made
_SEED = np.uint64(0x48594D48)
_NONE = np.uint64(1) << np.uint64(_REST)


def _orders() -> np.ndarray:
    """For each bucket the order in which it looks for a register: its own first."""
    rng = np.random.default_rng(11)
    others = [np.concatenate([[i], rng.permutation(np.delete(np.arange(REGISTERS), i))]) for i in range(REGISTERS)]
    return np.stack(others)


_ORDERS = _orders()


def compressed(least: np.ndarray) -> np.ndarray:
    """Registers of minima of ``_REST`` bits: leading zeros, then the bits after the first one."""
    length, left = np.zeros(least.shape, np.uint64), least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        over = left >> np.uint64(step)
        length += (over > 0) * np.uint64(step)
        left = np.where(over > 0, over, left)
    length += left > 0
    zeros = np.uint64(_REST) - length
    after = (least << zeros) & np.uint64((1 << _REST - 1) - 1)  # without the leading one
    return ((zeros << np.uint64(MANTISSA)) | (after >> np.uint64(_REST - 1 - MANTISSA))).astype(np.uint16)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a non-empty set."""
    hashes = mixed(shingles ^ _SEED)
    least = np.full(REGISTERS, _NONE)
    np.minimum.at(least, (hashes >> np.uint64(_REST)).astype(np.int64), hashes & (_NONE - np.uint64(1)))
    filled = least != _NONE
    registers = compressed(np.where(filled, least, np.uint64(0)))
    if not filled.all():
        registers = registers[_ORDERS[np.arange(REGISTERS), filled[_ORDERS].argmax(1)]]
    return registers


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity of the elements that hash to each of ``ODD_BITS`` bits."""
    parity = np.bincount((shingles % np.uint64(ODD_BITS)).astype(np.int64), minlength=ODD_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def most_different(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """In how many elements linked sets of these sizes can differ."""
    return n_a + n_b - 2 * -(-percent * (n_a + n_b) // (100 + percent))


def _octaves(n: np.ndarray) -> np.ndarray:
    """The chance that the least of a bucket's share of ``n`` uniform values has 0, 1, ... leading zeros."""
    share = np.maximum(np.asarray(n, float) / REGISTERS, 1.0)[..., None]
    edges = 0.5 ** np.arange(_REST + 1)
    above = (1 - edges) ** share
    return above[..., 1:] - above[..., :-1]


def estimated(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from how many registers are equal, corrected for equal registers of different minima."""
    chance = (_octaves(n_a) * _octaves(n_b)).sum(-1) / (1 << MANTISSA)
    return (equal / REGISTERS - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    p = percent / 100
    return p - 4 * math.sqrt(p * (1 - p) / REGISTERS)


def _packed(registers: np.ndarray) -> np.ndarray:
    """Bands of four registers as 64-bit integers."""
    return registers.view(np.int64)


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """A list column, of lists of one length, as a matrix of its integers seen as ``dtype``."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(dtype).reshape(len(column), -1)


def document_sketches(texts: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, f1, f2, bands, odd): set size, set fingerprint, packed registers and odd sketch of ``texts(doc_id, text)``."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1):
                sizes, digests, bands, odd = [], [], [], []
                for own in shingle_sets(part.column(1), size):
                    sizes.append(len(own))
                    digests.append(set_digests(own))
                    bands.append(_packed(sketch(own)) if len(own) else np.zeros(0, np.int64))
                    odd.append(odd_sketch(own))
                f1, f2 = zip(*digests)
                arrays = [pa.array(c, pa.int64()) for c in (sizes, f1, f2)] + [pa.array(c, pa.list_(pa.int64())) for c in (bands, odd)]
                yield pa.record_batch([part.column(0), *arrays], names=["doc_id", "n", "f1", "f2", "bands", "odd"])

    return texts.select("doc_id", "text").mapInArrow(profile, "doc_id long, n long, f1 long, f2 long, bands array<long>, odd array<long>")


def likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` whose sketches allow a link."""
    least = least_estimate(percent)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            equal = (_matrix(batch.column(4), np.uint16) == _matrix(batch.column(5), np.uint16)).sum(1)
            off = np.bitwise_count(_matrix(batch.column(6), np.uint64) ^ _matrix(batch.column(7), np.uint64)).sum(1)
            likely = (estimated(equal, n_a, n_b) >= least) & (off <= most_different(n_a, n_b, percent))
            yield batch.select([0, 1]).filter(pa.array(likely))

    one, other = (classes.select(F.col("class").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "bands", "odd")]) for c in "ab")
    met = pairs.join(other, "b").join(one, "a")
    return met.select("a", "b", "n_a", "n_b", "bands_a", "bands_b", "odd_a", "odd_b").mapInArrow(judge, "a long, b long")


def live_bands(classes: DataFrame) -> DataFrame:
    """(key, class, n, met) of the bands in which two classes or more meet, ``met`` of them."""
    placed = classes.select("class", "n", F.posexplode("bands").alias("band", "registers"))
    keyed = placed.select(F.xxhash64("band", "registers").alias("key"), "class", "n")
    held = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("met"))
    return join_unique(keyed, stored(held.filter("met > 1").withColumn("rows", F.col("met")), "bands"), ["key"])


def hub_pairs(live: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each class the hub of most of its bands."""
    score = live.groupBy("class").agg(F.sum("met").alias("score"))
    scored = stored(live.join(score, "class"), "scored")
    hub = F.max_by(F.struct("class", "n"), F.struct("score", -F.col("class"))).alias("hub")
    hubs = stored(scored.groupBy("key").agg(hub, F.count(F.lit(1)).alias("rows")), "hubs")
    met = join_unique(scored.select("key", "class", "n"), hubs, ["key"]).select("class", "n", F.col("hub.class").alias("hub"), F.col("hub.n").alias("hub_n"))
    fitting = met.filter("hub != class").filter(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    votes = fitting.groupBy(F.col("hub").alias("a"), F.col("class").alias("b")).agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("b").agg(F.max_by("a", F.struct("votes", -F.col("a"))).alias("a")).select("a", "b")


def open_pairs(live: DataFrame, classes: DataFrame, joined: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b) of classes that meet in a band, are in different components by ``joined(node, root)``, and may be linked by their estimate."""
    rooted = live.join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    held = stored(rooted.select("key", "class", "n", "root"), "rooted")
    spans = held.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("least"), F.max("root").alias("most"))
    apart = stored(spans.filter("least < most").select("key", "rows"), "apart")
    blocks = F.ceil(F.col("rows") / F.lit(block)).cast("long")
    counted = join_unique(held, apart.withColumn("blocks", blocks), ["key"])
    dealt = counted.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "n", "root")
    sketched = units.join(classes.select("class", "bands", "odd"), "class").select("key", "i", "j", "own", "class", "n", "root", "bands", "odd")
    least = least_estimate(percent)

    def compare(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = pa.Table.from_batches(rows).combine_chunks()
        i, j, own, name, n, root = (unit.column(k).to_numpy() for k in range(1, 7))
        registers, odd = (_matrix(unit.column(c).combine_chunks(), t) for c, t in (("bands", np.uint16), ("odd", np.uint64)))
        octaves = _octaves(n)
        for at in np.flatnonzero(own == i[0]) if len(name) > 1 else ():
            # within a block each pair once, between blocks the first against the second
            to = np.flatnonzero((own == j[0]) & (root != root[at]) & ((i[0] != j[0]) | (name > name[at])))
            to = to[100 * np.minimum(n[to], n[at]) >= percent * np.maximum(n[to], n[at])]
            to = to[np.bitwise_count(odd[to] ^ odd[at]).sum(1) <= most_different(n[to], n[at], percent)]
            chance = (octaves[to] @ octaves[at]) / (1 << MANTISSA)
            likely = ((registers[to] == registers[at]).sum(1) / REGISTERS - chance) / (1 - chance) >= least
            if likely.any():
                b = name[to[likely]]
                yield pa.record_batch([pa.array(np.minimum(b, name[at])), pa.array(np.maximum(b, name[at]))], names=["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held_rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for begin, end in zip(edges, edges[1:]):
                if tuple(keys[begin]) != of and held_rows:
                    yield from compare(held_rows)
                    held_rows = []
                of = tuple(keys[begin])
                held_rows.append(batch.slice(begin, end - begin))
        if held_rows:
            yield from compare(held_rows)

    ordered = sketched.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return ordered.mapInArrow(search, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that its links reach), and whether it is that one."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = stored(document_sketches(texts, size).withColumn("row", F.monotonically_increasing_id()), "sketches")
    worded = sketches.filter("n > 0")
    firsts = worded.groupBy("n", "f1", "f2").agg(
        F.min(F.struct("row", F.col("doc_id").alias("head"))).alias("first"), F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("rows")
    )
    named = stored(firsts.select("n", "f1", "f2", F.col("first.row").alias("class"), F.col("first.head").alias("doc_id"), "smallest", "rows"), "named")
    registers = sketches.select(F.col("row").alias("class"), "bands", "odd")
    classes = stored(named.select("class", "doc_id", "n", "f1", "f2").join(registers, "class"), "classes")

    live = stored(live_bands(classes), "live")
    hubs = stored(likely_pairs(hub_pairs(live, percent), classes, percent), "candidates")
    links = stored(verified(hubs, classes, texts, size, percent), "links")
    candidates = stored(open_pairs(live, classes, components(links), percent, block), "candidates")
    more = verified(candidates, classes, texts, size, percent)
    roots = components(links.union(more)).withColumnRenamed("node", "class")

    rooted = stored(named.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    found = join_unique(rooted.select("n", "f1", "f2", "root", F.col("rows").alias("copies")), stored(lowest, "lowest"), ["root"])
    by_set = stored(found.select("n", "f1", "f2", "component_id", F.col("copies").alias("rows")), "by-set")
    linked = join_unique(worded.select("doc_id", "n", "f1", "f2"), by_set, ["n", "f1", "f2"]).select("doc_id", "n", "component_id")
    every = linked.union(sketches.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
