"""Benchmark items found inside documents by size-partitioned MinHash containment search, verified exactly.

A short item resembles a long document little, so containment is searched among pieces of comparable size. Items are
partitioned by the size of their shingle sets (powers of two). For a partition of sizes up to s, a document is read as
overlapping windows of 2s shingles every s: one of them holds the whole of any passage of up to s shingles. A window's and
an item's MinHash values agree, each with the chance of their resemblance; the containment asked and the largest window make
that at least ``least_resemblance``, and ``HASHES`` values of one row a band miss a passage with a chance of
(1 - resemblance)^HASHES: at most 0.01 % for a verbatim one, 0.3 % for one that just reaches 75 %. Each (document, item) that agrees in any value is a candidate,
and is reported if the document's whole shingle set holds at least ``percent`` of the item's.

Items are shingled and signed in tasks and stored. They are searched in blocks of at most ``ITEMS_PER_BLOCK``, each collected as it is stored and
broadcast to one pass over the documents without a shuffle; what a block holds is bounded by ``SHINGLES_PER_BLOCK``. Skew does not matter to a pass:
documents stay where they are.

Documents and items without words match nothing. An item or document of fewer words than a shingle is one shingle, its whole
sequence. NULL ids are kept. Repeated documents are each reported; repeated rows of one item are one item; items of one id with
different texts are told apart and give rows of their own. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.lean import lean
from wayfare.llm.shingles import shingle_hashes, shingle_sets, sliced, slices, word_hashes
from wayfare.llm.subwords import mixed
from wayfare.sources.sinks import stored

SHINGLE_WORDS = 5
PERCENT = 75
HASHES = 32
ITEMS_PER_BLOCK = 50_000
SHINGLES_PER_BLOCK = 5_000_000
_SEEDS = np.random.default_rng(0xBE7C).integers(1, 2**63, HASHES, dtype=np.uint64)


class Item(NamedTuple):
    item_id: int | None
    shingles: np.ndarray  # sorted and distinct
    signature: np.ndarray


def least_resemblance(size: int, window: int, percent: int) -> float:
    """The least Jaccard resemblance of an item of ``size`` shingles and a window that holds ``percent`` of them."""
    held = percent * size / 100
    return held / (size + window - held)


def _class_of(size: int) -> int:
    return 1 << max(size - 1, 0).bit_length()


def signature(shingles: np.ndarray) -> np.ndarray:
    """The ``HASHES`` MinHash values of a non-empty set."""
    return np.array([mixed(shingles ^ seed).min() for seed in _SEEDS])


class ItemIndex:
    """The items of a block: exact sets and, for each size class, MinHash values by hash function."""

    def __init__(self, items: list[Item]):
        self.ids = [item.item_id for item in items]
        self.sets = sets = [item.shingles for item in items]
        signed = np.array([item.signature for item in items])
        classes = np.array([_class_of(len(s)) for s in sets])
        self.by_class: dict[int, tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = {}
        for size in np.unique(classes):
            members = np.flatnonzero(classes == size)
            signatures = signed[members]
            tables = []
            for k in range(HASHES):
                order = np.argsort(signatures[:, k], kind="stable")
                tables.append((signatures[order, k], members[order]))
            self.by_class[int(size)] = (members, tables)

    def candidates(self, shingles: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs that agree in a MinHash value, for documents' shingles laid end to end."""
        found: set[tuple[int, int]] = set()
        if not len(shingles):
            return found
        ends = np.cumsum(counts)
        begins = ends - counts
        for k, seed in enumerate(_SEEDS):
            values = mixed(shingles ^ seed)
            for size, (_, tables) in self.by_class.items():
                # minima of blocks of `size` shingles; a window is a block and the next one of its document
                per = -(-counts // size)
                owner = np.repeat(np.arange(len(counts)), per)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
                lows = np.minimum.reduceat(values, begins[owner] + nth * size)
                follows = np.append(owner[1:] == owner[:-1], False)
                lows[:-1] = np.where(follows[:-1], np.minimum(lows[:-1], lows[1:]), lows[:-1])
                known, items = tables[k]
                first = np.searchsorted(known, lows, side="left")
                last = np.searchsorted(known, lows, side="right")
                for at in np.flatnonzero(last > first):
                    found.update((int(owner[at]), int(item)) for item in items[first[at] : last[at]])
        return found


_FOUND = "doc_id long, item_id long, n_shared long, n_item long"


def contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) for every document that holds at least ``percent`` of an item's shingles."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = texts.sparkSession.createDataFrame([], _FOUND)
    for block in item_blocks(benchmark, size):
        out = out.union(_search(texts, block, size, percent))
    return out


def signed_items(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, shingles, signature) of the items with words, the last two as bytes of 64-bit integers."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in sliced(batch, 1)):
            rows = [(i.as_py(), s.tobytes(), signature(s).tobytes()) for i, s in zip(part.column(0), shingle_sets(part.column(1), size)) if len(s)]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], names=["item_id", "shingles", "signature"]
            )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return rows.mapInArrow(lean(sign), "item_id long, shingles binary, signature binary")


def item_blocks(benchmark: DataFrame, size: int) -> Iterator[list[Item]]:
    """The items, signed by tasks, block by block; the driver holds one block at a time."""
    block, held = [], 0
    for row in stored(signed_items(benchmark, size), "items").toLocalIterator():
        item = Item(row["item_id"], *(np.frombuffer(row[c], np.uint64) for c in ("shingles", "signature")))
        if block and (len(block) >= ITEMS_PER_BLOCK or held + len(item.shingles) > SHINGLES_PER_BLOCK):
            yield block
            block, held = [], 0
        block.append(item)
        held += len(item.shingles)
    if block:
        yield block


def _hits(column: pa.Array, index: ItemIndex, size: int, percent: int) -> Iterator[tuple[int, int, int]]:
    """(text, item, shared shingles) of the texts that hold ``percent`` of an item, in order of text and item."""
    for first, rows in slices(column):
        shingles, counts = shingle_hashes(*word_hashes(rows, lower=True), size)
        worded = np.flatnonzero(counts)
        begins = np.cumsum(counts) - counts
        held: dict[int, np.ndarray] = {}
        for doc, item in sorted(index.candidates(shingles, counts[worded])):
            at = int(worded[doc])
            if at not in held:
                held = {at: np.unique(shingles[begins[at] : begins[at] + counts[at]])}
            n = len(np.intersect1d(held[at], index.sets[item], assume_unique=True))
            if 100 * n >= percent * len(index.sets[item]):
                yield first + at, item, n


def _search(texts: DataFrame, block: list[Item], size: int, percent: int) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(ItemIndex(block))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            docs = batch.column(0)
            out = [(docs[at].as_py(), index.ids[i], n, len(index.sets[i])) for at, i, n in _hits(batch.column(1), index, size, percent)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_shared", "n_item"])

    return texts.select("doc_id", "text").mapInArrow(lean(search), _FOUND)


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, text: str = "text"
) -> DataFrame:
    """``docs`` without those that hold at least ``percent`` of an item's shingles, one pass a block of items."""
    place = docs.columns.index(text)
    for block in item_blocks(benchmark, size):
        shared = docs.sparkSession.sparkContext.broadcast(ItemIndex(block))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[at for at, _, _ in _hits(batch.column(place), shared.value, size, percent)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(lean(keep), docs.schema)
    return docs
