"""Confirm candidate pairs on whole shingle sets, recomputed from the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.fetch import texts_for
from wayfare.llm.lean import lean
from wayfare.llm.shingles import shingle_sets
from wayfare.llm.subwords import mixed

# Pairs of one class that a task verifies together.
PORTION = 500
_SEEDS = (0x1234567, 0x89ABCDE)


def digest(shingles: np.ndarray, seed: int) -> int:
    """A 64-bit fingerprint of a set."""
    total = mixed(shingles ^ np.uint64(seed)).sum(dtype=np.uint64, keepdims=True)
    return int((total * np.uint64(2) + np.uint64(seed)).view(np.int64)[0])


def set_digests(shingles: np.ndarray) -> tuple[int, int]:
    return digest(shingles, _SEEDS[0]), digest(shingles, _SEEDS[1])


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` of classes whose sets reach the threshold; ``classes(class, doc_id, f1, f2)`` names a text of each.

    Pairs meet by their first class, in portions of ``PORTION`` pairs, so that one class with very many pairs is dealt to
    many tasks. A task streams each portion: the first class's text, then the others', and holds one set at a time.
    """
    portions = F.ceil(F.col("n_pairs") / F.lit(PORTION))
    counted = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n_pairs"))
    dealt = pairs.join(counted, "a").withColumn("portion", F.pmod(F.xxhash64("b"), portions))
    heads = dealt.select("a", "portion", F.col("a").alias("class")).distinct()
    roles = dealt.select("a", "portion", F.col("b").alias("class")).union(heads)
    wanted = roles.join(classes, "class").select("a", "portion", "class", F.col("doc_id").alias("of"), "f1", "f2")
    found = texts_for(texts, wanted).select("a", "portion", "class", "f1", "f2", "text")
    ordered = found.repartition("a", "portion").sortWithinPartitions("a", "portion", F.col("class") != F.col("a"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, head = None, None
        for batch in batches:
            links = []
            for (a, portion, own_class, f1, f2), own in zip(
                zip(*(batch.column(i).to_pylist() for i in range(5))), shingle_sets(batch.column(5), size)
            ):
                if set_digests(own) != (f1, f2):
                    continue  # another text under the same doc_id
                if own_class == a:
                    of, head = (a, portion), own
                elif of == (a, portion):
                    shared = len(np.intersect1d(head, own, assume_unique=True))
                    if 100 * shared >= percent * (len(head) + len(own) - shared):
                        links.append((a, own_class))
            columns = list(zip(*links)) or [(), ()]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return ordered.mapInArrow(lean(compare), "a long, b long").distinct()
