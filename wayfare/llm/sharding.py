"""Shards by a hierarchical weighted hash tree, native DataFrame expressions only.

A tree has regions, racks and shards, each leaf with a weight; an inner node weighs what its
leaves weigh. A key descends level by level: every child of the current node draws an
exponential variate, ``-ln(u) / weight`` with ``u`` a hash of key and child, and the smallest
draw wins. A child is thus chosen in proportion to its weight, and since a draw depends only on
the child's own name and weight, changing one weight moves keys into or out of that child's
subtree and nowhere else. :func:`grown` opens a new shard in a region of its own: no other
node's weight changes, so rows move only into the new shard.

Nulls, ties and repeats: a null key is a key of its own (one shard); equal draws go to the child
listed first; repeated rows get the same shard and different slots. Empty tables give empty results.
Only the columns named are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.sources.sinks import stored

# region -> rack -> shard number -> weight
Tree = dict[str, dict[str, dict[int, float]]]

_DRAW_BITS = 52


def even_tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2) -> Tree:
    """A tree of equal leaves, filled rack by rack and region by region.

    To add a shard to data that is sharded by it, use :func:`grown`: a larger even tree also moves rows between the old shards.
    """
    if shards < 1:
        raise ValueError("a tree needs at least one shard")
    tree: Tree = {}
    for shard in range(shards):
        rack = shard // shards_per_rack
        region = rack // racks_per_region
        tree.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
    return tree


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """``tree`` with the next shard number in a rack and region of its own."""
    new = 1 + max(s for racks in tree.values() for leaves in racks.values() for s in leaves)
    return tree | {f"region+{new}": {f"rack+{new}": {new: weight}}}


def _draw(key: Column, node: str, weight: float) -> Column:
    digest = F.md5(F.concat(key, F.lit(f"/{node}")))
    bits = F.conv(F.substring(digest, 1, _DRAW_BITS // 4), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(2**_DRAW_BITS)) / weight


def _winner(key: Column, weights: dict[str, float]) -> Column:
    """The place, among the names of ``weights``, of the smallest draw."""
    if len(weights) == 1:
        return F.lit(0)
    draws = [F.struct(_draw(key, name, w), F.lit(i)) for i, (name, w) in enumerate(weights.items())]
    return F.least(*draws)["col2"]


def _branch(place: Column, options: list[Column]) -> Column:
    out = options[-1]
    for i in reversed(range(len(options) - 1)):
        out = F.when(place == i, options[i]).otherwise(out)
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard number (int) of ``key`` by descent through ``tree``."""
    text = F.coalesce(key.cast("string"), F.lit("\0null"))

    def total(racks: dict[str, dict[int, float]]) -> float:
        return sum(w for leaves in racks.values() for w in leaves.values())

    regions = []
    for region, racks in tree.items():
        chosen = []
        for rack, leaves in racks.items():
            names = {f"{region}/{rack}/{shard}": w for shard, w in leaves.items()}
            chosen.append(_branch(_winner(text, names), [F.lit(s) for s in leaves]))
        weights = {f"{region}/{rack}": sum(leaves.values()) for rack, leaves in racks.items()}
        regions.append(_branch(_winner(text, weights), chosen))
    root = _winner(text, {region: total(racks) for region, racks in tree.items()})
    return _branch(root, regions).cast("int")


def with_slots(placed: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    The rows are stored with the number of the task that made them as their block. Blocks are
    counted, a running sum over the (shard, block) counts gives each block its first number,
    and rows are numbered within their block: no task sees more than one block of a shard,
    whatever key is hot.
    """
    block, first = f"__{slot}_block", f"__{slot}_first"
    columns = placed.columns
    rows = stored(placed.withColumn(block, F.spark_partition_id()), "shards")
    counts = rows.groupBy(shard, block).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(shard).alias("__shard"),
        F.col(block).alias("__block"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(first),
    )
    within = Window.partitionBy(shard, block).orderBy(*[c for c in columns if c != shard])
    numbered = rows.withColumn(slot, F.row_number().over(within).cast("long") - 1)
    joined = numbered.join(
        starts, (F.col(shard) == F.col("__shard")) & (F.col(block) == F.col("__block"))
    )
    return joined.select(*columns, (F.col(slot) + F.col(first)).alias(slot))


def shard_documents(docs: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``law``, ``shard``,
    ``slot`` and ``grown_shard``, its shard in :func:`grown`'s tree. A null text has size 1."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    placed = docs.select(
        F.col(key),
        (F.length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), tree).alias("shard"),
        shard_of(F.col(key), grown(tree)).alias("grown_shard"),
    )
    slotted = with_slots(placed)
    return slotted.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, tree: Tree, path: str, key: str = "doc_id") -> None:
    """Write whole documents as Parquet, one folder per shard."""
    docs.withColumn("shard", shard_of(F.col(key), tree)).hint("rebalance", F.col("shard")).write.partitionBy(
        "shard"
    ).parquet(path)
