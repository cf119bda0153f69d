"""Merkle manifest of a dataset: a content-addressed DAG of digests, and inclusion proofs by descent.

Leaves are digests of rows. The rows of a source, by doc_id, are the leaves of its tree; the sources' roots, by source, are
the leaves of the dataset's. Every 16 consecutive nodes (the last run may be shorter, even one) become their digest, level by
level, while a tree has more than one node.

1. Places: rows get their rank in their source, sources theirs among the sources, by :func:`~wayfare.llm.ranking.ranked`.
2. Store: per height one table of records, digest -> its children's digests end to end, unique by digest. A run has 16 children
   at most, so no group grows with the data.
3. Proofs: a request names a leaf by tree and rank. Requests start at the dataset's root and descend: at each height the next
   base-16 digit of the rank selects a child of the record found by digest, and the children not selected are collected as a
   path segment. Requests with the same leading digits take the same steps, so they travel as one row until they part: the root
   is not a hot key, and 16 leaves share the segments above their run. Arrived, a leaf's segments are reversed: leaf to root.

All lookups are equi-joins on digests or on (tree, prefix), whose keys are even whatever share of the rows one source holds.
Only counts of levels come to the driver.

A NULL in a hashed column is written ``-``, other than the empty string ``0:``. A NULL source is a source of its own, the first;
NULL doc_ids come first in their source. Rows of equal doc_id are ordered by their digests; rows equal in all hashed columns are
interchangeable, and all are returned. An empty table has no root and gives no rows. Columns not named are not read.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.ranking import ranked
from wayfare.sources.sinks import stored

# The columns of a leaf in hashing order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 4  # of a rank's digit: 16 children
WIDTH = 32  # bytes of a digest


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(values: list[Column]) -> Column:
    """The digest of a row: each value as UTF-8 byte count, ``:`` and value, or ``-`` for NULL, one after the other."""
    texts = [v.cast("string") for v in values]
    written = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return _hash(F.concat(*written))


class Forest(NamedTuple):
    """Trees over ranked digests."""

    records: list[DataFrame]  # by height from 1: (digest, run), unique by digest
    tops: DataFrame  # (tree, n, digest, height) of every tree


def forest(leaves: DataFrame, largest: int) -> Forest:
    """The trees of ``leaves(tree, n, rank, digest)``, where a tree has ``n`` leaves, ``largest`` at most.

    A tree of n leaves has more than one node at height h while n > 16^h.
    """
    nodes, records, tops, height = leaves, [], [], 0
    while True:
        reached = 1 << BITS * height
        tops.append(nodes.filter(F.col("n") <= reached).select("tree", "n", "digest", F.lit(height).alias("height")))
        if largest <= reached:
            return Forest(records, reduce(DataFrame.union, tops))
        runs = nodes.filter(F.col("n") > reached).groupBy("tree", "n", F.shiftright("rank", BITS).alias("rank"))
        run = F.sort_array(F.collect_list(F.struct("rank", "digest")))  # 16 at most
        built = runs.agg(F.aggregate(run, F.lit(b""), lambda done, x: F.concat(done, x["digest"])).alias("run"))
        parents = stored(built.withColumn("digest", _hash(_hex(F.col("run")))), "merkle")
        records.append(parents.select("digest", "run").dropDuplicates(["digest"]))
        nodes, height = parents.select("tree", "n", "rank", "digest"), height + 1


def _segment(run: Column, place: Column) -> Column:
    """What stands left and right of the selected child."""
    left = F.substring(run, F.lit(1), place * WIDTH)
    right = F.substring(run, (place + 1) * WIDTH + 1, F.length(run))
    return F.struct(left.alias("left"), right.alias("right"))


def descend(frontier: DataFrame, records: list[DataFrame], wanted: DataFrame, until: int) -> DataFrame:
    """Move ``frontier(tree, prefix, digest, height, path, ...)`` down to nodes of height ``until`` or less.

    ``wanted(tree, rank)`` holds the requested nodes of height ``until``; only nodes above one of them are entered. Other
    columns ride along.
    """
    riding = [c for c in frontier.columns if c not in ("tree", "prefix", "digest", "height", "path")]
    for height in range(len(records), until, -1):
        record = records[height - 1].withColumnRenamed("digest", "of")
        met = frontier.filter(F.col("height") == height).join(record, F.col("digest") == F.col("of"))
        places = F.sequence(F.lit(0), (F.length("run") / WIDTH).cast("int") - 1)
        below = met.withColumn("place", F.explode(places)).select(
            "tree",
            (F.shiftleft("prefix", BITS) + F.col("place")).alias("prefix"),
            F.substring("run", F.col("place") * WIDTH + 1, F.lit(WIDTH)).alias("digest"),
            F.lit(height - 1).alias("height"),
            F.concat("path", F.array(_segment(F.col("run"), F.col("place")))).alias("path"),
            *riding,
        )
        above = F.shiftright("rank", BITS * (height - 1 - until)).alias("prefix")
        asked = wanted.select("tree", above).distinct()
        frontier = frontier.filter(F.col("height") < height).unionByName(below.join(asked, ["tree", "prefix"], "left_semi"))
    return frontier


class Manifest(NamedTuple):
    """A dataset's digests: ``leaves(tree, n, rank, ...)``, its sources' trees and the tree over their roots."""

    leaves: DataFrame
    trees: Forest
    top: Forest


def build_manifest(rows: DataFrame, source: str = "source", key: str = "doc_id", leaf: str = "leaf") -> Manifest:
    """The manifest of ``rows``, which hold their leaf digests as binary; other columns stay with the leaves."""
    placed = ranked(rows, [source], [key, leaf])
    sizes = stored(rows.groupBy(source).agg(F.count(F.lit(1)).alias("n")), "sources")
    numbered = stored(ranked(sizes, [], [source], "tree"), "sources").alias("s")
    same = F.col(f"p.{source}").eqNullSafe(F.col(f"s.{source}"))
    leaves = stored(placed.alias("p").join(numbered, same).select("tree", "n", *[F.col(f"p.{c}") for c in placed.columns]), "leaves")
    sources, largest = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    trees = forest(leaves.select("tree", "n", "rank", F.col(leaf).alias("digest")), largest or 0)
    zero, count = F.lit(0).cast("long").alias("tree"), F.lit(sources).cast("long").alias("n")
    roots = stored(trees.tops.select(zero, count, F.col("tree").alias("rank"), "digest"), "subroots")
    return Manifest(leaves, trees, forest(roots, sources))


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """``requests(tree, rank, ...)``, which name each leaf once at most, with ``subroot``, ``root`` and ``proof``.

    ``proof`` lists the siblings left and right, digests end to end, from the leaf's level to the root's.
    """
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<struct<left: binary, right: binary>>")
    asked = [c for c in requests.columns if c not in ("tree", "rank")]
    run = requests.groupBy("tree", F.shiftright("rank", BITS).alias("prefix"))
    members = stored(run.agg(F.collect_list(F.struct("rank", *asked)).alias("members")), "requests")  # 16 at most
    runs = members.select("tree", F.col("prefix").alias("rank"))
    trees = runs.select(zero.alias("tree"), F.col("tree").alias("rank")).distinct()
    start = manifest.top.tops.select("tree", zero.alias("prefix"), "digest", "height", none.alias("path"), F.col("digest").alias("root"))
    sources = descend(start, manifest.top.records, trees, 0).select(F.col("prefix").alias("of"), "path", "root")
    entered = manifest.trees.tops.join(sources, F.col("tree") == F.col("of")).select(
        "tree", zero.alias("prefix"), "digest", "height", "path", "root", F.col("digest").alias("subroot")
    )
    reached = descend(entered, manifest.trees.records, runs, 1)  # at runs, and at leaves alone in their tree
    last = (manifest.trees.records or [entered.select("digest", F.lit(b"").alias("run")).limit(0)])[0]
    opened = reached.join(last.withColumnRenamed("digest", "of"), F.col("digest") == F.col("of"), "left")
    arrived = opened.select("tree", "prefix", "root", "subroot", "run", F.reverse("path").alias("above")).join(members, ["tree", "prefix"])
    each = arrived.withColumn("member", F.explode("members"))
    digit = (F.col("member.rank") - F.shiftleft("prefix", BITS)).cast("int")
    own = F.when(F.col("run").isNull(), none).otherwise(F.array(_segment(F.col("run"), digit)))
    return each.select("tree", "member.*", "subroot", "root", F.concat(own, F.col("above")).alias("proof"))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings, leaf to root, left to right; that of the empty string if there are none."""
    return _hash(F.array_join(F.transform(proof, lambda s: _hex(F.concat(s["left"], s["right"]))), ""))


def folded(leaf: Column, proof: Column) -> Column:
    """The root, in hex, that ``leaf`` and the siblings of ``proof`` give."""
    return F.aggregate(proof, _hex(leaf), lambda node, s: F.sha2(F.concat(_hex(s["left"]), node, _hex(s["right"])), 256))


def verify_documents(docs: DataFrame, tampered: Column, changed: Column) -> DataFrame:
    """Prove every document against the manifest of ``docs``, with ``changed`` in the place of the text where ``tampered``.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root (hex digests) and whether that equals the root.
    """
    own = [F.col(c) for c in LEAF_COLUMNS]
    altered = F.when(tampered, leaf_digest([*own[:-1], changed]))
    hashed = docs.select("doc_id", "source", leaf_digest(own).alias("leaf"), altered.alias("altered"))
    manifest = build_manifest(stored(hashed, "hashed"))
    proofs = prove(manifest, manifest.leaves.select("tree", "rank", "doc_id", "leaf", "altered"))
    judged = proofs.select(
        "doc_id",
        *[_hex(F.col(name)).alias(name) for name in ("leaf", "subroot", "root")],
        _hex(proof_digest(F.col("proof"))).alias("proof_sha256"),
        folded(F.coalesce("altered", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return judged.withColumn("verified", F.col("folded_root") == F.col("root"))
