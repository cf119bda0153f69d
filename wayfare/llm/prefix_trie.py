"""The trie of conversations' turn prefixes, from vertical bitmaps.

A node is a distinct sequence of the first d turns; its members are the conversations that start with it.

1. Places: turns get their rank in their conversation by :func:`~wayfare.llm.ranking.ranked`, each a 128-bit fingerprint of role
   and text with the text's bytes; no text is shuffled.
2. Shards: conversations, by id, go to shards of ``SHARD`` neighbours, and each is cut into bands of ``BAND`` turns. A task holds one
   band of one shard, however many conversations share a prefix and however long one of them is. What comes before a band is known
   by the fingerprint of the prefix, from one row a band, streamed in order.
3. Vertical bitmaps: in a shard's band, (position, turn) -> the bitset of the conversations with that turn there. A node's bitset is its
   parent's intersected with a posting, depth first; the lowest conversation still without a child names the next posting, so there
   are as many intersections as nodes. Shards report bitsets and the ids that end at the node.
4. Nodes of equal fingerprint merge over shards with partial aggregation. Shards hold ascending ids, so that a node's list of ends is hashed
   as a stream over shards, whatever its length.
5. Sums over subtrees need no walk. The smallest member of a node owns it; the owned nodes of a conversation are the tail of its path.
   Leaves below a node are its members that own one. Each text below that more than one conversation has counts once for every member but the owner:
   so for each member but the smallest, the bytes that it shares with smaller ones beyond this node's parent. A second pass
   over the stored bitsets adds both up.

Rows with a NULL conversation id belong to no conversation and are not read. NULL roles and texts are empty ones. Turns of equal number are ordered by their
fingerprints; a NULL number comes first. A conversation without turns is a member of the root. No conversations, no rows. Columns not named
are not read. Fingerprints of different prefixes agree with a chance of 2^-128 a pair.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.ranking import ranked
from wayfare.sources.sinks import stored

SHARD = 1024
BAND = 256
_BYTES = 16
_ROOT = bytes(_BYTES)
# Rows of a result batch.
_ROWS = 20_000


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, mark, size): turns by their place in the conversation, as fingerprint and bytes of text."""
    said, by = (F.coalesce(F.col(c), F.lit("")) for c in (text, role))
    whole = F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said)
    mark = F.substring(F.unhex(F.sha2(whole, 256)), F.lit(1), F.lit(_BYTES))
    marked = conversations.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), mark.alias("mark"), F.octet_length(said).cast("long").alias("size")
    )
    narrow = stored(marked.filter("conv_id IS NOT NULL"), "turns")
    return ranked(narrow, ["conv_id"], ["turn", "mark"], "place").select("conv_id", "place", "mark", "size")


def spliced(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """``turns`` anew by ``plan(conv_id, base, keep)``: the first ``keep`` turns of ``base``, then a conversation's own after its first ``keep``."""
    lengths = turns.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("n"))
    lent = plan.join(lengths, "base", "left").withColumn("taken", F.least("keep", F.coalesce("n", F.lit(0)))).select("conv_id", "base", "keep", "taken")
    first = turns.withColumnRenamed("conv_id", "of").join(lent, (F.col("of") == F.col("base")) & (F.col("place") < F.col("keep")))
    rest = turns.join(lent, "conv_id").filter(F.col("place") >= F.col("keep"))
    moved = rest.withColumn("place", F.col("place") - F.col("keep") + F.col("taken"))
    return first.select("conv_id", "place", "mark", "size").unionByName(moved.select("conv_id", "place", "mark", "size"))


def _hash(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(left + right).digest()[:_BYTES]


def _banded(turns: DataFrame, conversations: DataFrame, shard: int, band: int) -> DataFrame:
    """(shard, slot, conv_id, band, last, marks, sizes): a row for each band of each conversation, one at least."""
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    numbered = ranked(stored(conversations.select("conv_id").distinct(), "conversations"), [], ["conv_id"]).join(lengths, "conv_id", "left")
    whole = turns.groupBy("conv_id", F.expr(f"place div {band}").alias("band")).agg(
        F.sort_array(F.collect_list(F.struct("place", "mark", "size"))).alias("turns")  # `band` at most
    )
    met = numbered.join(whole, "conv_id", "left").withColumn("band", F.coalesce("band", F.lit(0).cast("long")))
    none = F.array().cast("array<struct<place: long, mark: binary, size: long>>")
    held = F.coalesce("turns", none)
    return met.select(
        F.expr(f"rank div {shard}").alias("shard"),
        F.expr(f"rank % {shard}").cast("int").alias("slot"),
        "conv_id",
        "band",
        (F.coalesce("n", F.lit(0)) <= (F.col("band") + 1) * band).alias("last"),
        F.transform(held, lambda t: t["mark"]).alias("marks"),
        F.transform(held, lambda t: t["size"]).alias("sizes"),
    )


def _starts(bands: DataFrame) -> DataFrame:
    """(conv_id, band, prefix, before): for bands after the first, the prefix that they continue and its bytes."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chains = []
            for marks in batch.column(2):
                chain = b""
                for mark in marks:
                    chain = _hash(chain, mark.as_py())
                chains.append(chain)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(chains, pa.binary()), batch.column(3)], names=["conv_id", "band", "chain", "bytes"])

    full = bands.filter("NOT last").select("conv_id", "band", "marks", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("bytes"))
    digests = full.mapInArrow(summed, "conv_id long, band long, chain binary, bytes long")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, prefix, before = None, _ROOT, 0
        for batch in batches:
            rows = []
            for conv, band, chain, size in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != of:
                    of, prefix, before = conv, _ROOT, 0
                prefix, before = _hash(prefix, chain), before + size
                rows.append((conv, band + 1, prefix, before))
            yield _batch(rows, _START)

    return digests.repartition("conv_id").sortWithinPartitions("conv_id", "band").mapInArrow(chained, "conv_id long, band long, prefix binary, before long")


_START = pa.schema([("conv_id", pa.int64()), ("band", pa.int64()), ("prefix", pa.binary()), ("before", pa.int64())])
_PARTIAL = pa.schema(
    [
        ("shard", pa.int64()), ("band", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("before", pa.int64()),
        ("conv_id", pa.int64()), ("n", pa.int64()), ("low", pa.int32()), ("bits", pa.binary()), ("ends", pa.string()),
    ]
)
_SUMMED = pa.schema(
    [("node", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("leaves", pa.int64()), ("shared", pa.int64()), ("own_shared", pa.int64())]
)
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def _members(bits: int) -> Iterator[int]:
    while bits:
        yield _lowest(bits)
        bits &= bits - 1


def shard_nodes(shard: int, band: int, width: int, rows: list[tuple]) -> Iterator[tuple]:
    """The nodes of one band of one shard, from its (slot, conv_id, last, marks, sizes, prefix, before)."""
    postings: dict[tuple[int, bytes], int] = defaultdict(int)
    lengths: dict[int, int] = defaultdict(int)
    ends: dict[int, int] = defaultdict(int)
    starts: dict[bytes, int] = defaultdict(int)
    by_slot = {}
    for slot, conv, last, marks, sizes, prefix, before in rows:
        bit = 1 << slot
        by_slot[slot] = (conv, marks, sizes, before)
        for place, mark in enumerate(marks):
            postings[place, mark] |= bit
        lengths[len(marks)] |= bit
        if last:
            ends[len(marks)] |= bit
        starts[prefix] |= bit

    def node(bits: int, name: bytes, parent: bytes | None, place: int, before: int) -> tuple:
        low, over = _lowest(bits), bits & ends[place]
        packed = bits >> low
        return (
            shard, band, name, parent, band * width + place, before, by_slot[low][0], bits.bit_count(), low,
            packed.to_bytes((packed.bit_length() + 7) // 8, "little"),
            ",".join(str(by_slot[slot][0]) for slot in _members(over)) if over else None,
        )

    for prefix, members in starts.items():
        if band == 0:
            yield node(members, prefix, None, 0, 0)
        open_nodes = [(members, 0, b"", prefix, by_slot[_lowest(members)][3])]
        while open_nodes:
            bits, place, chain, name, through = open_nodes.pop()
            rest = bits & ~lengths[place]
            while rest:
                _, marks, sizes, _ = by_slot[_lowest(rest)]
                child = bits & postings[place, marks[place]]
                rest &= ~child
                longer = _hash(chain, marks[place])
                below = _hash(prefix, longer)
                yield node(child, below, name, place + 1, through)
                open_nodes.append((child, place + 1, longer, below, through + sizes[place]))


def _partials(bands: DataFrame, width: int) -> DataFrame:
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, out = None, [], []

        def done() -> Iterator[tuple]:
            return shard_nodes(*of, width, held) if held else iter(())

        for batch in batches:
            for shard, band, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, band) != of:
                    for made in done():
                        out.append(made)
                        if len(out) >= _ROWS:
                            yield _batch(out, _PARTIAL)
                            out = []
                    of, held = (shard, band), []
                held.append(row)
        for made in done():
            out.append(made)
            if len(out) >= _ROWS:
                yield _batch(out, _PARTIAL)
                out = []
        yield _batch(out, _PARTIAL)

    dealt = bands.select("shard", "band", "slot", "conv_id", "last", "marks", "sizes", "prefix", "before")
    return dealt.repartition("shard", "band").sortWithinPartitions("shard", "band", "slot").mapInArrow(grow, _ddl(_PARTIAL))


def _summed(partials: DataFrame, weights: DataFrame, shard: int) -> DataFrame:
    """Per partial node its members' weights added up; ``weights(shard, band, slot, shared, leaf)`` of a band come before its nodes."""
    nothing = {"node": "binary", "conv_id": "long", "n": "long", "low": "int", "bits": "binary"}
    heads = weights.select("shard", "band", F.lit(0).alias("kind"), "slot", "shared", "leaf", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    own = {"slot": "int", "shared": "long", "leaf": "int"}
    nodes = partials.select("shard", "band", F.lit(1).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in own.items()], *nothing)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        for batch in batches:
            out = []
            for number, band, kind, slot, value, is_leaf, node, conv, n, low, bits in zip(*(c.to_pylist() for c in batch.columns)):
                if (number, band) != of:
                    of, shared, leaf = (number, band), np.zeros(shard, np.int64), np.zeros(shard, np.int64)
                if kind == 0:
                    shared[slot], leaf[slot] = value, is_leaf
                elif n == 1:
                    out.append((node, conv, n, int(leaf[low]), int(shared[low]), int(shared[low])))
                else:
                    at = low + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
                    out.append((node, conv, n, int(leaf[at].sum()), int(shared[at].sum()), int(shared[low])))
            yield _batch(out, _SUMMED)

    dealt = heads.union(nodes).repartition("shard", "band").sortWithinPartitions("shard", "band", "kind")
    return dealt.mapInArrow(add, _ddl(_SUMMED))


def _ends_digests(partials: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end, each node's ids streamed shard by shard."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = None, None
        for batch in batches:
            out = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if node != of:
                    if of is not None:
                        out.append((of, state.hexdigest()))
                    of, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield _batch(out, _ENDS)
        yield _batch([(of, state.hexdigest())] if of is not None else [], _ENDS)

    chunks = partials.filter("ends IS NOT NULL").select("node", "shard", "ends")
    return chunks.repartition("node").sortWithinPartitions("node", "shard").mapInArrow(digest, "node binary, ends_sha256 string")


_ENDS = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])


def prefix_trie(turns: DataFrame, conversations: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """Per node of the trie of ``turns(conv_id, place, mark, size)``, places gapless from 0, over ``conversations(conv_id)``:

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of texts that further members
    repeat, over the subtree), ends_sha256 (of the members that end here).
    """
    cut = stored(_banded(turns, conversations, shard, band), "bands")
    starts = stored(_starts(cut), "starts")
    begun = cut.join(starts, ["conv_id", "band"], "left").withColumns(
        {"prefix": F.coalesce("prefix", F.lit(_ROOT)), "before": F.coalesce("before", F.lit(0).cast("long"))}
    )
    partials = stored(_partials(begun, band), "partials")
    merged = partials.groupBy("node").agg(*[F.min(c).alias(c) for c in ("parent", "depth", "before", "conv_id")])
    children = merged.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(merged.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    owners = nodes.groupBy("conv_id").agg(F.min_by("before", "depth").alias("shared"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    total = F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))
    weighed = cut.groupBy("conv_id").agg(total.alias("total")).join(owners, "conv_id", "left")
    weights = weighed.select("conv_id", F.coalesce("shared", "total").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    summed = _summed(partials, cut.select("shard", "band", "slot", "conv_id").join(weights, "conv_id"), shard)
    sums = summed.groupBy("node").agg(
        F.sum("n").alias("n_convs"), F.sum("leaves").alias("n_leaves"), F.sum("shared").alias("shared"), F.min_by("own_shared", "conv_id").alias("own_shared")
    )
    # The root is every first turn's parent: its smallest member is known without the join.
    parent = F.when(F.col("depth") > 1, F.col("parent")).otherwise(F.col("node"))
    above = nodes.select(F.col("node").alias("of"), F.col("conv_id").alias("above"))
    first = nodes.agg(F.min("conv_id")).scalar()
    placed = nodes.join(sums, "node").join(above, parent == F.col("of")).join(_ends_digests(partials), "node", "left")
    parent_conv = F.when(F.col("depth") > 1, F.col("above")).when(F.col("depth") == 1, first)
    saved = F.col("shared") - F.col("own_shared") - (F.col("n_convs") - 1) * F.col("before")
    no_ends = hashlib.sha256(b"").hexdigest()
    return placed.select(
        "conv_id", "depth", parent_conv.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(no_ends)).alias("ends_sha256"),
    )
