"""Near-duplicate documents by a grouped prefix join on word shingles, exact at the threshold.

Shingles have one global order, frequent ones last. Two sets as similar as asked share a shingle among the first few of
each (their prefixes), so documents meet by prefix shingle only:

1. Documents with equal sets collapse into one class, classes with equal size and prefix into one group. Only groups send their
   prefixes through the shuffle, and only shingles that two groups share go on.
2. Each group is held against one hub, the group that is the smallest of most of its shingles: the head of the hub against all
   classes of the group, and its own head against its other classes. Large sets of near copies take few comparisons by that, not all pairs.
3. Shingles whose groups are then still in different components are joined in full. Group pairs go on only if their sizes and the shingle's
   place in both sets allow the threshold; a shingle of many groups becomes pairs of blocks of ``BLOCK`` groups, dealt to
   tasks, which compare in numpy and give distinct pairs only.
4. The group pairs that are left expand to pairs of their classes. Those go on if the distance of their sets' odd sketches
   (parity bits; they can differ in no more bits than the sets differ in elements) allows the threshold. None of these filters loses a link.
5. Candidates are verified on whole sets, recomputed from the texts; links become components.

A document without words has the empty set and links with nothing, not with another empty one. Repeated rows and
doc_ids are separate documents here; equal sets always share a class. A NULL doc_id does not count when a component's
smallest doc_id is sought. Texts are read whole; sets are of 64-bit hashes. Extra columns are not read.

The order decides speed alone. It comes from shingles that two documents of one Arrow batch hold, counted in all batches of all documents: the
``FREQUENT`` most frequent of them, cut where a count would not fit whole. All others stand before them by their hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.components import components
from wayfare.llm.fetch import split_rows
from wayfare.llm.lean import lean
from wayfare.llm.shingles import shingle_sets, sliced
from wayfare.llm.spread import join_unique
from wayfare.llm.verification import digest, set_digests, verified
from wayfare.sources.sinks import stored

SHINGLE_WORDS = 5
PERCENT = 75
FREQUENT = 1 << 18
# A shingle is counted in an Arrow batch of documents if so many of them hold it.
_LEAST_IN_BATCH = 2
# Shingles that a task counts together at most, and one document's more.
_COUNTED_AT_ONCE = 2_000_000
# Groups of a block.
BLOCK = 512
_LEAST_SKETCH_BITS = 1024


def frequent_shingles(texts: DataFrame, size: int, most: int = FREQUENT) -> np.ndarray:
    """The most frequent shingle hashes, rarest first: of all counts the least that at most ``most`` shingles reach."""

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= _LEAST_IN_BATCH
        return pa.record_batch([pa.array(found[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["shingle", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size_held = [], 0
            for own in shingle_sets(batch.column(0), size):
                held.append(own)
                size_held += len(own)
                if size_held >= _COUNTED_AT_ONCE:
                    yield repeated(held)
                    held, size_held = [], 0
            if held:
                yield repeated(held)

    partial = texts.select("text").mapInArrow(lean(count), "shingle long, n long")
    counted = stored(partial.groupBy("shingle").agg(F.sum("n").alias("n")), "frequencies")
    by_count = counted.groupBy("n").agg(F.count(F.lit(1)).alias("shingles"))
    so_far = Window.orderBy(F.desc("n"))  # over the distinct counts
    reached = by_count.select("n", F.sum("shingles").over(so_far).alias("reached")).filter(F.col("reached") <= most)
    least = reached.agg(F.min("n")).first()[0]
    top = counted.filter(F.col("n") >= F.lit(least)).toArrow()  # at most `most` rows, none if `least` is NULL
    shingles, counts = (top.column(i).to_numpy() for i in range(2))
    return shingles[np.lexsort((shingles, counts))].astype(np.int64).view(np.uint64)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity of the elements that hash to each bit; as many bits as elements at least, a power of two."""
    size = max(_LEAST_SKETCH_BITS, 1 << max(len(shingles) - 1, 0).bit_length())
    bits = np.bincount((shingles % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


_SET_COLUMNS = ["n", "f1", "f2", "p", "prefix", "sketch"]
_SET_SCHEMA = "doc_id long, n long, f1 long, f2 long, p long, prefix array<long>, sketch array<long>"
_PREFIX_SEED = 0x13579BD


def document_sets(texts: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Per document: set size, fingerprints of set and prefix, the prefix in global order, the odd sketch; further columns (long) stay."""
    identity = [c for c in texts.columns if c not in ("doc_id", "text")]
    order = np.argsort(frequent)
    shared = texts.sparkSession.sparkContext.broadcast((frequent[order], order))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for part in (part for batch in batches for part in sliced(batch, 1)):
            rows = []
            for own in shingle_sets(part.column(1), size):
                n = len(own)
                length = n - -(-percent * n // 100) + 1 if n else 0
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                hot = known[at] == own if len(known) else np.zeros(n, bool)
                late = own[hot][np.argsort(rank[at[hot]], kind="stable")] if hot.any() else own[:0]
                prefix = np.concatenate([own[~hot][:length], late])[:length]
                digests = (*set_digests(own), digest(prefix, _PREFIX_SEED))
                rows.append((n, *digests, prefix.view(np.int64), odd_sketch(own)))
            columns = list(zip(*rows))
            lists = pa.list_(pa.int64())
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, lists) for c in columns[4:]]
            yield pa.record_batch([part.column(0), *arrays, *part.columns[2:]], names=["doc_id", *_SET_COLUMNS, *identity])

    schema = ", ".join([_SET_SCHEMA, *[f"{name} long" for name in identity]])
    return texts.select("doc_id", "text", *identity).mapInArrow(lean(profile), schema)


def _need(a: Column, b: Column, percent: int) -> Column:
    """The least overlap of sets of sizes a and b at the threshold."""
    return F.ceil(percent * (a + b) / F.lit(100 + percent) - F.lit(1e-9))


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def live_prefixes(heads: DataFrame) -> DataFrame:
    """(shingle, group, n, place, hub, hub_n) for shingles in the prefixes of two groups or more; the hub is the smallest of them.

    ``heads(group, n, prefix)`` is one set of each group.
    """
    placed = heads.select("group", "n", F.posexplode("prefix").alias("place", "shingle"))
    held = placed.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("group", "n")).alias("hub"))
    live = join_unique(placed, stored(held.filter("rows > 1"), "shingles"), ["shingle"])
    return live.select("shingle", "group", "n", "place", F.col("hub.group").alias("hub"), F.col("hub.n").alias("hub_n"))


def hub_candidates(live: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of classes: for each class the head of its group's best hub, and of its own group."""
    fitting = live.filter(F.col("hub") != F.col("group")).filter(_sizes_allow(F.col("hub_n"), F.col("n"), percent))
    votes = fitting.groupBy("hub", "group").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("group").agg(F.max_by("hub", F.struct("votes", -F.col("hub"))).alias("hub"))
    hubs = best.join(classes.select("group", "class"), "group").select(F.col("hub").alias("a"), F.col("class").alias("b"))
    return hubs.union(classes.filter(F.col("class") != F.col("group")).select(F.col("group").alias("a"), F.col("class").alias("b")))


def open_groups(live: DataFrame, spans: DataFrame, percent: int, block: int) -> DataFrame:
    """Distinct pairs (a, b) of groups that may hold linked classes of different components.

    ``spans(group, least, most)``: the smallest and the largest root of a group's classes.
    """
    rooted = stored(live.select("shingle", "group", "n", "place").join(spans, "group"), "rooted")
    reach = rooted.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"))
    apart = stored(reach.filter("least < most").select("shingle", "rows"), "apart")
    blocks = F.ceil(F.col("rows") / F.lit(block)).cast("long")
    counted = join_unique(rooted, apart.withColumn("blocks", blocks), ["shingle"])
    dealt = counted.withColumn("own", F.pmod(F.xxhash64("group"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = dealt.select("shingle", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "group", "n", "place", "least", "most")

    def compare(unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, i, j, own, name, n, place, least, most = unit
        left = n - place
        for at in np.flatnonzero(own == i[0]) if len(name) > 1 else ():
            fits = (own == j[0]) & ((i[0] != j[0]) | (name > name[at])) & ((least != least[at]) | (most != most[at]) | (least != most))
            fits &= 100 * np.minimum(n, n[at]) >= percent * np.maximum(n, n[at])
            need = -(-percent * (n + n[at]) // (100 + percent))
            b = name[fits & (np.minimum(left, left[at]) >= need)]
            if len(b):
                yield pa.record_batch([pa.array(np.minimum(b, name[at])), pa.array(np.maximum(b, name[at]))], names=["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            edges = [0, *(np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0)) + 1).tolist(), rows.shape[1]]
            for begin, end in zip(edges, edges[1:]):
                if held and begin < end and (held[-1][:3, -1] != rows[:3, begin]).any():
                    yield from compare(np.concatenate(held, 1))
                    held = []
                if begin < end:
                    held.append(rows[:, begin:end])
        if held:
            yield from compare(np.concatenate(held, 1))

    ordered = units.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    inside = spans.filter("least < most").select(F.col("group").alias("a"), F.col("group").alias("b"))
    return ordered.mapInArrow(lean(search), "a long, b long").union(inside).distinct()


def open_candidates(groups: DataFrame, rooted: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes (a, b) that pairs of groups stand for, if in different components and close by their sketches."""
    one, other = (rooted.select(F.col("group").alias(f"g_{c}"), F.col("class").alias(c), F.col("root").alias(f"r_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
    pairs = groups.select(F.col("a").alias("g_a"), F.col("b").alias("g_b")).join(one, "g_a").join(other, "g_b")
    pairs = pairs.filter("r_a != r_b AND (g_a != g_b OR a < b)").select("a", "b", "n_a", "n_b")
    sketched = pairs.join(sketches.select(F.col("class").alias("a"), F.col("sketch").alias("s_a")), "a").join(
        sketches.select(F.col("class").alias("b"), F.col("sketch").alias("s_b")), "b"
    )
    most = F.col("n_a") + F.col("n_b") - 2 * _need(F.col("n_a"), F.col("n_b"), percent)
    return sketched.filter(_differing_bits(F.col("s_a"), F.col("s_b")) <= most).select("a", "b")


def _differing_bits(a: Column, b: Column) -> Column:
    """Bits in which two odd sketches differ, the longer one folded; sizes that allow a link differ by one fold at most."""
    length = F.least(F.size(a), F.size(b))

    def word(sketch: Column, i: Column) -> Column:
        return F.get(sketch, i).bitwiseXOR(F.when(F.size(sketch) > length, F.get(sketch, i + length)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(
        F.sequence(F.lit(0), length - 1), F.lit(0), lambda n, i: n + F.bit_count(word(a, i).bitwiseXOR(word(b, i)))
    )


def document_components(texts: DataFrame, size: int, percent: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored documents with words, (doc_id, n) of the others, stored (n, f1, f2, root, rows) of the classes).

    Documents have row, doc_id, n, f1, f2 and what further columns ``texts`` has. ``root`` is the smallest class of a component,
    ``rows`` the number of a class's documents.
    """
    frequent = frequent_shingles(texts, size)
    rows = document_sets(texts, size, percent, frequent).withColumn("row", F.monotonically_increasing_id())
    sets = stored(rows, "profiles")
    worded = sets.filter("n > 0").drop("p", "prefix", "sketch")
    firsts = sets.filter("n > 0").groupBy("n", "f1", "f2").agg(
        F.min(F.struct("row", "doc_id", "p")).alias("first"), F.count(F.lit(1)).alias("rows")
    )
    named = firsts.select("n", "f1", "f2", "rows", F.col("first.row").alias("class"), "first.doc_id", "first.p")
    named = stored(named, "named")
    groups = named.groupBy("n", "p").agg(F.min("class").alias("group"))
    classes = stored(named.join(groups, ["n", "p"]).drop("p"), "classes")
    heads = sets.select(F.col("row").alias("group"), "n", "prefix").join(classes.filter("class = group").select("group"), "group")
    live = stored(live_prefixes(heads), "prefixes")

    hubs = stored(hub_candidates(live, classes, percent), "candidates")
    links = stored(verified(hubs, classes, texts, size, percent), "links")
    rooted = stored(_rooted(classes, components(links)), "rooted")
    spans = rooted.groupBy("group").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    open_pairs = stored(open_groups(live, stored(spans, "spans"), percent, block), "groups")
    sketches = sets.select(F.col("row").alias("class"), "sketch")
    candidates = stored(open_candidates(open_pairs, rooted, sketches, percent), "candidates")
    more = verified(candidates, classes, texts, size, percent)
    final = _rooted(classes, components(links.union(more))).select("n", "f1", "f2", "root", "rows")
    return worded, sets.filter("n = 0").select("doc_id", "n"), stored(final, "classes")


def _rooted(classes: DataFrame, joined: DataFrame) -> DataFrame:
    return classes.join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))


def _by_component(documents: DataFrame, classes: DataFrame, value: Column, name: str) -> DataFrame:
    """``documents`` with ``name``, the least ``value`` of their component: first of each class, then of each component."""
    keys = ["n", "f1", "f2"]
    of_class = documents.groupBy(*keys).agg(F.min(value).alias(name))
    met = stored(classes.join(of_class, keys), "least")
    lowest = stored(met.groupBy("root").agg(F.min(name).alias(name), F.count(F.lit(1)).alias("classes")), "least")
    by_class = join_unique(met.drop(name), lowest, ["root"], "classes").select(*keys, name, "rows")
    return join_unique(documents, stored(by_class, "least"), keys)


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """Per document: doc_id, ``n_shingles``, and ``component_id``, the smallest doc_id its links reach."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    worded, wordless, classes = document_components(texts, size, percent, block)
    linked = _by_component(worded, classes, F.col("doc_id"), "component_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(wordless.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id (then of the smallest text hash), one row of it if it is repeated.

    Documents without words are all kept. Documents are told apart by doc_id and a 128-bit hash of the text. Only those that go, or that occur
    repeatedly, are shuffled whole; texts are not shingled again to find them.
    """
    tag = "__" + uuid.uuid4().hex[:8]
    names = [f"{tag}_{k}" for k in ("id", "t1", "t2")]
    hashes = {names[0]: F.col(key).cast("long"), names[1]: F.xxhash64(F.col(text)), names[2]: F.xxhash64(F.lit(1), F.col(text))}
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *[h.alias(n) for n, h in list(hashes.items())[1:]])
    worded, _, classes = document_components(texts, size, percent)
    identity = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col(names[1]).alias("t1"), F.col(names[2]).alias("t2"))
    judged = _by_component(worded, classes, identity, "best")
    stays = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col(names[1]) == F.col("best.t1")) & (F.col(names[2]) == F.col("best.t2"))
    counted = judged.groupBy(F.col("doc_id").alias(names[0]), *names[1:]).agg(F.min(stays).alias("stays"), F.count(F.lit(1)).alias("copies"))
    leaving = stored(counted.filter("NOT stays OR copies > 1"), "dropped")
    marked = docs.withColumns(hashes)
    rest, _ = split_rows(marked, leaving, names)
    _, repeated = split_rows(marked, leaving.filter("stays"), names)
    return rest.unionByName(repeated.dropDuplicates(names)).drop(*names)
