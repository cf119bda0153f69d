"""The Merkle manifest and the prefix trie against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHING, ODD
from wayfare.llm import merkle, prefix_trie
from wayfare.llm.ranking import ranked


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, place):
    out = []
    for level in tree[:-1]:
        first = place // 16 * 16
        run = level[first : first + 16]
        out.append((run[: place - first], run[place - first + 1 :]))
        place //= 16
    return out


LOW = {c: c + 32 for c in range(65, 91)}


def brute_proofs(rows):
    """Sorted result rows for (doc_id, source, lang, n_chars, text) rows."""
    sources = defaultdict(list)
    for row in rows:
        def leaf(values):
            return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

        changed = [*row[:4], None if row[4] is None else row[4].translate(LOW)]
        tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        sources[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), leaf(changed if tampered else row), row[0]))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[2] for x in sorted(sources[s])]) for s in order]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, leaf, altered, doc) in enumerate(sorted(sources[s])):
            path = siblings(trees[k], i) + siblings(top, k)
            for left, right in path:
                altered = sha("".join(left) + altered + "".join(right))
            proof = sha("".join("".join(a + b) for a, b in path))
            out.append((doc, leaf, trees[k][-1][0], top[-1][0], proof, altered, altered == top[-1][0]))
    return out


def check_proofs(spark, rows, **extra):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.verify_documents(docs.withColumns({k: F.lit(v) for k, v in extra.items()}), tampered, lowered).collect()
    assert Counter(map(tuple, got)) == Counter(brute_proofs(rows))


def test_proofs_match_plain_python(spark):
    pick = random.Random(4)
    rows = [(i, "hot", "en", 3, f"Text {i} É") for i in range(300)]  # three levels, the last run short
    rows += [(i, f"s{i % 37}", None, None, pick.choice([None, "", "UPPER", "ß İ"])) for i in range(1000, 1200)]
    rows += [(7, None, "de", 1, "a"), (7, None, "de", 1, "a"), (7, None, "de", 1, "B"), (None, None, None, None, None), (9, "", "", 0, "")]
    rows += [(i, "seventeen", "en", 1, "x") for i in range(17)]  # a run of one
    clash = {c: 1 for c in ("tree", "rank", "prefix", "digest", "leaf", "n", "run", "path", "root", "altered")}
    check_proofs(spark, rows, **CLASHING | clash)


def test_lone_rows_are_their_own_root(spark):
    check_proofs(spark, [(5, "one", "en", 2, "ABC")])
    check_proofs(spark, [(5, "one", "en", 2, "ABC"), (6, "two", "en", 2, "y" * 100_000)])
    check_proofs(spark, [])


def test_a_manifest_proves_chosen_leaves(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("source"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))
    manifest = merkle.build_manifest(rows, key="id")
    wanted = manifest.leaves.filter("id IN (3, 50, 51)").select("tree", "rank", "id", "leaf")
    proofs = merkle.prove(manifest, wanted).withColumn("back", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert sorted(r.id for r in proofs) == [3, 50, 51]
    assert {r.back for r in proofs} == {bytes(r.root).hex() for r in proofs} and len({bytes(r.root) for r in proofs}) == 1


def test_ranks_are_gapless_whatever_the_layout(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 500).alias("v")).union(spark.sql("SELECT NULL, NULL"))
    got = ranked(rows.repartition(7), ["g"], ["v"]).collect()
    by_group = defaultdict(list)
    for r in got:
        by_group[r.g].append((r.v is not None, r.v or 0, r["rank"]))
    assert all([x[2] for x in sorted(own)] == list(range(len(own))) for own in by_group.values()) and len(got) == 501


def brute_trie(rows, plan=None):
    """Sorted nodes of (conv_id, turn, role, text) rows, conversations rebuilt by conv_id - conv_id % 5 and crc32 % 9."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    for conv in own:
        own[conv].sort(key=lambda t: t[0])
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = [t[1:] for t in own.get(c - c % 5, [])[:h] + own[c][h:]]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, out = defaultdict(int), []
    for path in members:
        if path:
            children[path[:-1]] += 1
    saved, leaves = Counter(), Counter()
    for path, own_members in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(own_members) - 1) * len(path[-1][1].encode()) if path else 0
            leaves[path[:d]] += not children[path]
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(m), len(path), parent, len(m), children[path], leaves[path], saved[path], sha(ends)))
    return out


def conversations(pick):
    turns = [f"turn {i}" for i in range(4)] + ["", None, "É"]
    rows = []
    for c in [*range(60), 1_000_003, 77]:
        if c % 10 != 5:  # some bases are absent
            rows += [(c, t, pick.choice(["user", None]), pick.choice(turns)) for t in range(pick.randrange(1, 7))]
    rows += [(200 + c, t, "user", f"same {t}") for c in range(30) for t in range(3)]  # copies
    rows += [(300, t, "user", f"long {t}") for t in range(40)] + [(301, t, "user", f"long {t}") for t in range(30)]
    return rows + [(None, 1, "user", "nobody"), (400, None, "user", "no number"), (400, 0, "user", "then")]


@pytest.mark.parametrize("shard, band", [(1024, 256), (7, 3), (1, 1)])
def test_trie_matches_plain_python(spark, shard, band):
    rows = conversations(random.Random(2))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    table = table.withColumns({c: F.lit(1) for c in ("place", "mark", "size", "shard", "band", "node", "depth", "rank", "n")})
    turns = prefix_trie.ordered_turns(table)
    ids = turns.select("conv_id").distinct()
    keep = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    plan = ids.select("conv_id", (F.col("conv_id") - F.pmod("conv_id", F.lit(5))).alias("base"), keep.alias("keep"))
    got = prefix_trie.prefix_trie(prefix_trie.spliced(turns, plan), ids, shard, band).collect()
    assert Counter(map(tuple, got)) == Counter(brute_trie(rows))


def test_an_empty_table_has_no_trie(spark):
    turns = prefix_trie.ordered_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert prefix_trie.prefix_trie(turns, turns.select("conv_id").distinct()).collect() == []


def test_odd_documents_have_proofs(documents):
    docs = documents([*enumerate(ODD)], **CLASHING)
    rows = [tuple(r[c] for c in merkle.LEAF_COLUMNS) for r in docs.collect()]
    by = [(d, s, la, n, t) for d, s, la, n, t in rows]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = merkle.verify_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lowered)
    assert Counter(map(tuple, got.collect())) == Counter(brute_proofs(by))
