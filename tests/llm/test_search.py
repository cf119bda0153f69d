"""Joins, searches and substring removal against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import CLASHING, ODD
from wayfare.llm import components, decontamination, fm_index, hyperminhash, jaccard, shingles, substrings, verification

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return WORD.findall(text or "")


def shingle_set(text, size=5):
    words = words_of((text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def edited(words, pick, edits):
    out = list(words)
    for _ in range(edits):
        out[pick.randrange(len(out))] = f"e{pick.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    pick = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{pick.randrange(3000)}" for _ in range(pick.choice([12, 60, 90, 300]))]
        texts += [" ".join(base)] + [" ".join(edited(base, pick, pick.randrange(4))) for _ in range(pick.randrange(8))]
    passage = " ".join(f"license{i}" for i in range(40))
    texts += [" ".join(f"u{i}x{k}" for k in range(30)) + " " + passage for i in range(40)]
    center = [f"c{i}" for i in range(120)]
    texts += [" ".join(edited(center, pick, 3)) for _ in range(60)] + [" ".join(center)]
    texts += ["same words here again now please"] * 20 + ["SAME  words here\tagain now please", "rep " * 90, *ODD, *ODD]
    return texts


def brute_components(texts, size=5, percent=75):
    sets = [shingle_set(t, size) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_match_brute_force(documents, corpus, monkeypatch, block):
    monkeypatch.setattr(verification, "PORTION", 7)
    rows = jaccard.near_duplicates(documents(corpus, **CLASHING), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(corpus)
    assert len(rows) == len(corpus)


def test_group_pairs_of_a_template_stay_few(spark, documents):
    """Texts that share a little less than asked: the shared shingles are frequent and so in no prefix."""
    template = [f"t{i}" for i in range(100)]
    texts = [" ".join(template + [f"own{k}x{i}" for i in range(35)]) for k in range(400)]
    rows = documents(texts).select("doc_id", "text")
    sets = jaccard.document_sets(rows, 5, 75, jaccard.frequent_shingles(rows, 5)).withColumnRenamed("doc_id", "group")
    assert jaccard.live_prefixes(sets.select("group", "n", "prefix")).count() == 0


@pytest.mark.parametrize("block", [512, 3])
def test_hyperminhash_matches_brute_force(documents, corpus, block):
    texts = [*corpus, *("a few words only here now " + str(i % 7) for i in range(20))]
    rows = hyperminhash.near_duplicates(documents(texts, **CLASHING, bands=1, n_shingles=2, kept=3), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts, 4, 80)
    assert len(rows) == len(texts) and all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_hyperminhash_of_repeated_and_missing_ids(documents):
    text = "one two three four five six"
    rows = hyperminhash.near_duplicates(documents([(4, text), (4, text), (None, text), (2, text), (None, "alone " + text), (None, None), (7, "")])).collect()
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows)
    assert got == Counter(
        [(4, 3, 2, False), (4, 3, 2, False), (None, 3, 2, False), (2, 3, 2, True), (None, 4, None, True), (None, 0, None, True), (7, 0, 7, True)]
    )
    assert hyperminhash.near_duplicates(documents([])).collect() == []


def test_registers_agree_as_often_as_sets():
    rng = np.random.default_rng(5)
    for size, similarity in ((6, 2 / 3), (50, 0.8), (300, 0.8), (5000, 0.6), (400, 0.0)):
        estimates = []
        for _ in range(60):
            both = round(size * 2 * similarity / (1 + similarity))
            pool = rng.integers(0, 2**63, 2 * size - both).astype(np.uint64)
            a, b = np.sort(pool[:size]), np.sort(pool[size - both :])
            equal = (hyperminhash.sketch(a) == hyperminhash.sketch(b)).sum()
            estimates.append(float(hyperminhash.estimated(np.array(equal), np.array(size), np.array(size))))
        assert abs(np.mean(estimates) - both / (2 * size - both)) < 0.03


def test_registers_hold_zeros_and_mantissa():
    rest = hyperminhash._REST
    values = np.array([1 << (rest - 1), (1 << rest) - 1, 1, 0b1011 << (rest - 10)], np.uint64)
    assert hyperminhash.compressed(values).tolist() == [0, 1023, (rest - 1) << 10, (6 << 10) | (0b011 << 7)]


def test_one_of_each_component_stays(documents, corpus):
    docs = documents([*enumerate(corpus), (0, corpus[0]), (0, corpus[0]), (None, corpus[1]), (None, "alone in here and without any doc id")], **CLASHING)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    want = brute_components(corpus)
    roots = Counter(root for i, (n, root) in want.items() if n and i == root)
    wordless = Counter(i for i, (n, _) in want.items() if not n)
    assert Counter(r.doc_id for r in kept.collect()) == roots + wordless + Counter([None])


def test_repeated_ids_and_empty_tables(documents):
    rows = jaccard.near_duplicates(documents([(1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (None, "q r s t u v")])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in rows) == [(0, 1), (1, 1), (1, 1), (2, 1)]
    assert jaccard.near_duplicates(documents([])).collect() == []
    assert jaccard.one_of_each(documents([])).collect() == []
    assert [r.component_id for r in jaccard.near_duplicates(documents([(None, "only null id here now")])).collect()] == [None]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (7, 6), (6, 7)]
    rows = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert len(rows) == 81
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_shingle_hashes_tell_sets_apart(corpus):
    sets = list(shingles.shingle_sets(pa.array(corpus, pa.string())))
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in corpus]


def removal(texts, window):
    words = [words_of(t) for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot_runs, shard_words", [(20_000, 250_000), (2, 300)])
def test_repeated_substrings_are_removed(documents, corpus, hot_runs, shard_words):
    pick = random.Random(2)
    texts = [*corpus, "ab " * 200, "x y z " * 40 + "end", " ".join(pick.choice("ab") for _ in range(400))]
    docs = documents(texts, **CLASHING)
    rows = substrings.without_repeats(docs, hot_runs=hot_runs, shard_words=shard_words).collect()
    want = removal(texts, 35)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == dict(enumerate(want))
    for r in rows:
        if r.kept_text is not None:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_runs_of_periodic_texts_are_cut(documents):
    line, pick = [f"w{i}" for i in range(28)], random.Random(4)
    periodic = " ".join(line * 40)
    mixed = " ".join(" ".join([*line[:12], *(f"v{pick.randrange(999)}" for _ in range(8))]) for _ in range(40))
    words, counts = shingles.word_hashes(pa.array([periodic, mixed, "a b", periodic + " end"]), lower=False)
    at, anchors, several, per = substrings.runs_of(words, counts, 35, 8)
    ends = np.repeat(np.cumsum(counts) - 34, per)
    owner = np.repeat(np.arange(4), per)
    following = np.where(np.append(owner[1:], -1) == owner, np.append(at[1:], 0), ends)
    assert (following > at).all() and (following - at).max() <= 56 and several[following - at > 28].all()
    assert (following - at).sum() == (counts[counts >= 35] - 34).sum()
    texts = [periodic, mixed, periodic + " end", " ".join(line[3:] + line[:3]), "a b"]
    for hot_runs in (1, 20_000):
        rows = substrings.without_repeats(documents(texts), hot_runs=hot_runs, shard_words=300).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == dict(enumerate(removal(texts, 35)))


def test_substring_edges(documents):
    long = " ".join(f"w{i}" for i in range(50))
    rows = substrings.without_repeats(documents([(1, long), (1, long), (1, "other"), (None, long + " z"), (2, "Other")])).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in rows) == [(0, 51, 50), (1, 1, 0), (1, 50, 50), (1, 50, 50), (2, 1, 0)]
    assert substrings.without_repeats(documents([])).collect() == []


@pytest.mark.parametrize("symbols, depth", [(1, 4), (2, 5), (7, 3), (300, 8)])
def test_fm_index_counts_every_window(symbols, depth):
    rng = np.random.default_rng(symbols)
    lengths = rng.integers(depth, 40, 30)
    pieces = [rng.integers(1, symbols + 1, n) for n in lengths]
    pieces += [pieces[0].copy(), np.concatenate([pieces[1], pieces[2]])]
    weights = np.ones(len(pieces), np.int64)
    weights[3] = 2
    lengths = np.array([len(p) for p in pieces])
    text = np.concatenate([np.append(p, 0) for p in pieces])
    starts = np.cumsum(lengths + 1) - lengths - 1
    counts = Counter()
    for p, w in zip(pieces, weights):
        for i in range(len(p) - depth + 1):
            counts[tuple(p[i : i + depth])] += int(w)
    index = fm_index.FMIndex(text, np.repeat(weights, lengths + 1), depth)
    found = index.repeated(starts, lengths, text)
    for p, s in zip(pieces, starts):
        for i in range(len(p)):
            assert found[s + i] == (i <= len(p) - depth and counts[tuple(p[i : i + depth])] > 1)


def test_contaminated_documents_match_brute_force(documents, spark):
    pick = random.Random(4)
    items = [" ".join(f"b{k}x{i}" for i in range(n)) for k, n in enumerate([5, 9, 16, 17, 33, 60, 150])]
    items += ["two words", "", None, items[0]]
    filler = lambda n: [f"f{pick.randrange(500)}" for _ in range(n)]
    texts = [" ".join(filler(40) + item.split() + filler(700)) for item in items if item] * 3
    texts += [" ".join(filler(30) + item.split()[: int(len(item.split()) * 0.9)] + filler(30)) for item in items if item]
    texts += [" ".join(filler(200)) for _ in range(20)] + [items[5].upper(), "Two\nWORDS", *ODD]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontamination.contaminated(documents(texts, **CLASHING), benchmark).collect()
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            own, held = shingle_set(item), shingle_set(text)
            if own and 100 * len(own & held) >= 75 * len(own):
                want[d, i] = (len(own & held), len(own))
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in rows}
    assert got == want and len(rows) == len(want)
    clean = decontamination.decontaminated(documents(texts, **CLASHING), benchmark)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_decontamination_of_empty_tables_and_in_blocks(documents, spark, monkeypatch):
    benchmark = spark.createDataFrame([(i, " ".join(f"b{i}x{k}" for k in range(20))) for i in range(5)], "item_id long, text string")
    docs = documents([f"some words before b{i}x" + f" b{i}x".join(map(str, range(20))) for i in range(5)])
    monkeypatch.setattr(decontamination, "ITEMS_PER_BLOCK", 2)
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, benchmark).collect()} == {(i, i) for i in range(5)}
    assert decontamination.decontaminated(docs, benchmark).count() == 0
    assert decontamination.contaminated(documents([]), benchmark).collect() == []
    assert decontamination.contaminated(docs, benchmark.limit(0)).collect() == []
