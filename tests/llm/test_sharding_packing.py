import hashlib
import math
import zlib
from collections import defaultdict
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import CLASHING, ODD
from wayfare.llm import packing, sharding

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ADDED = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_shards_are_even_gapless_and_grow_into_the_new_one_only(documents):
    docs = documents([f"text {i}" for i in range(400)] + ODD, **CLASHING)
    rows = sharding.shard_documents(docs, sharding.even_tree(8)).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert set(slots) == set(range(8))
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
        assert 25 < len(found) < 85
    assert 20 < sum(r.grown_shard == 8 for r in rows) < 80
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in rows}
    assert sizes[400] == (1, 0) and sizes[406] == (len("é à ü".encode()) + 1, zlib.crc32("é à ü".encode()))


@pytest.mark.parametrize("shards", [1, 2, 3, 5, 13])
def test_any_tree_grows_into_the_new_shard_only(documents, shards):
    docs = documents([f"{i}" for i in range(100)])
    tree = sharding.even_tree(shards)
    for r in sharding.shard_documents(docs, tree).collect():
        assert r.grown_shard in (r.shard, shards) and 0 <= r.shard < shards


def test_changing_a_weight_moves_keys_within_or_into_that_subtree_only(spark):
    from pyspark.sql import functions as F

    small = {"r0": {"a": {0: 1.0, 1: 1.0}, "b": {2: 1.0}}, "r1": {"c": {3: 1.0, 4: 1.0}}}
    large = {"r0": {"a": {0: 1.0, 1: 3.0}, "b": {2: 1.0}}, "r1": {"c": {3: 1.0, 4: 1.0}}}
    rows = spark.range(3000).select(
        sharding.shard_of(F.col("id"), small).alias("before"), sharding.shard_of(F.col("id"), large).alias("after")
    ).collect()
    moves = {(r.before, r.after) for r in rows if r.before != r.after}
    assert moves and all(after in (0, 1, 2) for _, after in moves)  # into the region that grew
    assert not {(before, after) for before, after in moves if before in (0, 1, 2) and after == 2}
    share = sum(r.after in (0, 1) for r in rows) / 3000
    assert abs(share - 4 / 7) < 0.04


def plain_shard(key, tree):
    """The descent in plain Python: the smallest weighted draw at each level."""
    text = "\0null" if key is None else str(key)

    def draw(node, weight):
        bits = int(hashlib.md5(f"{text}/{node}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2.0**52) / weight

    def weigh(node):
        return node if isinstance(node, float) else sum(map(weigh, node.values()))

    path, node = [], tree
    while not isinstance(node, float):
        names = {child: "/".join(map(str, [*path, child])) for child in node}
        child = min(node, key=lambda c: draw(names[c], weigh(node[c])))
        path, node = [*path, child], node[child]
    return path[-1]


def test_shards_match_a_plain_descent(documents):
    uneven = {"r0": {"a": {0: 1.0, 1: 2.5}, "b": {2: 0.5}}, "r1": {"c": {3: 4.0}}, "r2": {"d": {4: 1.0, 5: 1.0, 6: 0.25}}}
    docs = documents([(i * 7919 - 100, "x") for i in range(500)] + [(None, "y")])
    for tree in (uneven, sharding.even_tree(8)):
        rows = sharding.shard_documents(docs, tree).collect()
        assert len(rows) == 501
        for r in rows:
            assert r.shard == plain_shard(r.doc_id, tree) and r.grown_shard == plain_shard(r.doc_id, sharding.grown(tree))


def test_repeated_rows_and_null_keys_share_a_shard(documents):
    docs = documents([(7, "same")] * 50 + [(None, "n")] * 30)
    rows = sharding.shard_documents(docs, sharding.even_tree(4)).collect()
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1
    assert sorted(r.slot for r in rows if r.shard == rows[0].shard) == list(range(sum(r.shard == rows[0].shard for r in rows)))
    assert sharding.shard_documents(documents([]), sharding.even_tree(4)).collect() == []


def test_written_shards_hold_every_document(documents, spark, tmp_path):
    docs = documents([f"t{i}" for i in range(40)])
    sharding.write_shards(docs, sharding.even_tree(3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def check_packing(rows, texts, tokenizer, capacity):
    ids = {}
    for key, text in texts.items():
        ids[key] = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for key, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            part = ids[key][r.start : r.start + r.length]
            assert r.start == at and len(part) == r.length
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += r.length
        assert at == len(ids[key])
        assert all(r.length == capacity for r in own[1:]) and (len(own) == 1 or at > capacity)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= capacity
    return len(sequences), sum(map(len, ids.values()))


def test_packing_round_trip(documents, tokenizer):
    texts = ODD + ["word " * n for n in (3, 40, 63, 64, 65, 200, 1000)] + [f"some text number {i} " * (i % 9) for i in range(300)]
    texts += ["a  b", "a \n \n b", " lead", "trail ", "no\xa0break \xa0 here", "<|endoftext|> plain", "x <|endoftext|> y", "<|endoftext|><|endoftext|>", " <|endoftext|>  z <|endof|>"]
    rows = packing.pack_documents(documents(texts, **CLASHING), RANKS, public_tokenizers.PATTERN, ADDED, capacity=64, open_bins=16).collect()
    sequences, tokens = check_packing(rows, dict(enumerate(texts)), tokenizer, 64)
    assert sequences <= 1.05 * tokens / 64 + 4


def test_packing_of_nothing_and_of_repeats(documents, tokenizer):
    assert packing.pack_documents(documents([]), RANKS, public_tokenizers.PATTERN, ADDED).collect() == []
    rows = packing.pack_documents(documents([(1, "same"), (1, "same")]), RANKS, public_tokenizers.PATTERN, ADDED).collect()
    assert len(rows) == 2 and len({r.ids_crc32 for r in rows}) == 1


def test_words_encode_as_the_tokenizer_does(tokenizer):
    import random

    words = packing.WordIds(RANKS, public_tokenizers.PATTERN, ADDED)
    pick = random.Random(5)
    for _ in range(3000):
        text = "".join(pick.choice([*" \n\tab'1.é<|　\xa0s\x1c\x85", "<|endoftext|>", "<|endof"]) for _ in range(pick.randint(0, 14)))
        want = b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids)
        assert words.encode(text) == want, text


def test_the_longest_of_two_added_tokens_is_cut_out(tmp_path):
    words = packing.WordIds(RANKS, public_tokenizers.PATTERN, {"<a>": 7, "<a><b>": 8})
    assert words.encode("<a><b><a>") == (8).to_bytes(4, "little") + (7).to_bytes(4, "little")
    (tmp_path / "t.json").write_text('{"added_tokens": [{"content": "x", "id": 1, "single_word": false, "lstrip": true, "rstrip": false, "normalized": false}]}')
    with pytest.raises(ValueError):
        packing.added_tokens(str(tmp_path / "t.json"))


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="test tables not present")
@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_large_batches_are_packed_tightly(spark, documents, partitions):
    """10,000 documents, in one batch where they are one partition: within 1 % of the least possible."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(partitions, "doc_id")
    rows = packing.pack_documents(docs, RANKS, public_tokenizers.PATTERN, ADDED).selectExpr("sequence_id", "length").collect()
    assert len({r.sequence_id for r in rows}) <= 1.01 * sum(r.length for r in rows) / packing.CAPACITY


def test_open_bins_find_the_tightest_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.add(7, ["a"]) is None and bins.add(4, ["b"]) is None
    assert bins.add(3, ["c"]) == ["a", "c"]  # exactly full
    assert bins.add(8, ["d"]) is None
    assert bins.add(9, ["e"]) == ["d"]  # the fullest closes
    assert bins.drain() == [(9, ["e"]), (4, ["b"])]
