"""Pack documents into token sequences by bounded-space online best fit.

Every scan task packs its own documents: nothing is shuffled, a sequence never spans tasks, and a
recomputed task packs the same rows the same way. A task holds at most ``open_bins`` open sequences, in a
bitset with one bit for each amount of free space. A piece goes to the open sequence with the least free
space that holds it (the lowest set bit from its length up); when none does and the space is
used up, the fullest sequence closes first. Pieces are offered in chunks of ``CHUNK``, long ones before short ones, whatever the batches
are: longer chunks would fill the open sequences with long pieces, which then close before short ones come. At the end of the task
the sequences still open are fitted into each other by the same rule.

Documents longer than a sequence are cut into full sequences, the odd remainder first; only that remainder is packed.

A null or empty text is the end id alone. Repeated rows are packed as often as they occur. Empty
tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator, Mapping

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.lean import lean

CAPACITY = 1024
OPEN_BINS = 512
CHUNK = 2 * OPEN_BINS
END_ID = 2
# Rows of a result batch.
_ROWS = 10_000
# Words kept with their ids by one Python worker.
CACHED_WORDS = 100_000

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
)


class OpenBins:
    """At most ``most`` open bins of ``capacity``, found by free space through a bitset."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.count = capacity, most, 0
        self.free_bits = 0  # bit f is set while some open bin has f free
        self.by_free: dict[int, list[list]] = defaultdict(list)

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        taken = bins.pop()
        if not bins:
            self.free_bits &= ~(1 << free)
        self.count -= 1
        return taken

    def _put(self, free: int, contents: list) -> None:
        self.by_free[free].append(contents)
        self.free_bits |= 1 << free
        self.count += 1

    @staticmethod
    def _lowest(bits: int) -> int:
        return (bits & -bits).bit_length() - 1

    def add(self, length: int, items: list) -> list | None:
        """Place ``items`` of total ``length``; a bin that closes by it is returned."""
        fitting = self.free_bits >> length
        closed = None
        if fitting:
            free = length + self._lowest(fitting)
            contents = self._take(free)
        else:
            if self.count >= self.most:
                closed = self._take(self._lowest(self.free_bits))
            free, contents = self.capacity, []
        contents.extend(items)
        if free == length:
            return contents
        self._put(free - length, contents)
        return closed

    def drain(self) -> list[tuple[int, list]]:
        """All open bins as (filled, contents), fullest first; none stays open."""
        out = [(self.capacity - f, c) for f in sorted(self.by_free) for c in self.by_free[f]]
        self.by_free.clear()
        self.free_bits = self.count = 0
        return out


class WordIds(dict):
    """Token ids as little-endian 32-bit bytes: of a text by :meth:`encode`, of one word after a space as an item.

    The vocabulary's pre-tokenizer never joins a space to what stands before it, so a text can be split at
    its spaces and each word, its space in front, encoded alone and remembered. Where white space holds
    two spaces or more, the whole run decides, and such texts are encoded whole.

    The rank file gives the ids of the JSON file of the same vocabulary and encodes unseen words ten times as fast. What it lacks are
    ``added`` tokens, whose text has an id of its own wherever it stands: texts are cut at them first, the longest of those that
    begin at one place.
    """

    _SPACES = re.compile(r" \s* ")

    def __init__(self, ranks_path: str, pattern: str, added: Mapping[str, int] = {}):
        super().__init__()
        self.added = {text: number.to_bytes(4, "little") for text, number in added.items()}
        longest = sorted(map(re.escape, added), key=len, reverse=True)
        self.cuts = re.compile(f"({'|'.join(longest)})") if longest else None
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ids = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        ids = array("I", self.ids(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = self.whole(" " + word)
        return found

    def encode(self, text: str) -> bytes:
        if self.cuts is not None and self.cuts.search(text):
            parts = self.cuts.split(text)
            return b"".join(self.added[p] if k % 2 else self.plain(p) for k, p in enumerate(parts))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if self._SPACES.search(text):
            return self.whole(text)
        first, *words = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, words))


def added_tokens(json_path: str) -> dict[str, int]:
    """The tokens that a tokenizer's JSON file adds to its vocabulary. Only ones that match as they stand are supported."""
    with open(json_path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens that look at what stands around them are not supported")
    return {t["content"]: t["id"] for t in added}


_ENCODERS: dict[tuple, WordIds] = {}


def _encoder(path: str, pattern: str, added: Mapping[str, int]) -> WordIds:
    """One per Python worker, kept from task to task."""
    key = (path, pattern, *sorted(added.items()))
    if key not in _ENCODERS:
        _ENCODERS[key] = WordIds(path, pattern, added)
    return _ENCODERS[key]


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece: the odd remainder first, then full pieces."""
    total, view = len(ids) // 4, memoryview(ids)
    ends = [total] if total <= capacity else [e for e in range(total % capacity, total + 1, capacity) if e]
    out, start = [], 0
    for end in ends:
        out.append((start, end - start, zlib.crc32(view[4 * start : 4 * end])))
        start = end
    return out


def pack_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    added: Mapping[str, int],
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    end_id: int = END_ID,
    key: str = "doc_id",
    body: str = "text",
) -> DataFrame:
    """One row per piece, with the sequence it went to and its place there.

    ``ranks_path``, ``pattern`` and ``added`` describe the tokenizer: a file of base64 tokens with their ranks, the
    pattern that splits text before merging, and the tokens that are cut out first, see :func:`added_tokens`.
    ``sequence_id`` is the scan task's number times 2^33 plus a count.
    """
    end = end_id.to_bytes(4, "little")

    def pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks_path, pattern, added).encode
        bins = OpenBins(capacity, open_bins)
        sequences, rows, waiting = 0, [], []

        def offer() -> None:
            waiting.sort(key=lambda item: -item[3])
            for item in waiting:
                if (closed := bins.add(item[3], [item])) is not None:
                    close(closed)
            waiting.clear()

        def close(contents: list) -> None:
            nonlocal sequences
            offset = 0
            for item in contents:
                rows.append((*item, base + sequences, offset))
                offset += item[3]
            sequences += 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(_ARROW)
            out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)
            rows.clear()
            return out

        base = None
        for batch in batches:
            if base is None and batch.num_rows:
                base = batch.column(2)[0].as_py() << 33
            ids = batch.column(0).to_pylist()
            for doc, text in zip(ids, batch.column(1)):
                for piece, (start, length, crc) in enumerate(cut(encode(text.as_py() or "") + end, capacity)):
                    item = (doc, piece, start, length, crc)
                    if length == capacity:
                        close([item])
                    else:
                        waiting.append(item)
                        if len(waiting) >= CHUNK:
                            offer()
                if len(rows) >= _ROWS:
                    yield flushed()
        offer()
        last = OpenBins(capacity, max(1, bins.count))
        for filled, contents in bins.drain():
            if (closed := last.add(filled, contents)) is not None:
                close(closed)
        for _, contents in last.drain():
            close(contents)
        if rows:
            yield flushed()

    source = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(body).alias("text"), F.spark_partition_id().cast("long").alias("task")
    )
    return source.mapInArrow(lean(pack_task), PIECES)


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
