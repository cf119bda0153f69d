"""Language identification by a linear-chain conditional random field over the words of a text.

Each word's label (a language) scores by hashed features of the word, namely affixes, inner character n-grams and
the word itself (lexicon), averaged; neighbouring labels score by learned transitions. Forward-backward gives
every word its label probabilities, so code-switched text is labelled word by word; a document's
language is the one with the most probability over its words that have letters, and its score is that share.

Training sequences are code-switched by construction: passages of documents of all languages are chained, so
that transitions are learned along with the features. The documents are a bounded sample, about ``per_language`` of each
language, chosen by a hash of doc_id from all that the caller allows; the fit runs in numpy on the driver.

Labelling is one pass without a shuffle. Chains are cut into blocks whose transfer matrices are multiplied, so that
all blocks of many documents advance together, exactly.

NULL texts and texts without letters are ``und`` with score 0. A document's chain starts from an even mix of languages.
Ties go to the language first in alphabetical order. Repeated rows are labelled alike. Blank texts teach nothing: a language
that has no others is left out. With nothing to learn from, every document is ``und``; with one language, all with letters are
that one. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.lean import lean
from wayfare.llm.subwords import WordScores, mixed, ngrams, slices

SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 17
PER_LANGUAGE = 400
UNDETERMINED = "und"
CACHED_WORDS = 100_000
BLOCK = 64
SLICE_WORDS = 40_000
_SEED = 20_24
_MOST_LOGIT = 30.0
_HAS_WORDS = r"(?U)[^\s\x1c-\x1f]"  # what str.split leaves


@dataclass(frozen=True)
class LanguageModel:
    """``weights[bucket, label]`` and ``transitions[from, to]``, in logits."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Per word: a potential for each language, the largest 1, and whether it has a letter."""
        owners, buckets = _features(words)
        counts = np.maximum(np.bincount(owners, minlength=len(words)), 1)
        logits = _summed(owners, self.weights[buckets], len(words)) / counts[:, None]
        letters = np.fromiter((any(map(str.isalpha, w)) for w in words), np.float32, len(words))
        return np.concatenate([_potentials(logits), letters[:, None]], 1).astype(np.float32)


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of the words' features, in word order."""
    owners, buckets = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for at in range(0, len(words), 50_000):
        owner, hashes, places = ngrams(words[at : at + 50_000], SIZES)
        order = np.argsort(owner, kind="stable")
        placed = mixed(hashes[order] + places[order].astype(np.uint64))
        owners.append((owner[order] + at).astype(np.int32))
        buckets.append((placed % np.uint64(BUCKETS)).astype(np.int32))
    return np.concatenate(owners), np.concatenate(buckets)


def _summed(group: np.ndarray, rows: np.ndarray, groups: int) -> np.ndarray:
    return np.stack([np.bincount(group, column, groups) for column in rows.T], 1)


def _potentials(logits: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(logits - logits.max(-1, keepdims=True), -_MOST_LOGIT))


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _even(rows: np.ndarray) -> np.ndarray:
    return rows / rows.sum(-1, keepdims=True)


def block_messages(
    emission: np.ndarray, valid: np.ndarray, step: np.ndarray, first: np.ndarray, last: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages, (blocks, places, labels), within blocks that go on from ``first`` and to ``last``.

    ``emission`` (blocks, places, labels) and ``step`` (labels, labels) are potentials; at places that are not ``valid`` the
    chain stands still.
    """
    forward, backward = np.empty_like(emission), np.empty_like(emission)
    now = first
    for k in range(emission.shape[1]):
        now = np.where(valid[:, k, None], _even((now @ step) * emission[:, k]), now)
        forward[:, k] = now
    now = last
    for k in reversed(range(emission.shape[1])):
        backward[:, k] = now
        now = np.where(valid[:, k, None], _even((now * emission[:, k]) @ step.T), now)
    return forward, backward


def marginals(emission: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Label probabilities of every word of chains laid end to end, given potentials."""
    labels = step.shape[0]
    per = -(-lengths // BLOCK)
    blocks = int(per.sum())
    if not blocks:
        return np.zeros((0, labels))
    chain = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(blocks) - np.repeat(np.cumsum(per) - per, per)
    begin = (np.cumsum(lengths) - lengths)[chain] + nth * BLOCK
    size = np.minimum(lengths[chain] - nth * BLOCK, BLOCK)
    valid = np.arange(BLOCK) < size[:, None]
    index = np.where(valid, begin[:, None] + np.arange(BLOCK), 0)
    framed = emission[index]

    transfer = np.broadcast_to(np.eye(labels), (blocks, labels, labels)).copy()
    for k in range(BLOCK):
        moved = (transfer @ step) * framed[:, k, None, :]
        moved /= moved.max((1, 2), keepdims=True)
        transfer = np.where(valid[:, k, None, None], moved, transfer)
    first, last = np.full((blocks, labels), 1 / labels), np.full((blocks, labels), 1 / labels)
    # blocks by their number within the chain: all chains advance together
    by_number = np.split(np.argsort(nth, kind="stable"), np.cumsum(np.bincount(nth))[:-1])
    for at in by_number[1:]:
        first[at] = _even(np.einsum("bi,bij->bj", first[at - 1], transfer[at - 1]))
    for at in reversed(by_number[1:]):
        last[at - 1] = _even(np.einsum("bij,bj->bi", transfer[at], last[at]))

    forward, backward = block_messages(framed, valid, step, first, last)
    return _even(forward * backward)[valid]


def train(texts: list[str], languages: list[str], steps: int = 240, rate: float = 0.4, batch: int = 48, length: int = 128) -> LanguageModel:
    """Adagrad on the conditional likelihood of code-switched chains of passages from ``texts``."""
    vocabulary: dict[str, int] = {}
    coded = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in tokens(t)), np.int32) for t in texts]
    names = sorted({own for c, own in zip(coded, languages) if len(c)})
    pools = [[c for c, own in zip(coded, languages) if own == name and len(c)] for name in names]
    weights = np.zeros((BUCKETS, len(names)), np.float32)
    transitions = np.zeros((len(names), len(names)))
    if len(names) < 2:
        return LanguageModel(names, weights, transitions)
    owners, buckets = _features(list(vocabulary))
    begin = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(vocabulary)))])
    del owners
    rng = np.random.default_rng(_SEED)

    def chained() -> tuple[np.ndarray, np.ndarray]:
        words, labels = np.empty(length, np.int64), np.empty(length, np.int64)
        filled = 0
        while filled < length:
            label = rng.integers(len(names))
            source = pools[label][rng.integers(len(pools[label]))]
            at = rng.integers(len(source))
            passage = source[at : at + rng.integers(8, 64)][: length - filled]
            words[filled : filled + len(passage)] = passage
            labels[filled : filled + len(passage)] = label
            filled += len(passage)
        return words, labels

    seen_w = np.full(weights.shape, 1e-6, np.float32)
    seen_t = np.full(transitions.shape, 1e-6)
    valid = np.ones((batch, length), bool)
    even = np.full((batch, len(names)), 1 / len(names))
    for _ in range(steps):
        words, gold = (np.stack(x) for x in zip(*[chained() for _ in range(batch)]))
        distinct, place = np.unique(words, return_inverse=True)
        place = place.reshape(words.shape)
        sizes = begin[distinct + 1] - begin[distinct]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        own = buckets[np.repeat(begin[distinct] - starts, sizes) + np.arange(sizes.sum())]
        logits = np.add.reduceat(weights[own], starts) / sizes[:, None]
        emission, step = _potentials(logits)[place], np.exp(transitions)
        forward, backward = block_messages(emission, valid, step, even, np.ones_like(even))
        error = _even(forward * backward)
        pairs = forward[:, :-1, :, None] * step * (emission * backward)[:, 1:, None, :]
        pairs /= pairs.sum((2, 3), keepdims=True)
        g_t = pairs.sum((0, 1))
        np.subtract.at(g_t, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        np.subtract.at(error.reshape(-1, len(names)), (np.arange(gold.size), gold.ravel()), 1)
        g_words = _summed(place.ravel(), error.reshape(-1, len(names)), len(distinct)) / sizes[:, None]
        g_w = _summed(own, np.repeat(g_words, sizes, axis=0), BUCKETS) / gold.size
        seen_w += g_w**2
        weights -= rate * g_w / np.sqrt(seen_w)
        g_t /= gold.size
        seen_t += g_t**2
        transitions -= rate * g_t / np.sqrt(seen_t)
    return LanguageModel(names, weights, transitions)


def labelled_sample(docs: DataFrame, allowed: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """About ``per_language`` (doc_id, text, lang) rows of each language among ``allowed`` rows with words and lang."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("text").rlike(_HAS_WORDS) & F.col("lang").isNotNull() & allowed)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    rank = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40))
    return known.filter(rank < share * F.lit(float(1 << 40)))


def fit(docs: DataFrame, allowed: Column, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Train on :func:`labelled_sample`, which alone comes to the driver."""
    sample = labelled_sample(docs, allowed, per_language).orderBy("lang", "doc_id", "text").toPandas()
    return train(sample["text"].tolist(), sample["lang"].tolist())


def detect_languages(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, ``lang_pred``, ``score`` and its ``segments``, runs of words of one most probable language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(shared.value)
        for batch in batches:
            langs, scores, runs = labeller(batch.column(1))
            columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(runs, _RUNS)]
            yield pa.record_batch(columns, names=["doc_id", "lang_pred", "score", "segments"])

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(
        lean(label),
        "doc_id long, lang_pred string, score double, segments array<struct<lang: string, first_word: int, n_words: int>>",
    )


def keep_determined(docs: DataFrame, model: LanguageModel, least_score: float, text: str = "text") -> DataFrame:
    """``docs`` without the documents that are ``und`` or whose language scores less than ``least_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(shared.value)
        for batch in batches:
            langs, scores, _ = labeller(batch.column(place), with_runs=False)
            yield batch.filter(pa.array([x != UNDETERMINED and y >= least_score for x, y in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)


class _Labeller:
    """Languages, scores and runs of a column of texts, by one model; words seen are remembered."""

    def __init__(self, model: LanguageModel):
        self.names, self.step = np.array([*model.languages, UNDETERMINED]), np.exp(model.transitions)
        self.labels = len(model.languages)
        self.known = WordScores(model.word_rows, self.labels + 1, CACHED_WORDS)

    def __call__(self, column: pa.Array, with_runs: bool = True) -> tuple[list[str], list[float], list[list[dict]]]:
        n, labels = len(column), self.labels
        if not labels:
            return [UNDETERMINED] * n, [0.0] * n, [[] for _ in range(n)]
        langs, scores, runs = [], [], []
        for texts in slices(column, tokens, SLICE_WORDS):
            flat, lengths = self.known.numbers(texts)
            rows = self.known.rows[flat]
            probable = marginals(rows[:, :labels].astype(np.float64), lengths, self.step)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            lettered = rows[:, labels] > 0
            totals = np.zeros((len(lengths), labels + 1))
            totals[:, :labels] = _summed(owner[lettered], probable[lettered], len(lengths))
            mass = totals.sum(1)
            best = np.where(mass > 0, totals.argmax(1), labels)
            langs.extend(self.names[best].tolist())
            scores.extend((totals[np.arange(len(best)), best] / np.maximum(mass, 1e-300)).tolist())
            if with_runs:
                runs.extend(_runs(probable.argmax(1), lengths, self.names))
        return langs, scores, runs


_RUNS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))


def _runs(labels: np.ndarray, lengths: np.ndarray, names: np.ndarray) -> list[list[dict]]:
    """Runs of equal labels in each chain."""
    out: list[list[dict]] = [[] for _ in lengths]
    if not len(labels):
        return out
    starts = np.cumsum(lengths) - lengths
    change = np.zeros(len(labels), bool)
    change[starts[lengths > 0]] = True
    change[1:] |= labels[1:] != labels[:-1]
    at = np.flatnonzero(change)
    owner = np.searchsorted(np.cumsum(lengths), at, side="right")
    for chain, first, end in zip(owner, at, np.append(at[1:], len(labels))):
        out[chain].append({"lang": names[labels[first]], "first_word": int(first - starts[chain]), "n_words": int(end - first)})
    return out
