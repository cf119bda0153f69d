"""Toxicity by averaged subword-bag embeddings under a linear softmax, trained in numpy.

A word is the mean of the embeddings of its hashed character n-grams and of itself, a passage of ``PASSAGE`` words the
mean of its words (a word's repeats within a passage and the places that a text's last passage lacks count as zero), and a
two-class softmax reads the passage. Embeddings and softmax are trained jointly by Adagrad, so unseen
spellings share the vectors of their n-grams. A document is scored whole and gets the score of its most toxic passage,
which keeps a few words in a very long text from being averaged away. Training begins with every passage under its document's label and goes on with the most toxic passage only; a fifth
of the sample is kept to place the threshold of best F1 at a score of 0.5.

Once trained, a bucket counts only by its embedding's product with the softmax weights, so tasks get one
number per bucket. Scoring is one pass without a shuffle.

Labels are learned from a bounded sample: about ``toxic`` and ``clean`` labelled documents of each class at most, chosen
by a hash of doc_id from all that the caller allows. Rows of one doc_id with both labels count as toxic; NULL labels and NULL
doc_ids are skipped. A NULL or empty text scores as the bias alone. Ties and repeats: equal texts score
equally. Without any labelled documents of both classes, every score is the share of the class there is (0.5 without any). Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.subwords import WordScores, ngrams, slices

SIZES = (3, 4, 5)
BUCKETS = 1 << 17
DIMENSIONS = 4
PASSAGE = 50
TOXIC_SAMPLE, CLEAN_SAMPLE = 1500, 4500
CACHED_WORDS = 300_000
_SEED = 20_24


@dataclass(frozen=True)
class ToxicityModel:
    """``weights[b]``: what bucket b adds to the logit of the toxic class; ``bias``: the logit without words."""

    weights: np.ndarray
    bias: float

    def word_logits(self, words: list[str]) -> np.ndarray:
        owners, buckets = _bucketed(words)
        counts = np.bincount(owners, minlength=len(words))
        sums = np.bincount(owners, weights=self.weights[buckets], minlength=len(words))
        return (sums / np.maximum(counts, 1)).astype(np.float32)[:, None]


def _bucketed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of the words' subwords, in word order."""
    owners, buckets = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for at in range(0, len(words), 50_000):
        owner, hashes, _ = ngrams(words[at : at + 50_000], SIZES)
        order = np.argsort(owner, kind="stable")
        owners.append((owner[order] + at).astype(np.int32))
        buckets.append((hashes[order] % np.uint64(BUCKETS)).astype(np.int32))
    return np.concatenate(owners), np.concatenate(buckets)


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def passage_words(flat: np.ndarray, lengths: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, word) for each distinct word of each passage, and the document of each passage.

    ``flat`` holds word numbers under ``known`` of documents laid end to end. A document without words has one passage.
    """
    per = np.maximum(-(-lengths // PASSAGE), 1)
    base = np.concatenate([[0], np.cumsum(per)[:-1]])
    within = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    passage = np.repeat(base, lengths) + within // PASSAGE
    pairs = np.unique(passage * max(known, 1) + flat)
    return pairs // max(known, 1), pairs % max(known, 1), np.repeat(np.arange(len(lengths)), per)


def train(texts: list[str], labels: np.ndarray, steps: int = 1000, rate: float = 0.2, batch: int = 48, warm: float = 0.5) -> ToxicityModel:
    """About ``steps`` Adagrad steps (8 to 40 epochs) on the cross entropy of each document's most toxic passage."""
    labels = np.asarray(labels, np.float64)
    if len(labels) == 0 or labels.min() == labels.max():
        share = min(max(labels.mean() if len(labels) else 0.5, 1e-3), 1 - 1e-3)
        return ToxicityModel(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    vocabulary: dict[str, int] = {}
    coded = [
        np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in tokens(t)), np.int32) for t in texts
    ]
    owners, buckets = _bucketed(list(vocabulary))
    first = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(vocabulary)))])
    del owners

    rng = np.random.default_rng(_SEED)
    everything = rng.permutation(len(coded))
    tuning, learning = np.split(everything, [len(coded) // 5])
    table = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    softmax = rng.uniform(-1, 1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_table = np.full((BUCKETS, DIMENSIONS), 1e-6, np.float32)
    seen_softmax, seen_bias = np.full_like(softmax, 1e-6), np.full_like(bias, 1e-6)
    batches = -(-len(learning) // batch)
    epochs = min(max(8, steps // batches), 40)
    for epoch in range(epochs):
        shuffled = rng.permutation(learning)
        for at in range(0, len(shuffled), batch):
            chosen = shuffled[at : at + batch]
            lengths = np.array([len(coded[i]) for i in chosen])
            flat = np.concatenate([coded[i] for i in chosen])
            if not len(flat):
                continue
            passage, word, document = passage_words(flat, lengths, len(vocabulary))
            distinct, place = np.unique(word, return_inverse=True)
            sizes = first[distinct + 1] - first[distinct]
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            index = np.repeat(first[distinct] - begins, sizes) + np.arange(sizes.sum())
            subwords = buckets[index]
            vectors = np.add.reduceat(table[subwords], begins) / sizes[:, None]
            means = _summed(passage, vectors[place], len(document)) / PASSAGE
            logits = means @ softmax + bias
            margin = logits[:, 1] - logits[:, 0]
            if epoch < warm * epochs:
                read, share = np.arange(len(document)), 1 / np.bincount(document)[document]
            else:
                read, share = _largest(margin, document, len(chosen)), np.ones(len(chosen))
            toxic = 1 / (1 + np.exp(-margin[read]))
            error = (toxic - labels[chosen][document[read]]) * share / len(chosen)
            both = np.stack([-error, error], 1)
            g_softmax, g_bias = means[read].T @ both, both.sum(0)
            pull = np.zeros((len(document), DIMENSIONS))
            pull[read] = both @ softmax.T / PASSAGE
            g_words = _summed(place, pull[passage], len(distinct)) / sizes[:, None]
            g_table = _summed(subwords, np.repeat(g_words, sizes, axis=0), BUCKETS)
            seen_table += g_table**2
            table -= rate * g_table / np.sqrt(seen_table)
            seen_softmax += g_softmax**2
            softmax -= rate * g_softmax / np.sqrt(seen_softmax)
            seen_bias += g_bias**2
            bias -= rate * g_bias / np.sqrt(seen_bias)
    model = ToxicityModel(table.astype(np.float64) @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0]))
    rows = model.word_logits(list(vocabulary))[:, 0]
    lengths = np.array([len(coded[i]) for i in tuning])
    flat = np.concatenate([coded[i] for i in tuning]) if len(tuning) else np.zeros(0, np.int64)
    margins = document_margins(flat, lengths, rows, model.bias)
    return ToxicityModel(model.weights, model.bias - best_threshold(margins, labels[tuning]))


def document_margins(flat: np.ndarray, lengths: np.ndarray, word_logits: np.ndarray, bias: float) -> np.ndarray:
    """The logit of each document's most toxic passage."""
    passage, word, document = passage_words(flat, lengths, len(word_logits))
    margins = np.bincount(passage, word_logits[word], len(document)) / PASSAGE + bias
    return margins[_largest(margins, document, len(lengths))]


def best_threshold(margins: np.ndarray, labels: np.ndarray, least: int = 5) -> float:
    """The cut of the best F1, midway to the next margin below; 0 with fewer than ``least`` of either class."""
    if min((labels == 1).sum(), (labels == 0).sum()) < least:
        return 0.0
    order = np.argsort(-margins)
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    cut = int(np.argmax(f1))
    below = margins[order[min(cut + 1, len(order) - 1)]]
    return float((margins[order[cut]] + below) / 2)


def _summed(group: np.ndarray, rows: np.ndarray, groups: int) -> np.ndarray:
    return np.stack([np.bincount(group, column, groups) for column in rows.T], 1)


def _largest(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The place of the largest value of each group (the first of equals); groups are contiguous."""
    order = np.lexsort((np.arange(len(values)), -values, group))
    return order[np.searchsorted(group[order], np.arange(groups))]


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, toxic: int = TOXIC_SAMPLE, clean: int = CLEAN_SAMPLE) -> DataFrame:
    """About ``toxic`` and ``clean`` (text, toxic) rows of the two classes, among ``allowed`` doc_ids of ``labels``.

    The labels are counted by class and each class is thinned by a hash of doc_id, so only bounded
    rows meet the documents. Of several texts under one doc_id the smallest is taken.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & allowed)
    classes = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in classes.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40))
    share = F.lit(0.0)
    for label, most in ((0, clean), (1, toxic)):
        share = F.when(F.col("toxic") == label, min(1.0, most / max(counts.get(label, 1), 1))).otherwise(share)
    thinned = classes.filter(F.col("toxic").isin(0, 1) & (rank < share * F.lit(float(1 << 40))))
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    # At most about toxic + clean rows, whatever the size of the tables.
    return texts.join(F.broadcast(thinned), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def score_documents(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = WordScores(model.word_logits, 1, CACHED_WORDS)
        for batch in batches:
            scores = [np.zeros(0)]
            for texts in slices(batch.column(1), tokens):
                flat, lengths = known.numbers(texts)
                best = document_margins(flat, lengths, known.rows[: len(known), 0], model.bias)
                scores.append(1 / (1 + np.exp(-np.clip(best, -500, 500))))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(scores), pa.float64())], names=["doc_id", "score"])

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(score, "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, **bounds: int) -> ToxicityModel:
    """Train on :func:`labelled_sample`, which alone comes to the driver."""
    sample = labelled_sample(docs, labels, allowed, **bounds).orderBy("doc_id").toPandas()
    return train(sample["text"].tolist(), sample["toxic"].to_numpy())
