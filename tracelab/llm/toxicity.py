"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, arrow_map, crc_mod, fitted, keep_rows, ngram_ids, small, word_ngrams

#: Character n-grams of a word, buckets of their embeddings, dimensions.
SIZES, BUCKETS, DIM = (3, 4, 5), 1 << 18, 8
#: An n-gram is learnt if it stands in so many documents of the sample; others have no embedding. Small samples take less.
LEAST_DOCS = 12
#: At most so many labelled documents of each class are learnt from (the bound of the fitting sample).
PER_CLASS = 1200
STEPS, BATCH, START = 160, 100, 100.0
#: Step sizes and weight decays of the embeddings, the linear layer and its bias.
RATES, DECAYS = (0.003, 0.5, 0.05), (0.1, 0.0, 0.0)
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def normal(word: str) -> str:
    """A word as the model sees it: lower case, without ASCII punctuation at its ends."""
    return word.lower().strip(EDGES)


@dataclass
class Model:
    """Embeddings of the learnt n-grams (slots: bucket to row, the last row is zero), the linear layer's difference between
    the classes, and its bias."""

    slots: np.ndarray
    embeddings: np.ndarray
    direction: np.ndarray
    bias: float

    def word_logits(self, words: list[str]) -> np.ndarray:
        """Per raw word: its part of the logit, and 1 (0 and 0 if nothing is left of it). The layers are linear, so a
        document's logit is the mean of its words' parts."""
        plain = [normal(w) for w in words]
        ids, owner = ngram_ids(plain, SIZES, BUCKETS, whole=True)
        n = np.bincount(owner, minlength=len(words))
        part = np.bincount(owner, (self.embeddings @ self.direction)[self.slots[ids]], minlength=len(words)) / np.maximum(n, 1)
        real = np.array([w != "" for w in plain], float)
        return np.stack([part * real, real], axis=1)


def fit(rows: Iterable[tuple[str, int]], seed: int = 5) -> Model:
    """Trains embeddings and softmax jointly by Adam on the cross-entropy of mini-batches of documents (text and label).

    A text is turned into the frequencies of its words as it comes, so no more than one text is held.
    """
    rng = np.random.default_rng(seed)
    numbers: dict[str, int] = {}
    docs, labels = [], []
    for text, label in rows:
        labels.append(label)
        freq: Counter = Counter()
        for w, n in Counter(text.split()).items():
            if plain := normal(w):
                freq[numbers.setdefault(plain, len(numbers))] += n
        docs.append((np.fromiter(freq.keys(), np.int64, len(freq)), np.fromiter(freq.values(), float, len(freq))))
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.int32), np.zeros((1, DIM)), np.zeros(DIM), 0.0 if not labels else (6.0 if labels[0] else -6.0))
    ids, per_word = word_ngrams(list(numbers), SIZES, BUCKETS, whole=True)
    begins = np.cumsum(per_word) - per_word
    spread = np.zeros(BUCKETS, np.int64)
    toxic = np.zeros(BUCKETS, np.int64)
    for (words, _), label in zip(docs, labels, strict=True):
        n = per_word[words]
        own = np.unique(ids[np.repeat(begins[words] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        spread[own] += 1
        toxic[own] += label
    least = max(2, min(LEAST_DOCS, len(docs) // 80))
    learnt = np.flatnonzero(spread >= least)
    slots = np.full(BUCKETS, len(learnt), np.int32)
    slots[learnt] = np.arange(len(learnt))
    kept = spread[ids] >= least
    ids, sizes, per_word = slots[ids[kept]], np.maximum(per_word, 1), np.bincount(np.repeat(np.arange(len(numbers)), per_word)[kept], minlength=len(numbers))
    begins = np.cumsum(per_word) - per_word
    target = np.eye(2)[np.array(labels)]
    weight = (len(labels) / 2 / np.bincount(labels, minlength=2))[np.array(labels)]  # both classes weigh the same
    table, weights, bias = (rng.random((len(learnt), DIM)) - 0.5) / DIM / 100, rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    # the first dimension starts at the n-gram's log odds of the classes, less 2.5 standard errors
    of_class, yes, no = np.bincount(labels, minlength=2), toxic[learnt] + 0.5, (spread - toxic)[learnt] + 0.5
    odds = np.log(yes / (of_class[1] + 1)) - np.log(no / (of_class[0] + 1))
    table[:, 0] = np.sign(odds) * np.maximum(0, np.abs(odds) - 2.5 * np.sqrt(1 / yes + 1 / no))
    weights[0] = -START, START
    params = [table, weights, bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    usable = np.array([i for i, (w, _) in enumerate(docs) if len(w)])
    while step < STEPS and len(usable):
        for batch in np.array_split(rng.permutation(usable), max(1, len(usable) // BATCH)):
            words, where = np.unique(np.concatenate([docs[i][0] for i in batch]), return_inverse=True)
            share = np.concatenate([docs[i][1] / docs[i][1].sum() for i in batch])
            doc = np.repeat(np.arange(len(batch)), [len(docs[i][0]) for i in batch])
            n = per_word[words]
            sub_of = np.repeat(np.arange(len(words)), n)
            sub = ids[np.repeat(begins[words] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            # a dimension at a time: the n-grams' rows of all dimensions would take eight times as much
            columns = lambda index, values, size: np.stack([np.bincount(index, values(k), minlength=size) for k in range(DIM)], axis=1)
            vectors = columns(sub_of, lambda k: table[sub, k], len(words)) / sizes[words][:, None]
            pooled = columns(doc, lambda k: vectors[where, k] * share, len(batch))
            logits = pooled @ weights + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target[batch]) * weight[batch, None] / len(batch)
            to_docs = g @ weights.T
            to_words = columns(where, lambda k: to_docs[doc, k] * share, len(words)) / sizes[words][:, None]
            grads = [columns(sub, lambda k: to_words[sub_of, k], len(table)), pooled.T @ g, g.sum(0)]
            step += 1
            for q, dq, m, v, rate, decay in zip(params, grads, first, second, RATES, DECAYS, strict=True):
                m += 0.1 * (dq - m)
                v += 0.01 * (dq * dq - v)
                q -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) + decay * q)
    return Model(slots, np.r_[table, np.zeros((1, DIM))], weights[:, 1] - weights[:, 0], float(bias[1] - bias[0]))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fitting sample, columns id, text and toxic: of each class, the PER_CLASS learnable documents whose ids hash lowest.

    Learnable: crc32 of the id's text modulo 3 is not 1, and neither label nor text is null. Of repeated labels the higher
    counts, of repeated ids the smallest text.
    """
    usable = labels.where((crc_mod(F.col(id_col), 3) != 1) & F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("of")).agg(F.max("toxic").cast("int").alias("toxic"))
    lowest = lambda c: usable.where(F.col("toxic") == c).orderBy(F.xxhash64("of"), "of").limit(PER_CLASS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(lowest(0).union(lowest(1))), F.col("id") == F.col("of"))  # 2 * PER_CLASS ids
    return rows.groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def model_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> Model:
    """The model of the labelled sample, fitted by an executor."""
    return fitted(labelled(docs, labels, id_col, text_col), lambda rows: fit((text, label) for _, text, label in rows))


def scorer(model: Model) -> Callable[[list[str]], np.ndarray]:
    """A function from whole texts to probabilities of label 1; it keeps its words' parts between calls."""
    known = WordTable(model.word_logits, 2)

    def of(texts: list[str]) -> np.ndarray:
        sums = known.sums([Counter(t.split()) for t in texts])
        logits = model.bias + sums[:, 0] / np.maximum(sums[:, 1], 1)
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))

    return of


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score (probability of label 1) and predicted (1 if score >= threshold).

    Every whole text is read; a block's distinct words get their part of the logit once. A text without words, null
    included, scores by the bias alone. Null and repeated ids pass through, a null id isn't held out. Other columns are
    not carried; the score depends on the text alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(model)
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own(batch.column(1).to_pylist()))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = arrow_map(rows, run, f"id {kind}, score double")
    held = F.coalesce(crc_mod(F.col("id"), 3) == 1, F.lit(False))
    return rows.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fits on the labelled sample and scores all documents; without labels of both classes the score is constant."""
    return score(docs, model_of(docs, labels, id_col, text_col), threshold, id_col, text_col)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are predicted toxic, all columns kept. The model is fitted as in toxicity()."""
    model = model_of(docs, labels, id_col, text_col)

    def accept() -> Callable[[list[str]], np.ndarray]:
        own = scorer(model)
        return lambda texts: own(texts) < threshold

    return keep_rows(docs, text_col, accept)
