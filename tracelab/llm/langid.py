"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL with elastic net."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, arrow_map, crc_mod, fitted, keep_rows, ngram_ids, small

SIZES, BUCKETS = (1, 2, 3), 1 << 15
#: The fitting sample: about so many documents of each language; with many languages fewer of each, so that the sample has
#: about so many documents, but never fewer than FEWEST of a language that has as many.
PER_LANGUAGE, SAMPLE, FEWEST = 600, 38_400, 30
#: Follow-the-regularised-leader: step, its smoothing, L1 and L2 penalties; passes, documents of a step.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
PASSES, BATCH = 3, 16
#: Term frequencies are shares of a document's n-grams; this scales them.
SCALE = 20.0
#: The share of the sample that the temperature is fitted on.
HELD = 5


def letters(word: str) -> str:
    """The lower-cased letters of a word: digits and signs say nothing of a language."""
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


@dataclass
class Model:
    """Weights of n-gram buckets by language with their IDF multiplied in, biases and the temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def word_sums(self, words: list[str]) -> np.ndarray:
        """Per raw word: its n-grams' weights summed, by language, and their number. Sums over a document's words make its
        logits, as TF-IDF with relative frequencies is linear in the words."""
        ids, owner = ngram_ids([letters(w) for w in words], SIZES, BUCKETS, whole=False)
        has = np.array([bool(letters(w)) for w in words], bool)
        ids, owner = ids[has[owner]], owner[has[owner]]
        sums = [np.bincount(owner, self.weights[ids, k], minlength=len(words)) for k in range(len(self.languages))]
        return np.stack([*sums, np.bincount(owner, minlength=len(words)).astype(float)], axis=1)

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        logits = (SCALE * sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias) / self.temperature
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's n-gram buckets and their shares of its n-grams, in 6 bytes for each."""
    words = Counter(letters(w) for w in text.split())
    words.pop("", None)
    ids, owner = ngram_ids(list(words), SIZES, BUCKETS, whole=False)
    counts = np.bincount(ids, np.fromiter(words.values(), float, len(words))[owner], minlength=BUCKETS)
    own = np.flatnonzero(counts)
    return own.astype(np.uint16), (counts[own] / max(1.0, counts.sum())).astype(np.float32)


def fit(rows: Iterable[tuple[str, str]], seed: int = 3) -> Model | None:
    """Trains on all but a part of the sample (text and language) and calibrates the temperature on that part.

    A text is turned into its features as it comes, so no more than one text is held. None without a language.
    """
    docs, langs = [], []
    for text, lang in rows:
        docs.append(features(text))
        langs.append(lang)
    languages = sorted(set(langs))
    if not languages:
        return None
    df = np.bincount(np.concatenate([d[0] for d in docs]), minlength=BUCKETS)
    idf = np.log((1 + len(docs)) / (1 + df)) + 1
    number = {x: k for k, x in enumerate(languages)}
    code = np.array([number[x] for x in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs))
    held, learnt = order[: len(order) // HELD], order[len(order) // HELD :]
    # a language whose documents are all held out gives one back
    lost = np.flatnonzero(~np.isin(code[held], code[learnt]))
    lost = lost[np.unique(code[held][lost], return_index=True)[1]]
    held, learnt = np.delete(held, lost), np.r_[learnt, held[lost]]
    shape = (BUCKETS + 1, len(languages))  # the last row is the bias, always 1
    z, n = np.zeros(shape), np.zeros(shape)

    def leader(rows: np.ndarray) -> np.ndarray:
        """The weights that minimise the linearised losses so far with the elastic net."""
        shrunk = np.sign(z[rows]) * np.maximum(np.abs(z[rows]) - np.where(rows == BUCKETS, 0, L1)[:, None], 0)
        return -shrunk / ((BETA + np.sqrt(n[rows])) / ALPHA + L2)

    for _ in range(PASSES):
        for batch in np.array_split(rng.permutation(learnt), max(1, len(learnt) // BATCH)):
            rows, where = np.unique(np.concatenate([docs[i][0] for i in batch]), return_inverse=True)
            rows = np.r_[rows, BUCKETS]
            x = np.zeros((len(batch), len(rows)))
            x[np.repeat(np.arange(len(batch)), [len(docs[i][0]) for i in batch]), where] = np.concatenate([docs[i][1] for i in batch])
            x[:, :-1] *= SCALE * idf[rows[:-1]]
            x[:, -1] = 1
            w = leader(rows)
            logits = x @ w
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), code[batch]] -= 1
            g = x.T @ p
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / ALPHA
            z[rows] += g - sigma * w
            n[rows] += g * g
    w = leader(np.arange(BUCKETS + 1))
    model = Model(languages, w[:-1] * idf[:, None], w[-1], 1.0)
    if len(held):
        sums = np.stack([np.r_[(model.weights[i] * x[:, None]).sum(0), 1.0] for i, x in (docs[k] for k in held)])
        losses = {}
        for t in np.geomspace(0.05, 20, 80):
            model.temperature = float(t)
            losses[float(t)] = -np.log(np.maximum(model.probabilities(sums)[np.arange(len(held)), code[held]], 1e-12)).mean()
        model.temperature = min(losses, key=losses.get)
    return model


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The fitting sample, columns id, text and lang: of each language, the documents whose ids hash below the share that
    leaves about PER_LANGUAGE, or fewer where there are many languages; twice that many at most, the lowest first.

    Learnable: crc32 of the id's text modulo 5 is not 0, text and language not null."""
    usable = docs.where((crc_mod(F.col(id_col), 5) != 0) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = usable.groupBy(F.col(lang_col).alias("lang")).count().orderBy("lang").collect()
    per = min(PER_LANGUAGE, max(FEWEST, SAMPLE // max(1, len(counts))))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per / r["count"])) for r in counts], "of string, share double")
    usable = usable.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = usable.join(F.broadcast(shares), F.col("lang") == F.col("of"))  # one row for each language
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    return usable.where(place < F.col("share")).select("id", "text", "lang").orderBy(F.xxhash64("id"), "id", "text").limit(2 * per * len(counts))


def model_of(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> Model | None:
    """The model of the sample, fitted by an executor."""
    return fitted(sample(docs, id_col, text_col, lang_col), lambda rows: fit((text, lang) for _, text, lang in rows))


def predictor(model: Model | None) -> Callable[[list[str]], tuple[list[str], np.ndarray]]:
    """A function from whole texts to languages and scores; it keeps its words' sums between calls."""
    known = WordTable(model.word_sums, len(model.languages) + 1) if model else None

    def of(texts: list[str]) -> tuple[list[str], np.ndarray]:
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if model and texts:
            sums = known.sums([Counter(t.split()) for t in texts])
            p = model.probabilities(sums)
            for k in np.flatnonzero(sums[:, -1] > 0):
                langs[k], scores[k] = model.languages[p[k].argmax()], p[k].max()
        return langs, scores

    return of


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, lang_pred and score (the calibrated probability of lang_pred).

    Every whole text is read; a block's distinct words get their sums once. A text that is null or has no letter is `und`
    with score 0, as is every text where nothing could be learnt. Null and repeated ids pass through; a null id isn't held
    out. Other columns are not carried; the prediction depends on the text alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = predictor(model)
        for batch in small(batches):
            langs, scores = own(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = arrow_map(rows, run, f"id {kind}, lang_pred string, score double")
    held = F.coalesce(crc_mod(F.col("id"), 5) == 0, F.lit(False))
    return rows.select(F.col("id").alias(id_col), held.alias("held_out"), "lang_pred", "score")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on the sample and predicts the language of every document."""
    return predict(docs, model_of(docs, id_col, text_col, lang_col), id_col, text_col)


def reject(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that are `und` or whose language is less likely than `least`, all columns kept."""
    model = model_of(docs, id_col, text_col, lang_col)

    def accept() -> Callable[[list[str]], np.ndarray]:
        own = predictor(model)

        def good(texts: list[str]) -> np.ndarray:
            langs, scores = own(texts)
            return np.array([x != "und" for x in langs], bool) & (scores >= least)

        return good

    return keep_rows(docs, text_col, accept)
