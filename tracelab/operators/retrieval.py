"""Retrieval over a sample's own pool of chunks: BM25, dense vectors, and how much gold is found."""

from __future__ import annotations

import functools
import itertools
import math
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.text import words
from ..sources.storage import stored

#: Fixed values of the Okapi variant: saturation, length weight, and the share of the mean IDF that negative ones get.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: What words() takes as a word, for Python.
_WORD = re.compile(r"\w+")


def bm25(queries: DataFrame, chunks: DataFrame, top: int = 5) -> DataFrame:
    """The top chunks of each sample's pool: sample_id, rank, chunk_id, score.

    queries: sample_id, question. chunks: sample_id, ordinal, chunk_id, text. Statistics are those of the sample's pool;
    empty chunks count in its size, and pools without a token give nothing. Query tokens count as often as they occur. Scores
    may be negative and aren't filtered. Equal scores (to nine digits) keep the chunks' order.

    Texts are read once, into a stored row for each chunk and different term; they are counted where they are read. What
    follows are joins and sums by sample and term, or by chunk: no pool's words meet in one row or task, however large it is.
    Of the stored rows those of asked terms alone are joined; all others are only counted.
    """
    own = chunks.select(F.monotonically_increasing_id().alias("row"), "sample_id", "ordinal", "chunk_id", words(F.col("text")).alias("w"))
    chunk = ["row", "sample_id", "ordinal", "chunk_id", "dl"]
    tf = stored(_terms(own.select("row", "sample_id", "ordinal", "chunk_id", F.size("w").alias("dl"), "w")), "terms")
    every = tf.select(*chunk).distinct()
    pool = every.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).where("avgdl > 0")
    df = tf.where("term is not null").groupBy("sample_id", "term").agg(F.count(F.lit(1)).alias("df"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    asked = queries.select("sample_id", F.explode(words(F.col("question"))).alias("term")).groupBy("sample_id", "term").agg(F.count(F.lit(1)).alias("times"))
    known = df.join(pool, "sample_id").withColumn("raw", raw)
    mean = known.groupBy("sample_id").agg(F.avg("raw").alias("mean"))
    weight = F.col("times") * F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    weights = known.join(asked, ["sample_id", "term"]).join(mean, "sample_id").select("sample_id", "term", "avgdl", weight.alias("weight"))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = tf.join(asked.select("sample_id", "term"), ["sample_id", "term"]).select("row", "sample_id", "term", "dl", "tf")
    found = hits.join(weights, ["sample_id", "term"]).groupBy("row").agg(F.sum(part).alias("score"))
    asking = queries.select("sample_id").join(pool.select("sample_id"), "sample_id", "left_semi")
    scored = every.join(asking, "sample_id").join(found, "row", "left").select("sample_id", "ordinal", "chunk_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return _ranked(scored, top)


def _terms(rows: DataFrame) -> DataFrame:
    """rows with their words w counted: a row for each different term, with tf, or one without a term where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                counts = [Counter(w) or {None: 0} for w in part.column(part.num_columns - 1).to_pylist()]
                take = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]))
                terms = pa.array([t for c in counts for t in c], pa.string())
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in part.columns[:-1]), terms, pa.array([n for c in counts for n in c.values()], pa.int64())], names)

    names = [*rows.columns[:-1], "term", "tf"]
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], *StructType.fromDDL("term string, tf long").fields]))


def _okapi(question: str, texts: list[str], top: int) -> list[tuple[int, int, float]]:
    """Rank, place and score of the best texts of a pool."""
    chunks = [_WORD.findall((t or "").lower()) for t in texts]
    total, n = sum(map(len, chunks)), len(chunks)
    if not total:
        return []
    df = Counter(itertools.chain.from_iterable(map(set, chunks)))
    raw = lambda d: math.log(n - d + 0.5) - math.log(d + 0.5)
    mean = sum(raw(d) * times for d, times in Counter(df.values()).items()) / len(df)
    weights = {t: times * (raw(df[t]) if raw(df[t]) >= 0 else EPSILON * mean) for t, times in Counter(_WORD.findall((question or "").lower())).items() if t in df}
    scores = []
    for w in chunks:
        found = Counter(filter(weights.__contains__, w))
        flat = K1 * (1 - B + B * len(w) * n / total)
        scores.append(sum(weights[t] * tf * (K1 + 1) / (tf + flat) for t, tf in found.items()))
    order = sorted(range(n), key=lambda i: (-round(scores[i], 9), i))[:top]
    return [(k, i, scores[i]) for k, i in enumerate(order, 1)]


def with_bm25(rows: DataFrame, question_col: str, pool_col: str, top: int = 5) -> DataFrame:
    """rows with a column ranked: bm25() for pools that are arrays in their samples' rows (structs with a text, in order), as
    an array of rank, at (the chunk's place in the pool, from 0) and score. Rows stream through Arrow batches and nothing is
    shuffled. A pool that is too large for a row goes by bm25()."""
    names = [*rows.columns, "ranked"]
    at = [rows.columns.index(c) for c in (question_col, pool_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                pools = part.column(at[1])
                texts = pools.flatten().field("text").to_pylist()
                ends = np.cumsum([len(x) if x.is_valid else 0 for x in pools]).tolist()
                found = [_okapi(q, texts[a:b], top) for q, a, b in zip(part.column(at[0]).to_pylist(), [0, *ends], ends, strict=False)]
                columns = zip(*itertools.chain.from_iterable(found), strict=True) if any(found) else [()] * 3
                values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["rank", "at", "score"])
                counts = pa.array(np.r_[0, np.cumsum([len(x) for x in found])], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(counts, values)], names)

    ranked = ArrayType(StructType.fromDDL("rank int, at int, score double"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("ranked", ranked)]))


def dense(queries: DataFrame, chunks: DataFrame, top: int = 5) -> DataFrame:
    """The top chunks of each sample's pool by cosine. queries: sample_id, vector. chunks: sample_id, ordinal, chunk_id,
    vector. Vectors are normalised first (zero vectors stay); equal scores keep the chunks' order."""
    norm = lambda v: F.nullif(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))), F.lit(0.0))
    unit = lambda v: F.transform(v, lambda x: F.coalesce(x.cast("double") / norm(v), F.lit(0.0)))
    q = queries.select("sample_id", unit(F.col("vector")).alias("q"))
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    both = chunks.select("sample_id", "ordinal", "chunk_id", unit(F.col("vector")).alias("v")).join(q, "sample_id")
    return _ranked(both.select("sample_id", "ordinal", "chunk_id", dot.alias("score")), top)


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("sample_id").orderBy(F.desc(F.round("score", 9)), "ordinal")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("sample_id", "rank", "chunk_id", "score")


METHODS: dict[str, Callable[..., DataFrame]] = {"bm25": bm25, "dense": dense}


def search(method: str, queries: DataFrame, chunks: DataFrame, top: int = 5) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown retrieval method: {method}")
    return METHODS[method](queries, chunks, top)


def sentence_transformer(name: str) -> Callable[[list[str]], list[list[float]]]:
    """A model of the sentence-transformers library, which a worker loads where it is installed."""
    from sentence_transformers import SentenceTransformer

    model = SentenceTransformer(name)
    return lambda texts: model.encode(texts, normalize_embeddings=True).tolist()


ENCODERS: dict[str, Callable[[], Callable[[list[str]], list[list[float]]]]] = {}


def register_encoder(name: str, encoder: Callable[[], Callable[[list[str]], list[list[float]]]]) -> None:
    """Adds an encoder under a model's name."""
    ENCODERS[name] = encoder


def encoder_of(name: str) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """The encoder that is registered under a name, or else the sentence-transformers model of that name."""
    return ENCODERS.get(name) or functools.partial(sentence_transformer, name)


_MODELS: dict[tuple, Callable] = {}


def _model(encoder: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[list[str]], list[list[float]]]:
    """What encoder() gives: made once in a worker's life if encoder is a function of a module, or one with arguments (partial),
    else once a task."""
    own = encoder.func if isinstance(encoder, functools.partial) else encoder
    if getattr(sys.modules.get(own.__module__), getattr(own, "__name__", ""), None) is not own:
        return encoder()
    key = (own, *getattr(encoder, "args", ()))
    if key not in _MODELS:
        _MODELS[key] = encoder()
    return _MODELS[key]


def encoded(texts: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], text_col: str = "text") -> DataFrame:
    """texts with a column vector. encoder() gives a function over lists of texts, which a worker keeps (see _model)."""
    names, at = [*texts.columns, "vector"], texts.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _model(encoder)
        for batch in batches:
            vectors = encode([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float64()))], names)

    return texts.mapInArrow(run, StructType([*texts.schema.fields, StructField("vector", ArrayType(DoubleType()))]))


def evaluate(gold: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per sample of gold (sample_id, gold_ids): recall_at_k, hit_at_k and n_gold_chunks; null scores without gold."""
    found = retrieved.groupBy("sample_id").agg(F.collect_set("chunk_id").alias("found"))
    rows = gold.join(found, "sample_id", "left").withColumn("gold_ids", F.array_distinct("gold_ids"))
    hits = F.size(F.array_intersect("gold_ids", F.coalesce("found", F.array().cast("array<string>"))))
    n = F.nullif(F.size("gold_ids"), F.lit(0))
    return rows.select("sample_id", (hits / n).alias("recall_at_k"), F.when(n.isNotNull(), (hits > 0).cast("int")).alias("hit_at_k"), F.size("gold_ids").alias("n_gold_chunks"))


def summary(evaluated: DataFrame) -> DataFrame:
    """Means over the samples with gold."""
    return evaluated.agg(F.count(F.lit(1)).alias("samples"), F.count("hit_at_k").alias("with_gold"), F.avg("recall_at_k").alias("recall_at_k"), F.avg("hit_at_k").alias("hit_at_k"))
