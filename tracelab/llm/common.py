"""What the operators of this subpackage share: tables, shared storage, hashing of rows, word tables."""

from __future__ import annotations

import itertools
import pickle
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: list[str] = []

#: Arrow batches of texts on their way to Python hold about so many bytes at most: Spark's 10,000 rows or 64 MB, twice a task in
#: the JVM and once in Python, are most of what a task holds.
BATCH_BYTES = 4 << 20
#: Words whose n-grams are hashed at once; one word takes about 2 KB while it is hashed.
WORDS_AT_ONCE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, read through Spark (any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder in spark.checkpoint.dir. Where that is unset, a local session (one machine) uses
    its warehouse; on a cluster a folder must be named, since executors don't see each other's disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    _OWN.append(f"{base.rstrip('/')}/tracelab/{name}-{uuid.uuid4().hex}")
    return _OWN[-1]


def clean(spark: SparkSession) -> None:
    """Removes the tables that this process has written; results that read them can't be read again."""
    while _OWN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_OWN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder. It cuts the lineage: a lost executor costs no recomputation,
    and values such as monotonically_increasing_id() are the same for every later reader."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(keys: DataFrame, most: int = 32_000_000) -> DataFrame:
    """A written table, to be broadcast if it has so many bytes at most: 8 for each number and those of its texts. Beyond
    that the join is a shuffle, with the same result."""
    texts = [F.sum(F.coalesce(F.octet_length(c), F.lit(0))) for c, kind in keys.dtypes if kind in ("string", "binary")]
    rows, *lengths = keys.agg(F.count(F.lit(1)), *texts).first()
    return F.broadcast(keys) if 8 * rows * len(keys.columns) + sum(x or 0 for x in lengths) <= most else keys


def fitted(sample: DataFrame, fit: Callable[[Iterable[tuple]], Any]) -> Any:
    """What `fit` makes of the rows of a bounded sample (tuples, in the order of the columns), in one task of an executor.

    Rows are sorted by Spark and streamed, so `fit` holds only what it keeps of them; the model's bytes alone come to the
    driver. A lost executor costs another run of the task, with the same rows in the same order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in small(batches, 64) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    # an empty table may have no partition at all
    row = sample.repartition(1).sortWithinPartitions(*sample.columns)
    row = arrow_map(row, run, "model binary").first()
    return pickle.loads(row.model) if row else fit(())


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: Any) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of about BATCH_BYTES, however long the rows are.

    Spark has this limit for a session alone and reads it when it plans, which may be after this call: so the session keeps it.
    A lower limit that the session has stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key)) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of the value's text modulo mod (null stays null)."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(mod)


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def small(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches in slices: word frequencies of a slice's texts are all that is held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def keep_rows(docs: DataFrame, text_col: str, accept: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """The rows of docs, with all their columns, whose whole text the accepting function takes (a null text counts as empty).

    accept() is called once a task and gives a function from texts to booleans. Rows are filtered where they are read: no
    shuffle, repeated rows and null ids are judged row by row.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = accept()
        for batch in small(batches):
            yield batch.filter(pa.array(good([t or "" for t in batch.column(at).to_pylist()]), pa.bool_()))

    return arrow_map(docs, run, docs.schema)


class WordTable:
    """Rows of numbers by word, computed once per distinct word of a worker and kept up to `keep` words.

    `compute` maps a list of words to an array with a row for each. The first `keep` words met stay for the life of the
    worker (frequent words are met early); later words are computed once per call. A word's row is a place in one array, so
    memory is bounded by `keep` words and as many rows.
    """

    def __init__(self, compute: Callable[[Sequence[str]], np.ndarray], width: int, keep: int = 150_000):
        self.compute, self.keep, self.places, self.rows = compute, keep, {}, np.zeros((1024, width))

    def sums(self, freqs: Sequence[Counter]) -> np.ndarray:
        """A row for each document: the sum of its words' rows times their frequencies."""
        places, held = self.places, len(self.places)
        new = [w for w in set().union(*freqs) if w not in places]
        if new:
            if held + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((held + len(new), self.rows.shape[1]))])
            for at in range(0, len(new), WORDS_AT_ONCE):
                some = new[at : at + WORDS_AT_ONCE]
                self.rows[held + at : held + at + len(some)] = np.reshape(self.compute(some), (len(some), -1))
            places.update(zip(new, range(held, held + len(new)), strict=True))
        sizes = np.fromiter(map(len, freqs), np.int64, len(freqs))
        at = np.fromiter(map(places.__getitem__, itertools.chain.from_iterable(freqs)), np.int64, sizes.sum())
        times = np.fromiter(itertools.chain.from_iterable(f.values() for f in freqs), float, len(at))
        out = np.zeros((len(freqs), self.rows.shape[1]))
        if len(at):
            some = sizes > 0
            out[some] = np.add.reduceat(self.rows[at] * times[:, None], (np.cumsum(sizes) - sizes)[some])
        if len(places) > self.keep:
            for w in new:
                del places[w]
        return out


def ngram_ids(words: Sequence[str], sizes: Sequence[int], buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of "<word>" for every word: bucket numbers and the index of the word of each.

    All words are hashed in one pass over one array of code points; n-grams that reach over a word's end are masked.
    whole: adds a feature for the entire word.
    """
    marked = "".join(f"\x02{w}\x03" for w in words)
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(points))
    ids, of = [], []
    key = np.zeros(len(points), np.uint64)
    for n in range(1, max(sizes) + 1):
        key = key[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        if n in sizes and len(key):
            ok = at[: len(key)] + n <= ends[: len(key)]
            ids.append(key[ok])
            of.append(owner[: len(key)][ok])
    if whole and len(words):
        weights = points * (at - (ends - np.repeat(lengths, lengths)) + 31).astype(np.uint64) ** np.uint64(3)
        ids.append(np.add.reduceat(weights * np.uint64(0x9E3779B97F4A7C15), np.cumsum(lengths) - lengths) + np.uint64(977))
        of.append(np.arange(len(words)))
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.concatenate(ids)
    key ^= key >> np.uint64(33)
    key *= np.uint64(0xFF51AFD7ED558CCD)
    key ^= key >> np.uint64(29)
    return (key % np.uint64(buckets)).astype(np.int64), np.concatenate(of)


def word_ngrams(words: Sequence[str], sizes: Sequence[int], buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """As ngram_ids, word after word and with the number of each word's n-grams; WORDS_AT_ONCE words are hashed at once, so
    what is held beside the result doesn't grow with the words."""
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(words), WORDS_AT_ONCE):
        some = words[at : at + WORDS_AT_ONCE]
        own, owner = ngram_ids(some, sizes, buckets, whole)
        ids.append(own[np.argsort(owner, kind="stable")].astype(np.int32))
        counts.append(np.bincount(owner, minlength=len(some)))
    return np.concatenate(ids), np.concatenate(counts)
