"""What tasks hold of long texts and of many words is bounded."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tracelab.llm import common, langid, simhash, toxicity

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def limit(spark):
    old = spark.conf.get(KEY)
    yield lambda value: spark.conf.set(KEY, value)
    spark.conf.set(KEY, old)


def test_texts_come_in_small_batches(spark, limit):
    """One task reads 40 MB of texts; the Arrow memory of its Python worker stays near the limit of a batch."""
    limit("64m")
    docs = spark.range(0, 4000, 1, 1).selectExpr("id doc_id", "repeat('abcde ghi ', 1000) || id text")

    def accept():
        def good(texts):
            held = pa.total_allocated_bytes()
            if held > 16_000_000:
                raise MemoryError(f"{held} bytes of Arrow batches")
            return np.array([not t.endswith("7") for t in texts])

        return good

    assert common.keep_rows(docs, "text", accept).count() == 3600


@pytest.mark.parametrize("maker", [lambda d: simhash.fingerprints(d, "doc_id", "text"), lambda d: toxicity.score(d, toxicity.fit(())), lambda d: langid.predict(d, None)])
def test_every_operator_bounds_its_batches(spark, limit, maker):
    docs = spark.createDataFrame([(1, "a b c d"), (2, None)], "doc_id long, text string")
    limit("64m")
    assert maker(docs).count() == 2 and int(spark.conf.get(KEY).rstrip("b")) == common.BATCH_BYTES
    limit("1m")
    assert maker(docs).count() == 2 and spark.conf.get(KEY) == "1m"  # a lower limit is the session's choice


def test_words_are_hashed_in_parts(monkeypatch):
    """Word after word the same n-grams, in whatever parts; what is held meanwhile is a part's."""
    rng = np.random.default_rng(4)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(0, 12, 9000)] + ["", "ünï", "\U0001f600x"]
    ids, owner = common.ngram_ids(words, (3, 4, 5), 1 << 18, True)
    order = np.argsort(owner, kind="stable")
    for parts in (1 << 20, 700):
        monkeypatch.setattr(common, "WORDS_AT_ONCE", parts)
        got, counts = common.word_ngrams(words, (3, 4, 5), 1 << 18, True)
        assert np.array_equal(got, ids[order]) and np.array_equal(counts, np.bincount(owner, minlength=len(words)))
        table = common.WordTable(lambda some: np.array([[len(w)] for w in some], float), 1)
        assert table.sums([{w: 1 for w in words}])[0, 0] == sum(map(len, set(words)))
    assert [len(x) for x in common.word_ngrams([], (3,), 8, True)] == [0, 0]


def test_fit_of_many_words(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(toxicity, "STEPS", 3)
    docs = [(" ".join("".join(map(chr, rng.integers(97, 123, 9))) for _ in range(500)), i % 2) for i in range(80)]
    tracemalloc.start()
    toxicity.fit(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6, peak  # 40,000 words of a million n-grams; 186 MB when all were hashed at once
