"""Tags over a stream, gold in huge documents, digests of files and of rows."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tracelab.operators import chunking, human, quality
from tracelab.sources import jsonl
from tracelab.streaming import duplicates


def put(folder, name, rows):
    """A file of a stream, there at once: line and value of each row as one JSON object."""
    (folder.parent / name).write_text("".join(json.dumps({"line": i, "value": v}) + "\n" for i, v in rows))
    (folder.parent / name).rename(folder / name)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # else a stream that expires state never runs out of batches
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield spark
    spark.conf.unset(key)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_stream_tags_like_the_batch(rocks, tmp_path):
    """Ids that repeat within and over batches, with a restart in between; a hot id; rows without an id and broken ones."""
    spark, source = rocks, tmp_path / "in"
    source.mkdir()
    rng = random.Random(5)
    ids = [f"t{rng.randint(0, 12)}" if rng.random() < 0.6 else "hot" for _ in range(120)]
    rows = [(k, json.dumps({"trace_id": i, "query": "what?"} if i != "t3" else {"query": "none"})) for k, i in enumerate(ids)] + [(500, "broken"), (501, "[1]")]

    def run():
        stream = duplicates.check_stream(spark.readStream.schema("line long, value string").json(str(source)))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(100)

    put(source, "a.json", rng.sample(rows[:60], 60))
    run()
    put(source, "b.json", rng.sample(rows[60:], len(rows) - 60))
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = quality.check(jsonl.parsed(spark.createDataFrame(rows, "line long, value string")).where("trace is not null").select("line", "trace"))
    assert got.columns == want.columns
    show = lambda df: sorted(map(str, df.withColumn("issues", F.to_json("issues")).collect()))
    assert show(got) == show(want) and sum("duplicate_trace_id" in r.quality_tags for r in got.collect()) == 120 - len(set(ids))


def test_stream_forgets(rocks, tmp_path):
    """After its time to live an id counts as new: the state holds no more than that time's ids."""
    import time

    spark, source = rocks, tmp_path / "in"
    source.mkdir()
    for name in ("a.json", "b.json"):
        put(source, name, [(1, '{"trace_id": "x"}')])
        stream = duplicates.seen_before(spark.readStream.schema("line long, value string").json(str(source)), days=1 / 86_400)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(100)
        time.sleep(2)
    assert [r.again for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [False, False]


@pytest.mark.parametrize("bin_chars", [7, 50, 10_000])
def test_cover_in_bins(spark, bin_chars):
    """Every overlap once, whatever the bins; empty and unlocated gold, empty chunks, texts without chunks."""
    rng = random.Random(bin_chars)
    chunks, gold = [], []
    for d in ("a", "b", "c"):
        at = 0
        for k in range(40 if d != "c" else 0):
            size = rng.randint(0, 25)
            chunks.append((d, f"{d}{k}", k, max(0, at - rng.randint(0, 10)), at + size))
            at += size
        for k in range(30):
            a = rng.randint(0, 400)
            gold.append((f"s{k % 4}", k, d, "g", a, a + rng.randint(0, 90)))
    gold.append(("s", 0, "a", "none", None, None))
    c = spark.createDataFrame(chunks, "document_id string, chunk_id string, chunk_index int, start_char int, end_char int")
    g = spark.createDataFrame(gold, "sample_id string, ordinal int, document_id string, gold_text string, gold_start int, gold_end int")
    got = {(r.sample_id, r.ordinal, r.document_id): (list(r.covering_chunk_ids), r.is_preserved, r.locate_ok) for r in chunking.cover(g, c, bin_chars).collect()}
    for s, o, d, _, a, b in gold:
        over = [x for x in chunks if a is not None and x[0] == d and x[3] < b and a < x[4] and x[3] < x[4] and a < b]
        assert got[s, o, d] == ([x[1] for x in sorted(over, key=lambda x: x[2])], any(x[3] <= a and b <= x[4] for x in over), a is not None)
    assert len(got) == len(gold)


def test_huge_document_is_spread(spark):
    """One document of many chunks: no task joins more than a few times the mean."""
    c = spark.range(50_000).selectExpr("'d' as document_id", "concat('c', id) as chunk_id", "cast(id as int) as chunk_index", "cast(id * 400 as int) as start_char", "cast(id * 400 + 480 as int) as end_char")
    g = spark.range(5000).selectExpr("concat('s', id) as sample_id", "0 as ordinal", "'d' as document_id", "'t' as gold_text", "cast(id * 4000 + 390 as int) as gold_start", "cast(id * 4000 + 450 as int) as gold_end")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "20"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = chunking.cover(g, c)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert all(r.covering_chunk_ids == [f"c{int(r.sample_id[1:]) * 10}", f"c{int(r.sample_id[1:]) * 10 + 1}"] and r.is_preserved for r in out.collect())
        sizes = [r.n for r in c.select((F.floor(F.col("start_char") / 20_000)).alias("bin"), "document_id").repartition(20, "document_id", "bin").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "bin" in plan.split("SortMergeJoin")[1][:80] and len(sizes) == 20 and max(sizes) < 2.5 * 50_000 / 20


def test_digests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    bodies = {"a.txt": b"one\ntwo", "b.bin": bytes(range(256)) * 50}
    for name, body in bodies.items():
        (tmp_path / "in" / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in human.file_digests(spark, str(tmp_path / "in")).collect()}
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in bodies.items()}
    rows = [(i, f"x{i}", None if i % 5 else "z") for i in range(300)]
    of = lambda own, **how: human.manifest(spark.createDataFrame(own, "i int, s string, t string"), **how).collect()
    whole = of(rows)
    assert whole[0].rows == 300 and of(rows[::-1]) == whole and of(rows[1:]) != whole and of([*rows, rows[0]]) != whole and of([*rows[1:], (0, "y", "z")]) != whole
    # two rows for two others of the same sum of hashes would go unseen by a sum; here each part is hashed in order
    assert len(of(rows, by=["t"])) == 2 and of([])[0].rows == 0
