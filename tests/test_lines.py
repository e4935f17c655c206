"""The data source of lines: ranges of any size, a stream over files that grow, writes that break off."""

import random

import pytest
from pyspark.sql import functions as F

from tracelab.sources import jsonl, lines


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(lines.Lines)
    return spark


def test_ranges_of_any_size(source, tmp_path):
    rng = random.Random(1)
    want = []
    for name in ("a.jsonl", "b.jsonl", "_hidden"):
        body, at = b"", 0
        for i in range(200):
            line = rng.choice(["", " ", "x" * rng.randint(1, 70), f'{{"i": {i}, "é": "日本"}}', "y\r"]).encode()
            if line.strip() and name[0] != "_":
                want.append((name, len(body), line.rstrip(b"\r").decode()))
            body += line + (b"\n" if i < 199 or name == "a.jsonl" else b"")
        (tmp_path / name).write_bytes(body)
    for size in (1, 7, 1000):
        system = lines.opened(str(tmp_path))[0]
        found = [tuple(r.values()) for file, n in lines.files(str(tmp_path)) for part in lines.ranges(file, 0, n, size) for b in lines.read_range(system, part) for r in b.to_pylist()]
        assert found == want
    for size in (300, 10**9):
        assert sorted(map(tuple, source.read.format("lines").option("range_bytes", size).load(str(tmp_path)).collect())) == sorted(want)
    # the same good and bad lines as the text source gives
    rows = jsonl.parsed(source.read.format("lines").load(f"file://{tmp_path}/a.jsonl"))
    assert rows.where("trace is not null").count() == jsonl.tolerant(source, str(tmp_path / "a.jsonl"))[0].count() > 0


def test_stream_follows_files(source, tmp_path):
    """Files that appear, lines that are added, one that is ended later; a restart goes on where the checkpoint is."""
    (tmp_path / "in").mkdir()
    one, two = tmp_path / "in" / "one.jsonl", tmp_path / "in" / "two.jsonl"

    def run():
        stream = source.readStream.format("lines").option("range_bytes", 9).load(str(tmp_path / "in"))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).start(str(tmp_path / "out"))
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r.source_file, r.offset, r.value) for r in source.read.parquet(str(tmp_path / "out")).collect())

    one.write_text("first\nsecond line\nnot en")
    assert run() == [("one.jsonl", 0, "first"), ("one.jsonl", 6, "second line")]
    with one.open("a") as f:
        f.write("ded\nlast\n")
    two.write_text("other\n")
    assert run() == [("one.jsonl", 0, "first"), ("one.jsonl", 6, "second line"), ("one.jsonl", 18, "not ended"), ("one.jsonl", 28, "last"), ("two.jsonl", 0, "other")]


def test_writes_are_whole(source, tmp_path):
    path = str(tmp_path / "out")
    rows = source.range(0, 100, 1, 4).select(F.concat(F.lit('{"i": '), "id", F.lit("}")).alias("value"))
    broken = rows.withColumn("value", F.when(F.col("value").contains("77"), F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="killed"):
        broken.write.format("lines").mode("append").save(path)
    assert not [p for p in (tmp_path / "out").rglob("*.jsonl")] if (tmp_path / "out").exists() else True
    rows.write.format("lines").mode("append").save(path)
    assert len(list((tmp_path / "out").glob("part-*.jsonl"))) == 4 and (tmp_path / "out" / "_SUCCESS").exists() and not list((tmp_path / "out").rglob("_staged/*/*"))
    read = lambda: sorted(r.value for r in source.read.format("lines").load(path).collect())
    assert read() == sorted(r.value for r in rows.collect())
    # a write that breaks off leaves what was there; one that overwrites replaces it
    with pytest.raises(Exception, match="killed"):
        broken.write.format("lines").mode("overwrite").save(path)
    assert len(read()) == 100
    rows.limit(3).write.format("lines").mode("overwrite").save(path)
    assert len(read()) == 3 and source.read.text(path).count() == 3
    with pytest.raises(Exception, match="one column"):
        source.range(3).write.format("lines").mode("append").save(path)
