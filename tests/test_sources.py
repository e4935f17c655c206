"""Stages that later runs find, CSV records over splits, rows that share ids."""

import csv
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tracelab.operators import faults, generation, metrics, retrieval, stats
from tracelab.plans import oracles, queries, stages, traces
from tracelab.sources import jsonl, records, storage


def made(spark, calls, n=5):
    def make():
        calls.append(n)
        return spark.range(n).withColumn("x", F.col("id") * 2)

    return make


def test_stage_is_made_once(spark):
    calls = []
    first = storage.stage(spark, "once", {"a": 1, "b": [2, "x"]}, made(spark, calls))
    second = storage.stage(spark, "once", {"b": [2, "x"], "a": 1}, made(spark, calls))
    assert calls == [5] and first.key == second.key and second.rows.schema == first.rows.schema
    assert sorted(map(tuple, second.rows.collect())) == [(i, 2 * i) for i in range(5)]
    # another parameter, another name
    assert storage.stage(spark, "once", {"a": 2, "b": [2, "x"]}, made(spark, calls)).key != first.key
    storage.stage(spark, "twice", {"a": 1, "b": [2, "x"]}, made(spark, calls))
    assert calls == [5] * 3


def test_stage_after_other_code_and_files(spark, monkeypatch, tmp_path):
    calls, path = [], str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    key = storage.files_key(spark, path)
    assert key == storage.files_key(spark, path)
    storage.stage(spark, "code", {"files": key}, made(spark, calls))
    monkeypatch.setattr(storage, "code", lambda: "other code")
    storage.stage(spark, "code", {"files": key}, made(spark, calls))
    spark.range(4).write.mode("append").parquet(path)
    assert storage.files_key(spark, path) != key and calls == [5, 5]


def test_stage_recovers(spark):
    """A run that breaks off leaves nothing that is read; rows that lost a file are made again."""
    calls = []

    def broken():
        return spark.range(10).withColumn("x", F.when(F.col("id") == 7, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))

    with pytest.raises(Exception, match="lost"):
        storage.stage(spark, "broken", {"a": 1}, broken)
    own = storage.stage(spark, "broken", {"a": 1}, made(spark, calls))
    assert calls == [5] and own.rows.count() == 5
    storage.remove(spark, next(f for f in own.rows.inputFiles()))
    again = storage.stage(spark, "broken", {"a": 1}, made(spark, calls))
    assert calls == [5, 5] and again.rows.count() == 5
    # a mark of a run at the same time: all read one of the two
    storage.stage(spark, "broken", {"a": 1}, made(spark, calls))
    assert calls == [5, 5]


def test_clean_stages(spark):
    calls = []
    storage.stage(spark, "cleaned", {"a": 1}, made(spark, calls))
    assert storage.clean_stages(spark, "cleaned", 3600) == 0
    storage.stage(spark, "cleaned", {"a": 1}, made(spark, calls))
    assert calls == [5] and storage.clean_stages(spark, "cleaned") == 1 and storage.clean_stages(spark, "cleaned") == 0
    storage.stage(spark, "cleaned", {"a": 1}, made(spark, calls))
    assert calls == [5, 5] and storage.clean_stages(spark, "no such name") == 0


def test_kept_traces(spark, tmp_path, monkeypatch):
    """Scores, quality and deltas read the traces that are kept; another budget makes others."""
    own = str(tmp_path)
    docs = [(i, f"Text {i} begins here. " + f"It says {i} and {i % 7} words. " * 5, "en") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{own}/documents.parquet")
    builds = []
    build = traces.build
    monkeypatch.setattr(traces, "build", lambda *a: builds.append(a[1:]) or build(*a))
    assert traces.kept_scores(spark, own).rows.count() == 11 * 40
    assert traces.kept_quality(spark, own).rows.count() == 40 and traces.kept_summary(spark, own, rounds=50).rows.count() == 99
    assert len(builds) == 1
    traces.kept(spark, own, budget=10)
    assert builds == [(5, 3000, "run"), (5, 10, "run")]


def test_kept_traces_are_small(spark, tmp_path):
    """Texts are kept once, and read as they were built; every text is shuffled once. Ids below zero, at the ends of ranges and far apart."""
    ids = [*range(-70, 140), 2**63 - 1, -(2**63), 2**62, 2**62 + 1]
    docs = [(i, " ".join(f"Word{(i * 31 + k * k) % 997} of {i} says {k}." for k in range(abs(i) % 300)), "en") for i in ids]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = lambda df: sorted(r.t for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("t")).collect())
    built, kept = traces.build(frame), traces.kept(spark, str(tmp_path)).rows
    assert [(f.name, f.dataType.simpleString()) for f in built.schema] == [(f.name, f.dataType.simpleString()) for f in kept.schema]
    assert text(built) == text(kept)
    lent = {int(r.source_record_id[7:]): {int(c.document_id[4:]) for c in r.chunks} for r in kept.where("chunks is not null").collect()}
    texts = {i for i, t, _ in docs if t}
    assert lent == {i: {i, i + 1} & texts for i in texts}
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    whole, small = f"{tmp_path}/whole", f"{tmp_path}/small"
    built.write.parquet(whole)
    traces.packed(built).write.parquet(small)
    size = lambda path: storage._size(spark, path)[1]
    assert size(small) < 0.5 * size(whole)


def test_csv_of_one_language(spark, tmp_path, monkeypatch):
    """A language is several files, written by several tasks, and all of its rows come back."""
    docs = [(i, f'Text "{i}",\nof more lines' if i % 3 else "", "en", f"s{i % 4}") for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "fresh_path", lambda *_: f"{tmp_path}/csv")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.doc_id, r.digest, r.source, r.n_fields) for r in queries.s8_csv_records(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(i, hashlib.md5(t.encode()).hexdigest(), s, 3) for i, t, _, s in docs}
    assert len(list((tmp_path / "csv" / "kind=en").glob("part-*"))) > 1


def test_bm25_shuffles_no_texts(spark):
    """Terms are counted where they are read, and joined to questions before anything else."""
    pool = spark.createDataFrame([(i % 2, i, i, f"word{i} same same" if i else None) for i in range(30)], "sample_id long, ordinal long, chunk_id long, text string")
    terms = retrieval._terms(pool.select("sample_id", "ordinal", F.split(F.coalesce("text", F.lit("")), " ").alias("w")).withColumn("w", F.array_remove("w", "")))
    assert "Exchange" not in terms._jdf.queryExecution().executedPlan().toString()
    rows = {(r.ordinal, r.term): r.tf for r in terms.collect()}
    assert rows == {(0, None): 0} | {(i, "same"): 2 for i in range(1, 30)} | {(i, f"word{i}"): 1 for i in range(1, 30)}
    found = retrieval.bm25(spark.createDataFrame([(0, "word4 same"), (1, "nothing")], "sample_id long, question string"), pool, 2).collect()
    assert [(r.sample_id, r.rank, r.chunk_id) for r in sorted(found)] == [(0, 1, 4), (0, 2, 2), (1, 1, 1), (1, 2, 3)]


def test_records_are_made_once(spark):
    """The filter on good records reads them, and doesn't make them again."""
    own = queries.n1_n4_english(spark, "/root/testdata/sf0.001")
    filters = [x for x in own._jdf.queryExecution().optimizedPlan().toString().splitlines() if x.lstrip(" +-:").startswith("Filter")]
    assert filters and not any("split(" in x for x in filters)


def test_repeated_ids_make_no_more_traces(spark):
    """A third of the rows without, or of one, id; ids that all repeat; equal rows."""
    docs = [(i // 5, f"Row {i} is here. It has a second sentence.", "en") for i in range(50)] + [(3, "Row 15 is here. It has a second sentence.", "en")] * 25
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    built = traces.build(frame).collect()
    assert len(built) == 75
    # whoever has the next id lends one row's chunks
    assert {len(r.chunks) for r in built if r.source_record_id != "sample_9"} == {2} and {len(r.chunks) for r in built if r.source_record_id == "sample_9"} == {1}
    lent = {(r.source_record_id, r.chunks[1].text) for r in built if len(r.chunks) > 1}
    assert len(lent) == 9


def test_samples_that_share_ids(spark):
    kind = ", ".join(f"{k} {v}" for k, v in stages.SAMPLE.items() if k in ("sample_id", "question", "source_documents", "gold_evidence"))
    rows = [("s", f"question {i}", [("d", None, f"Text of {i}. It ends.")], []) for i in range(6)] + [(None, "none", [("d", None, "no id")], [])] * 2
    samples = spark.createDataFrame(rows, kind)
    chunked = stages.chunk(samples)
    assert sorted((r.question, r.chunks[0].text) for r in chunked.collect()) == sorted((q, d[0][2]) for _, q, d, _ in rows)
    found = stages.contexts(stages.retrieve(chunked))
    made = stages.generate(found, "p", "r").collect()
    assert len(made) == 8 and all(r.query in r.generation.final_prompt and r.generation.final_answer.startswith("[DRY_RUN]") for r in made)


def test_prompt_is_exact(spark):
    r = spark.sql("select 'who?' as q, 'some {query} text' as c, cast(null as string) as n").select(generation.prompt(F.col("q"), F.col("c")).alias("p"), generation.prompt(F.col("n"), F.col("n")).alias("none")).first()
    head = "You are a question-answering assistant.\n\nAnswer the question using only the supplied context.\nDo not introduce unsupported facts.\nIf the context is insufficient, explicitly state that the answer\ncannot be determined from the provided context.\n\n"
    assert r.p == head + "Question:\nwho?\n\nContext:\nsome {query} text\n\nAnswer:"
    assert r.none == head + "Question:\n\n\nContext:\n\n\nAnswer:"


def test_dense_by_name(spark):
    def letters():
        return lambda texts: [[float(t.count(c)) for c in "abcde"] for t in texts]

    retrieval.register_encoder("letters", letters)
    kind = "sample_id string, question string, chunks " + stages.SAMPLE["chunks"]
    pool = lambda *texts: [(f"c{i}", "d", t, i, 0, len(t), 1) for i, t in enumerate(texts)]
    rows = [("x", "aab", pool("bbb", "aab", "zzz", "ab")), ("x", "c", pool("a", "cc")), ("y", "d", [])]
    got = stages.retrieve(spark.createDataFrame(rows, kind), "dense", 2, retrieval.encoder_of("letters")).collect()
    assert {r.question: [(c.chunk_id, c["rank"]) for c in r.retrieval.retrieved_chunks] for r in got} == {"aab": [("c1", 1), ("c3", 2)], "c": [("c1", 1), ("c0", 2)], "d": []}
    with pytest.raises(ValueError, match="encoder"):
        stages.retrieve(spark.createDataFrame(rows, kind), "dense")


@pytest.mark.parametrize("seed", range(6))
def test_csv_records_over_splits(spark, tmp_path, seed):
    """Random files with quotes, doubled ones, commas and line breaks, well formed or not, at splits of a few bytes."""
    rng = random.Random(seed)
    for name in ("a", "b"):
        pieces = ['"', '""', ",", "\n", "x", "word", " ", "\r\n", '"a,b"', '"l1\nl2"', ""]
        text = "".join(rng.choices(pieces, [3 if seed % 2 else 0.3, 3, 8, 6, 8, 8, 3, 1, 4, 4, 2], k=rng.randint(200, 900)))
        (tmp_path / f"{name}.csv").write_text(("﻿" if name == "b" else "") + text, newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = {}
    for name in ("a", "b"):
        with open(tmp_path / f"{name}.csv", encoding="utf-8-sig", newline=None) as f:
            want[f"{name}.csv"] = [r for r in csv.reader(io.StringIO(f.read(), newline="")) if r]
    try:
        for size in ("37", "400", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = records.records(spark, str(tmp_path)).collect()
            for name, rows in want.items():
                assert [r.fields for r in sorted((r for r in got if r.source_file == name), key=lambda r: r.record)] == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_annotations_with_line_breaks(spark, tmp_path):
    text = 'trace_id,annotator,confidence,notes\nt1,me,3,"two\nlines, ""quoted"""\n"t2,""you"",x,""a note, with comma"""\n\n,nobody,1,\nt3, him ,4\nt1,her,5,last\n'
    (tmp_path / "a.csv").write_text(text)
    rows = {r.trace_id: (r.annotator, r.confidence, r.notes) for r in jsonl.annotations(spark, str(tmp_path / "a.csv")).collect()}
    assert rows == {"t1": ("her", 5, "last"), "t2": ("you", 0, "a note, with comma"), "t3": ("him", 4, None)}
    (tmp_path / "b.csv").write_text('trace_id,notes\nt1,"two\nlines, ""quoted"""\n')
    assert jsonl.annotations(spark, str(tmp_path / "b.csv")).first().notes == 'two\nlines, "quoted"'


def test_results_are_scored_once(spark, tmp_path):
    """The counters come with the rows that are written."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        calls.add(1)
        return x

    registry = metrics.default_registry()
    rows = spark.createDataFrame([(i, f'{{"trace_id": "t{i}"}}') for i in range(30)] + [(99, "bad")], "line long, value string")
    results = metrics.score(jsonl.parsed(rows), registry=registry)
    want = metrics.counters(results).first().asDict()
    got = jsonl.write_results(results.withColumn("score", counted(F.coalesce("score", F.lit(0.0)))), str(tmp_path / "out"))
    assert got == want and calls.value == want["results"] == 31 * 11


def test_faults_are_drawn_in_one_scan(spark):
    """The same draws as by sorting all traces; a plan with one scan of whole traces; equal and repeated ids."""
    docs = [(i, f"Text {i} begins here. " + f"It says {i} and {i % 7} words. " * 9, "en" if i % 3 else "ru") for i in range(60)]
    built = storage.stored(traces.build(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)), "t")
    for language in ("any", "en"):
        pool = built if language == "any" else built.where("language = 'en'")
        for fault, own in faults.inject_all(built, None, 7, language).items():
            want = pool.orderBy(faults.drawn("trace", fault, F.col("trace_id")), "trace_id").limit(7).select("trace_id").collect()
            assert sorted(r.original_trace_id for r in own.collect()) == sorted(r.trace_id for r in want)
    drawn = faults.sampled(built, list(faults.INJECTORS), 7, "any")
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and plan.count("WindowGroupLimit") == 2
    whole = [line for line in drawn._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line]
    assert sum("retrieval" in line for line in whole) == 1
    twice = built.unionByName(built.where("trace_id < 'sample_3'")).unionByName(built)
    assert all(own.count() == 7 for own in faults.inject_all(twice, ["chunk_merge", "out_of_scope"], 7, "any").values())
    assert faults.inject(twice, "out_of_scope", 500, "any").count() == twice.count()


def plain_poisson(values, ids, group, rounds):
    import hashlib
    import math

    means = []
    for r in range(rounds):
        total = weight = 0
        for v, i in zip(values, ids, strict=True):
            x = int(hashlib.md5("|".join(["42", *group, i, str(r // 4)]).encode()).hexdigest()[8 * (r % 4) : 8 * (r % 4) + 8], 16) / 2**32
            k, chance, below = 0, math.exp(-1), math.exp(-1)
            while x >= below:
                k += 1
                chance /= k
                below += chance
            total += k * v
            weight += k
        if weight:
            means.append(total / weight)
    return means


def test_hashed_intervals(spark):
    """Against a plain loop with the same draws, and against the exact resampling within its error; any partitioning."""
    import numpy as np

    rng = random.Random(1)
    data = [("f", m, f"t{i}", rng.gauss(0.3, 1) if m == "a" else 0.5, i) for m, n in (("a", 60), ("b", 1), ("c", 0)) for i in range(n)] + [("f", "c", "t0", None, 0)]
    frame = spark.createDataFrame(data, "fault_type string, metric_name string, original_trace_id string, delta double, line long")
    keys = ["fault_type", "metric_name"]
    got = {r.metric_name: (r.ci_95_lower, r.ci_95_upper) for r in stats.hashed_intervals(frame, keys, "original_trace_id", rounds=403).collect()}
    again = {r.metric_name: (r.ci_95_lower, r.ci_95_upper) for r in stats.hashed_intervals(frame.repartition(7), keys, "original_trace_id", rounds=403).collect()}
    own = [d[3] for d in data if d[1] == "a"]
    want = np.quantile(plain_poisson(own, [d[2] for d in data if d[1] == "a"], ("f", "a"), 403), [0.025, 0.975])
    assert np.allclose(got["a"], want) and np.allclose(again["a"], want) and got["b"] == (0.5, 0.5) and set(got) == {"a", "b"}
    exact = stats.bootstrap_interval(own)
    wide = {r.metric_name: (r.ci_95_lower, r.ci_95_upper) for r in stats.hashed_intervals(frame, keys, "original_trace_id").collect()}["a"]
    # the ends of either vary by about 0.01 for 2000 rounds of 60 values
    assert np.abs(np.subtract(wide, exact)).max() < 0.06 and len(oracles.intervals().split(">= ")) - 1 == len(stats.LIMITS)
    assert all(f">= {n})" in oracles.intervals() for n in stats.LIMITS)


def test_ranks_of_a_hot_group(spark):
    """Ranks by ranges of values against ranking all values; the hot group's rows are in no window of their own."""
    rng = random.Random(3)
    rows = [("hot", round(rng.gauss(0.1, 1), 2)) for _ in range(3000)] + [("few", x) for x in (0.5, -0.5, 0.0, 2.0)] + [("none", 0.0), ("one", -3.0), (None, 1.0), ("null", None)]
    got = {r.g: r.rank_biserial_effect for r in stats.rank_biserial(spark.createDataFrame(rows, "g string, delta double"), ["g"]).collect()}
    for g in ("hot", "few", "none", "one", None):
        own = [x for k, x in rows if k == g and x]
        ranks = [sum(abs(y) < abs(x) for y in own) + (sum(abs(y) == abs(x) for y in own) + 1) / 2 for x in own]
        assert abs(got[g] - (sum(r if x > 0 else -r for r, x in zip(ranks, own, strict=True)) / sum(ranks) if own else 0.0)) < 1e-12
    assert "null" not in got
