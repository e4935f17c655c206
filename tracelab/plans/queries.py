"""Queries of the trace engine over the tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import chunking, context, faults, generation, human, metrics, normalize, quality, retrieval, stats
from ..sources import jsonl, records
from ..sources.storage import fresh_path
from . import oracles as O
from . import traces


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _json(**fields: Column) -> Column:
    return F.parse_json(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])))


def t1_metric_tokens(spark, sf):
    tokens = T.metric_tokens(F.col("text"), F.col("lang"))
    return _t(spark, sf, "documents").select("doc_id", tokens.alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


def r1_words(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", T.words(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


def t2_sentences(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", T.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\n").cast("binary")).alias("digest"))


def t3_normal_form(spark, sf):
    return _t(spark, sf, "documents").groupBy(F.md5(T.normal_form(F.col("text")).cast("binary")).alias("form")).agg(F.count(F.lit(1)).alias("n"))


def t4_text_checks(spark, sf):
    c = F.col("text")
    return _t(spark, sf, "documents").select("doc_id", T.readable(c).alias("readable"), T.cut_short(c).alias("cut_short"), T.api_error(c).alias("api_error"), T.refusal(c).alias("refusal"))


def c1_c6_chunks(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return chunking.chunk_documents(docs).select("chunk_id", "document_id", "chunk_index", "start_char", "end_char", "token_count", F.md5(F.col("text").cast("binary")).alias("digest"))


def c7_gold_locate(spark, sf):
    docs = _t(spark, sf, "documents")
    s = T.sentences(F.col("text"))
    gold = docs.select(F.col("doc_id").alias("sample_id"), F.lit(0).alias("ordinal"), F.col("doc_id").alias("document_id"), F.get(s, F.size(s) - 1).alias("gold_text"), F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"))
    located = chunking.locate(gold, docs.select(F.col("doc_id").alias("document_id"), "text"))
    return located.select(F.col("document_id").alias("doc_id"), F.col("gold_start").cast("long").alias("gold_start"), F.col("gold_end").cast("long").alias("gold_end"))


def c8_gold_cover(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    s = T.sentences(F.col("text"))
    gold = docs.select(F.col("document_id").alias("sample_id"), F.lit(0).alias("ordinal"), "document_id", F.get(s, F.size(s) - 1).alias("gold_text"), F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"))
    found = chunking.cover(chunking.locate(gold, docs), chunking.chunk_documents(docs))
    return found.select("sample_id", "gold_start", "gold_end", F.array_join("covering_chunk_ids", ",").alias("covering"), "is_preserved", "locate_ok")


def _bm25(spark, sf):
    items, docs = _t(spark, sf, "benchmark"), _t(spark, sf, "documents")
    n = items.count() or 1
    questions = items.select(F.col("item_id").alias("sample_id"), F.col("text").alias("question"))
    pool = docs.select(F.pmod("doc_id", F.lit(n)).alias("sample_id"), F.col("doc_id").alias("ordinal"), F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.search("bm25", questions, pool)


def r2_bm25(spark, sf):
    return _bm25(spark, sf).select("sample_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def _dense(spark, sf, top=5):
    """The vector of least id of each label asks the label's vectors."""
    v = _t(spark, sf, "embeddings").where("embedding is not null and label is not null")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(F.col("label").alias("sample_id"), "vector")
    return retrieval.dense(first, v.select(F.col("label").alias("sample_id"), F.col("vec_id").alias("ordinal"), F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector")), top)


def r3_dense(spark, sf):
    return _dense(spark, sf).select("sample_id", "rank", "chunk_id", F.round("score", 5).alias("score"))


def _gold(spark, sf):
    """The ten least ids of each label, as the gold that a test run needs: made input, not a limit on a result."""
    v = _t(spark, sf, "embeddings").where("label is not null").groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return v.select(F.col("label").alias("sample_id"), F.transform(F.slice("ids", 1, 10), lambda x: x.cast("string")).alias("gold_ids"))


def r6_retrieval_eval(spark, sf):
    return retrieval.evaluate(_gold(spark, sf), _dense(spark, sf)).select("sample_id", F.round("recall_at_k", 6).alias("recall_at_k"), "hit_at_k", "n_gold_chunks")


def r7_run_summary(spark, sf):
    s = retrieval.summary(retrieval.evaluate(_gold(spark, sf), _dense(spark, sf)))
    return s.select("samples", "with_gold", F.round("recall_at_k", 6).alias("recall_at_k"), F.round("hit_at_k", 6).alias("hit_at_k"))


def m1_m4_retrieval_metrics(spark, sf):
    found = _dense(spark, sf).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("retrieved_chunks"))
    rows = _gold(spark, sf).join(found, "sample_id", "left")
    evidence = F.array(F.struct(F.col("gold_ids").alias("covering_chunk_ids")))
    trace = _json(trace_id=F.col("sample_id").cast("string"), gold_evidence=evidence, retrieval=F.struct("retrieved_chunks"))
    out = metrics.score(rows.select(F.col("sample_id").cast("long").alias("line"), trace.alias("trace"))).where("stage = 'retrieval'")
    return out.select("trace_id", "metric_name", F.round("score", 6).alias("score"), "label", "status")


def _turns(spark, sf):
    c = _t(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = c.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
    return rows.where("role = 'user' and next_role = 'assistant'")


def m10_m11_generation_metrics(spark, sf):
    trace = _json(trace_id=F.concat_ws("-", "conv_id", "turn"), query=F.col("text"), language=F.lit("en"), context_construction=F.struct(F.col("text").alias("final_context")), generation=F.struct(F.col("answer").alias("final_answer")))
    out = metrics.score(_turns(spark, sf).select(F.xxhash64("conv_id", "turn").alias("line"), trace.alias("trace"))).where("stage = 'generation'")
    return out.select("trace_id", "metric_name", F.round("score", 6).alias("score"), "label", "status")


def m5_m9_trace_metrics(spark, sf):
    r = traces.scored(traces.read(spark, sf))
    return r.select("trace_id", "metric_name", "stage", F.round("score", 6).alias("score"), "label", "status", F.array_join("warnings", ",").alias("warnings"), F.col("error.code").alias("error"))


def m0_counters(spark, sf):
    return metrics.counters(traces.scored(traces.read(spark, sf)))


def m0e_extractors(spark, sf):
    t = metrics.of_columns(traces.read(spark, sf))
    own = traces.read(spark, sf).select(t.alias("t"))
    return own.select("t.trace_id", F.array_join(metrics.gold_ids(F.col("t")), ",").alias("gold"), F.array_join(metrics.selected_ids(F.col("t")), ",").alias("selected"), F.array_join("t.ranked", ",").alias("retrieved"))


def m_variant_metrics(spark, sf):
    """The same metrics over the traces as JSON: typed and untyped reading must agree."""
    r = metrics.score(traces.as_variant(traces.read(spark, sf)))
    return r.select("trace_id", "metric_name", F.round("score", 6).alias("score"), "label", "status")


def x_context(spark, sf):
    c = F.col("context_construction")
    return traces.read(spark, sf).select("trace_id", F.array_join(c["selected_chunk_ids"], ",").alias("selected"), F.array_join(c["deduplicated_chunk_ids"], ",").alias("repeated"), c["context_token_count"].alias("tokens"), c["truncated"].alias("truncated"), F.md5(c["final_context"].cast("binary")).alias("digest"))


def x3_token_budget(spark, sf):
    """The turns of a conversation as chunks under a budget of 60 tokens."""
    chunk = F.struct(F.col("turn").cast("string").alias("chunk_id"), F.col("role").alias("document_id"), F.col("turn").cast("int").alias("rank"), "text")
    rows = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", chunk.alias("c")))).alias("t"))
    own = rows.select("conv_id", context.build(F.transform("t", lambda x: x["c"]), 60).alias("x"))
    return own.select("conv_id", F.array_join("x.selected_chunk_ids", ",").alias("selected"), F.array_join("x.dropped_chunk_ids", ",").alias("dropped"), F.array_join("x.deduplicated_chunk_ids", ",").alias("repeated"), F.md5(F.col("x.final_context").cast("binary")).alias("digest"))


def x5_gold_in_context(spark, sf):
    gold = F.array_distinct(F.flatten(F.col("gold_evidence.covering_chunk_ids")))
    return traces.read(spark, sf).select("trace_id", context.gold_in_context(gold, F.col("context_construction.selected_chunk_ids")).alias("gold_in_context"))


def g_traces(spark, sf):
    return traces.read(spark, sf).select("trace_id", "source_record_id", "language", F.md5(F.col("generation.final_prompt").cast("binary")).alias("prompt"), "runtime.status")


def g2_generate(spark, sf):
    asked = _t(spark, sf, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("sample_id"), generation.prompt(F.col("text"), F.lit(None)).alias("final_prompt"))
    return generation.generate(asked, generation.backend("dry-run")).select("sample_id", "final_answer", "status", "error")


def _quality(spark, sf):
    return traces.kept_quality(spark, sf).rows


def q_quality(spark, sf):
    return _quality(spark, sf).select("trace_id", F.array_join("quality_tags", ",").alias("tags"), "severity", "usable", "has_issues", "n_gold_chunks", "n_present_chunks", "gold_present_any", "gold_present_all")


def q_variant_quality(spark, sf):
    """The same checks over the traces as JSON, with the warnings."""
    own = quality.check(traces.as_variant(traces.read(spark, sf)))
    return own.select("trace_id", F.array_join("quality_tags", ",").alias("tags"), F.array_join("warnings", " | ").alias("warnings"))


def q5_tag_counts(spark, sf):
    return quality.tag_counts(_quality(spark, sf))


def q5_severities(spark, sf):
    return quality.severities(_quality(spark, sf))


def q5_top_tags(spark, sf):
    return quality.top_tags(_quality(spark, sf))


def q6_problems(spark, sf):
    return quality.problems(_quality(spark, sf)).select("trace_id", "severity")


def h1_healthy(spark, sf):
    return faults.healthy(traces.read(spark, sf)).select("trace_id", "_is_healthy")


def f_fault_injection(spark, sf):
    """What each fault makes of the traces that it is put into: the parts that it can change, long ones as digests."""
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    chunks = F.col("trace.retrieval.retrieved_chunks")
    return reduce(
        DataFrame.unionByName,
        [
            w.select(
            "original_trace_id", "injected_fault", "injection_method", "expected_diagnosis", "expected_metric_change", F.col("trace.query").alias("query"), F.col("trace.generation.final_answer").alias("answer"),
            digest("trace.context_construction.final_context").alias("context"), digest("trace.generation.final_prompt").alias("prompt"), F.array_join("trace.context_construction.selected_chunk_ids", ",").alias("selected"),
            F.array_join(chunks["chunk_id"], ",").alias("retrieved"), F.array_join(chunks["document_id"], ",").alias("sources"), F.md5(F.array_join(chunks["text"], "|").cast("binary")).alias("texts"),
            )
            for w in faults.inject_all(traces.read(spark, sf), language="any").values()
        ],
    )


def _rounded(summary: DataFrame) -> DataFrame:
    r = lambda c: (F.round(c, 6) + 0.0).alias(c)
    sizes = ["healthy_mean", "fault_mean", "mean_delta", "median_delta", "std_delta", "ci_95_lower", "ci_95_upper", "standardized_effect", "rank_biserial_effect", "quality_mean_delta"]
    return summary.select(*[r(c) if c in sizes else c for c in summary.columns])


def a_controlled_failures(spark, sf):
    """The orchestrated analysis with its bootstrap intervals, whose weights are hashes that SQL can draw as well."""
    return _rounded(traces.kept_summary(spark, sf).rows)


def a17_summary(spark, sf):
    """The orchestrated analysis without its bootstrap intervals, which a_controlled_failures has."""
    return a_controlled_failures(spark, sf).drop("ci_95_lower", "ci_95_upper")


def a11_a12_core(spark, sf):
    return stats.core(stats.all_retrievers({"bm25": a_controlled_failures(spark, sf), "dense": None})).drop("ci_95_lower", "ci_95_upper")


def a3_deltas(spark, sf):
    return traces.kept_deltas(spark, sf).rows.select("fault_type", "metric_name", "original_trace_id", "state", F.round("delta", 6).alias("delta"))


def a16_stratified(spark, sf):
    rows = _t(spark, sf, "labels").select(F.concat("quality", F.lit("/"), "toxic").alias("injected_fault"), F.col("doc_id").cast("string").alias("original_trace_id"))
    return stats.stratified(rows, 30)


def _sentences(spark, sf) -> DataFrame:
    return _t(spark, sf, "documents").withColumn("s", T.sentences(F.col("text")))


def n1_n4_english(spark, sf):
    """Documents as multi-hop records: their sentences dealt to three titled parts (the third repeats a title), facts known,
    unknown and, where a part is short, out of range."""
    part = lambda k: F.filter("s", lambda x, i: i % 3 == k)
    record = _json(
        id=F.col("doc_id").cast("string"),
        question=F.coalesce(F.get("s", F.lit(0)), F.lit("")),
        answer=F.array(F.array(F.col("lang"), F.lit("")), F.array(F.col("source"), F.col("lang"))),
        context=F.struct(F.array("lang", "source", "lang").alias("title"), F.array(part(0), part(1), part(2)).alias("sentences")),
        supporting_facts=F.struct(F.array(F.col("source"), F.lit("nobody"), F.col("lang"), F.col("lang")).alias("title"), F.array(F.lit(0), F.lit(0), F.lit(1), F.lit(7)).alias("sent_id")),
    )
    good, _ = normalize.english(_sentences(spark, sf).select("doc_id", record.alias("record")))
    show = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws("=", *[x[f].cast("string") for f in fields])), "|")
    return good.select("sample_id", F.md5(F.col("question").cast("binary")).alias("question"), "reference_answer", F.md5(show("source_documents", "document_id", "title", "text").cast("binary")).alias("documents"), F.md5(show("gold_evidence", "document_id", "sentence_index", "gold_text").cast("binary")).alias("gold"))


def n5_n6_russian(spark, sf):
    """Documents as single-context records whose text is their middle sentence; every seventh line is bad, and every third
    text isn't in its context."""
    middle = F.coalesce(F.get("s", F.floor(F.size("s") / 2).cast("int")), F.lit(""))
    part = F.when(F.col("doc_id") % 3 == 0, F.lit("\u0000none")).otherwise(middle)
    record = F.when(F.col("doc_id") % 7 != 0, _json(text=part, q=F.col("lang"), a=F.col("source"), context=F.col("text")))
    rows = normalize.russian(_sentences(spark, sf).select(F.col("doc_id").alias("line"), record.alias("record")))
    gold = F.get("gold_evidence", F.lit(0))
    return rows.select("sample_id", "question", "reference_answer", gold["document_id"].alias("document_id"), gold["char_start"].alias("char_start"), gold["char_end"].alias("char_end"))


def s8_csv_records(spark, sf):
    """Documents as CSV files, by ranges of language and doc_id, with every text quoted, its line breaks in it: read as records
    again. A language is as many files as its size asks for, so that no task has all of it."""
    quoted = F.concat(F.lit('"'), F.replace(F.col("text"), F.lit('"'), F.lit('""')), F.lit('"'))
    rows = _t(spark, sf, "documents").where("text is not null").select(F.coalesce("lang", F.lit("none")).alias("kind"), "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(","), quoted, F.lit(","), F.coalesce("source", F.lit(""))).alias("value"))
    path = fresh_path(spark, "csv")
    rows.repartitionByRange("kind", "doc_id").sortWithinPartitions("kind", "doc_id").drop("doc_id").write.partitionBy("kind").text(path)
    f = F.col("fields")
    return records.records(spark, path).select(f[0].cast("long").alias("doc_id"), F.md5(f[1].cast("binary")).alias("digest"), f[2].alias("source"), F.size("fields").alias("n_fields"))


def q4_duplicates(spark, sf):
    """Traces, then those of an even document once more: the second rows are tagged, and nothing else about them changes."""
    own = traces.read(spark, sf)
    even = F.regexp_extract("source_record_id", r"(\d+)$", 1).cast("long") % 2 == 0
    twice = own.withColumn("copy", F.lit(0)).unionByName(own.where(even).withColumn("copy", F.lit(1)))
    n = F.regexp_extract("source_record_id", r"(\d+)$", 1).cast("long")
    checked = quality.check(twice.withColumn("line", n * 2 + F.col("copy")).drop("copy"))
    return checked.select("trace_id", (F.col("line") % 2).cast("int").alias("copy"), F.array_join("quality_tags", ",").alias("tags"), "severity", "usable")


def d7_manifest(spark, sf):
    """Rows and digests of the documents of each source, whatever their order."""
    docs = _t(spark, sf, "documents").select("source", "doc_id", "n_chars", "lang")
    return human.manifest(docs, ["doc_id", "lang", "n_chars"], ["source"])


def d7_files(spark, sf):
    """The labels as a file for each quality, and those files' digests."""
    rows = _t(spark, sf, "labels").select("quality", "doc_id", F.concat_ws(",", F.col("doc_id").cast("string"), F.col("toxic").cast("string")).alias("value"))
    path = fresh_path(spark, "files")
    rows.repartition("quality").sortWithinPartitions("quality", "doc_id").drop("doc_id").write.partitionBy("quality").text(path)
    return human.file_digests(spark, path).select(F.regexp_extract("path", r"quality=(\d+)/", 1).alias("quality"), "length", "sha256")


def _lines(spark, sf) -> DataFrame:
    """A file of JSON lines for each language: blank, broken and other lines among the good ones, in order of doc_id."""
    m, name = F.col("doc_id") % 10, F.col("doc_id").cast("string")
    value = F.when(m == 3, " ").when(m == 7, F.concat(F.lit("{bad "), name)).when(m == 9, F.concat(F.lit("["), name, F.lit("]"))).otherwise(F.concat(F.lit('{"trace_id": "t'), name, F.lit('"}')))
    rows = _t(spark, sf, "documents").select(F.coalesce("lang", F.lit("none")).alias("kind"), "doc_id", value.alias("value"))
    path = fresh_path(spark, "lines")
    rows.repartition("kind").sortWithinPartitions("kind", "doc_id").drop("doc_id").write.partitionBy("kind").text(path)
    return jsonl.parsed(jsonl.lines(spark, path))


def s1_s2_lines(spark, sf):
    return _lines(spark, sf).select("number", "value", F.col("trace").isNotNull().alias("good"), "message")


def s3_metric_scan(spark, sf):
    rows = metrics.score(_lines(spark, sf)).where("error.code = 'invalid_jsonl_record'")
    return rows.groupBy("trace_id", F.col("error.message").alias("message")).agg(F.count(F.lit(1)).alias("n"))


def d1_unquoted(spark, sf):
    plain = F.concat_ws(",", "conv_id", "turn", "role")
    value = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('"'), F.concat_ws(",", "conv_id", F.concat(F.lit('""'), F.col("role"), F.lit('""'))), F.lit('"'))).otherwise(plain)
    return jsonl.unquoted(_t(spark, sf, "conversations").select("conv_id", "turn", value.alias("value"))).drop("n")


def d2_diagnoses(spark, sf):
    return human.diagnose(traces.kept_scores(spark, sf).rows)


def _judged(spark, sf) -> DataFrame:
    own = _t(spark, sf, "labels")
    warnings = F.when(F.col("doc_id") % 11 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>"))
    return own.select(
        "doc_id", F.col("quality").cast("string").alias("expected"), F.when(F.col("doc_id") % 5 > 0, F.col("toxic").cast("string")).alias("predicted"), (F.col("doc_id") % 3 > 0).alias("supported"),
        (F.col("doc_id") % 7 + 1).cast("int").alias("confidence"), F.when(F.col("doc_id") % 4 > 0, "diagnosed").otherwise("unknown").alias("diagnosis_status"), warnings.alias("warnings"),
    )


def d3_rates(spark, sf):
    r = human.rates(_judged(spark, sf))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


def d5_review_queue(spark, sf):
    return human.review_queue(_judged(spark, sf)).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


def _natural(spark, sf) -> DataFrame:
    """Two runs on records that partly differ: the right one is made without a third of the documents, so that some have no partner."""
    left = _t(spark, sf, "labels").select(F.col("doc_id").alias("source_record_id"), F.col("quality").cast("string").alias("diagnosis"), (F.col("quality") == 1).alias("hit"))
    right = _t(spark, sf, "documents").where("doc_id % 3 > 0").select(F.col("doc_id").alias("source_record_id"), F.col("lang").alias("diagnosis"), (F.col("lang") == "en").alias("hit"))
    return human.natural_pairs(left, right)


def d6_natural_pairs(spark, sf):
    return _natural(spark, sf).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def d6_transitions(spark, sf):
    return human.transitions(_natural(spark, sf))


def d7_difference(spark, sf):
    docs = _t(spark, sf, "documents").select("text", "lang")
    return human.difference(docs, docs.where("lang <> 'de'").unionByName(docs.where("lang = 'fr'")))


def _total(steps: int) -> Column:
    """The sum of a vector's components, each rounded to so many steps a unit: exact in any order."""
    return F.aggregate("embedding", F.lit(0).cast("long"), lambda a, c: a + F.floor(c.cast("double") * steps + 0.5)) / steps


def _deltas(spark, sf):
    """The sums of each label's vectors as score differences."""
    v = _t(spark, sf, "embeddings").where("embedding is not null").withColumn("delta", _total(8))
    return v.select(F.col("label").cast("string").alias("fault_type"), F.lit("context.noise_ratio").alias("metric_name"), F.col("vec_id").alias("line"), F.lit("ok").alias("state"), F.lit(0.0).alias("h_score"), F.col("delta").alias("score"), "delta")


def a4_group_summary(spark, sf):
    s = stats.summarise(_deltas(spark, sf), "demo")
    r = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return s.select("fault_type", "sample_count", r("mean_delta"), r("median_delta"), r("std_delta"), "improved_count", "degraded_count", "unchanged_count", r("quality_mean_delta"), r("standardized_effect"))


def a9_rank_biserial(spark, sf):
    return stats.rank_biserial(_deltas(spark, sf), ["fault_type"]).select("fault_type", F.round("rank_biserial_effect", 6).alias("rank_biserial_effect"))


def a13_compare_runs(spark, sf):
    run = lambda steps: _t(spark, sf, "embeddings").select(F.col("vec_id").alias("line"), F.col("vec_id").cast("string").alias("trace_id"), F.lit("m").alias("metric_name"), _total(steps).alias("score"), F.lit("ok").alias("status"), F.col("label").cast("string").alias("label"))
    out, _ = stats.compare_runs([run(64), run(8)])
    return out.withColumn("exact_match_rate", F.round("exact_match_rate", 6)).withColumn("mean_absolute_score_delta", F.round("mean_absolute_score_delta", 6))


def a14_label_accuracy(spark, sf):
    own = _t(spark, sf, "labels")
    predicted = own.select(F.col("doc_id").alias("line"), F.col("doc_id").cast("string").alias("trace_id"), F.col("quality").cast("string").alias("label"))
    want = own.select(F.col("doc_id").cast("string").alias("trace_id"), F.col("toxic").cast("string").alias("expected"))
    return stats.accuracy(stats.against_labels(predicted, want)).withColumn("accuracy", F.round("accuracy", 6))


def a15_human_agreement(spark, sf):
    name = lambda c: F.when(F.col(c) == 1, "retrieval").otherwise("chunking")
    rows = stats.human_agreement(_t(spark, sf, "labels").select(name("quality").alias("expected"), name("toxic").alias("human")))
    return rows.groupBy("expected", "human", "kind").agg(F.count(F.lit(1)).alias("n"))


def a15_agreement_summary(spark, sf):
    name = lambda c: F.when(F.col(c) == 1, "retrieval").otherwise(F.when(F.col("doc_id") % 2 == 0, "chunking").otherwise("generation"))
    rows = stats.human_agreement(_t(spark, sf, "labels").select(name("quality").alias("expected"), name("toxic").alias("human")))
    s = stats.agreement_summary(rows)
    return s.withColumn("accuracy", F.round("accuracy", 6)).withColumn("partial_accuracy", F.round("partial_accuracy", 6))


def a15_agreement_by_class(spark, sf):
    name = lambda c: F.when(F.col(c) == 1, "retrieval").otherwise(F.when(F.col("doc_id") % 2 == 0, "chunking").otherwise("generation"))
    return stats.agreement_by(stats.human_agreement(_t(spark, sf, "labels").select(name("quality").alias("expected"), name("toxic").alias("human"))), "expected")


def d4_confusion(spark, sf):
    rows = _t(spark, sf, "labels").select(F.col("quality").cast("string").alias("expected"), F.col("toxic").cast("string").alias("human"))
    return stats.confusion(rows, axis=["0", "1", "2"])


#: Fixed pieces of the SQL below.
_WORDS, _SENTENCES = O.WORDS, O.SENTENCES
_STOP = O.quoted(T.STOP_WORDS["en"])
_TOKENS = "list_distinct(list_filter(" + _WORDS + ", lambda w: not list_contains(" + _STOP + ", w)))"
_CHECKS = r"[^\p{L}\p{N}_\s.,!?;:''\"()\-\x{0400}-\x{04ff}]"
_RANKED = """ranked as (select *, row_number() over (partition by sample_id order by round(score, 9) desc, ordinal) as rank from scored)"""
_DENSE = (
    """v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings where embedding is not null and label is not null),
 u as (select vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as e from v),
 q as (select label, arg_min(e, vec_id) as q from u group by label),
 scored as (select u.label as sample_id, vec_id as ordinal, vec_id::varchar as chunk_id, list_sum(list_transform(list_zip(e, q), lambda p: p[1] * p[2])) as score from u join q using (label)),
 """
    + _RANKED
    + """, top as (select * from ranked where rank <= 5),
 gold as (select label as sample_id, list_transform((list_sort(list(vec_id)))[1:10], lambda x: x::varchar) as ids from embeddings where label is not null group by label),
 found as (select gold.sample_id, ids, coalesce(list(chunk_id order by rank) filter (chunk_id is not null), []) as got from gold left join top using (sample_id) group by all)"""
)
_EVAL = "select sample_id, len(list_intersect(ids, got)) / len(ids) as recall, (len(list_intersect(ids, got)) > 0)::int as hit, len(ids) as n from found"
_TURNS = "t as (select conv_id, turn, role, text, lead(role) over w as next_role, lead(text) over w as answer from conversations window w as (partition by conv_id order by turn))"
_DELTAS = "d as (select label::varchar as fault_type, list_sum([floor(8 * c::double + 0.5)::bigint for c in embedding]) / 8.0::double as delta from embeddings where embedding is not null)"

SQL = {
    "t1_metric_tokens": "with w as (select doc_id, case when lang = 'en' then list_filter(" + _WORDS.format("text") + ", lambda w: not list_contains(" + _STOP + ", w)) else " + _WORDS.format("text") + " end as w from documents) select doc_id, len(w) as n, md5(array_to_string(w, ' ')) as digest from w",
    "r1_words": "with w as (select doc_id, " + _WORDS.format("text") + " as w from documents) select doc_id, len(w) as n, len(list_distinct(w)) as n_distinct from w",
    "t2_sentences": "with s as (select doc_id, " + _SENTENCES.format("text") + " as s from documents) select doc_id, len(s) as n, md5(array_to_string(s, chr(10))) as digest from s",
    "t3_normal_form": r"select md5(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')) as form, count(*) as n from documents group by 1",
    "t4_text_checks": "select doc_id, length(regexp_replace(text, '" + _CHECKS + "', '', 'g')) / length(text) > 0.7 as readable, regexp_matches(text, '" + "|".join(T.CUT_SHORT) + "') as cut_short, regexp_matches(lower(text), '" + "|".join(T.API_ERRORS) + "') as api_error, regexp_matches(lower(text), '" + "|".join(T.REFUSALS) + "') as refusal from documents",
    "c7_gold_locate": "with s as (select doc_id, text, " + _SENTENCES.format("text") + " as s from documents), g as (select doc_id, text, s[len(s)] as g from s), p as (select doc_id, g, nullif(instr(text, g), 0) - 1 as a from g) select doc_id, a as gold_start, a + length(g) as gold_end from p",
    "r2_bm25": "with n as (select count(*) as items from benchmark), c as (select doc_id % items as sample_id, doc_id, " + _WORDS.format("text") + " as w from documents, n), pool as (select sample_id, count(*) as n, avg(len(w)) as avgdl from c group by 1 having avg(len(w)) > 0),"
    " x as (select sample_id, doc_id, len(w) as dl, unnest(w) as term from c), tf as (select sample_id, doc_id, dl, term, count(*) as tf from x group by all),"
    " df as (select sample_id, term, count(*) as df from tf group by all), raw as (select df.*, ln(n - df + 0.5) - ln(df + 0.5) as r, avgdl from df join pool using (sample_id)),"
    " idf as (select *, case when r < 0 then 0.25 * avg(r) over (partition by sample_id) else r end as idf from raw),"
    " q as (select item_id as sample_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as term from benchmark), qc as (select sample_id, term, count(*) as times from q group by all),"
    " s as (select sample_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as s from tf join qc using (sample_id, term) join idf using (sample_id, term) group by all),"
    " scored as (select c.sample_id, c.doc_id as ordinal, c.doc_id as chunk_id, coalesce(s, 0) as score from c join pool using (sample_id) join benchmark on item_id = c.sample_id left join s on s.sample_id = c.sample_id and s.doc_id = c.doc_id), "
    + _RANKED
    + " select sample_id, rank::int as rank, chunk_id, round(score, 6) as score from ranked where rank <= 5",
    "r3_dense": "with " + _DENSE + " select sample_id, rank::int as rank, chunk_id, round(score, 5) as score from top",
    "r6_retrieval_eval": "with " + _DENSE + ", e as (" + _EVAL + ") select sample_id, round(recall, 6) as recall_at_k, hit as hit_at_k, n::int as n_gold_chunks from e",
    "r7_run_summary": "with " + _DENSE + ", e as (" + _EVAL + ") select count(*) as samples, count(hit) as with_gold, round(avg(recall), 6) as recall_at_k, round(avg(hit), 6) as hit_at_k from e",
    "m1_m4_retrieval_metrics": "with " + _DENSE + """, m as (select sample_id, ids, got, list_filter(got, lambda x: list_contains(ids, x)) as hits from found),
 f as (select *, list_position(got, hits[1]) as first from m),
 r as (select sample_id, 'retrieval.hit_at_k' as metric_name, (len(hits) > 0)::int::double as score, case when len(hits) > 0 then 'hit' else 'miss' end as label from f
 union all select sample_id, 'retrieval.recall_at_k', len(hits) / len(ids), case when len(hits) = len(ids) then 'complete' when len(hits) > 0 then 'partial' else 'miss' end from f
 union all select sample_id, 'retrieval.precision_at_k', len(hits) / len(got), case when len(hits) / len(got) >= 0.8 then 'high' when len(hits) > 0 then 'partial' else 'none' end from f
 union all select sample_id, 'retrieval.mrr', coalesce(1.0 / first, 0), case when first is null then 'miss' else 'ranked' end from f)
 select sample_id::varchar as trace_id, metric_name, round(score, 6) as score, label, 'ok' as status from r""",
    "m10_m11_generation_metrics": "with " + _TURNS + ", u as (select conv_id || '-' || turn as trace_id, text, answer, " + _TOKENS.format("text") + " as q, " + _TOKENS.format("answer") + " as a, " + _SENTENCES.format("answer") + " as s from t where role = 'user' and next_role = 'assistant'),"
    " k as (select *, list_transform(s, lambda x: " + _TOKENS.format("x") + ") as st from u),"
    " f as (select *, len(list_filter(st, lambda x: len(x) > 0 and len(list_intersect(x, q)) / len(x) >= 0.5)) / len(s) as support, len(list_intersect(q, a)) / len(q) as shared from k),"
    """ r as (select trace_id, 'generation.answer_relevance' as metric_name, case when trim(text) = '' or trim(answer) = '' or len(q) = 0 then null else shared end as score from f
 union all select trace_id, 'generation.faithfulness', case when trim(text) = '' or trim(answer) = '' or len(s) = 0 then null else support end from f)
 select trace_id, metric_name, round(score, 6) as score, case when score is null then 'unknown' when metric_name = 'generation.answer_relevance' then case when score >= 0.5 then 'relevant' when score > 0 then 'weakly_relevant' else 'unrelated' end
 else case when score >= 0.8 then 'supported' when score >= 0.5 then 'partially_supported' else 'unsupported' end end as label, case when score is null then 'skipped' else 'ok' end as status from r""",
    "a4_group_summary": "with " + _DELTAS + " select fault_type, count(*) as sample_count, round(avg(delta), 6) + 0.0 as mean_delta, round(median(delta), 6) + 0.0 as median_delta, round(stddev_pop(delta), 6) as std_delta, count(*) filter (delta < 0) as improved_count, count(*) filter (delta > 0) as degraded_count, count(*) filter (delta = 0) as unchanged_count, round(-avg(delta), 6) + 0.0 as quality_mean_delta, round(avg(delta) / nullif(stddev_pop(delta), 0), 6) as standardized_effect from d group by 1",
    "a9_rank_biserial": "with " + _DELTAS + ", r as (select fault_type, delta, rank() over (partition by fault_type order by abs(delta)) + (count(*) over (partition by fault_type, abs(delta)) - 1) / 2 as r from d where delta <> 0) select fault_type, round(sum(case when delta > 0 then r else -r end) / sum(r), 6) as rank_biserial_effect from r group by 1",
    "a13_compare_runs": "with r as (select list_sum([floor(64 * c::double + 0.5)::bigint for c in embedding]) / 64.0::double as a, list_sum([floor(8 * c::double + 0.5)::bigint for c in embedding]) / 8.0::double as b from embeddings) select 2 as run_count, count(*) as result_count, count(*) filter (a = b) as exact_matches, round(count(*) filter (a = b) / count(*), 6) as exact_match_rate, round(round(avg(abs(a - b)), 12), 6) as mean_absolute_score_delta from r",
    "a14_label_accuracy": "select count(*) as total, count(*) filter (quality = toxic) as correct, round(count(*) filter (quality = toxic) / count(*), 6) as accuracy, 0::bigint as missing from labels",
    "a15_human_agreement": "select case when quality = 1 then 'retrieval' else 'chunking' end as expected, case when toxic = 1 then 'retrieval' else 'chunking' end as human, case when quality = toxic then 'exact' else 'partial' end as kind, count(*) as n from labels group by all",
    "d4_confusion": "select e as expected, g as got, count(quality) as n from (select unnest(['0', '1', '2']) as e) cross join (select unnest(['0', '1', '2']) as g) left join labels on quality::varchar = e and toxic::varchar = g group by all",
}

_R = "with recursive "
_LINES = "l as (select coalesce(lang, 'none') as kind, doc_id, row_number() over (partition by coalesce(lang, 'none') order by doc_id) as number, doc_id % 10 as m from documents)"
_NAMED = "l as (select case when quality = 1 then 'retrieval' when doc_id % 2 = 0 then 'chunking' else 'generation' end as expected, case when toxic = 1 then 'retrieval' when doc_id % 2 = 0 then 'chunking' else 'generation' end as human from labels), k as (select *, case when expected = human then 'exact' when expected in ('chunking', 'retrieval') and human in ('chunking', 'retrieval') then 'partial' else 'mismatch' end as kind from l)"
_JUDGED = "j as (select doc_id, quality::varchar as expected, case when doc_id % 5 > 0 then toxic::varchar end as predicted, doc_id % 3 > 0 as supported, doc_id % 7 + 1 as confidence, case when doc_id % 4 > 0 then 'diagnosed' else 'unknown' end as st from labels)"
_NATURAL = "a as (select doc_id, quality::varchar as d, quality = 1 as hit from labels), b as (select doc_id, lang as d, lang = 'en' as hit from documents where doc_id % 3 > 0), p as (select a.d as l, b.d as r, coalesce(a.hit, false) as lh, coalesce(b.hit, false) as rh from a full join b using (doc_id))"
_GOLD_SQL = "list_sort(list_distinct(gold))"
_PRESENT = "len(list_intersect(list_distinct(gold), list_distinct(selected)))"
_QUALITY = _R + O.TRACES + ", " + O.TAGS
_FAULT_ROWS = ", ".join(f"('{f}', '{d}', '{c}')" for f, (_, d, c) in faults.FAULTS.items())

SQL |= {
    "c1_c6_chunks": _R + O.CHUNKS.replace("{prefix}", "") + " select chunk_id, doc_id::varchar as document_id, chunk_index::int as chunk_index, start_char, end_char, " + O.COUNT.format("text") + "::int as token_count, md5(text) as digest from chunks",
    "c8_gold_cover": _R + O.CHUNKS.replace("{prefix}", "") + ", s as (select doc_id, text, " + _SENTENCES.format("text") + " as s from documents), g as (select doc_id, s[len(s)] as g, nullif(instr(text, s[len(s)]), 0) - 1 as gs from s)"
    " select g.doc_id::varchar as sample_id, any_value(gs)::int as gold_start, any_value(gs + length(g))::int as gold_end, coalesce(string_agg(c.chunk_id, ',' order by c.chunk_index), '') as covering, coalesce(bool_or(c.start_char <= gs and gs + length(g) <= c.end_char), false) as is_preserved, any_value(gs) is not null as locate_ok"
    " from g left join chunks c on c.doc_id = g.doc_id and c.start_char < gs + length(g) and gs < c.end_char group by g.doc_id",
    "m5_m9_trace_metrics": _R + O.TRACES + ", " + O.metrics("traces") + " select trace_id, metric_name, stage, round(score, 6) as score, label, status, warnings, error from results",
    "m_variant_metrics": _R + O.TRACES + ", " + O.metrics("traces") + " select trace_id, metric_name, round(score, 6) as score, label, status from results",
    "m0_counters": _R + O.TRACES + ", " + O.metrics("traces") + " select count(distinct trace_id) as input_traces, count(*) as results, count(*) filter (status = 'skipped') as skipped_metrics, count(*) filter (status = 'error') as errors from results",
    "m0e_extractors": _R + O.TRACES + " select trace_id, array_to_string(" + _GOLD_SQL + ", ',') as gold, array_to_string(list_sort(list_distinct(selected)), ',') as selected, array_to_string(ids, ',') as retrieved from traces",
    "x_context": _R + O.TRACES + " select trace_id, array_to_string(selected, ',') as selected, array_to_string(repeated, ',') as repeated, case when context = '' then 0 else " + O.COUNT.format("context") + " end::int as tokens, truncated, md5(context) as digest from traces",
    "x3_token_budget": _R + "t as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) as r from conversations),"
    " x as (select conv_id, 0::bigint as r, []::varchar[] as seen, []::varchar[] as selected, []::varchar[] as dropped, []::varchar[] as repeated, []::varchar[] as parts, 0::bigint as tokens from (select distinct conv_id from conversations) c"
    " union all select conv_id, r + 1, case when twice then seen else list_append(seen, key) end, case when twice or big then selected else list_append(selected, turn::varchar) end, case when big and not twice then list_append(dropped, turn::varchar) else dropped end,"
    " case when twice then list_append(repeated, turn::varchar) else repeated end, case when twice or big then parts else list_append(parts, piece) end, case when twice or big then tokens else tokens + cost end from ("
    " select *, len(selected) > 0 and tokens + cost > 60 as big from (select *, list_contains(seen, key) as twice, " + O.COUNT.format("piece") + " as cost from ("
    " select x.*, turn, " + O.FORM.format("text") + " as key, '[' || (len(selected) + 1) || '] (source: ' || role || ')' || chr(10) || text as piece from x join t on t.conv_id = x.conv_id and t.r = x.r + 1) a) b) c),"
    " z as (select * from x qualify row_number() over (partition by conv_id order by r desc) = 1)"
    " select conv_id, array_to_string(selected, ',') as selected, array_to_string(dropped, ',') as dropped, array_to_string(repeated, ',') as repeated, md5(array_to_string(parts, chr(10) || chr(10))) as digest from z",
    "x5_gold_in_context": _R + O.TRACES + " select trace_id, case when len(gold) > 0 then (" + _PRESENT + " > 0)::int end as gold_in_context from traces",
    "g_traces": _R + O.TRACES + " select trace_id, 'sample_' || sample as source_record_id, lang as language, md5(" + O.PROMPT + ") as prompt, 'success' as status from traces",
    "g2_generate": "select conv_id || '-' || turn as sample_id, '[DRY_RUN] 占位答案，未调用真实模型。' as final_answer, 'success' as status, null::varchar as error from conversations where role = 'user'",
    "q_quality": _QUALITY + " select trace_id, array_to_string(tags, ',') as tags, severity, severity <> 'high' as usable, len(tags) > 0 as has_issues, len(" + _GOLD_SQL + ")::int as n_gold_chunks, " + _PRESENT + "::int as n_present_chunks, " + _PRESENT + " > 0 as gold_present_any, len(gold) > 0 and " + _PRESENT + " = len(" + _GOLD_SQL + ") as gold_present_all from graded",
    "q_variant_quality": _QUALITY + ", w as (select *, list_filter(list_transform(tags, lambda t: case t when 'missing_fields' then 'Missing fields: language' when 'gold_evidence_lost_in_chunking' then 'Gold evidence 0 lost in chunking' when 'no_retrieved_chunks' then 'No retrieved chunks'"
    " when 'duplicate_retrieved_chunks' then 'Duplicate retrieved chunks found' when 'empty_final_context' then 'Final context is empty' when 'context_truncated' then 'Context appears truncated' when 'gold_evidence_not_in_context' then 'Gold evidence chunks not found in context'"
    " when 'gold_evidence_partial_in_context' then 'Partial gold evidence: ' || " + _PRESENT + " || '/' || len(" + _GOLD_SQL + ") when 'answer_truncated' then 'Answer appears truncated' when 'possible_safety_refusal' then 'Possible safety refusal in answer'"
    " else case when starts_with(t, 'unsupported_language_') then 'Unsupported language: ' || coalesce(lang, 'None') else '' end end), lambda x: x <> '') as w from graded) select trace_id, array_to_string(tags, ',') as tags, array_to_string(w, ' | ') as warnings from w",
    "q5_tag_counts": _QUALITY + " select tag, count(*) as n from (select unnest(tags) as tag from graded) q group by 1",
    "q5_severities": _QUALITY + " select severity, count(*) as n, count(*) filter (severity <> 'high') as usable, count(*) filter (" + _PRESENT + " > 0) as gold_any, count(*) filter (len(gold) > 0 and " + _PRESENT + " = len(" + _GOLD_SQL + ")) as gold_all from graded group by 1",
    "q5_top_tags": _QUALITY + ", c as (select tag, count(*) as n from (select unnest(tags) as tag from graded) q group by 1) select 'documents_bm25_v1' as pipeline_id, tag, n, row_number() over (order by n desc, tag)::int as place from c qualify place <= 5",
    "q6_problems": _QUALITY + " select trace_id, severity from graded where len(tags) > 0",
    "h1_healthy": _R + O.TRACES + ", " + O.HEALTHY + " select trace_id, true as _is_healthy from healthy",
    "f_fault_injection": _R + O.TRACES + ", " + O.faulty("traces") + ", k as (select * from (values " + _FAULT_ROWS + ") t(fault, diagnosis, change)) select trace_id as original_trace_id, fault as injected_fault, method as injection_method, diagnosis as expected_diagnosis, change as expected_metric_change, query, answer, md5(context) as context, md5(prompt) as prompt,"
    " array_to_string(selected, ',') as selected, array_to_string(ids, ',') as retrieved, array_to_string(sources, ',') as sources, md5(array_to_string(texts, '|')) as texts from faulty join k using (fault)",
    "a3_deltas": O.DELTAS + " select fault_type, metric_name, trace_id as original_trace_id, state, round(delta, 6) as delta from deltas",
    "a_controlled_failures": O.SUMMARY + ", " + O.intervals() + " select s.*, i.ci_95_lower, i.ci_95_upper from summary s left join intervals i using (fault_type, metric_name)",
    "a17_summary": O.SUMMARY + " select * from summary",
    "a11_a12_core": O.SUMMARY + " select " + ", ".join(c for c in stats.CORE if not c.startswith("ci_95")) + " from summary where expected_direction <> 'unspecified'",
    "a15_agreement_summary": "with " + _NAMED + " select count(*) as total, count(*) filter (kind = 'exact') as exact_matches, count(*) filter (kind = 'partial') as partial_matches, count(*) filter (kind = 'mismatch') as mismatches, round(count(*) filter (kind = 'exact') / count(*), 6) as accuracy, round(count(*) filter (kind <> 'mismatch') / count(*), 6) as partial_accuracy from k",
    "a15_agreement_by_class": "with " + _NAMED + " select expected, count(*) as total, count(*) filter (kind = 'exact') as correct from k group by 1",
    "a16_stratified": "with r as (select quality || '/' || toxic as f, doc_id::varchar as d from labels), h as (select *, md5('42|' || f || '|' || d) as h from r), k as (select *, row_number() over (partition by f order by h, d) as k, count(*) over () as total from h), e as (select greatest(1, 30 // count(distinct f)) as each from r)"
    " select f as injected_fault, d as original_trace_id from k, e order by case when k <= each then 0 else 1 end, h, d limit 30",
    "n1_n4_english": "with s as (select doc_id, lang, source, " + _SENTENCES.format("text") + " as s from documents), p as (select *, 'en__hotpot__' || doc_id as id, list_filter(s, lambda x, i: i % 3 = 1) as a, list_filter(s, lambda x, i: i % 3 = 2) as b, list_filter(s, lambda x, i: i % 3 = 0) as c from s)"
    " select id as sample_id, md5(coalesce(s[1], '')) as question, array_to_string(list_filter(case when lang = source then [lang] else [lang, source] end, lambda x: x <> ''), ' | ') as reference_answer,"
    " md5(id || '__doc_000=' || lang || '=' || array_to_string(a, '') || '|' || id || '__doc_001=' || source || '=' || array_to_string(b, '') || '|' || id || '__doc_002=' || lang || '=' || array_to_string(c, '')) as documents,"
    " md5(id || '__doc_001=0=' || coalesce(b[1], '') || '|' || id || '__doc_000=1=' || coalesce(a[2], '') || '|' || id || '__doc_000=7=' || coalesce(a[8], '')) as gold from p",
    "n5_n6_russian": "with s as (select *, row_number() over (order by doc_id) as n, " + _SENTENCES.format("text") + " as s from documents), r as (select *, coalesce(s[len(s) // 2 + 1], '') as part from s), g as (select *, case when doc_id % 3 = 0 then null else nullif(instr(text, part), 0) - 1 end as a from r)"
    " select printf('ru__retrieval_dataset__%06d', n) as sample_id, lang as question, source as reference_answer, case when doc_id % 3 = 0 or part <> '' then printf('ru__retrieval_dataset__%06d', n) || '__doc_000' end as document_id, case when part <> '' then a end::int as char_start, case when part <> '' then a + length(part) end::int as char_end from g where doc_id % 7 <> 0",
    "s8_csv_records": "select doc_id, md5(regexp_replace(text, '\\r\\n?', chr(10), 'g')) as digest, coalesce(source, '') as source, 3 as n_fields from documents where text is not null",
    "q4_duplicates": _QUALITY + ", c as (select *, unnest(case when sample % 2 = 0 then [0, 1] else [0] end) as copy from graded) select trace_id, copy, array_to_string(case when copy = 1 then list_append(tags, 'duplicate_trace_id') else tags end, ',') as tags, severity, severity <> 'high' as usable from c",
    "d7_manifest": "with r as (select source, sha256('{\"doc_id\":' || doc_id || ',\"lang\":' || coalesce('\"' || lang || '\"', 'null') || ',\"n_chars\":' || n_chars || '}') as h from documents), p as (select source, substr(h, 1, 3) as part, count(*) as n, sha256(string_agg(h, '' order by h)) as h from r group by all)"
    " select source, sum(n)::bigint as rows, sha256(string_agg(h, '' order by part)) as sha256 from p group by source",
    "d7_files": "with f as (select quality, string_agg(doc_id || ',' || toxic || chr(10), '' order by doc_id) as body from labels group by quality) select quality::varchar as quality, length(body)::bigint as length, sha256(body) as sha256 from f",
    "s1_s2_lines": "with " + _LINES + " select number, case when m = 7 then '{bad ' || doc_id when m = 9 then '[' || doc_id || ']' else '{\"trace_id\": \"t' || doc_id || '\"}' end as value, m not in (7, 9) as good, case m when 7 then 'not valid JSON' when 9 then 'trace must be a JSON object' end as message from l where m <> 3",
    "s3_metric_scan": "with " + _LINES + " select 'line-' || number as trace_id, case m when 7 then 'not valid JSON' else 'trace must be a JSON object' end as message, 11 * count(*) as n from l where m in (7, 9) group by 1, 2",
    "d1_unquoted": "select conv_id, turn, case when turn % 2 = 0 then conv_id || ',\"' || role || '\"' else conv_id || ',' || turn || ',' || role end as value, turn % 2 = 0 as recovered from conversations",
    "d2_diagnoses": _R + O.TRACES + ", " + O.metrics("traces") + ", p as (pivot (select trace_id, metric_name, label from results) on metric_name in ('retrieval.hit_at_k', 'retrieval.recall_at_k', 'generation.answer_relevance', 'generation.faithfulness') using any_value(label) group by trace_id),"
    " st as (select trace_id, bool_or(status = 'error') as broken, bool_and(status = 'skipped') as nothing from results group by 1), cut as (select trace_id, len(list_filter(texts, lambda t: not " + O.BLANK.format("t") + " and " + O.MARKED.format("t") + ")) > 0 as cut from more),"
    " d as (select trace_id, broken, nothing, case when \"retrieval.hit_at_k\" = 'miss' then 'retrieval_missing_evidence' when \"retrieval.recall_at_k\" = 'partial' then 'retrieval_incomplete_evidence' when cut then 'chunking_integrity_failure' when \"generation.answer_relevance\" = 'unrelated' then 'answer_query_mismatch' when \"generation.faithfulness\" = 'unsupported' then 'unsupported_or_contradictory_answer' end as cause from p join st using (trace_id) join cut using (trace_id)),"
    " e as (select *, case when broken then 'input_error' when nothing then 'unknown' when cause is not null then 'diagnosed' else 'no_decisive_fault' end as s from d) select trace_id, s as diagnosis_status, case when s = 'diagnosed' then cause end as primary_cause from e",
    "d3_rates": "with " + _JUDGED + " select round(count(*) filter (predicted = expected) / count(*), 6) as strict_accuracy, round(count(*) filter (predicted = expected and supported) / nullif(count(*) filter (supported), 0), 6) as supported_accuracy, round(count(predicted) / count(*), 6) as coverage, round((count(*) - count(predicted)) / count(*), 6) as abstention from j",
    "d5_review_queue": "with " + _JUDGED + ", r as (select doc_id, list_filter([case when predicted is null or predicted <> expected then 'mismatch' else '' end, case when confidence <= 4 then 'low_confidence' else '' end, case when st <> 'diagnosed' then 'not_diagnosed' else '' end, case when not supported then 'unsupported_gold' else '' end, case when doc_id % 11 = 0 then 'warnings' else '' end], lambda x: x <> '') as r from j) select doc_id, array_to_string(r, ',') as reasons from r where len(r) > 0",
    "d6_natural_pairs": "with " + _NATURAL + " select case when lh and rh then 'both' when lh then 'only_left' when rh then 'only_right' else 'neither' end as bucket, count(*) as n from p group by 1",
    "d6_transitions": "with " + _NATURAL + " select l as left, r as right, count(*) as n from p group by 1, 2",
    "d7_difference": "select count(*) filter (lang = 'de') as only_left, count(*) filter (lang = 'fr') as only_right from documents",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        s1_s2_lines, s3_metric_scan, s8_csv_records, n1_n4_english, n5_n6_russian, t1_metric_tokens, r1_words, t2_sentences, t3_normal_form, t4_text_checks, c1_c6_chunks, c7_gold_locate, c8_gold_cover,
        r2_bm25, r3_dense, r6_retrieval_eval, r7_run_summary, x_context, x3_token_budget, x5_gold_in_context, g_traces, g2_generate,
        m0_counters, m0e_extractors, m1_m4_retrieval_metrics, m10_m11_generation_metrics, m5_m9_trace_metrics, m_variant_metrics, q_quality, q_variant_quality, q5_tag_counts, q5_severities, q5_top_tags, q6_problems, q4_duplicates,
        h1_healthy, f_fault_injection, a_controlled_failures, a3_deltas, a17_summary, a11_a12_core, a4_group_summary, a9_rank_biserial, a13_compare_runs, a14_label_accuracy,
        a15_human_agreement, a15_agreement_summary, a15_agreement_by_class, a16_stratified, d1_unquoted, d2_diagnoses, d3_rates, d4_confusion, d5_review_queue, d6_natural_pairs, d6_transitions, d7_difference, d7_manifest, d7_files,
    ]
    return {f.__name__: f for f in own}
