"""Command line: python -m tracelab COMMAND. Paths are any that Spark reads; JSON lines are written as a folder of parts."""

from __future__ import annotations

import argparse
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunking, faults, metrics, normalize, quality, retrieval, stats
from .plans import stages
from .sources import jsonl
from .sources.storage import stored


def _records(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = jsonl.first(jsonl.parsed(jsonl.lines(spark, a.input)), a.limit)
    return rows.withColumnRenamed("trace", "record")


def normalize_english(spark, a):
    good, bad = normalize.english(_records(spark, a))
    jsonl.write_jsonl(good, a.output)
    return {"failed": bad.count()}


def normalize_russian(spark, a):
    jsonl.write_jsonl(normalize.russian(_records(spark, a)), a.output)


def _stage(spark, a, made) -> dict:
    jsonl.write_jsonl(made(stages.read(spark, a.input, stages.SAMPLE, a.limit)).drop("line"), a.output)
    return {}


def chunk(spark, a):
    counter = None if a.fallback_counter else chunking.tiktoken_counter
    return _stage(spark, a, lambda rows: stages.chunk(rows, a.chunk_size, a.overlap, counter))


def retrieve(spark, a):
    _stage(spark, a, lambda rows: stages.retrieve(rows, a.method, a.top_k, retrieval.encoder_of(a.model) if a.method == "dense" else None))
    return stages.evaluated(stages.read(spark, a.output, stages.SAMPLE)).first().asDict()


def build_context(spark, a):
    return _stage(spark, a, lambda rows: stages.contexts(rows, a.max_tokens, not a.no_dedup))


def generate(spark, a):
    done = stages.read(spark, a.resume, stages.TRACE) if a.resume else None
    rows = stages.read(spark, a.input, stages.SAMPLE, a.limit)
    jsonl.write_jsonl(stages.generate(rows, a.pipeline_id, a.run_id or uuid.uuid4().hex, a.backend, done=done), a.output)


def run_metrics(spark, a):
    results = metrics.score(jsonl.parsed(jsonl.lines(spark, a.input)), jsonl.settings(a.config))
    return jsonl.write_results(results, a.output)


def _results(spark, path: str) -> DataFrame:
    rows = jsonl.strict(spark, path)
    text = lambda n: F.try_variant_get("trace", f"$.{n}", "string").alias(n)
    return rows.select("line", *[text(n) for n in ("trace_id", "metric_name", "status", "label", "fault_label", "diagnosis_label")], F.try_variant_get("trace", "$.score", "double").alias("score"))


def validate(spark, a):
    if a.runs:
        out, missing = stats.compare_runs([_results(spark, r) for r in a.runs])
        report = out.first().asDict() | {"missing_or_extra_keys": [r.key for r in missing.orderBy("key").limit(100).collect()], "missing_or_extra_count": missing.count()}
    else:
        rows = _results(spark, a.metrics)
        used = next((n for n in ("fault_label", "diagnosis_label", "label") if not rows.where(F.col(n).isNotNull()).isEmpty()), "label")
        report = stats.accuracy(stats.against_labels(rows.select("line", "trace_id", F.col(used).alias("label")), jsonl.annotations(spark, a.labels))).first().asDict()
    jsonl.write_text(spark, json.dumps(report, ensure_ascii=False, indent=2) + "\n", a.output)
    return report


def check_quality(spark, a):
    rows = jsonl.parsed(jsonl.lines(spark, a.input)).where("trace is not null")
    checked = stored(quality.check(rows.select("line", "trace")), "quality")
    report = quality.report(checked)
    jsonl.write_text(spark, json.dumps(report, ensure_ascii=False, indent=2), a.output_report)
    jsonl.write_jsonl(quality.problems(checked).drop("line"), a.output_problematic)
    return {k: report[k] for k in ("total_traces", "usable_traces", "problematic_traces")}


def healthy(spark, a):
    jsonl.write_jsonl(faults.healthy(stages.read(spark, a.input, stages.TRACE).drop("line"), a.max_count), a.output)


def inject(spark, a):
    traces = stored(stages.read(spark, a.input, stages.TRACE).drop("line"), "traces")
    chosen = list(faults.INJECTORS) if a.fault == "all" else [a.fault]
    for fault, wrappers in faults.inject_all(traces, chosen, a.count, a.language).items():
        jsonl.write_jsonl(wrappers, f"{a.output}/{fault}.jsonl")
    return {"faults": chosen}


def _wrappers(spark, path: str) -> DataFrame:
    """Wrappers of all *.jsonl files or folders of a directory, with the fault type (the label, or else the name)."""
    rows = jsonl.parsed(jsonl.lines(spark, f"{path}/*.jsonl")).where("trace is not null")
    text = lambda n: F.try_variant_get("trace", f"$.{n}", "string")
    return rows.select("line", text("original_trace_id").alias("original_trace_id"), stats.fault_type(text("injected_fault"), F.col("source_file")).alias("fault_type"), text("expected_diagnosis").alias("expected_diagnosis"), F.variant_get("trace", "$.trace", "variant").alias("trace"))


def _analysed(spark, retriever: str, good: str, faulty: str, config: dict) -> DataFrame:
    own = jsonl.strict(spark, good).select("line", "trace")
    wrapped = stored(_wrappers(spark, faulty), "wrappers")
    last = metrics.score(own, config).groupBy("trace_id", "metric_name").agg(F.max_by(F.struct("status", "score"), "line").alias("r")).select("trace_id", "metric_name", "r.*")
    bad = metrics.score(wrapped.select("line", "trace"), config).join(wrapped.select("line", "original_trace_id", "fault_type"), "line")
    # bounded groups: the intervals that Python's generator draws
    return stats.summarise(stats.pair(last, bad)[0], retriever, draws="python")


def analyze(spark, a):
    config = jsonl.settings(a.config)
    summary = stored(stats.all_retrievers({name: _analysed(spark, name, good, faulty, config) for name, good, faulty in a.retriever}), "summary").orderBy("retriever", "fault_type", "metric_name")
    jsonl.write_report(summary, {"retrievers": [r[0] for r in a.retriever]}, a.output_json, a.output_csv, stats.FIELDS)
    if a.core_csv:
        jsonl.write_text(spark, jsonl.report(stats.core(summary), stats.CORE)[1], a.core_csv)
    if a.heatmap:
        jsonl.draw_heatmap(summary, a.heatmap)
    return {"rows": summary.count()}


def compare_human(spark, a):
    rows = jsonl.annotations(spark, a.human)
    compared = stored(stats.human_agreement(rows.select("trace_id", F.trim("expected_diagnosis").alias("expected"), F.trim("fault_class").alias("human"), "fault_type")), "agreement")
    by = lambda c: {r[0]: {"total": r.total, "correct": r.correct} for r in stats.agreement_by(compared, c).collect()}
    wrong = stats.disagreements(compared).orderBy("trace_id")
    table: dict[str, dict] = {}
    for r in stats.confusion(wrong).collect():
        table.setdefault(r.expected, {})[r.got] = r.n
    report = stats.agreement_summary(compared).first().asDict() | {"by_class": by("expected"), "by_fault_type": by("fault_type"), "confusion_matrix": table, "disagreements": [r.asDict() for r in wrong.select("trace_id", "expected", "human", "fault_type").limit(20).collect()]}
    jsonl.write_text(spark, json.dumps(report, ensure_ascii=False, indent=2), a.output)
    jsonl.write_text(spark, jsonl.report(wrong, ["trace_id", "expected", "human", "fault_type"])[1], a.csv_report)
    return {k: report[k] for k in ("total", "exact_matches", "partial_matches", "mismatches")}


#: Columns of the annotation template.
TEMPLATE = ["trace_id", "annotator", "fault_class", "confidence", "notes", "fault_type", "expected_diagnosis", "query_snippet"]


def template(spark, a):
    rows = _wrappers(spark, a.injected).withColumns({"trace_id": F.coalesce(F.try_variant_get("trace", "$.trace_id", "string"), F.lit("unknown")), "query_snippet": F.substring(F.try_variant_get("trace", "$.query", "string"), 1, 200)})
    drawn = stats.stratified(rows.drop("trace"), a.samples, "fault_type", "trace_id")
    jsonl.write_text(spark, jsonl.report(drawn, TEMPLATE)[1], a.output)
    return {"samples": drawn.count()}


def evaluate_all(spark, a):
    """Healthy traces, all faults and the analysis, one after another."""
    folder = a.output.rstrip("/")
    healthy(spark, argparse.Namespace(input=a.input, output=f"{folder}/healthy.jsonl", max_count=a.max_count))
    inject(spark, argparse.Namespace(input=f"{folder}/healthy.jsonl", output=f"{folder}/faults", fault="all", count=a.count, language=a.language))
    return analyze(spark, argparse.Namespace(retriever=[(a.name, f"{folder}/healthy.jsonl", f"{folder}/faults")], config=a.config, output_json=f"{folder}/report.json", output_csv=f"{folder}/report.csv", core_csv=f"{folder}/core.csv", heatmap=None))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracelab", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name, run, *options, io=("input", "output")):
        own = commands.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        for x in io:
            own.add_argument(f"--{x}", required=True)
        for flag, how in options:
            own.add_argument(flag, **how)
        own.set_defaults(run=run)

    limit = ("--limit", {"type": int})
    config = ("--config", {})
    add("normalize-english", normalize_english, limit)
    add("normalize-russian", normalize_russian, limit)
    add("chunk", chunk, limit, ("--chunk-size", {"type": int, "default": 400}), ("--overlap", {"type": int, "default": 80}), ("--fallback-counter", {"action": "store_true"}))
    add("retrieve", retrieve, limit, ("--method", {"default": "bm25", "choices": ["bm25", "dense"]}), ("--model", {"default": "paraphrase-multilingual-MiniLM-L12-v2", "help": "encoder of dense retrieval"}), ("--top-k", {"type": int, "default": 5}))
    add("context", build_context, limit, ("--max-tokens", {"type": int, "default": 3000}), ("--no-dedup", {"action": "store_true"}))
    add("generate", generate, limit, ("--pipeline-id", {"required": True}), ("--backend", {"default": "dry-run"}), ("--run-id", {}), ("--resume", {"help": "traces of an earlier run"}))
    add("metrics", run_metrics, config)
    add("validate", validate, ("--runs", {"nargs": "+"}), ("--metrics", {}), ("--labels", {}), io=("output",))
    add("quality", check_quality, ("--output-report", {"required": True}), ("--output-problematic", {"required": True}), io=("input",))
    add("healthy", healthy, ("--max-count", {"type": int}))
    add("inject", inject, ("--fault", {"default": "all", "choices": ["all", *faults.INJECTORS]}), ("--count", {"type": int, "default": 20}), ("--language", {"default": "en"}))
    add("analyze", analyze, ("--retriever", {"nargs": 3, "action": "append", "required": True, "metavar": ("NAME", "HEALTHY", "FAULTS")}), ("--output-json", {"required": True}), ("--output-csv", {"required": True}), ("--core-csv", {}), ("--heatmap", {"nargs": "+"}), config, io=())
    add("compare-human", compare_human, ("--csv-report", {"required": True}), io=("human", "output"))
    add("template", template, ("--samples", {"type": int, "default": 30}), io=("injected", "output"))
    add("evaluate", evaluate_all, ("--name", {"default": "bm25"}), ("--count", {"type": int, "default": 20}), ("--max-count", {"type": int}), ("--language", {"default": "any"}), config)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    top = parser()
    a = top.parse_args(argv)
    if a.command == "validate" and not a.runs and not (a.metrics and a.labels):
        top.error("give --runs, or --metrics and --labels")
    own = spark or SparkSession.builder.appName(f"tracelab {a.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    said = a.run(own, a)
    print(json.dumps(said or {}, ensure_ascii=False))
