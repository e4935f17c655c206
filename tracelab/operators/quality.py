"""Data quality of traces: ordered tags per trace with issues and warnings, severity, duplicates and the report."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import variants as V
from .metrics import once

#: Fields that a trace must have, and tags by severity.
REQUIRED = ["trace_id", "source_record_id", "pipeline_id", "language", "query", "reference_answer", "gold_evidence", "retrieval", "context_construction", "generation"]
HIGH = ["empty_query", "no_gold_evidence", "no_retrieved_chunks", "missing_fields", "empty_generated_answer", "empty_final_context", "api_quota_exceeded", "generation_refused_content_policy", "gold_evidence_lost_in_chunking"]
MEDIUM = ["gold_evidence_not_in_context", "generation_status_error", "possible_safety_refusal", "context_truncated", "answer_truncated", "gold_evidence_partial_in_context"]
LEAST = {"query": 3, "answer": 2, "chunk": 20, "context": 50}
MOST_QUERY = 500
#: Retrieved chunks that are looked at one by one.
INSPECTED = 10

ITEM = "struct<kind:string,has_document:boolean,gold_text:string,has_ids:boolean,lost:boolean>"
PIECE = "struct<kind:string,text:string>"
#: What the checks read of a trace. Kinds are Python's names of types; NoneType where there is nothing, and an empty value's
#: kind ends with a question mark.
VIEW = (
    "struct<trace_id:string,pipeline_id:string,language:string,source_record_id:string,missing:array<string>,query:string,reference:string,gold_kind:string,"
    f"gold:array<{ITEM}>,retrieval_kind:string,chunks_kind:string,chunks:array<{PIECE}>,context_kind:string,context:string,generation_kind:string,"
    "answer:string,status:string,error:string,prompt:string,gold_ids:array<string>,selected:array<string>>"
)
#: What a rule that applies says: its tag, the issue that it sets (or adds to, if more), and its warning.
RULE = "struct<tag:string,key:string,messages:array<string>,more:boolean,warning:string>"
NONE = "array<string>"


def _struct(kind: str, values: dict[str, Column]) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()]).cast(kind)


def kind_of(v: Column) -> Column:
    """Python's name of a node's type, with a question mark if the value is empty or zero."""
    items, fields, kind = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "map<string,variant>"), F.schema_of_variant(v)
    empty = lambda name, is_empty: F.when(is_empty, f"{name}?").otherwise(name)
    number = F.try_variant_get(v, "$", "double") == 0
    return (
        F.when(v.isNull() | F.is_variant_null(v), "NoneType")
        .when(fields.isNotNull(), empty("dict", F.size(fields) == 0))
        .when(items.isNotNull(), empty("list", F.size(items) == 0))
        .when(kind == "STRING", empty("str", F.try_variant_get(v, "$", "string") == ""))
        .when(kind == "BOOLEAN", empty("bool", ~F.try_variant_get(v, "$", "boolean")))
        .when(kind == "BIGINT", empty("int", number))
        .otherwise(empty("float", number))
    )


def of_variant(v: Column) -> Column:
    """VIEW of a trace in a VARIANT column."""
    node, text = lambda name: V.node(v, f"$.{name}"), lambda name: V.string(v, f"$.{name}")
    absent = lambda x: x.isNull() | F.is_variant_null(x)
    shown = lambda x, path: F.coalesce(V.string(x, path), F.when(F.is_variant_null(V.node(x, path)), "None").otherwise(""))
    evidence, chunks, generation = V.items(v, "$.gold_evidence"), V.items(v, "$.retrieval.retrieved_chunks"), node("generation")

    def item(x: Column) -> Column:
        ids, flag = V.node(x, "$.covering_chunk_ids"), V.node(x, "$.is_preserved")
        lost = (F.schema_of_variant(flag) == "BOOLEAN") & ~F.try_variant_get(x, "$.is_preserved", "boolean")
        return _struct(ITEM, {"kind": kind_of(x), "has_document": V.node(x, "$.document_id").isNotNull(), "gold_text": V.string(x, "$.gold_text"), "has_ids": ~kind_of(ids).rlike(r"NoneType|\?"), "lost": F.coalesce(lost, F.lit(False))})

    objects = F.filter(F.coalesce(evidence, F.array().cast("array<variant>")), V.is_object)
    return _struct(
        VIEW,
        {
            "trace_id": text("trace_id"),
            "pipeline_id": text("pipeline_id"),
            "language": shown(v, "$.language"),
            "source_record_id": text("source_record_id"),
            "missing": F.array_compact(F.array(*[F.when(absent(node(n)), n) for n in REQUIRED])),
            "query": text("query"),
            "reference": text("reference_answer"),
            "gold_kind": kind_of(node("gold_evidence")),
            "gold": F.transform(evidence, item),
            "retrieval_kind": kind_of(node("retrieval")),
            "chunks_kind": kind_of(V.node(v, "$.retrieval.retrieved_chunks")),
            "chunks": F.transform(chunks, lambda x: _struct(PIECE, {"kind": kind_of(x), "text": V.string(x, "$.text")})),
            "context_kind": kind_of(node("context_construction")),
            "context": text("context_construction.final_context"),
            "generation_kind": kind_of(generation),
            "answer": V.string(generation, "$.final_answer"),
            "status": shown(generation, "$.status"),
            "error": V.string(generation, "$.error"),
            "prompt": V.string(generation, "$.final_prompt"),
            "gold_ids": F.array_distinct(F.flatten(F.transform(objects, lambda x: V.strings(x, "$.covering_chunk_ids")))),
            "selected": F.array_distinct(V.strings(v, "$.context_construction.selected_chunk_ids")),
        },
    )


def of_columns(traces: DataFrame) -> Column:
    """VIEW of typed traces (columns as in plans.traces)."""
    empty = F.array().cast(NONE)
    present = lambda c, name: F.when(F.col(c).isNull(), "NoneType").otherwise(name)
    listed = lambda c: F.when(F.col(c).isNull(), "NoneType").when(F.size(c) == 0, "list?").otherwise("list")
    ids = lambda g: F.filter(F.coalesce(g["covering_chunk_ids"], empty), lambda x: x.isNotNull())
    name = lambda x: F.when(x.isNull(), "NoneType").otherwise("dict")
    item = lambda g: _struct(ITEM, {"kind": name(g), "has_document": F.lit(True), "gold_text": g["gold_text"], "has_ids": F.size(F.coalesce(g["covering_chunk_ids"], empty)) > 0, "lost": F.coalesce(~g["is_preserved"], F.lit(False))})
    chunks = "retrieval.retrieved_chunks"
    return _struct(
        VIEW,
        {
            "trace_id": F.col("trace_id"),
            "pipeline_id": F.col("pipeline_id"),
            "language": F.coalesce("language", F.lit("None")),
            "source_record_id": F.col("source_record_id"),
            "missing": F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in REQUIRED])),
            "query": F.col("query"),
            "reference": F.col("reference_answer"),
            "gold_kind": listed("gold_evidence"),
            "gold": F.transform("gold_evidence", item),
            "retrieval_kind": present("retrieval", "dict"),
            "chunks_kind": listed(chunks),
            "chunks": F.transform(chunks, lambda c: _struct(PIECE, {"kind": name(c), "text": c["text"]})),
            "context_kind": present("context_construction", "dict"),
            "context": F.col("context_construction.final_context"),
            "generation_kind": present("generation", "dict"),
            "answer": F.col("generation.final_answer"),
            "status": F.coalesce("generation.status", F.lit("None")),
            "error": F.col("generation.error"),
            "prompt": F.col("generation.final_prompt"),
            "gold_ids": F.array_distinct(F.flatten(F.transform("gold_evidence", ids))),
            "selected": F.array_distinct(F.filter(F.coalesce("context_construction.selected_chunk_ids", empty), lambda x: x.isNotNull())),
        },
    )


def rule(tag: str | Column, key: str | Column | None = None, message: str | Column | None = None, warning: str | Column | None = None, more: bool = False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    messages = F.lit(None) if message is None else message if isinstance(message, Column) and more is None else F.array(lit(message))
    return _struct(RULE, {"tag": lit(tag), "key": lit(key), "messages": messages, "more": F.lit(bool(more)), "warning": lit(warning)})


def _text_rules(value: Column, least: int, key: str | Column, empty: Column, short: str, rest: Column) -> Column:
    """The rule of a text that is empty, short, or as rest says."""
    too_short = rule(short, key, F.format_string(f"length %d < {least}", F.length(value)))
    return F.when(T.blank(value), empty).when(F.length(value) < least, too_short).otherwise(rest)


def rules(q: Column) -> Column:
    """The rules that apply to a trace (VIEW), in the order of the rule groups; rules of items repeat."""
    some = lambda *own: F.array_compact(F.array(*own))
    none = F.array().cast(f"array<{RULE}>")
    falsy = lambda kind: kind.rlike(r"NoneType|\?")
    bare = lambda kind: F.replace(kind, F.lit("?"), F.lit(""))
    place = lambda name, i: F.format_string(f"{name}[%d]", i)
    query, reference, context, answer, error = q["query"], q["reference"], q["context"], q["answer"], q["error"]
    listed = F.array_join(q["missing"], ", ")
    long = F.when(F.length(query) > MOST_QUERY, rule("query_too_long", "query", F.format_string(f"length %d > {MOST_QUERY}", F.length(query))))
    first = some(
        F.when(F.size(q["missing"]) > 0, _struct(RULE, {"tag": F.lit("missing_fields"), "key": F.lit("missing_fields"), "messages": q["missing"], "more": F.lit(False), "warning": F.concat(F.lit("Missing fields: "), listed)})),
        _text_rules(query, LEAST["query"], "query", rule("empty_query", "query", "empty or whitespace-only", "Query is empty"), "query_too_short", long.when(~T.readable(query), rule("unreadable_query", "query", "contains non-readable characters"))),
        _text_rules(reference, LEAST["answer"], "reference_answer", rule("empty_reference_answer", "reference_answer", "empty or whitespace-only", "Reference answer is empty"), "answer_too_short", F.when(~T.readable(reference), rule("unreadable_answer", "reference_answer", "contains non-readable characters"))),
    )

    def evidence(x: Column, i: Column) -> Column:
        key = place("gold_evidence", i)
        own = some(
            F.when(~x["has_document"], rule("evidence_missing_document_id", key, "missing document_id")),
            F.when(T.blank(x["gold_text"]), rule("evidence_empty_gold_text", key, "empty gold_text")),
            F.when(~x["has_ids"], rule("gold_evidence_no_chunk_ids", key, "missing covering_chunk_ids")),
            F.when(x["lost"], rule("gold_evidence_lost_in_chunking", key, "gold evidence not preserved in chunks", F.format_string("Gold evidence %d lost in chunking", i))),
        )
        return F.when(x["kind"].startswith("dict"), own).otherwise(F.array(rule("gold_evidence_invalid_item", key, F.concat(F.lit("not a dict, got "), bare(x["kind"])))))

    of_gold = (
        F.when(falsy(q["gold_kind"]), F.array(rule("no_gold_evidence", "gold_evidence", "empty list", "No gold evidence provided")))
        .when(q["gold_kind"] != "list", F.array(rule("gold_evidence_not_list", "gold_evidence", F.concat(F.lit("expected list, got "), q["gold_kind"]))))
        .otherwise(F.flatten(F.transform(q["gold"], evidence)))
    )

    def chunk(x: Column, i: Column) -> Column:
        key = place("retrieved_chunks", i)
        cut = F.when(T.cut_short(x["text"]), rule("chunk_truncated", key, "appears truncated", F.format_string("Chunk %d appears truncated", i)))
        own = _text_rules(x["text"], LEAST["chunk"], key, rule("empty_retrieved_chunk", key, "empty text"), "chunk_too_short", cut)
        return F.when(x["kind"].startswith("dict"), own).otherwise(rule("chunk_not_dict", key, F.concat(F.lit("not a dict, got "), bare(x["kind"]))))

    texts = F.transform(F.filter(q["chunks"], lambda x: x["kind"].startswith("dict")), lambda x: F.coalesce(x["text"], F.lit("")))
    again = once(texts, lambda t: F.when(F.size(F.array_distinct(t)) < F.size(t), F.array(rule("duplicate_retrieved_chunks", "retrieval", "duplicate chunk texts found", "Duplicate retrieved chunks found"))).otherwise(none))
    of_retrieval = (
        F.when(falsy(q["retrieval_kind"]), F.array(rule("no_retrieval_data", "retrieval", "empty or missing", "No retrieval data")))
        .when(falsy(q["chunks_kind"]), F.array(rule("no_retrieved_chunks", "retrieval", "retrieved_chunks is empty", "No retrieved chunks")))
        .when(q["chunks_kind"] != "list", F.array(rule("retrieved_chunks_not_list", "retrieval", F.concat(F.lit("expected list, got "), q["chunks_kind"]))))
        .otherwise(F.concat(F.array_compact(F.transform(F.slice(q["chunks"], 1, INSPECTED), chunk)), again))
    )
    n, held = F.size(q["gold_ids"]), F.size(F.array_intersect(q["gold_ids"], q["selected"]))
    part = F.format_string("%d/%d", held, n)
    in_context = some(
        _text_rules(context, LEAST["context"], "context_construction", rule("empty_final_context", "context_construction", "final_context is empty", "Final context is empty"), "context_too_short", F.when(T.cut_short(context), rule("context_truncated", "context_construction", "context appears truncated", "Context appears truncated"))),
        F.when((n > 0) & (held == 0), rule("gold_evidence_not_in_context", "context_construction", F.format_string("no gold evidence chunks in context (gold chunks: %d)", n), "Gold evidence chunks not found in context")).when(
            held < n, rule("gold_evidence_partial_in_context", "context_construction", F.concat(F.lit("partial gold evidence: "), part, F.lit(" chunks in context")), F.concat(F.lit("Partial gold evidence: "), part))
        ),
    )
    of_context = F.when(falsy(q["context_kind"]), none).when(q["context_kind"] != "dict", F.array(rule("context_not_dict", "context_construction", F.concat(F.lit("expected dict, got "), q["context_kind"])))).otherwise(in_context)
    status = q["status"]
    failure = (
        F.when(T.api_error(error), rule("api_quota_exceeded", warning="API quota exceeded"))
        .when(T.refusal(error), rule("generation_refused_content_policy", warning="Generation refused due to content policy"))
        .when(F.lower(error).contains("token") & F.lower(error).contains("max"), rule("hit_max_tokens_limit", warning="Hit max tokens limit"))
    )
    said = F.coalesce(error, F.lit("")) != ""
    told = F.when(said, F.array(F.concat(F.lit("status: "), status), F.concat(F.lit("error: "), error))).otherwise(F.array(F.concat(F.lit("status: "), status)))
    stated = _struct(RULE, {"tag": F.concat(F.lit("generation_status_"), status), "key": F.lit("generation"), "messages": told, "more": F.lit(False), "warning": F.lit(None)})
    refused = T.refusal(q["prompt"]) | T.refusal(error) | F.coalesce(F.lower(status).rlike("refused|blocked"), F.lit(False))
    silent = some(
        rule("empty_generated_answer", "generation", "final_answer is empty", "Generated answer is empty"),
        F.when(refused, rule("generation_refused_content_policy", "generation", "likely safety refusal (empty answer + safety indicators)", "Empty answer likely due to content policy refusal", more=True)),
    )
    answered = some(
        F.when(F.length(answer) < LEAST["answer"], rule("answer_too_short", "generation", F.format_string(f"length %d < {LEAST['answer']}", F.length(answer)))).when(T.cut_short(answer), rule("answer_truncated", "generation", "answer appears truncated", "Answer appears truncated")),
        F.when(T.refusal(answer), rule("possible_safety_refusal", "generation", "possible safety refusal in answer", "Possible safety refusal in answer")),
    )
    of_generation = F.concat(F.when(status != "success", some(stated, F.when(said, failure))).otherwise(none), F.when(T.blank(answer), silent).otherwise(answered))
    of_generation = F.when(falsy(q["generation_kind"]), none).when(q["generation_kind"] != "dict", F.array(rule("generation_not_dict", "generation", F.concat(F.lit("expected dict, got "), q["generation_kind"])))).otherwise(of_generation)
    language = q["language"]
    last = some(
        F.when(F.coalesce(q["pipeline_id"], F.lit("")) == "", rule("missing_pipeline_id", "pipeline_id", "empty or missing", "Missing pipeline_id")),
        F.when(language != "en", rule(F.concat(F.lit("unsupported_language_"), language), "language", F.concat(F.lit("language '"), language, F.lit("' not supported (only 'en' allowed)")), F.concat(F.lit("Unsupported language: "), language))),
        F.when(F.coalesce(q["source_record_id"], F.lit("")) == "", rule("missing_source_record_id", "source_record_id", "empty or missing")),
    )
    return F.concat(first, of_gold, of_retrieval, of_context, of_generation, last)


def issues(own: Column) -> Column:
    """The messages of each key: a rule replaces those that earlier rules of its key set, or adds to them."""
    keys = F.array_distinct(F.filter(F.transform(own, lambda r: r["key"]), lambda k: k.isNotNull()))
    told = lambda k: F.aggregate(F.filter(own, lambda r: r["key"] == k), F.array().cast(NONE), lambda a, r: F.when(r["more"], F.concat(a, r["messages"])).otherwise(r["messages"]))
    return F.map_from_arrays(keys, F.transform(keys, told))


COLUMNS = ["line", "trace_id", "pipeline_id", "quality_tags", "severity", "usable", "has_issues", "n_gold_chunks", "n_present_chunks", "gold_present_any", "gold_present_all", "warnings", "issues"]


def check(traces: DataFrame) -> DataFrame:
    """A row per trace: line, trace_id, pipeline_id, quality_tags, severity, usable, has_issues, gold counts, warnings and
    issues (messages by key). traces: line and trace (VARIANT), or line and the columns of typed traces.

    The second and later rows of a trace_id, in order of line, get the tag duplicate_trace_id; it changes neither severity nor usable.
    """
    firsts = traces.select(F.coalesce(V.string(F.col("trace"), "$.trace_id") if "trace" in traces.columns else F.col("trace_id"), F.lit("unknown")).alias("id"), "line").groupBy("id").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("times"))
    rows = check_alone(traces).join(firsts.where("times > 1").drop("times"), F.col("trace_id") == F.col("id"), "left")
    return tagged(rows, F.col("line") > F.col("first"))


def check_alone(traces: DataFrame) -> DataFrame:
    """check() of each trace by itself, without the tag of later rows of an id: no shuffle, no state."""
    view = of_variant(F.col("trace")) if "trace" in traces.columns else of_columns(traces)
    own = traces.select("line", view.alias("q")).select("line", "q", rules(F.col("q")).alias("rules"))
    n, held = F.size("q.gold_ids"), F.size(F.array_intersect("q.gold_ids", "q.selected"))
    tags = F.transform("rules", lambda r: r["tag"])
    made = F.struct(
        F.coalesce("q.trace_id", F.lit("unknown")).alias("trace_id"), F.col("q.pipeline_id").alias("pipeline_id"), tags.alias("quality_tags"), F.filter(F.transform("rules", lambda r: r["warning"]), lambda w: w.isNotNull()).alias("warnings"),
        issues(F.col("rules")).alias("issues"), n.alias("n_gold_chunks"), held.alias("n_present_chunks"), (held > 0).alias("gold_present_any"), ((n > 0) & (held == n)).alias("gold_present_all"),
    )
    # exploded, so that what is worked out once isn't worked out again where its result is filtered
    rows = own.select("line", F.explode(F.array(made)).alias("m")).select("line", "m.*")
    has = lambda names: F.arrays_overlap("quality_tags", F.lit(names))
    rows = rows.withColumns(
        {
            "severity": F.when(F.size("quality_tags") == 0, "none").when(has(HIGH), "high").when(has(MEDIUM), "medium").otherwise("low"),
            "usable": ~F.coalesce(has(HIGH), F.lit(False)),
            "has_issues": F.size("quality_tags") > 0,
        }
    )
    return rows


def tagged(rows: DataFrame, again: Column) -> DataFrame:
    """Rows of check_alone() with the tag of those for which `again` holds."""
    name = "duplicate_trace_id"
    rows = rows.withColumns(
        {
            "quality_tags": F.when(again, F.array_append("quality_tags", F.lit(name))).otherwise(F.col("quality_tags")),
            "warnings": F.when(again, F.array_append("warnings", F.concat(F.lit("Duplicate trace_id: "), F.col("trace_id")))).otherwise(F.col("warnings")),
            "issues": F.when(again, F.map_concat(F.map_filter("issues", lambda k, _: k != "trace_id"), F.create_map(F.lit("trace_id"), F.array(F.lit("duplicate trace_id found"))))).otherwise(F.col("issues")),
        }
    )
    return rows.select(*COLUMNS)


def tag_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("quality_tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def severities(checked: DataFrame) -> DataFrame:
    return checked.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_if("usable").alias("usable"), F.count_if("gold_present_any").alias("gold_any"), F.count_if("gold_present_all").alias("gold_all"))


def top_tags(checked: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent tags of each pipeline."""
    counts = checked.select("pipeline_id", F.explode("quality_tags").alias("tag")).groupBy("pipeline_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("pipeline_id").orderBy(F.desc("n"), "tag"))).where(F.col("place") <= top)


def examples(checked: DataFrame, each: int = 3) -> DataFrame:
    """The first traces of each tag, by line. Each line's tags count once."""
    rows = checked.select("line", "trace_id", "issues", "severity", F.explode(F.array_distinct("quality_tags")).alias("tag"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("tag").orderBy("line"))).where(F.col("place") <= each)


def problems(checked: DataFrame) -> DataFrame:
    return checked.where("has_issues")


def report(checked: DataFrame) -> dict[str, Any]:
    """The report of a run: counts, severities, tags, gold statistics, figures by pipeline, and three examples for each of ten
    tags (the most frequent). Only aggregates are collected: a row for each severity, tag, pipeline and example."""
    share = lambda a, b: a / b if b else 0
    of = checked.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_if("usable").alias("u"), F.count_if("gold_present_any").alias("some"), F.count_if("gold_present_all").alias("every"), F.count_if(~F.col("gold_present_any") & (F.col("n_gold_chunks") > 0)).alias("none")).collect()
    total, usable, some, every, none = (sum(r[k] for r in of) for k in ("n", "u", "some", "every", "none"))
    tags = {r.tag: r.n for r in tag_counts(checked).orderBy(F.desc("n"), "tag").collect()}
    pipelines: dict[str, dict] = {}
    for r in checked.groupBy(F.coalesce("pipeline_id", F.lit("unknown")).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if("usable").alias("u")).collect():
        pipelines[r.id] = {"total": r.n, "usable": r.u, "usable_ratio": share(r.u, r.n), "top_issues": {}}
    for r in top_tags(checked).orderBy("place").collect():
        pipelines[r.pipeline_id or "unknown"]["top_issues"][r.tag] = r.n
    shown = list(tags)[:10]
    found: dict[str, list] = {t: [] for t in shown}
    for r in examples(checked).where(F.col("tag").isin(shown)).orderBy("tag", "place").collect() if shown else []:
        found[r.tag].append({"trace_id": r.trace_id, "issues": r.issues, "severity": r.severity})
    gold = {"gold_present_any": some, "gold_present_any_ratio": share(some, total), "gold_present_all": every, "gold_present_all_ratio": share(every, total), "gold_none": none, "gold_none_ratio": share(none, total)}
    return {
        "total_traces": total, "usable_traces": usable, "problematic_traces": total - usable, "usable_ratio": share(usable, total), "severity_distribution": {r.severity: r.n for r in of}, "tag_distribution": tags,
        "gold_statistics": gold, "by_pipeline": pipelines, "example_problems": found,
    }
