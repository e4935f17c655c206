"""Question-answering records as source samples."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import variants as V


def leaves(v: str | None) -> list[str]:
    """The leaves of a nested answer in a JSON text, in order; values that aren't strings as Python shows them."""
    out, stack = [], [json.loads(v)] if v is not None else []
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += x[::-1]
        else:
            out.append(x if isinstance(x, str) else str(x))
    return out


def flatten_answer(v: Column, depth: int = 3) -> Column:
    """The distinct leaves of a nested answer that aren't empty, in order, joined by ' | '.

    Answers nested to `depth` lists are read by expressions; an Arrow function reads the whole of deeper ones.
    """
    none = F.array().cast("array<string>")

    def of(x: Column, left: int) -> Column:
        inner = F.try_variant_get(x, "$", "array<variant>")
        leaf = F.array(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))
        return F.when(V.is_list(x), F.flatten(F.transform(inner, lambda y: of(y, left - 1))) if left else none).otherwise(leaf)

    def deep(x: Column, left: int) -> Column:
        inner = F.try_variant_get(x, "$", "array<variant>")
        return F.exists(inner, V.is_list) if not left else F.exists(inner, lambda y: deep(y, left - 1))

    whole = F.pandas_udf(lambda texts: texts.map(leaves), "array<string>")
    beyond = F.coalesce(deep(v, depth - 1), F.lit(False))
    own = F.when(beyond, whole(F.when(beyond, F.to_json(v)))).otherwise(of(v, depth))
    return F.array_join(F.array_distinct(F.filter(own, lambda s: s != "")), " | ")


def numbered(rows: DataFrame, by: str, size: int = 100_000) -> DataFrame:
    """rows with number, their place in order of a numeric column, from 1.

    Rows are numbered within ranges of the column's values, and the ranges' counts are added up.
    """
    keyed = rows.withColumn("_range", F.floor(F.col(by) / size))
    counts = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col("_range").alias("_of"), (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    placed = keyed.withColumn("number", F.row_number().over(Window.partitionBy("_range").orderBy(by))).join(before, F.col("_range").eqNullSafe(F.col("_of")))
    return placed.withColumn("number", F.col("number") + F.col("_before")).drop("_range", "_of", "_before")


def english(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples and bad rows of multi-hop records in a VARIANT column `record`.

    Titles and sentence lists are zipped to documents (the shorter list ends them), a text is its sentences joined. Facts
    (title, sentence number) become gold evidence: the first document of a title counts, facts of unknown titles fall away,
    a sentence number out of range keeps the evidence with an empty text. A record without an id is a bad row.
    """
    r = F.col("record")
    sample = F.concat(F.lit("en__hotpot__"), V.string(r, "$.id"))
    docs = F.try_variant_get(r, "$.context", "struct<title:array<string>,sentences:array<array<string>>>")
    facts = F.try_variant_get(r, "$.supporting_facts", "struct<title:array<string>,sent_id:array<int>>")
    # exploded, so that a record isn't made again where good and bad rows are told apart
    rows = records.withColumn("record", F.explode(F.array("record"))).withColumns({"sample_id": sample, "_c": docs, "_f": facts})
    n = F.least(F.size("_c.title"), F.size("_c.sentences"))
    doc = lambda i: F.struct(
        F.concat(F.col("sample_id"), F.lit("__doc_"), F.lpad(i.cast("string"), 3, "0")).alias("document_id"),
        F.col("_c.title")[i].alias("title"),
        F.array_join(F.col("_c.sentences")[i], "").alias("text"),
        F.col("_c.sentences")[i].alias("sentences"),
    )
    documents = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), doc)).otherwise(F.array())
    rows = rows.withColumn("source_documents", documents)
    pairs = F.slice(F.arrays_zip(F.col("_f.title").alias("title"), F.col("_f.sent_id").alias("sent")), F.lit(1), F.least(F.size("_f.title"), F.size("_f.sent_id")))
    of = lambda p: F.filter("source_documents", lambda d: d["title"] == p["title"])
    gold = F.transform(
        F.filter(F.coalesce(pairs, F.array().cast("array<struct<title:string,sent:int>>")), lambda p: F.size(of(p)) > 0),
        lambda p: F.struct(of(p)[0]["document_id"].alias("document_id"), p["sent"].alias("sentence_index"), F.coalesce(F.get(of(p)[0]["sentences"], F.when(p["sent"] >= 0, p["sent"])), F.lit("")).alias("gold_text"), F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end")),
    )
    out = rows.withColumn("gold", gold).select(
        "sample_id",
        F.lit("hotpot_en").alias("source_dataset"),
        F.lit("en").alias("language"),
        V.string(r, "$.question").alias("question"),
        flatten_answer(V.node(r, "$.answer")).alias("reference_answer"),
        "source_documents",
        F.when(F.size("gold") > 0, F.col("gold")).alias("gold_evidence"),
    )
    return out.where("sample_id is not null"), rows.where("sample_id is null").select("record")


def russian(records: DataFrame) -> DataFrame:
    """Samples of single-context records (line, record): ids count the lines that aren't blank, bad ones included. Gold is
    located as the first occurrence of the record's text in its context, offsets are null where there is none."""
    r = F.col("record")
    sample = F.format_string("ru__retrieval_dataset__%06d", F.col("number"))
    text, context = V.string(r, "$.text"), V.string(r, "$.context")
    start = F.nullif(F.instr(context, text), F.lit(0)) - 1
    doc = F.concat(F.col("sample_id"), F.lit("__doc_000"))
    gold = F.struct(doc.alias("document_id"), F.lit(None).cast("int").alias("sentence_index"), text.alias("gold_text"), start.alias("char_start"), (start + F.length(text)).alias("char_end"))
    rows = numbered(records, "line").withColumn("sample_id", sample).where(V.is_object(r))
    return rows.select(
        "sample_id",
        F.lit("retrieval_ru").alias("source_dataset"),
        F.lit("ru").alias("language"),
        V.string(r, "$.q").alias("question"),
        V.string(r, "$.a").alias("reference_answer"),
        F.array(F.struct(doc.alias("document_id"), F.lit(None).cast("string").alias("title"), context.alias("text"))).alias("source_documents"),
        F.when(text != "", F.array(gold)).alias("gold_evidence"),
    )
