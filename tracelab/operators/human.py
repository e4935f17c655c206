"""Diagnosis labels and their validation against annotators and between retrievers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def diagnose(results: DataFrame) -> DataFrame:
    """Per trace: status and primary cause from its metric results (columns trace_id, metric_name, label, status, evidence).

    The causes are tried from the earliest stage to the latest; that order is this library's choice.
    """
    has = lambda m, *labels: F.bool_or((F.col("metric_name") == m) & F.col("label").isin(*labels))
    cut = F.bool_or((F.col("metric_name") == "chunking.chunk_integrity") & F.col("evidence").contains("truncated"))
    broken = F.bool_or(F.col("status") == "error")
    facts = results.groupBy("trace_id").agg(
        broken.alias("broken"),
        has("retrieval.hit_at_k", "miss").alias("miss"),
        has("retrieval.recall_at_k", "partial").alias("partial"),
        cut.alias("cut"),
        has("generation.answer_relevance", "unrelated").alias("unrelated"),
        has("generation.faithfulness", "unsupported").alias("unsupported"),
        F.bool_and(F.col("status") == "skipped").alias("nothing"),
    )
    cause = (
        F.when(F.col("miss"), "retrieval_missing_evidence")
        .when(F.col("partial"), "retrieval_incomplete_evidence")
        .when(F.col("cut"), "chunking_integrity_failure")
        .when(F.col("unrelated"), "answer_query_mismatch")
        .when(F.col("unsupported"), "unsupported_or_contradictory_answer")
    )
    status = F.when(F.col("broken"), "input_error").when(F.col("nothing"), "unknown").when(cause.isNotNull(), "diagnosed").otherwise("no_decisive_fault")
    return facts.select("trace_id", status.alias("diagnosis_status"), F.when(status == "diagnosed", cause).alias("primary_cause"))


def rates(rows: DataFrame) -> DataFrame:
    """Accuracy, supported accuracy, coverage and abstention of rows (expected, predicted, supported): null over nothing."""
    share = lambda a, b: F.count_if(a) / F.nullif(F.count_if(b), F.lit(0))
    right, made = F.col("predicted") == F.col("expected"), F.col("predicted").isNotNull()
    every = F.lit(True)
    return rows.agg(share(right, every).alias("strict_accuracy"), share(right & F.col("supported"), F.col("supported")).alias("supported_accuracy"), share(made, every).alias("coverage"), share(~made, every).alias("abstention"))


def review_queue(rows: DataFrame) -> DataFrame:
    """Rows with a reason to be looked at again: expected, predicted, confidence, diagnosis_status, supported, warnings."""
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False)), "mismatch"),
            F.when(F.col("confidence") <= 4, "low_confidence"),
            F.when(F.col("diagnosis_status") != "diagnosed", "not_diagnosed"),
            F.when(~F.col("supported"), "unsupported_gold"),
            F.when(F.size("warnings") > 0, "warnings"),
        )
    )
    return rows.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def natural_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Diagnoses and hits of two retrievers on the same source record, full outer: source_record_id, left, right, bucket."""
    a = left.select("source_record_id", F.col("diagnosis").alias("left"), F.col("hit").alias("left_hit"))
    b = right.select("source_record_id", F.col("diagnosis").alias("right"), F.col("hit").alias("right_hit"))
    l, r = F.coalesce("left_hit", F.lit(False)), F.coalesce("right_hit", F.lit(False))
    bucket = F.when(l & r, "both").when(l, "only_left").when(r, "only_right").otherwise("neither")
    return a.join(b, "source_record_id", "full").withColumn("bucket", bucket)


def transitions(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))


def manifest(table: DataFrame, columns: list[str] | None = None, by: list[str] | None = None, parts: int = 4096) -> DataFrame:
    """Rows and a SHA-256 of a table's rows in any order, of the whole table or of each group in `by`.

    Rows are hashed, and dealt into `parts` by the first digits of their hashes (a power of 16); a part's hash is that of its rows' hashes in
    ascending order, and the result that of the parts' hashes in order. So a row that is added, lost, changed or
    repeated changes it, and no task holds more than one part's hashes.
    """
    by, digits = by or [], round(math.log(parts, 16))
    row = F.sha2(F.to_json(F.struct(*(columns or sorted(table.columns))), {"ignoreNullFields": "false"}), 256)
    rows = table.select(*by, row.alias("_row")).withColumn("_part", F.substring("_row", 1, digits))
    of_part = F.sha2(F.array_join(F.array_sort(F.collect_list("_row")), ""), 256)
    held = rows.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), of_part.alias("_hash"))
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_hash"))), lambda p: p["_hash"]), "")
    return held.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0).cast("long")).alias("rows"), F.sha2(in_order, 256).alias("sha256"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of every file at a path (files of 2 GB at most; Spark lists no empty ones), read
    where Spark reads them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows only one side has."""
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_left")).crossJoin(b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_right")))
