"""Files in and out: JSON lines (strict, tolerant, warn and skip, whole directories), CSV, YAML settings and reports."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import variants as V
from ..operators.metrics import DEFAULTS, merged
from .records import MOST_SPLITS, records


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line, number, source_file, value of every line that isn't blank.

    number is the line's place in its file from 1, blank lines included; line rises over all files in order of their names.
    A file may be any number of splits: rows are numbered within a split, and the splits' counts (a row for each split)
    are added up.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("at"))
    text = text.withColumn("id", F.monotonically_increasing_id())
    splits = text.groupBy("path", "source_file", "at").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = lambda w: F.sum("n").over(w) - F.col("n")
    # one row for each split
    splits = splits.withColumns({"in_file": before(Window.partitionBy("path").orderBy("at")), "in_all": before(Window.orderBy("source_file", "path", "at"))}).drop("n", "source_file")
    rows = text.join(F.broadcast(splits) if splits.count() <= MOST_SPLITS else splits, ["path", "at"])
    place = F.col("id") - F.col("first") + 1
    return rows.select((F.col("in_all") + place).alias("line"), (F.col("in_file") + place).alias("number"), "source_file", "value").where(F.regexp_replace("value", r"(?U)\s", "") != "")


def parsed(rows: DataFrame) -> DataFrame:
    """rows with a VARIANT column trace: null for lines that aren't JSON objects, of which message says what is wrong."""
    v = F.try_parse_json("value")
    message = F.when(F.col("v").isNull(), "not valid JSON").when(F.col("trace").isNull(), "trace must be a JSON object")
    return rows.withColumn("v", v).withColumn("trace", F.when(V.is_object(F.col("v")), F.col("v"))).withColumn("message", message).drop("v")


def tolerant(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that aren't JSON objects."""
    rows = parsed(lines(spark, path))
    return rows.where("trace is not null").drop("value", "message"), rows.where("trace is null").select("line", "number", "source_file", "value", "message")


def strict(spark: SparkSession, path: str) -> DataFrame:
    """Good rows; the first line that isn't a JSON object fails the query and is named."""
    message = F.concat("source_file", F.lit(":"), F.col("number").cast("string"), F.lit(" must contain a JSON object"))
    rows = parsed(lines(spark, path))
    return rows.where(F.when(F.col("trace").isNotNull(), True).otherwise(F.raise_error(message).cast("boolean"))).drop("value", "message")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """All *.jsonl of a directory, strictly read, with source_file and fault_type (the file's stem)."""
    return strict(spark, f"{path}/*.jsonl").withColumn("fault_type", F.regexp_extract("source_file", r"^(.*)\.jsonl$", 1))


def first(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows in line order, as many as limit."""
    return rows if limit is None else rows.orderBy("line").limit(limit)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """An annotation CSV with a header; a byte-order mark is dropped, values are stripped, the last row of a trace_id counts, a
    confidence that isn't digits is 0. Quoted fields may hold line breaks (see records.records); a record that is quoted as a
    whole, so that it is one field with commas, is read once more from that field. Missing fields are null, further ones
    are left out."""
    rows = records(spark, path)
    head = rows.orderBy("source_file", "path", "record").first()
    header = [h.strip() for h in head.fields] if head else ["trace_id"]
    again = (F.size("fields") == 1) & F.col("fields")[0].contains(",")
    inner = F.from_csv(F.col("fields")[0], F.lit(", ".join(f"`{h}` string" for h in header)), {"escape": '"', "multiLine": "true"})
    fields = F.when(again, F.array(*[inner[h] for h in header])).otherwise(F.col("fields"))
    body = rows.where(F.col("record") > 0).select("path", "record", fields.alias("f"))
    body = body.select("path", "record", *[F.regexp_replace(F.get("f", F.lit(i)), r"(?U)^\s+|\s+$", "").alias(h) for i, h in enumerate(header)]).where("trace_id <> ''")
    own = [c for c in header if c != "trace_id"]
    last = body.groupBy("trace_id").agg(F.max_by(F.struct(*own, F.lit(0).alias("_")), F.struct("path", "record")).alias("r")).select("trace_id", "r.*").drop("_")
    if "confidence" in header:
        last = last.withColumn("confidence", F.when(F.col("confidence").rlike(r"^\d+$"), F.col("confidence").cast("int")).otherwise(0))
    return last


def unquoted(text: DataFrame) -> DataFrame:
    """Lines with numbers n; a line that is one quoted field with doubled inner quotes becomes what it quotes."""
    whole = F.col("value").rlike(r'^".*"$') & F.col("value").contains('""') | F.col("value").rlike(r'^"[^"]*,[^"]*"$')
    inner = F.regexp_replace(F.expr("substring(value, 2, length(value) - 2)"), '""', '"')
    return text.withColumn("n", F.monotonically_increasing_id()).withColumn("recovered", whole).withColumn("value", F.when(whole, inner).otherwise(F.col("value")))


def settings(path: str | None) -> dict:
    """Metric settings: defaults with a YAML file's values merged in."""
    if path is None:
        return merged(DEFAULTS, {})
    import yaml

    with open(path, encoding="utf-8") as f:
        own = yaml.safe_load(f) or {}
    if not isinstance(own, dict):
        raise ValueError("settings must be a YAML object")
    return merged(DEFAULTS, own)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a row, keys sorted, characters as they are, null fields kept."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_results(results: DataFrame, path: str, metric: str = "retrieval.hit_at_k") -> dict[str, int]:
    """Metric results as JSON lines; returns the run's counters (see metrics.counters).

    The counters are observed while the rows are written, so the metrics are worked out once. `metric` is one that every trace
    has a result of: those results are the traces.
    """
    from ..operators.metrics import as_lines

    seen, n = Observation(), F.count_if
    own = results.observe(
        seen, n(F.col("metric_name") == metric).alias("input_traces"), F.count(F.lit(1)).alias("results"), n(F.col("status") == "skipped").alias("skipped_metrics"), n(F.col("status") == "error").alias("errors")
    )
    as_lines(own).write.mode("overwrite").text(path)
    return seen.get


def report(df: DataFrame, fields: list[str]) -> tuple[str, str]:
    """A small aggregate as JSON and as CSV text with fixed columns (missing: empty)."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    out = io.StringIO()
    writer = csv.DictWriter(out, fields, extrasaction="ignore", restval="", lineterminator="\n")
    writer.writeheader()
    writer.writerows({k: "" if v is None else v for k, v in r.items()} for r in rows)
    return json.dumps(rows, ensure_ascii=False, indent=2), out.getvalue()


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file, through the file system that the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()


def write_report(summary: DataFrame, metadata: dict, json_path: str, csv_path: str, fields: list[str]) -> None:
    """A report of a small summary: metadata and rows as JSON, and the rows as CSV with fixed columns."""
    rows, table = report(summary, fields)
    write_text(summary.sparkSession, json.dumps({"metadata": metadata, "summary": json.loads(rows)}, ensure_ascii=False, indent=2) + "\n", json_path)
    write_text(summary.sparkSession, table, csv_path)


def heatmap(summary: DataFrame, retriever: str, metrics: list[str], value: str = "quality_mean_delta") -> DataFrame:
    """The fault by metric matrix of one retriever."""
    return summary.where(F.col("retriever") == retriever).groupBy("fault_type").pivot("metric_name", metrics).agg(F.first(value)).orderBy("fault_type")


def draw_heatmap(summary: DataFrame, paths: list[str], least: float = 0.005) -> None:
    """The heatmaps of all retrievers side by side, in one symmetric range of colours; values of `least` or more are written
    into their cells. Needs matplotlib. A path's suffix names the kind of file."""
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt
    import numpy as np

    rows = summary.select("retriever", "fault_type", "metric_name", "quality_mean_delta").collect()  # at most faults x metrics
    names = [sorted({r[k] for r in rows}) for k in range(3)]
    most = max((abs(r[3]) for r in rows if r[3] is not None), default=0) or 1.0
    fig, axes = plt.subplots(1, max(1, len(names[0])), squeeze=False, figsize=(2 + 1.2 * len(names[2]) * max(1, len(names[0])), 7), layout="constrained")
    for axis, retriever in zip(axes[0], names[0], strict=False):
        cells = np.full((len(names[1]), len(names[2])), np.nan)
        for r in rows:
            if r[0] == retriever and r[3] is not None:
                cells[names[1].index(r[1]), names[2].index(r[2])] = r[3]
        shown = axis.imshow(cells, vmin=-most, vmax=most, cmap="RdYlGn", aspect="auto")
        axis.set(title=retriever, xticks=range(len(names[2])), yticks=range(len(names[1])), yticklabels=names[1])
        axis.set_xticklabels([n.rsplit(".", 1)[-1] for n in names[2]], rotation=50, ha="right")
        for (y, x), v in np.ndenumerate(cells):
            if abs(v) >= least:
                axis.text(x, y, f"{v:.2f}", ha="center", va="center", fontsize=7)
        fig.colorbar(shown, ax=axis)
    for path in paths:
        fig.savefig(path)
    plt.close(fig)
