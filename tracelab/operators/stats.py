"""Offline statistics: paired faults, repeatability, labels and human agreement."""

from __future__ import annotations

import itertools
import math
import random
import statistics
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import stored

#: How each fault should move each metric.
EXPECTED = {
    "missing_evidence": {
        "retrieval.hit_at_k": "decrease",
        "retrieval.recall_at_k": "decrease",
        "retrieval.precision_at_k": "decrease",
        "retrieval.mrr": "decrease",
        "context.evidence_coverage": "decrease",
        "context.noise_ratio": "increase",
    },
    "irrelevant_document": {
        "retrieval.hit_at_k": "decrease",
        "retrieval.recall_at_k": "decrease",
        "retrieval.precision_at_k": "decrease",
        "retrieval.mrr": "decrease",
        "context.noise_ratio": "increase",
    },
    "chunk_truncation": {"chunking.chunk_integrity": "decrease"},
    "chunk_merge": {"chunking.chunk_integrity": "decrease"},
    "distractor_context": {"context.noise_ratio": "increase", "generation.faithfulness": "decrease"},
    "unsupported_answer": {"generation.faithfulness": "decrease"},
    "contradictory_answer": {"generation.faithfulness": "decrease"},
    "corrupted_query": {"generation.answer_relevance": "decrease"},
    "out_of_scope": {"generation.answer_relevance": "decrease"},
}
#: Metrics that are better when they are lower.
LOWER_IS_BETTER = ["context.noise_ratio"]
#: Columns of the reports.
CORE = [
    "retriever",
    "fault_type",
    "metric_name",
    "sample_count",
    "healthy_mean",
    "fault_mean",
    "mean_delta",
    "ci_95_lower",
    "ci_95_upper",
    "standardized_effect",
    "rank_biserial_effect",
    "expected_direction",
    "direction_match",
    "skipped_count",
    "error_count",
]
FIELDS = [
    "retriever",
    "fault_type",
    "metric_name",
    "sample_count",
    "healthy_mean",
    "fault_mean",
    "mean_delta",
    "median_delta",
    "std_delta",
    "improved_count",
    "degraded_count",
    "unchanged_count",
    "expected_direction",
    "direction_match",
    "ci_95_lower",
    "ci_95_upper",
    "standardized_effect",
    "rank_biserial_effect",
    "quality_mean_delta",
    "skipped_count",
    "error_count",
]


def bootstrap_interval(deltas: list[float], rounds: int = 2000, seed: int = 42) -> tuple[float | None, float | None]:
    """The 95 percent interval of the mean over resamples, whose places Python's generator draws; none for no values."""
    if not deltas:
        return None, None
    places = itertools.starmap(random.Random(seed).randrange, itertools.repeat((len(deltas),), rounds * len(deltas)))
    samples = np.array(deltas, float)[np.fromiter(places, np.int64)].reshape(rounds, -1)
    return tuple(np.quantile([statistics.mean(s) for s in samples.tolist()], [0.025, 0.975]).tolist())


#: Draws of a hash, and their bits; the chance of a weight (Poisson with mean 1) in units of a draw, added up, until it is below one.
DRAWS, BITS = 4, 32
LIMITS = [int(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) * 2**BITS) for n in range(13)]


def hashed_intervals(deltas: DataFrame, keys: list[str], id_col: str, value: str = "delta", rounds: int = 2000, seed: int = 42) -> DataFrame:
    """Per group: the 95 percent interval of the mean (ci_95_lower, ci_95_upper) by a bootstrap that needs no group in one task.

    In each round a row counts 0, 1, 2, ... times, as a Poisson number of mean 1 says that is drawn from the MD5 of seed, group, id
    and round; a round's mean is that of the rows so weighted. Rows are weighted where they are: a task adds up the weights
    and the weighted values of its rows for each round, those sums are added up (one row a round, group and task), and the
    interval is read from the rounds' means. A draw depends on nothing but the row, so any partitioning gives the same
    weights, and partial sums of other runs can be added. A round that draws no row doesn't count; rows of a group that share an
    id are weighted alike.
    """
    step = F.sequence(F.lit(0), F.lit((rounds - 1) // DRAWS))
    hashed = lambda b: F.md5(F.concat_ws("|", F.lit(str(seed)), *keys, F.col(id_col).cast("string"), b.cast("string")).cast("binary"))
    own = deltas.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.posexplode(F.transform(step, hashed)).alias("_b", "_h"))
    digits = BITS // 4
    numbers = own.select(*keys, "_v", (F.col("_b") * DRAWS).alias("_r"), *[F.conv(F.substring("_h", d * digits + 1, digits), 16, 10).cast("long").alias(f"_x{d}") for d in range(DRAWS)])
    # the weight is the number of limits that the draw isn't below
    weight = lambda d: reduce(lambda a, b: a + b, [(F.col(f"_x{d}") >= n).cast("int") for n in LIMITS])
    drawn = numbers.select(*keys, "_v", "_r", *[weight(d).alias(f"_w{d}") for d in range(DRAWS)])
    sums = drawn.groupBy(*keys, "_r").agg(*[F.struct(F.sum(f"_w{d}").alias("n"), F.sum(F.col(f"_w{d}") * F.col("_v")).alias("s")).alias(f"_s{d}") for d in range(DRAWS)])
    means = sums.select(*keys, F.posexplode(F.array(*[F.col(f"_s{d}") for d in range(DRAWS)])).alias("_d", "_s"), "_r").where((F.col("_r") + F.col("_d") < rounds) & (F.col("_s.n") > 0))
    ends = F.percentile(F.col("_s.s") / F.col("_s.n"), F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*keys).agg(ends.alias("_e")).select(*keys, F.col("_e")[0].alias("ci_95_lower"), F.col("_e")[1].alias("ci_95_upper"))


def pair(healthy: DataFrame, faulty: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deltas of fault and metric, and ids without a partner.

    healthy: trace_id, metric_name, status, score. faulty: the same with original_trace_id, fault_type and line. An error on
    either side counts before a skip, a skip before a missing score; only rows with state ok have a delta (fault less healthy).
    Where healthy traces share an id, the result of the last line counts (of the largest score, where there are no lines).
    """
    last = F.max_by(F.struct("status", "score"), F.struct("line" if "line" in healthy.columns else F.lit(0), "score"))
    h = healthy.groupBy(F.col("trace_id").alias("id"), "metric_name").agg(last.alias("r")).select("id", "metric_name", F.col("r.status").alias("h_status"), F.col("r.score").alias("h_score"))
    rows = faulty.join(h, (faulty["original_trace_id"] == h["id"]) & (faulty["metric_name"] == h["metric_name"])).drop(h["metric_name"])
    either = lambda s: (F.col("status") == s) | (F.col("h_status") == s)
    state = F.when(either("error"), "error").when(either("skipped") | F.col("score").isNull() | F.col("h_score").isNull(), "skipped").otherwise("ok")
    rows = rows.withColumn("state", state).withColumn("delta", F.when(F.col("state") == "ok", F.col("score") - F.col("h_score")))
    lost = faulty.join(h, faulty["original_trace_id"] == h["id"], "left_anti").select(F.coalesce("original_trace_id", F.lit("unknown")).alias("original_trace_id")).distinct()
    return rows.select("fault_type", "metric_name", "line", "original_trace_id", "state", "h_score", "score", "delta"), lost


def rank_biserial(deltas: DataFrame, keys: list[str], value: str = "delta", ranges: int = 256) -> DataFrame:
    """(W+ - W-) / (W+ + W-) of each group over the ranks of the absolute values that aren't 0; ties share the mean rank; 0
    for a group without any.

    Rows are first counted by distinct absolute value, positive and negative ones apart. A value's mean rank follows from how many
    rows lie below it: in its range of values (the `ranges` ranges of a group lie between its least and its largest, so a group is spread
    over as many tasks) and in the ranges before.
    """
    d = F.col(value)
    size = F.abs(d).alias("size")
    counts = deltas.where(d != 0).groupBy(*keys, size).agg(F.count(F.lit(1)).alias("n"), F.count_if(d > 0).alias("up"))
    ends = counts.groupBy(*keys).agg(F.min("size").alias("least"), F.max("size").alias("most"))
    rows = _same(counts, ends, keys)
    width = F.nullif(F.col("most") - F.col("least"), F.lit(0.0))
    rows = rows.withColumn("range", F.coalesce(F.floor((F.col("size") - F.col("least")) / width * ranges), F.lit(0)).cast("long"))
    sums = rows.groupBy(*keys, "range").agg(F.sum("n").alias("of_range"))
    sums = sums.withColumn("before", F.sum("of_range").over(Window.partitionBy(*keys).orderBy("range")) - F.col("of_range")).drop("of_range")
    below = F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "range").orderBy("size")) - F.col("n")
    rank = below + (F.col("n") + 1) / 2
    found = _same(rows, sums, [*keys, "range"]).withColumn("r", rank).groupBy(*keys).agg((F.sum(F.col("r") * (2 * F.col("up") - F.col("n"))) / F.sum(F.col("r") * F.col("n"))).alias("rank_biserial_effect"))
    every = deltas.where(d.isNotNull()).select(*keys).distinct()
    return _same(every, found, keys, "left").withColumn("rank_biserial_effect", F.coalesce("rank_biserial_effect", F.lit(0.0)))


def _same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns that both have, where nulls are equal."""
    right = right.withColumnsRenamed({c: f"_of_{c}" for c in on})
    return left.join(right, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on], how).drop(*(f"_of_{c}" for c in on))


def direction_table() -> list[tuple[str, str, str]]:
    return [(f, m, d) for f, by in EXPECTED.items() for m, d in by.items()]


def summarise(deltas: DataFrame, retriever: str, rounds: int = 2000, seed: int = 42, draws: str = "hashed") -> DataFrame:
    """The summary row (FIELDS) of each fault and metric. Standard deviations are those of a population; groups without a
    usable pair keep their row.

    draws: `hashed` has the intervals of hashed_intervals(), for groups of any size; `python` resamples a group's deltas, in
    input order, at places drawn by Python's generator, in one task for each group (for groups of some thousand rows).
    """
    if draws not in ("hashed", "python"):
        raise ValueError(f"unknown draws: {draws}")
    spark = deltas.sparkSession
    keys = ["fault_type", "metric_name"]
    ok = F.col("state") == "ok"
    only = lambda c: F.when(ok, F.col(c))
    sign = F.when(F.col("metric_name").isin(LOWER_IS_BETTER), -1).otherwise(1)
    n = lambda c: F.count_if(c)
    base = deltas.groupBy(*keys).agg(
        n(ok).alias("sample_count"),
        F.avg(only("h_score")).alias("healthy_mean"),
        F.avg(only("score")).alias("fault_mean"),
        F.avg("delta").alias("mean_delta"),
        F.median("delta").alias("median_delta"),
        F.stddev_pop("delta").alias("std_delta"),
        n(F.col("delta") * sign > 0).alias("improved_count"),
        n(F.col("delta") * sign < 0).alias("degraded_count"),
        n(F.col("delta") == 0).alias("unchanged_count"),
        F.avg(F.col("delta") * sign).alias("quality_mean_delta"),
        n(F.col("state") == "skipped").alias("skipped_count"),
        n(F.col("state") == "error").alias("error_count"),
    )

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = bootstrap_interval(pdf.sort_values("line")["delta"].tolist(), rounds, seed)
        return pd.DataFrame([(*pdf[keys].iloc[0], low, high)], columns=[*keys, "ci_95_lower", "ci_95_upper"])

    usable = deltas.where(ok)
    if draws == "python":
        ci = usable.select(*keys, "line", "delta").groupBy(*keys).applyInPandas(interval, "fault_type string, metric_name string, ci_95_lower double, ci_95_upper double")
    else:
        ci = hashed_intervals(usable, keys, "original_trace_id" if "original_trace_id" in deltas.columns else "line", "delta", rounds, seed)
    expected = F.broadcast(spark.createDataFrame(direction_table(), "fault_type string, metric_name string, expected_direction string"))  # 19 fixed rows
    rows = base.join(ci, keys, "left").join(rank_biserial(usable, keys), keys, "left").join(expected, keys, "left")
    want, d = F.coalesce("expected_direction", F.lit("unspecified")), F.col("mean_delta")
    rows = rows.withColumns(
        {
            "retriever": F.lit(retriever),
            # what is left of equal differences by rounding is no deviation
            "standardized_effect": d / F.when(F.col("std_delta") > 1e-12, F.col("std_delta")),
            "direction_match": F.when(want == "decrease", d < 0).when(want == "increase", d > 0),
            "expected_direction": want,
        }
    )
    return rows.select(*FIELDS)


def fault_type(label: Column, source_file: Column) -> Column:
    """A wrapper's fault label, or else the stem of the file that it stands in."""
    return F.coalesce(label, F.regexp_extract(F.coalesce(source_file, F.lit("unknown")), r"([^/]*?)(?:\.[^./]*)?$", 1))


def core(summary: DataFrame) -> DataFrame:
    return summary.where("expected_direction <> 'unspecified'").select(*CORE)


def all_retrievers(summaries: dict[str, DataFrame | None]) -> DataFrame:
    """The summaries of all retrievers that have inputs."""
    own = [s for s in summaries.values() if s is not None]
    if not own:
        raise ValueError("no retriever has inputs")
    return reduce(DataFrame.unionByName, own)


def _keyed(run: DataFrame, number: int) -> DataFrame:
    """The last result of each trace and metric in a run (columns line, trace_id, metric_name, score, status, label)."""
    last = run.groupBy("trace_id", "metric_name").agg(F.max_by(F.struct("score", "status", "label"), "line").alias("r"))
    return last.select(F.lit(number).alias("run"), F.concat_ws("|", "trace_id", "metric_name").alias("key"), "r.*")


def compare_runs(runs: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Agreement of two or more runs on the results that all have, and the keys that some lack."""
    if len(runs) < 2:
        raise ValueError("at least two runs are needed")
    every = reduce(DataFrame.unionByName, [_keyed(r, i) for i, r in enumerate(runs)])
    text = F.concat_ws("/", F.coalesce(F.col("score").cast("string"), F.lit("None")), "status", F.coalesce("label", F.lit("None")))
    grouped = every.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(text).alias("kinds"),
        F.count("score").alias("scored"),
        F.max(F.when(F.col("run") == 0, F.col("score"))).alias("base"),
        F.collect_list(F.when(F.col("run") > 0, F.col("score"))).alias("others"),
    )
    common = grouped.where(F.col("n") == len(runs))
    gaps = F.when(F.col("scored") == len(runs), F.aggregate("others", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("base"))))
    count = F.count(gaps) * (len(runs) - 1)
    out = common.agg(
        F.lit(len(runs)).alias("run_count"),
        F.count(F.lit(1)).alias("result_count"),
        F.count_if(F.col("kinds") == 1).alias("exact_matches"),
        (F.count_if(F.col("kinds") == 1) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("exact_match_rate"),
        F.round(F.sum(gaps) / F.nullif(count, F.lit(0)), 12).alias("mean_absolute_score_delta"),
    )
    return out, grouped.where(F.col("n") < len(runs)).select("key")


def _first_text(df: DataFrame, names: list[str]) -> Column:
    own = [F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*own) if own else F.lit(None).cast("string")


def against_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Per label: trace_id, expected, predicted (null: missing) and correct.

    The prediction is the first of fault_label, diagnosis_label and label that the predictions have; the last one of a trace
    counts. Labels fall back over their columns; rows without one don't count.
    """
    field = next((f for f in ("fault_label", "diagnosis_label", "label") if f in predictions.columns), None)
    if field is None:
        raise ValueError("predictions have no fault_label, diagnosis_label or label")
    own = predictions.where(F.col("trace_id").isNotNull() & F.col(field).isNotNull()).groupBy("trace_id").agg(F.max_by(field, "line").alias("predicted"))
    want = labels.withColumn("expected", _first_text(labels, ["expected_diagnosis", "expected", "fault_class", "human"])).where("trace_id <> '' and expected is not null")
    return want.select("trace_id", "expected").join(own, "trace_id", "left").withColumn("correct", F.col("predicted") == F.col("expected"))


def accuracy(compared: DataFrame) -> DataFrame:
    seen = F.col("predicted").isNotNull()
    return compared.agg(F.count_if(seen).alias("total"), F.count_if("correct").alias("correct"), (F.count_if("correct") / F.nullif(F.count_if(seen), F.lit(0))).alias("accuracy"), F.count_if(~seen).alias("missing"))


def human_agreement(rows: DataFrame) -> DataFrame:
    """rows (expected, human) that have both, with kind: exact, partial (chunking and retrieval are close) or mismatch."""
    near = F.array_sort(F.array("expected", "human")) == F.lit(["chunking", "retrieval"])
    rows = rows.where("expected <> '' and human <> ''")
    return rows.withColumn("kind", F.when(F.col("expected") == F.col("human"), "exact").when(near, "partial").otherwise("mismatch"))


def agreement_by(compared: DataFrame, by: str) -> DataFrame:
    """Rows and exact matches by expected class or by fault type."""
    return compared.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "exact").alias("correct"))


def agreement_summary(compared: DataFrame) -> DataFrame:
    """Counts of each kind, accuracy and accuracy with partial matches (0 for no rows)."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    rate = lambda x: F.coalesce(x / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))
    return compared.agg(
        F.count(F.lit(1)).alias("total"), n("exact").alias("exact_matches"), n("partial").alias("partial_matches"), n("mismatch").alias("mismatches"),
        rate(n("exact")).alias("accuracy"), rate(n("exact") + n("partial")).alias("partial_accuracy"),
    )


def disagreements(compared: DataFrame) -> DataFrame:
    """The mismatches."""
    return compared.where("kind = 'mismatch'")


def confusion(rows: DataFrame, expected: str = "expected", got: str = "human", axis: list[str] | None = None) -> DataFrame:
    """Counts of each pair; with an axis all of its cells, zeros included."""
    counts = rows.groupBy(F.col(expected).alias("expected"), F.col(got).alias("got")).agg(F.count(F.lit(1)).alias("n"))
    if axis is None:
        return counts
    one = rows.sparkSession.createDataFrame([(a, b) for a in axis for b in axis], "expected string, got string")
    return one.join(counts, ["expected", "got"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def stratified(wrappers: DataFrame, n: int, by: str = "injected_fault", key: str = "original_trace_id", seed: int = 42) -> DataFrame:
    """n rows: n div strata of each stratum (one at least), then others; drawn and ordered by the MD5 of seed, stratum and key.

    One pass keeps the first 2 n of each stratum, of which a task sends no more; the rest is worked out among those, which are stored.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), by, key).cast("binary"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_h", key))
    rows = stored(wrappers.withColumn("_h", h).withColumn("_k", place).where(F.col("_k") <= 2 * n), "strata")
    each = max(1, n // max(1, rows.select(by).distinct().count()))
    rows = rows.orderBy(F.when(F.col("_k") <= each, 0).otherwise(1), "_h", key).limit(n)
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed + 1)), by, key).cast("binary"))).drop("_h", "_k")
