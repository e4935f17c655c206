"""Traces from a table of documents: each document is a sample whose pool holds its own chunks and its neighbour's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import chunking, context, faults, generation, metrics, quality, retrieval, stats
from ..sources.storage import Stage, files_key, stage, stored

PIPELINE = "documents_bm25_v1"
#: Documents with ids from one multiple of this to the next meet for their neighbours' chunks.
NEIGHBOURS = 64


def samples(docs: DataFrame) -> DataFrame:
    """A row per document with sentences: doc_id, sample_id, document_id, language, question (first sentence), gold_text (middle
    sentence), reference_answer, its chunks and the gold evidence located in them."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.format_string("doc_%d", "doc_id").alias("document_id"), "lang", "text")
    rows = chunking.with_chunks(rows).withColumn("s", T.sentences(F.col("text"))).where(F.size("s") > 0)
    rows = rows.withColumn("gold_text", F.col("s")[F.floor(F.size("s") / 2).cast("int")])
    rows = rows.withColumn("char_start", F.nullif(F.instr(F.col("text"), F.col("gold_text")), F.lit(0)) - 1).withColumn("char_end", F.col("char_start") + F.length("gold_text"))
    ids, preserved = chunking.covering(F.col("chunks"), F.col("char_start"), F.col("char_end"))
    evidence = {"document_id": F.col("document_id"), "sentence_index": F.lit(None).cast("int"), "gold_text": F.col("gold_text"), "char_start": F.col("char_start"), "char_end": F.col("char_end"), "covering_chunk_ids": ids, "is_preserved": preserved, "locate_ok": F.col("char_start").isNotNull()}
    return rows.select(
        "doc_id",
        F.format_string("sample_%d", "doc_id").alias("sample_id"),
        F.col("lang").alias("language"),
        F.col("s")[0].alias("question"),
        F.col("gold_text").alias("reference_answer"),
        F.array(F.struct(*[v.alias(k) for k, v in evidence.items()])).alias("gold_evidence"),
        "chunks",
    )


def build(docs: DataFrame, top: int = 5, budget: int = 3000, run_id: str = "run") -> DataFrame:
    """Full traces: chunks, located gold, BM25 top chunks, context, a dry-run answer.

    Everything of a document is worked out in its row; then the document with the next id, if there is one, lends its chunks
    to the pool. Rows meet by ranges of NEIGHBOURS ids, where the first of each range is also sent to the one before, as a
    lender alone: that is the only shuffle and the only sort, and each text is in it once. A pool is an array, the chunks of
    two documents. A row of docs is one trace at most; rows that share an id make traces that share theirs.
    """
    own, place = samples(docs), F.pmod("doc_id", F.lit(NEIGHBOURS)).cast("int")
    at = F.struct(F.expr(f"(doc_id - pmod(doc_id, {NEIGHBOURS})) div {NEIGHBOURS}").alias("range"), place.alias("place"))
    before = F.struct((at["range"] - 1).alias("range"), F.lit(NEIGHBOURS).alias("place"))
    own = own.withColumn("at", F.explode(F.when(place == 0, F.array(at, before)).otherwise(F.array(at)))).select("*", "at.range", "at.place").drop("at", "doc_id")
    next_id = Window.partitionBy("range").orderBy("place").rangeBetween(1, 1)
    order = F.when(F.size("chunks") > 0, F.struct(F.md5(F.array_join("chunks.text", "").cast("binary")), F.size("chunks")))
    rows = own.withColumn("lent", F.min_by("chunks", order).over(next_id)).where(F.col("place") < NEIGHBOURS).drop("range", "place")
    none = F.array().cast(f"array<{chunking.CHUNK}>")
    rows = rows.withColumn("pool", F.concat("chunks", F.coalesce("lent", none))).drop("chunks", "lent")
    rows = retrieval.with_bm25(rows, "question", "pool", top)

    def shown(r: Column) -> Column:
        c = F.get(F.col("pool"), r["at"])
        return F.struct(c["chunk_id"].alias("chunk_id"), c["document_id"].alias("document_id"), r["rank"].alias("rank"), r["score"].alias("score"), c["text"].alias("text"))

    rows = rows.withColumn("chunks", F.when(F.size("pool") > 0, F.col("pool")))
    rows = rows.withColumn("retrieval", F.struct(F.lit("bm25").alias("method"), F.lit(top).alias("top_k"), F.transform("ranked", shown).alias("retrieved_chunks")))
    rows = rows.withColumn("context_construction", context.build(F.col("retrieval.retrieved_chunks"), budget))
    rows = rows.withColumn("generation", generation.dry_run().withField("final_answer", F.col("reference_answer")))
    return generation.assemble(rows.withColumn("metadata", F.lit("{}")), PIPELINE, run_id)


def packed(traces: DataFrame) -> DataFrame:
    """Traces of build() without the texts that are also in their chunks: those of retrieved chunks, context and prompt."""
    none = F.lit(None).cast("string")
    found = F.transform("retrieval.retrieved_chunks", lambda r: r.withField("text", none))
    # exploded, so that a context is worked out once and not for each of its fields
    own = traces.withColumn("context_construction", F.explode(F.array("context_construction")))
    return own.withColumns(
        {
            "retrieval": F.col("retrieval").withField("retrieved_chunks", found),
            "context_construction": F.col("context_construction").withField("final_context", none),
            "generation": F.col("generation").withField("final_prompt", none),
        }
    )


def unpacked(rows: DataFrame) -> DataFrame:
    """packed() traces with their texts, by the ids of chunks: no two chunks of a pool share one, and none is empty."""
    text = lambda r: F.get(F.filter("chunks", lambda c: c["chunk_id"] == r["chunk_id"]), F.lit(0))["text"]
    found = F.transform("retrieval.retrieved_chunks", lambda r: r.withField("text", text(r)))
    told = context.rebuild(F.col("context_construction.selected_chunk_ids"), F.col("chunks"))
    rows = rows.withColumns({"retrieval": F.col("retrieval").withField("retrieved_chunks", found), "context_construction": F.col("context_construction").withField("final_context", told)})
    return rows.withColumn("generation", F.col("generation").withField("final_prompt", generation.prompt(F.col("query"), F.col("context_construction.final_context"))))


def as_variant(traces: DataFrame) -> DataFrame:
    """Traces as line and VARIANT, without fault labels: what quality checks read."""
    own = [c for c in traces.columns if c not in ("injected_fault", "_is_healthy")]
    whole = F.to_json(F.struct(*own), {"ignoreNullFields": "false"})
    return traces.select(F.monotonically_increasing_id().alias("line"), F.parse_json(whole).alias("trace"))


def scored(traces: DataFrame) -> DataFrame:
    """Metric results of typed traces, which are read as they are: no JSON between."""
    return metrics.score(traces.withColumn("line", F.monotonically_increasing_id()))


def paired(traces: DataFrame, count: int = 20, language: str = "any") -> tuple[DataFrame, DataFrame]:
    """Healthy traces, every fault injected, both sides scored and paired: deltas, and ids without a partner."""
    good = faults.healthy(traces)
    wrapped = reduce(DataFrame.unionByName, [faulty_lines(w) for w in faults.inject_all(good, None, count, language).values()])
    wrapped = stored(wrapped, "faulty").withColumn("trace", F.parse_json("trace"))
    # count for each fault at most
    ids = F.broadcast(wrapped.select("original_trace_id").distinct())
    healthy = stored(scored(good.join(ids, F.col("trace_id") == F.col("original_trace_id"), "left_semi")), "healthy-scores")
    faulty = stored(metrics.score(wrapped.select(F.col("n").alias("line"), "trace")), "faulty-scores")
    labelled = faulty.join(wrapped.select(F.col("n").alias("line"), "original_trace_id", "fault_type"), "line")
    return stats.pair(healthy, labelled)


def controlled_failures(traces: DataFrame, count: int = 20, language: str = "any", retriever: str = "bm25", rounds: int = 2000, draws: str = "hashed") -> DataFrame:
    """The orchestrated analysis: pairs of healthy and faulty traces, summarised."""
    return stats.summarise(paired(traces, count, language)[0], retriever, rounds, draws=draws)


def faulty_lines(wrappers: DataFrame) -> DataFrame:
    """n, original_trace_id, fault_type and the faulty trace as JSON."""
    whole = F.to_json("trace", {"ignoreNullFields": "false"})
    return wrappers.select(F.xxhash64("injected_fault", "original_trace_id", whole).alias("n"), "original_trace_id", F.col("injected_fault").alias("fault_type"), whole.alias("trace"))


def kept(spark: SparkSession, sf_dir: str, top: int = 5, budget: int = 3000, run_id: str = "run") -> Stage:
    """build() of the documents in a folder, as a stage: made once for the same files, parameters and code. Each text is kept
    with its chunk alone, and told again where traces are read."""
    path = f"{sf_dir}/documents.parquet"
    made_from = {"documents": files_key(spark, path), "top": top, "budget": budget, "run_id": run_id}
    own = stage(spark, "traces", made_from, lambda: packed(build(spark.read.parquet(path), top, budget, run_id)))
    return Stage(unpacked(own.rows), own.key)


def kept_scores(spark: SparkSession, sf_dir: str) -> Stage:
    """Metric results of the kept traces."""
    own = kept(spark, sf_dir)
    return stage(spark, "scores", {"traces": own.key}, lambda: scored(own.rows))


def kept_quality(spark: SparkSession, sf_dir: str) -> Stage:
    """Quality checks of the kept traces."""
    own = kept(spark, sf_dir)
    return stage(spark, "quality", {"traces": own.key}, lambda: quality.check(own.rows.withColumn("line", F.monotonically_increasing_id())))


def kept_deltas(spark: SparkSession, sf_dir: str, count: int = 20, language: str = "any") -> Stage:
    """Deltas of the kept traces (see paired)."""
    own = kept(spark, sf_dir)
    return stage(spark, "deltas", {"traces": own.key, "count": count, "language": language}, lambda: paired(own.rows, count, language)[0])


def kept_summary(spark: SparkSession, sf_dir: str, retriever: str = "bm25", rounds: int = 2000) -> Stage:
    """The summary of the kept deltas."""
    own = kept_deltas(spark, sf_dir)
    return stage(spark, "summary", {"deltas": own.key, "retriever": retriever, "rounds": rounds}, lambda: stats.summarise(own.rows, retriever, rounds))


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept traces of the documents in a folder."""
    return kept(spark, sf_dir).rows
