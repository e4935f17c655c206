"""The stages of a trace as table to table functions: chunks, retrieval, context, generation. Each adds its fields to samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, context, generation, retrieval
from ..operators.context import once
from ..sources import jsonl
from ..sources.storage import stored

EVIDENCE = "struct<document_id:string,sentence_index:int,gold_text:string,char_start:int,char_end:int,covering_chunk_ids:array<string>,is_preserved:boolean,locate_ok:boolean>"
FOUND = "struct<chunk_id:string,document_id:string,rank:int,score:double,text:string>"
#: Fields of a sample through all stages; those of later stages are null before them. metadata is any object.
SAMPLE = {
    "sample_id": "string",
    "source_dataset": "string",
    "language": "string",
    "question": "string",
    "reference_answer": "string",
    "source_documents": "array<struct<document_id:string,title:string,text:string>>",
    "gold_evidence": f"array<{EVIDENCE}>",
    "metadata": "variant",
    "chunks": f"array<{chunking.CHUNK}>",
    "retrieval": f"struct<method:string,top_k:int,retrieved_chunks:array<{FOUND}>>",
    "context_construction": "struct<selected_chunk_ids:array<string>,dropped_chunk_ids:array<string>,deduplicated_chunk_ids:array<string>,context_token_count:int,truncated:boolean,final_context:string>",
}
#: Fields of a full trace.
TRACE = {
    "trace_id": "string",
    "source_record_id": "string",
    "pipeline_id": "string",
    "language": "string",
    "query": "string",
    "reference_answer": "string",
    **{k: SAMPLE[k] for k in ("gold_evidence", "source_documents", "chunks", "retrieval", "context_construction")},
    "generation": f"struct<{generation.GENERATION.replace(' ', ':').replace(',:', ',')},prompt_version:string,final_prompt:string>",
    "pipeline_config": "variant",
    "injected_fault": "string",
    "runtime": "struct<run_id:string,status:string,error:string>",
}


def read(spark: SparkSession, path: str, fields: dict[str, str], limit: int | None = None) -> DataFrame:
    """JSON lines as typed rows with line; a line that isn't an object fails. Fields that aren't named are left out."""
    rows = jsonl.first(jsonl.parsed(jsonl.lines(spark, path)), limit)
    bad = F.raise_error(F.concat("source_file", F.lit(":"), F.col("number").cast("string"), F.lit(" must contain a JSON object"))).cast("boolean")
    rows = rows.where(F.when(F.col("trace").isNotNull(), True).otherwise(bad))
    kind = ", ".join(f"{k} {v}" for k, v in fields.items())
    return rows.select("line", F.from_json("value", kind).alias("r")).select("line", "r.*")


def numbered(samples: DataFrame) -> DataFrame:
    """Samples, stored, with a number of the row in _row: joins back to them go by it, since ids may repeat or lack."""
    return stored(samples.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def chunk(samples: DataFrame, size: int = 400, overlap: int = 80, counter: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    """Samples with the chunks of their documents, and gold evidence located in them. Samples that share an id stay apart."""
    samples = numbered(samples)
    docs = samples.select("_row", F.posexplode("source_documents").alias("ordinal", "d")).select("_row", "ordinal", "d.document_id", "d.text")
    made = chunking.with_chunks(docs, size, overlap, counter)
    made = made.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("ordinal", "document_id", "text", "chunks"))).alias("docs"))
    rows = samples.drop("chunks").join(made, "_row", "left").drop("_row")

    def located(g: Column) -> Column:
        def of(d: Column) -> Column:
            valid = F.coalesce((g["char_start"] >= 0) & (g["char_start"] < g["char_end"]) & (g["char_end"] <= F.length(d["text"])), F.lit(False))
            found = F.when(g["gold_text"] != "", F.nullif(F.instr(d["text"], g["gold_text"]), F.lit(0)) - 1)
            place = F.struct(F.when(valid, g["char_start"]).otherwise(found).alias("a"), F.when(valid, g["char_end"]).otherwise(found + F.length(g["gold_text"])).alias("b"))

            def covered(p: Column) -> Column:
                ids, whole = chunking.covering(d["chunks"], p["a"], p["b"])
                new = {"char_start": p["a"], "char_end": p["b"], "covering_chunk_ids": ids, "is_preserved": whole, "locate_ok": p["a"].isNotNull()}
                return F.struct(*[new.get(n, g[n]).alias(n) for n in ("document_id", "sentence_index", "gold_text", "char_start", "char_end", "covering_chunk_ids", "is_preserved", "locate_ok")])

            return once(place, covered)

        return once(F.get(F.filter("docs", lambda d: d["document_id"] == g["document_id"]), F.lit(0)), of)

    rows = rows.withColumn("_gold", F.transform("gold_evidence", located)).withColumn("chunks", F.flatten(F.transform("docs", lambda d: d["chunks"])))
    return rows.drop("gold_evidence", "docs").withColumnRenamed("_gold", "gold_evidence")


def retrieve(samples: DataFrame, method: str = "bm25", top: int = 5, encoder: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None) -> DataFrame:
    """Samples with the best chunks of their own pool. Dense retrieval takes an encoder (see retrieval.encoded): questions and
    chunks become vectors once each, in rows that hold no more than one text, and are joined by the sample's row."""
    if method not in retrieval.METHODS:
        raise ValueError(f"unknown retrieval method: {method}")
    if method == "dense" and encoder is None:
        raise ValueError("dense retrieval needs an encoder")
    rows = samples.drop("retrieval")
    if method == "bm25":
        rows = retrieval.with_bm25(rows, "question", "chunks", top)
    else:
        rows = numbered(rows)
        asked = retrieval.encoded(rows.select(F.col("_row").alias("sample_id"), "question"), encoder, "question").select("sample_id", "vector")
        pool = rows.select(F.col("_row").alias("sample_id"), F.posexplode("chunks").alias("ordinal", "c")).select("sample_id", "ordinal", F.col("ordinal").alias("chunk_id"), "c.text")
        found = retrieval.dense(asked, retrieval.encoded(pool, encoder).drop("text"), top)
        best = found.groupBy(F.col("sample_id").alias("_row")).agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("chunk_id").alias("at"), "score"))).alias("ranked"))
        rows = rows.join(best, "_row", "left").drop("_row")

    def shown(r: Column) -> Column:
        c = F.get(F.col("chunks"), r["at"])
        return F.struct(c["chunk_id"].alias("chunk_id"), c["document_id"].alias("document_id"), r["rank"].alias("rank"), r["score"].alias("score"), c["text"].alias("text"))

    ranked = F.coalesce("ranked", F.array().cast("array<struct<rank:int,at:int,score:double>>"))
    found = F.struct(F.lit(method).alias("method"), F.lit(top).alias("top_k"), F.transform(ranked, shown).alias("retrieved_chunks"))
    return rows.withColumn("retrieval", found).drop("ranked")


def gold_chunk_ids() -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(F.coalesce("gold_evidence", F.array().cast(f"array<{EVIDENCE}>")), lambda g: F.coalesce(g["covering_chunk_ids"], none))))


def evaluated(samples: DataFrame) -> DataFrame:
    """The run's recall and hits (retrieval.summary), and how many samples have gold in their context, if there is one."""
    gold = samples.select("sample_id", gold_chunk_ids().alias("gold_ids"))
    found = samples.select("sample_id", F.explode("retrieval.retrieved_chunks.chunk_id").alias("chunk_id"))
    return retrieval.summary(retrieval.evaluate(gold, found))


def contexts(samples: DataFrame, budget: int = 3000, deduplicate: bool = True) -> DataFrame:
    """Samples with contexts under a budget of tokens."""
    return samples.withColumn("context_construction", context.build(F.col("retrieval.retrieved_chunks"), budget, deduplicate))


def generate(samples: DataFrame, pipeline_id: str, run_id: str, backend: str = "dry-run", version: str = "grounded_v1", done: DataFrame | None = None) -> DataFrame:
    """Full traces, one for each row of samples. Samples with a successful trace in `done` aren't asked again."""
    rows = numbered(samples if done is None else generation.pending(samples, done, pipeline_id))
    asked = rows.select(F.col("_row").cast("string").alias("sample_id"), generation.prompt(F.col("question"), F.col("context_construction.final_context"), version).alias("final_prompt"))
    fields = [x.split()[0] for x in generation.GENERATION.split(", ")]
    answers = generation.generate(asked, generation.backend(backend)).select(F.col("sample_id").cast("long").alias("_row"), F.struct(*fields).alias("generation"))
    return generation.assemble(rows.join(answers, "_row").drop("_row"), pipeline_id, run_id, version)
