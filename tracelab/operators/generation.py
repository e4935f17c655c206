"""Prompts, answer clients and assembled traces."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prompt templates by version, with places for the question and the context, and the answer of a dry run.
PROMPTS = {
    "grounded_v1": """You are a question-answering assistant.

Answer the question using only the supplied context.
Do not introduce unsupported facts.
If the context is insufficient, explicitly state that the answer
cannot be determined from the provided context.

Question:
{query}

Context:
{final_context}

Answer:""",
}
DRY_ANSWER = "[DRY_RUN] 占位答案，未调用真实模型。"
GENERATION = "final_answer string, model_name string, temperature double, latency_ms int, input_tokens int, output_tokens int, status string, error string"


def prompt(query: Column, context: Column, version: str = "grounded_v1") -> Column:
    if version not in PROMPTS:
        raise ValueError(f"unknown prompt version: {version}")
    values = {"{query}": query, "{final_context}": context}
    parts = re.split(r"(\{query\}|\{final_context\})", PROMPTS[version])
    return F.concat(*[F.coalesce(values[p], F.lit("")) if p in values else F.lit(p) for p in parts])


def dry_run() -> Column:
    """The answer of the default backend: a constant, always a success."""
    values = {"final_answer": F.lit(DRY_ANSWER), "model_name": F.lit("dry-run"), "temperature": F.lit(0.0), "latency_ms": F.lit(0), "input_tokens": F.lit(None).cast("int"), "output_tokens": F.lit(None).cast("int"), "status": F.lit("success"), "error": F.lit(None).cast("string")}
    return F.struct(*[v.alias(k) for k, v in values.items()])


def generate(samples: DataFrame, client: Callable[[], Callable[[str], dict]], retries: int = 3, wait: float = 1.0) -> DataFrame:
    """samples (sample_id, final_prompt) with the answers of a client, a row each.

    client() is called once a task and gives a function from a prompt to the fields of GENERATION. A call that raises is
    tried again after `wait` seconds, then twice as many and so on; in the end it gives an error row, never an exception.
    Runs where the data are, in Arrow batches.
    """

    kinds = {n: {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}[k] for n, k in (x.split() for x in GENERATION.split(", "))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = client()

        def answer(text: str) -> dict:
            for attempt in range(retries):
                try:
                    return {"status": "success", "error": None, **ask(text)}
                except Exception as e:  # noqa: BLE001  any failure of a backend is an error row
                    error = str(e)
                    if attempt < retries - 1 and wait:
                        time.sleep(wait * 2**attempt)
            return {"status": "error", "error": error}

        for batch in batches:
            rows = [answer(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r.get(n) for r in rows], k) for n, k in kinds.items())], ["sample_id", *kinds])

    return samples.select("sample_id", "final_prompt").mapInArrow(run, f"sample_id string, {GENERATION}")


BACKENDS = {"dry-run": lambda: lambda text: {"final_answer": DRY_ANSWER, "model_name": "dry-run", "temperature": 0.0, "latency_ms": 0}}


def register_backend(name: str, client: Callable[[], Callable[[str], dict]]) -> None:
    """Adds a client (network backends are the caller's)."""
    BACKENDS[name] = client


def backend(name: str) -> Callable[[], Callable[[str], dict]]:
    if name not in BACKENDS:
        raise ValueError(f"unknown backend: {name}")
    return BACKENDS[name]


def pending(samples: DataFrame, done: DataFrame, pipeline_id: str) -> DataFrame:
    """Extension: samples without a successful trace in `done`, to resume a run."""
    ok = done.where("runtime.status = 'success'").select(F.col("trace_id").alias("_done"))
    return samples.join(ok, F.concat(F.col("sample_id"), F.lit(f"__{pipeline_id}")) == F.col("_done"), "left_anti")


def assemble(samples: DataFrame, pipeline_id: str, run_id: str, version: str = "grounded_v1") -> DataFrame:
    """Full traces of samples that have gone through all stages and carry a struct `generation`."""
    c = lambda n: F.col(n) if n in samples.columns else F.lit(None)
    text = prompt(F.col("question"), F.col("context_construction.final_context"), version)
    generation = F.col("generation").withField("prompt_version", F.lit(version)).withField("final_prompt", text)
    return samples.select(
        F.concat("sample_id", F.lit(f"__{pipeline_id}")).alias("trace_id"),
        F.col("sample_id").alias("source_record_id"),
        F.lit(pipeline_id).alias("pipeline_id"),
        c("language").alias("language"),
        F.col("question").alias("query"),
        *[c(n).alias(n) for n in ("reference_answer", "gold_evidence", "source_documents", "chunks", "retrieval", "context_construction")],
        generation.alias("generation"),
        c("metadata").alias("pipeline_config"),
        F.lit(None).cast("string").alias("injected_fault"),
        F.struct(F.lit(run_id).alias("run_id"), F.col("generation.status").alias("status"), F.col("generation.error").alias("error")).alias("runtime"),
    )
