"""Healthy traces and controlled faults on typed traces (columns as in plans.traces)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import stored
from .context import rebuild

#: What each fault does, whom a diagnosis should blame, and how metrics should change.
FAULTS = {
    "missing_evidence": ("Remove chunks containing gold evidence from retrieval", "retrieval", "Recall@K decreases"),
    "chunk_truncation": ("Truncate a chunk in the middle of a sentence", "chunking", "Chunk coherence decreases"),
    "chunk_merge": ("Merge two unrelated chunks together", "chunking", "Context relevance decreases"),
    "distractor_context": ("Add irrelevant chunks to context", "chunking/retrieval", "Context precision decreases"),
    "corrupted_query": ("Corrupt/truncate the query", "unknown", "All metrics deteriorate"),
    "out_of_scope": ("Replace query with out-of-scope question", "out_of_scope", "Retrieval relevance low, generation hallucinates"),
    "irrelevant_document": ("Replace retrieved chunk with chunk from another sample", "retrieval", "Context relevance drops significantly"),
    "unsupported_answer": ("Replace answer with unsupported information", "generation", "Faithfulness decreases"),
    "contradictory_answer": ("Generate answer that contradicts context", "generation", "Faithfulness decreases, contradiction detected"),
}
#: Questions, answers, the text and the signs that faults put in.
OUT_OF_SCOPE = [
    "What is the weather like today?",
    "Can you recommend a good restaurant?",
    "How do I bake a cake?",
    "What is the meaning of life?",
    "Tell me a joke",
    "What should I wear tomorrow?",
    "How to fix a broken pipe?",
    "What are today's stock prices?",
    "Can you predict the future?",
    "What is the best movie of all time?",
    "Who will win the next election?",
    "What is the price of Bitcoin?",
    "How to become a millionaire?",
    "What is the secret to happiness?",
    "Should I buy a new car?",
]
UNSUPPORTED = [
    "The answer cannot be determined from the context.",
    "I don't have enough information to answer this question.",
    "The context doesn't mention this topic.",
    "This is not covered in the provided documents.",
    "I'm sorry, but I don't know the answer.",
    "The information is not available in the given context.",
    "I cannot answer this question based on the provided context.",
    "The context does not contain the necessary information.",
]
CONTRADICTORY = [
    "The answer is the complete opposite of what the context states.",
    "No, this is not correct according to the information provided.",
    "The context actually says the opposite of this statement.",
    "This contradicts the information in the documents.",
    "The evidence suggests a different conclusion.",
    "The context clearly refutes this claim.",
    "This is contradicted by the provided information.",
]
DISTRACTOR = "This is irrelevant information that does not help answer the question. It is just random text inserted as a distractor."
GARBAGE = "!@#$%^&*()_+[]{}|;:',.<>?/"
SEED = 42


def drawn(*parts: Column | str) -> Column:
    """A number of 32 bits that depends on the seed and the parts alone: the first 8 digits of the MD5 of all, joined by bars.
    So a draw is the same in any partitioning, and any engine can work it out."""
    own = [p if isinstance(p, Column) else F.lit(p) for p in (str(SEED), *parts)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *own).cast("binary")), 1, 8), 16, 10).cast("long")


def draw(name: str, n: Column | int) -> Column:
    """A number below n for a purpose, of each trace its own."""
    return F.pmod(drawn(name, F.col("trace_id")), F.lit(n) if isinstance(n, int) else n).cast("int")


def pick(name: str, values: list[str]) -> Column:
    return F.lit(values)[draw(name, len(values))]


def healthy(traces: DataFrame, most: int | None = None) -> DataFrame:
    """Traces with gold chunk ids, all of which were selected, marked _is_healthy; the first `most` by trace id."""
    gold = F.array_distinct(F.flatten(F.transform("gold_evidence", lambda g: F.coalesce(g["covering_chunk_ids"], F.array().cast("array<string>")))))
    good = (F.size(gold) > 0) & (F.size(F.array_except(gold, "context_construction.selected_chunk_ids")) == 0)
    rows = traces.where(F.coalesce(good, F.lit(False))).withColumn("_is_healthy", F.lit(True))
    return rows if most is None else rows.orderBy("trace_id").limit(most)


_chunks, _ids = "retrieval.retrieved_chunks", "context_construction.selected_chunk_ids"


def _with(df: DataFrame, chunks: Column | None = None, ids: Column | None = None, context: Column | None = None) -> DataFrame:
    """df with parts of retrieval and context replaced; all read the trace as it was."""
    new = {}
    if chunks is not None:
        new["retrieval"] = F.col("retrieval").withField("retrieved_chunks", chunks)
    made = F.col("context_construction")
    if ids is not None:
        made = made.withField("selected_chunk_ids", ids)
    if context is not None:
        made = made.withField("final_context", context)
    new["context_construction"] = made
    # new names first: inside lambdas a name that is replaced beside would mean the new column
    return df.withColumns({f"_new_{k}": v for k, v in new.items()}).withColumns({k: F.col(f"_new_{k}") for k in new}).drop(*(f"_new_{k}" for k in new))


def missing_evidence(df: DataFrame) -> DataFrame:
    """Retrieved chunks of gold documents go, from the selection too; the context is built anew. A trace without gold
    documents, or without chunks of them, stays as it is."""
    gold = F.filter(F.transform("gold_evidence", lambda g: g["document_id"]), lambda d: d.isNotNull())
    is_gold = lambda c: F.coalesce(F.array_contains(gold, c["document_id"]), F.lit(False))
    left = F.filter(_chunks, lambda c: ~is_gold(c))
    gone = F.filter(_chunks, is_gold)
    ids = F.filter(_ids, lambda x: ~F.coalesce(F.array_contains(F.transform(gone, lambda c: c["chunk_id"]), x), F.lit(False)))
    found = F.coalesce(F.size(gone) > 0, F.lit(False))
    method = F.when(F.coalesce(F.size(gold), F.lit(0)) <= 0, "no_gold_evidence_found").when(~found, "no_chunks_with_gold_evidence").otherwise(F.format_string("removed %d chunks with gold evidence", F.size(gone)))
    context = F.col("context_construction.final_context")
    return _with(df.withColumn("injection_method", method), F.when(found, left).otherwise(F.col(_chunks)), F.when(found, ids).otherwise(F.col(_ids)), F.when(found, rebuild(ids, left)).otherwise(context))


def chunk_truncation(df: DataFrame) -> DataFrame:
    """A chunk of 50 characters or more ends between 30 and 70 percent, after a near mark if there is one."""
    n = F.size(_chunks)
    at = draw("chunk", F.greatest(n, F.lit(1)))
    text = F.get(F.col(_chunks), at)["text"]
    middle = F.floor(F.length(text) * (0.3 + draw("cut", 400) / 1000.0)).cast("int")
    low, high = F.greatest(F.lit(0), middle - 50), F.least(F.length(text), middle + 50)
    part = F.substring(text, low + 1, high - low)
    marks = [F.nullif(F.instr(part, F.lit(m)), F.lit(0)) + low for m in (". ", "! ", "? ", ", ", "; ")]
    cut = F.least(F.greatest(middle, *marks), F.length(text) - 10)
    fits = F.coalesce((n > 0) & (F.length(text) >= 50), F.lit(False))
    new = F.transform(_chunks, lambda c, i: F.when(i == at, c.withField("text", F.concat(F.substring(c["text"], F.lit(1), cut), F.lit(" [TRUNCATED]")))).otherwise(c))
    method = (
        F.when(F.coalesce(n, F.lit(0)) <= 0, "no_chunks_to_truncate")
        .when(F.coalesce(text, F.lit("")) == "", "invalid_chunk")
        .when(fits, F.concat(F.lit("truncated chunk at position "), cut.cast("string")))
        .otherwise("chunk_too_short_to_truncate")
    )
    return _with(df.withColumn("injection_method", method), F.when(fits, new).otherwise(F.col(_chunks)))


def chunk_merge(df: DataFrame) -> DataFrame:
    """The second of two drawn chunks moves into the first."""
    n = F.size(_chunks)
    a = draw("first", F.greatest(n, F.lit(1)))
    b = F.pmod(a + 1 + draw("second", F.greatest(n - 1, F.lit(1))), F.greatest(n, F.lit(1)))
    one, other = F.get(F.col(_chunks), a), F.get(F.col(_chunks), b)
    joined = F.transform(_chunks, lambda c, i: F.when(i == a, c.withField("text", F.concat(c["text"], F.lit(" [MERGED] "), other["text"]))).otherwise(c))
    fits = F.coalesce((n > 1) & (one["text"] != "") & (other["text"] != ""), F.lit(False))
    name = lambda c: F.coalesce(c["document_id"], F.lit("None"))
    method = F.when(fits, F.concat(F.lit("merged chunks from docs "), name(one), F.lit(" and "), name(other))).when(n > 1, "empty_chunk_text").otherwise("not_enough_chunks")
    return _with(df.withColumn("injection_method", method), F.when(fits, F.filter(joined, lambda c, i: i != b)).otherwise(F.col(_chunks)))


def distractor_context(df: DataFrame) -> DataFrame:
    """A chunk that doesn't help is appended; the context is built before the chunk is known, so it shows only its id."""
    name = F.format_string("distractor_%d", 1000 + draw("distractor", 9000))
    source = F.format_string("distractor_doc_%d", 1000 + draw("distractor source", 9000))
    kind = df.schema["retrieval"].dataType["retrieved_chunks"].dataType.elementType
    values = {"chunk_id": name, "document_id": source, "rank": F.coalesce(F.size(_chunks), F.lit(0)) + 1, "score": F.lit(0.5), "text": F.lit(DISTRACTOR)}
    added = F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])
    ids = F.array_append(_ids, name)
    none = F.col("context_construction").isNull()
    method = F.when(none, "no_context_to_modify").otherwise("added distractor chunk")
    chunks = F.when(none, F.col(_chunks)).otherwise(F.array_append(F.coalesce(_chunks, F.array().cast(df.schema["retrieval"].dataType["retrieved_chunks"].dataType)), added))
    return _with(df.withColumn("injection_method", method), chunks, ids, rebuild(ids, F.col(_chunks)))


def irrelevant_document(df: DataFrame) -> DataFrame:
    """One retrieved chunk becomes one of another trace's, its score 0.1; the id selected at that place is replaced as well.

    Traces are dealt into groups by hash; within a group each takes from the next in order of hash, the last from the first.
    """
    groups = F.lit(max(1, df.count() // 1000))
    rows = df.withColumn("_h", drawn("partner", F.col("trace_id"))).withColumn("_g", F.pmod("_h", groups))
    w = Window.partitionBy("_g").orderBy("_h", "trace_id")
    own = F.struct(F.col("trace_id").alias("trace_id"), F.get(F.col(_chunks), draw("own chunk", F.greatest(F.size(_chunks), F.lit(1)))).alias("chunk"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("other", F.coalesce(F.lead(own).over(w), F.first(own).over(whole))).drop("_h", "_g")
    at = draw("replace", F.greatest(F.size(_chunks), F.lit(1)))
    no_other, n = F.col("other.trace_id") == F.col("trace_id"), F.coalesce(F.size(_chunks), F.lit(0))
    fits = F.coalesce(~no_other & F.col("other.chunk").isNotNull() & (n > 0), F.lit(False))
    method = (
        F.when(no_other, "no_other_traces_with_chunks")
        .when(F.col("other.chunk").isNull(), "other_trace_no_chunks")
        .when(~fits, "no_chunks_to_replace")
        .otherwise(F.concat(F.lit("replaced chunk at position "), at.cast("string"), F.lit(" with chunk from "), F.col("other.trace_id")))
    )
    new = F.transform(_chunks, lambda c, i: F.when(i == at, F.col("other.chunk").withField("rank", c["rank"]).withField("score", F.lit(0.1))).otherwise(c))
    ids = F.transform(_ids, lambda x, i: F.when(i == at, F.col("other.chunk.chunk_id")).otherwise(x))
    context = F.when(fits & (at < F.size(_ids)), rebuild(ids, new)).otherwise(F.col("context_construction.final_context"))
    return _with(rows.withColumn("injection_method", method), F.when(fits, new).otherwise(F.col(_chunks)), F.when(fits, ids).otherwise(F.col(_ids)), context).drop("other")


def _query(df: DataFrame, new: Column, method: Column) -> DataFrame:
    text = F.when(F.coalesce(F.col("query"), F.lit("")) == "", F.col("generation.final_prompt")).otherwise(F.replace(F.col("generation.final_prompt"), F.col("query"), new))
    return df.withColumns({"injection_method": method, "original_query": F.col("query"), "generation": F.col("generation").withField("final_prompt", text), "query": new})


def corrupted_query(df: DataFrame) -> DataFrame:
    """The query is cut to 20 to 50 percent, its words are shuffled (cut to 30 percent if there are two at most), or ten
    signs are put in."""
    q, way = F.col("query"), draw("way", 3)
    words = F.filter(F.split(q, r"(?U)\s+"), lambda x: x != "")
    keyed = F.array_sort(F.transform(words, lambda x, i: F.struct(drawn("word", F.col("trace_id"), i.cast("string")).alias("k"), i.alias("i"), x.alias("x"))))
    shorter = lambda share: F.concat(F.substring(q, F.lit(1), F.floor(F.length(q) * share).cast("int")), F.lit("..."))
    signs = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.substring(F.lit(GARBAGE), (F.pmod(drawn("sign", F.col("trace_id"), i.cast("string")), F.lit(len(GARBAGE))) + 1).cast("int"), F.lit(1))), "")
    at = draw("place", F.length(q) + 1)
    mixed = F.concat(F.substring(q, F.lit(1), at), signs, F.substring(q, at + 1, F.length(q)))
    shuffled = F.when(F.size(words) > 2, F.array_join(F.transform(keyed, lambda s: s["x"]), " ")).otherwise(shorter(0.3))
    new = F.when(way == 0, shorter(0.2 + draw("share", 300) / 1000.0)).when(way == 1, shuffled).otherwise(mixed)
    name = F.when(way == 0, "truncate applied").when(way == 1, "scramble applied").otherwise("insert_garbage applied")
    blank = F.coalesce(q, F.lit("")) == ""
    return _query(df, F.when(blank, q).otherwise(new), F.when(blank, "empty_query").otherwise(name)).drop("original_query")


def out_of_scope(df: DataFrame) -> DataFrame:
    return _query(df, pick("scope", OUT_OF_SCOPE), F.lit("replaced with out-of-scope question"))


def _answer(df: DataFrame, answers: list[str], method: str) -> DataFrame:
    old = F.col("generation.final_answer")
    return df.withColumn("generation", F.col("generation").withField("final_answer", pick(method, answers)).withField("original_answer", F.coalesce(old, F.lit("")))).withColumn("injection_method", F.lit(method))


INJECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "missing_evidence": missing_evidence,
    "chunk_truncation": chunk_truncation,
    "chunk_merge": chunk_merge,
    "distractor_context": distractor_context,
    "corrupted_query": corrupted_query,
    "out_of_scope": out_of_scope,
    "irrelevant_document": irrelevant_document,
    "unsupported_answer": lambda df: _answer(df, UNSUPPORTED, "replaced with unsupported answer"),
    "contradictory_answer": lambda df: _answer(df, CONTRADICTORY, "replaced with contradictory answer"),
}


def bottom(rows: DataFrame, by: str, order: list[Column | str], count: int) -> DataFrame:
    """The `count` rows of each `by` that come first in `order`: a bottom-k sample if that begins with a hash. Each task keeps
    its own first `count` of a group before the shuffle, so as many rows a task and group move, however large the group is."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= count).drop("_place")


def sampled(traces: DataFrame, chosen: list[str], count: int, language: str) -> DataFrame:
    """The traces that each of the chosen faults is put into (column fault): `count` of them each, drawn without replacement
    from those without a fault in the language (`any`: all), by hash.

    All draws are made in one pass over ids, hashes and a number of the row; those of the drawn rows, `count` for each fault
    at most, then pick the whole traces in one scan. Traces that share an id are rows of their own.
    """
    pool = traces.where(F.col("injected_fault").isNull()).withColumn("_row", F.xxhash64("language", "query", "reference_answer"))
    pool = pool if language == "any" else pool.where(F.col("language") == language)
    draws = F.explode(F.array(*[F.struct(F.lit(f).alias("fault"), drawn("trace", f, F.col("trace_id")).alias("h")) for f in chosen]))
    first = bottom(pool.select("trace_id", "_row", draws.alias("d")).select("trace_id", "_row", "d.*"), "fault", ["h", "trace_id", "_row"], count)
    # a row for each drawn trace: count times the number of faults at most; equal traces are one with their number
    keys = first.groupBy(F.col("trace_id").alias("_id"), F.col("_row").alias("_of"), "fault").agg(F.count(F.lit(1)).alias("_n"))
    found = pool.join(F.broadcast(keys), F.col("trace_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_of")))
    equal = F.row_number().over(Window.partitionBy("fault", "_id", "_of").orderBy("_of"))
    # the first condition lets each task keep no more than that of equal traces
    return found.withColumn("_k", equal).where((F.col("_k") <= count) & (F.col("_k") <= F.col("_n"))).drop("_row", "_id", "_of", "_n", "_k")


def wrapped(picked: DataFrame, fault: str) -> DataFrame:
    """Wrappers of the picked traces (see inject) with a fault put in."""
    if fault not in INJECTORS:
        raise ValueError(f"unknown fault: {fault}")
    made = INJECTORS[fault](picked)
    description, diagnosis, change = FAULTS[fault]
    inner = [c for c in made.columns if c not in ("injected_fault", "_is_healthy", "injection_method")]
    return made.select(
        F.struct(*inner).alias("trace"),
        F.col("trace_id").alias("original_trace_id"),
        F.lit(fault).alias("injected_fault"),
        "injection_method",
        F.lit(change).alias("expected_metric_change"),
        F.lit(diagnosis).alias("expected_diagnosis"),
        F.lit(description).alias("fault_description"),
    )


def inject(traces: DataFrame, fault: str, count: int = 20, language: str = "en") -> DataFrame:
    """Wrappers of `count` faulty traces, drawn without replacement from those without a fault in the language (`any`: all).

    Columns: trace (the faulty trace, without labels), original_trace_id, injected_fault, injection_method and the catalogue's
    expectations. Labels stand in the wrapper alone.
    """
    return inject_all(traces, [fault], count, language)[fault]


def inject_all(traces: DataFrame, chosen: list[str] | None = None, count: int = 20, language: str = "en") -> dict[str, DataFrame]:
    """inject() for several faults (default: all), which draw their traces in one pass. The drawn traces are stored: `count`
    for each fault at most."""
    chosen = list(INJECTORS) if chosen is None else chosen
    if wrong := [f for f in chosen if f not in INJECTORS]:
        raise ValueError(f"unknown fault: {wrong[0]}")
    picked = stored(sampled(traces, chosen, count, language), "drawn")
    return {f: wrapped(picked.where(F.col("fault") == f).drop("fault"), f) for f in chosen}
