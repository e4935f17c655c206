"""Sentence-aware chunking with overlap, and where gold evidence falls in the chunks."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

SENTENCE_END = re.compile(r"""[.!?。！？…]+["')\]]*\s+|\n+""")
WORD = re.compile(r"\S+\s*")
CHUNK = "struct<chunk_id:string,document_id:string,text:string,chunk_index:int,start_char:int,end_char:int,token_count:int>"


def fallback_counter(text: str) -> int:
    """Tokens of a text without a tokenizer: its words, one at least."""
    return max(1, len(text.split()))


def tiktoken_counter(name: str = "cl100k_base") -> Callable[[str], int]:
    """Counts with an encoding of tiktoken (its file must be in tiktoken's cache)."""
    import tiktoken

    encoding = tiktoken.get_encoding(name)
    return lambda text: len(encoding.encode(text))


def atoms(text: str, size: int, count: Callable[[str], int]) -> list[tuple[int, int, int]]:
    """Start, end and token count of each atom: a sentence, or each word (with the space after it) of one over size."""
    out, at = [], 0
    for cut in [*(m.end() for m in SENTENCE_END.finditer(text)), len(text)]:
        if cut <= at:
            continue
        n = count(text[at:cut])
        words = [m.span() for m in WORD.finditer(text, at, cut)] if n > size else []
        out += [(i, j, count(text[i:j])) for i, j in words] if words else [(at, cut, n)]
        at = cut
    return out


def windows(tokens: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """First and end atom of each chunk, by searches in the prefix sums of the token counts."""
    total = np.r_[0, np.cumsum(tokens)]
    out, i, n = [], 0, len(tokens)
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + size, "right")) - 1)
        out.append((i, j))
        if j >= n:
            break
        i = max(i + 1, int(np.searchsorted(total, total[j] - overlap, "right")) - 1)
    return out


def chunk_text(document_id: str, text: str, size: int = 400, overlap: int = 80, count: Callable[[str], int] = fallback_counter) -> list[tuple]:
    """The chunks of a text (fields in the order of CHUNK): as many atoms as fit into size (one at least), each next chunk
    reaching back over the fewest last atoms that have overlap tokens, but always beginning later than the one before."""
    own, out = atoms(text or "", size, count), []
    for k, (i, j) in enumerate(windows([n for *_, n in own], size, overlap)):
        start, end = own[i][0], own[j - 1][1]
        body = text[start:end]
        out.append((f"{document_id}__chunk_{k:03d}", document_id, body, k, start, end, count(body)))
    return out


def with_chunks(docs: DataFrame, size: int = 400, overlap: int = 80, counter: Callable[[], Callable[[str], int]] | None = None, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """docs with a column chunks, the array of each document's chunks (fields of CHUNK). Offsets count code points, half open
    from 0; empty and null texts have no chunks. The token counter is any Python function, so documents stream through Arrow
    batches; nothing is shuffled and a chunk is a slice of its text. counter() is called once a task."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    kinds = {"chunk_id": pa.string(), "document_id": pa.string(), "text": pa.string(), "chunk_index": pa.int32(), "start_char": pa.int32(), "end_char": pa.int32(), "token_count": pa.int32()}
    at, names = [docs.columns.index(c) for c in (id_col, text_col)], [*docs.columns, "chunks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter() if counter else fallback_counter
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                lists = [chunk_text(d, t or "", size, overlap, count) for d, t in zip(*(part.column(k).to_pylist() for k in at), strict=True)]
                columns = zip(*itertools.chain.from_iterable(lists), strict=True) if any(lists) else [()] * len(kinds)
                values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))
                ends = pa.array(np.r_[0, np.cumsum([len(x) for x in lists])], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, values)], names)

    schema = StructType([*docs.schema.fields, StructField("chunks", ArrayType(_parse(CHUNK)))])
    return docs.mapInArrow(run, schema)


def _parse(kind: str) -> StructType:
    return StructType.fromDDL(kind[len("struct<") : -1].replace(":", " "))


def chunk_documents(docs: DataFrame, size: int = 400, overlap: int = 80, counter: Callable[[], Callable[[str], int]] | None = None, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """A row per chunk of each document (columns of CHUNK), as with_chunks() has them."""
    own = docs.select(F.col(id_col).cast("string").alias("document_id"), F.col(text_col).alias("text"))
    return with_chunks(own, size, overlap, counter).select(F.explode("chunks").alias("c")).select("c.*")


def locate(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """gold (sample_id, ordinal, document_id, gold_text, char_start, char_end) with offsets: its own if they are valid in
    the document's text, else those of the first occurrence of gold_text, else null."""
    rows = gold.join(docs.select("document_id", F.col("text").alias("body")), "document_id", "left")
    valid = (F.col("char_start") >= 0) & (F.col("char_start") < F.col("char_end")) & (F.col("char_end") <= F.length("body"))
    found = F.nullif(F.instr(F.col("body"), F.col("gold_text")), F.lit(0)) - 1
    start = F.when(F.coalesce(valid, F.lit(False)), F.col("char_start")).when(F.col("gold_text") != "", found)
    end = F.when(F.coalesce(valid, F.lit(False)), F.col("char_end")).otherwise(start + F.length("gold_text"))
    return rows.withColumns({"gold_start": start, "gold_end": end}).drop("body")


def cover(gold: DataFrame, chunks: DataFrame, bin_chars: int = 20_000) -> DataFrame:
    """Located gold joined to the chunks that it overlaps, by document and interval: covering_chunk_ids in chunk order,
    is_preserved (one chunk holds all of it) and locate_ok.

    Gold and chunks are dealt into bins of bin_chars characters of their document, by every bin that they reach into; they
    meet by document and bin, where the later of their two starts lies, so a pair is found once. A document of any length
    is spread over as many tasks as it has bins.
    """
    reach = lambda a, b: F.sequence(F.floor(F.col(a) / bin_chars), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / bin_chars))
    c = chunks.select("document_id", "chunk_id", "chunk_index", "start_char", "end_char").where("start_char < end_char")
    c = c.withColumn("bin", F.explode(reach("start_char", "end_char"))).withColumnRenamed("document_id", "of_document")
    keys = ["sample_id", "ordinal", "document_id", "gold_text", "gold_start", "gold_end"]
    found = gold.select(*keys).where("gold_start < gold_end").withColumn("of_bin", F.explode(reach("gold_start", "gold_end")))
    on = (F.col("document_id") == F.col("of_document")) & (F.col("bin") == F.col("of_bin")) & (F.col("start_char") < F.col("gold_end")) & (F.col("gold_start") < F.col("end_char"))
    once = F.floor(F.greatest("start_char", "gold_start") / bin_chars) == F.col("bin")
    holds = (F.col("start_char") <= F.col("gold_start")) & (F.col("gold_end") <= F.col("end_char"))
    hits = found.join(c, on & once).select(*keys, F.struct("chunk_index", "chunk_id").alias("c"), holds.alias("holds"))
    # gold without any chunk keeps its row
    every = hits.unionByName(gold.select(*keys, F.lit(None).cast(hits.schema["c"].dataType).alias("c"), F.lit(False).alias("holds")))
    out = every.groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("c"), F.max("holds").alias("is_preserved"))
    return out.withColumn("covering_chunk_ids", F.col("c.chunk_id")).withColumn("locate_ok", F.col("gold_start").isNotNull()).drop("c")


def covering(chunks: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """For gold in the row of its document's chunks: ids of the chunks that it overlaps, and whether one holds all of it."""
    over = F.filter(chunks, lambda c: (c["start_char"] < end) & (start < c["end_char"]))
    holds = F.exists(chunks, lambda c: (c["start_char"] <= start) & (end <= c["end_char"]))
    return F.coalesce(F.transform(over, lambda c: c["chunk_id"]), F.array().cast("array<string>")), F.coalesce(holds, F.lit(False))
