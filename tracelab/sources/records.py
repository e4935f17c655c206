"""CSV records over splits: quoted fields may hold line breaks, and a split may begin inside one."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: So many splits at most are broadcast (two numbers and a path each); more are joined by a shuffle.
MOST_SPLITS = 100_000


def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that begins inside one, or at a record's start. Quotes count at
    a field's start and within a quoted one, where two stand for one; elsewhere they are characters."""
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        quote = line.find('"', at)
        if quote < 0:
            return True
        inside = line.startswith('"', quote + 1)
        at = quote + 2 if inside else line.find(",", quote + 1) + 1
        if not at:
            return False


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """The lines of each batch by split (path, name, at, then what else is known of it); a byte-order mark at a file's start is dropped. A
    split's lines may come in several parts, in order."""
    last = None
    for batch in batches:
        rows = batch.to_pylist()
        begin = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or (rows[i]["path"], rows[i]["at"]) != (rows[begin]["path"], rows[begin]["at"]):
                own = tuple(v for k, v in rows[begin].items() if k not in ("value", "id"))
                lines = [r["value"] for r in rows[begin:i]]
                if rows[begin]["at"] == 0 and own[:3] != last:
                    lines[0] = lines[0].removeprefix("﻿")
                last = own[:3]
                yield own, lines
                begin = i


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split, if it begins outside of a quoted field and if inside: whether it ends inside, and the records that begin in it."""
    found: dict[tuple, list[list]] = {}
    for key, lines in _splits(batches):
        for state in found.setdefault(key, [[False, 0], [True, 0]]):
            for line in lines:
                state[1] += not state[0]
                state[0] = open_after(line, state[0])
    rows = [(*key, *a, *b) for key, (a, b) in found.items()]
    yield pa.RecordBatch.from_pylist([dict(zip(("path", "name", "at", "end0", "starts0", "end1", "starts1"), r, strict=True)) for r in rows], pa.schema([("path", pa.string()), ("name", pa.string()), ("at", pa.int64()), ("end0", pa.bool_()), ("starts0", pa.int64()), ("end1", pa.bool_()), ("starts1", pa.int64())]))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and, at both ends of a split, parts of records (whole: false), with their place in the file."""
    out: list[tuple] = []
    now, state, record, held, begun = None, False, 0, [], False

    def flush(whole: bool) -> None:
        if held:
            out.append((*now, record, whole, "\n".join(held)))
            held.clear()

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)], ["path", "name", "at", "record", "whole", "value"])

    for (path, name, at, inside, first), lines in _splits(batches):
        if (path, name, at) != now:
            flush(begun and not state)
            now, state, record, begun = (path, name, at), inside, first - 1, False
        for line in lines:
            if not state:
                flush(begun)
                record, begun = record + 1, True
            held.append(line)
            state = open_after(line, state)
        if len(out) > 2000:
            yield rows()
    flush(begun and not state)
    yield rows()


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(2**31 - 1)
    for batch in batches:
        fields = [next(csv.reader(io.StringIO(v, newline="")), []) for v in batch.column("value").to_pylist()]
        at = batch.schema.get_field_index("value")
        yield batch.set_column(at, "fields", pa.array(fields, pa.list_(pa.string())))


def records(spark: SparkSession, path: str) -> DataFrame:
    """source_file, path, record (its place in the file, from 0; blank ones count but are left out) and fields of every CSV record.

    A reader from the top of a file knows whether a line lies within quotes; one that begins at a split doesn't. So each split is
    scanned for both cases at once, which gives its end state and its number of records for either; a pass over those, one row
    for each split, picks the case; then every split is read knowing its own. Records within a split are whole there, and only
    parts at the ends of splits meet by file and record. Line breaks within fields become a line feed. A field that isn't
    closed ends with the file, so a stray opening quote makes one record of what follows, as for any CSV reader.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("at"), "value")
    kinds = "path string, name string, at long"
    found = text.mapInArrow(_scanned, f"{kinds}, end0 boolean, starts0 long, end1 boolean, starts1 long")
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.count_if(F.col("end0") & ~F.col("end1")).over(before), F.lit(0))
    known = F.last(F.when(F.col("end0") == F.col("end1"), F.struct("end0", "turns")), ignorenulls=True).over(before)
    splits = found.withColumn("turns", turns).withColumn("known", known)
    odd = (F.col("turns") - F.coalesce("known.turns", F.lit(0))) % 2 == 1
    splits = splits.withColumn("inside", F.coalesce("known.end0", F.lit(False)) != odd)
    first = F.coalesce(F.sum(F.when(F.col("inside"), F.col("starts1")).otherwise(F.col("starts0"))).over(before), F.lit(0))
    splits = splits.select("path", "at", "inside", first.alias("first"))
    few = splits.count() <= MOST_SPLITS
    rows = text.withColumn("id", F.monotonically_increasing_id()).join(F.broadcast(splits) if few else splits, ["path", "at"])
    rows = rows.select("path", "name", "at", "inside", "first", "id", "value").sortWithinPartitions("path", "at", "id")
    if not few:
        rows = rows.repartition("path", "at").sortWithinPartitions("path", "at", "id")
    pieces = rows.mapInArrow(_joined, f"{kinds}, record long, whole boolean, value string")
    ends = pieces.where("not whole").groupBy("path", "name", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda p: p["value"]), "\n").alias("value"))
    whole = pieces.where("whole").select("path", "name", "record", "value").unionByName(ends).where("value <> ''")
    out = whole.mapInArrow(_parsed, "path string, name string, record long, fields array<string>")
    return out.withColumnRenamed("name", "source_file")
