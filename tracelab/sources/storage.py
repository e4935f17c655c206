"""Tables in the folder that driver and executors share: intermediate ones, and stages that later runs find again."""

from __future__ import annotations

import functools
import hashlib
import json
import time
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Any, NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN: list[str] = []
#: What says that a stage is finished: where its rows are, their schema, its files and their bytes, and when.
MARK = "rows string, fields string, files long, bytes long, at double"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session (one machine) uses its warehouse; on a cluster
    a folder must be named, since executors don't see each other's disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local[") and spark.conf.get("spark.master", "local") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _OWN.append(f"{shared_folder(spark)}/traces/{name}-{uuid.uuid4().hex}")
    return _OWN[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: work that is used several times is done once, and a lost
    executor costs none of it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, on any store that Spark writes to. Without a JVM at hand (Spark Connect) it's emptied instead."""
    if hasattr(spark, "_jvm"):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    else:
        spark.range(0).write.mode("overwrite").parquet(path)


def clean(spark: SparkSession) -> None:
    """Removes the intermediate tables that this process has stored; results that read them can't be read again."""
    while _OWN:
        remove(spark, _OWN.pop())


class Stage(NamedTuple):
    """The rows of a stage, and the key that they are kept under: what a later stage was made from."""

    rows: DataFrame
    key: str


def digest(*parts: Any) -> str:
    """SHA-256 of plain values, objects by sorted keys."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


@functools.cache
def code() -> str:
    """A digest of this package's source, without the subpackage llm, which stages don't use: other code makes other rows."""
    top = Path(__file__).resolve().parent.parent
    own = sorted(p for p in top.rglob("*.py") if "llm" not in p.relative_to(top).parts)
    return digest(*((str(p.relative_to(top)), p.read_text(encoding="utf-8")) for p in own))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file at a path: path, length, modificationTime. Spark lists them; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def files_key(spark: SparkSession, path: str) -> str:
    """A key of the files at a path: their names, lengths and times of change. Spark's own listing is as large."""
    return digest(*sorted((r.path, r.length, r.modificationTime.isoformat()) for r in listing(spark, path).collect()))


def _marks(spark: SparkSession, home: str) -> list:
    try:
        return spark.read.schema(MARK).json(f"{home}/done-*").orderBy("rows").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _size(spark: SparkSession, path: str) -> tuple[int, int]:
    try:
        r = listing(spark, path).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
        return r.n, r.bytes
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, -1


def stage(spark: SparkSession, name: str, made_from: dict[str, Any], make: Callable[[], DataFrame]) -> Stage:
    """The rows of make(), kept under a key of the stage's name, what it is made from (keys of files and stages, parameters) and
    the package's code. A later call with the same key, of this process or another one, reads them and doesn't call make().

    Rows are written to a folder of their own, and a mark beside it when they are whole. So a run that breaks off leaves
    nothing that is read; of two that work at once both write, and all later ones read the same. Rows that have lost files since
    are made again. Anything else that rows depend on (the time, random numbers) must be in made_from.
    """
    key = digest(code(), name, made_from)
    home = f"{shared_folder(spark)}/stages/{name}/{key}"
    for mark in _marks(spark, home):
        if _size(spark, mark.rows) == (mark.files, mark.bytes):
            return Stage(spark.read.schema(StructType.fromJson(json.loads(mark.fields))).parquet(mark.rows), key)
    attempt = uuid.uuid4().hex
    rows, at = make(), f"{home}/rows-{attempt}"
    rows.write.parquet(at)
    mark = (at, json.dumps(rows.schema.jsonValue()), *_size(spark, at), time.time())
    spark.createDataFrame([mark], MARK).coalesce(1).write.json(f"{home}/done-{attempt}")
    return Stage(spark.read.schema(rows.schema).parquet(at), key)


def clean_stages(spark: SparkSession, name: str = "*", older: float = 0.0) -> int:
    """Removes the stages of a name (all: *) that were finished `older` seconds ago or earlier, and what broken runs have
    left since then; returns how many finished ones. A removed stage is made anew when it is asked for."""
    home, before = f"{shared_folder(spark)}/stages/{name}", time.time() - older
    marks = [m for m in _marks(spark, f"{home}/*") if m.at <= before]
    try:
        left = listing(spark, f"{home}/*/rows-*")
        folder = F.regexp_extract("path", r"^(.*/rows-[0-9a-f]+)/", 1)
        ages = {r.f: r.t.timestamp() for r in left.groupBy(folder.alias("f")).agg(F.max("modificationTime").alias("t")).collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        ages = {}
    whole = {m.rows.rsplit("/", 1)[1] for m in _marks(spark, f"{home}/*")}
    for m in marks:  # the mark first: rows without one are never read
        remove(spark, m.rows.replace("/rows-", "/done-"))
        remove(spark, m.rows)
    for path, t in ages.items():
        if path.rsplit("/", 1)[1] not in whole and t <= before:
            remove(spark, path)
    return len(marks)
