"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Rows of an arc that one task ranks.
ARC_ROWS = 100_000


def ring_points(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions of all virtual nodes on the ring of signed 64-bit hashes, and the shard of each."""
    points = [(xxhash.xxh64_intdigest(f"shard-{s}/node-{v}", 7) - 2**63, s) for s in range(shards) for v in range(vnodes)]
    points.sort()
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def capacities(total: int, shards: int, slack: float) -> np.ndarray:
    """Rows that each shard may hold. With no slack they add up to the rows, so that counts are at most one apart."""
    if slack <= 0:
        return np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    return np.full(shards, int(np.ceil((1 + slack) * total / shards)), np.int64)


def flow(counts: np.ndarray, owners: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """How the keys of each arc go to shards: (arc, first rank, end rank, shard, first slot), ranks half open.

    A shard first takes the keys of its own arcs, in ring order, while it has room. The other keys of an arc go clockwise
    to the next virtual node whose shard has room. The list has at most two entries an arc and one a shard.
    """
    room, used, moves = room.copy(), np.zeros_like(room), []
    left = np.zeros_like(counts)

    def take(arc: int, rank: int, n: int, shard: int) -> None:
        moves.append((arc, rank, rank + n, int(shard), int(used[shard])))
        used[shard] += n
        room[shard] -= n

    for arc, (n, shard) in enumerate(zip(counts.tolist(), owners.tolist(), strict=True)):
        own = min(n, int(room[shard]))
        left[arc] = n - own
        if own:
            take(arc, 0, own, shard)
    for arc in np.flatnonzero(left).tolist():
        at = arc
        while left[arc]:
            at = (at + 1) % len(owners)
            if n := min(int(left[arc]), int(room[owners[at]])):
                take(arc, int(counts[arc] - left[arc]), n, owners[at])
                left[arc] -= n
    return moves


def shard(docs: DataFrame, shards: int = 24, vnodes: int = 64, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size (UTF-8 bytes and 8), text_crc32, law, shard, slot and grown_shard.

    The key of a row is its id; rows without an id use the checksum of their text. A key belongs to the arc of the first
    virtual node at or after its hash. Loads are bounded: no shard holds more than (1 + slack) times the mean, and with no
    slack row counts are at most one apart (law `rows`). Keys of a full shard continue clockwise. How the arcs' keys flow
    is worked out from the arcs' counts alone, at most shards * vnodes numbers whatever the input's size; a row then finds its
    shard and slot by its rank within its arc, which follows the hash; in arcs of over ARC_ROWS rows, such as one repeated id
    can make, it also follows how the table is split into tasks. Texts are read once and never shuffled.

    Null texts have size 8 and checksum 0 (that of an empty text). Repeated rows get slots of their own. Equal texts need
    not share a shard. An empty table gives an empty result. Other columns are not carried.
    """
    spark = docs.sparkSession
    points, owners = ring_points(shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, h.to_numpy(np.int64)) % len(points), dtype="int32")

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    rows = rows.withColumn("h", F.when(F.col("id").isNull(), F.xxhash64("crc", "size")).otherwise(F.xxhash64("id")))
    rows = written(rows.withColumn("arc", arc_of("h")).withColumn("uid", F.monotonically_increasing_id()), "ring")
    counts = np.zeros(len(points), np.int64)
    for arc, n in rows.groupBy("arc").count().collect():  # one row for each virtual node at most
        counts[arc] = n
    moves = flow(counts, owners, capacities(int(counts.sum()), shards, slack))
    plan = spark.createDataFrame(moves, "arc int, first long, end long, shard int, base long")
    # an arc of many rows is ranked in parts of about ARC_ROWS, whose counts are added up
    parts = F.ceil(F.element_at(F.lit([int(max(1, n)) for n in counts]), F.col("arc") + 1) / ARC_ROWS)
    split = rows.withColumn("part", F.pmod(F.xxhash64("uid"), parts))
    sizes = split.groupBy("arc", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("arc").alias("of_arc"), F.col("part").alias("of_part"), (F.sum("n").over(Window.partitionBy("arc").orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("arc", "part").orderBy("h", "id", "crc", "size", "uid")) - 1
    ranked = split.withColumn("place", place).join(before, (F.col("arc") == F.col("of_arc")) & (F.col("part") == F.col("of_part")))
    ranked = ranked.withColumn("rank", (F.col("place") + F.col("before")).cast("long")).drop("of_arc", "of_part")
    plan = F.broadcast(plan.withColumnRenamed("arc", "of"))  # at most 2 * shards * vnodes + shards rows
    return ranked.join(plan, (F.col("arc") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows" if slack <= 0 else "bounded").alias("law"),
        "shard",
        (F.col("base") + F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
