"""Best-fit packing into bins of several permitted sequence lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, written

#: Permitted sequence lengths, and the cost of a sequence beside its length.
LENGTHS, OVERHEAD = (512, 1024, 2048, 4096, 8192), 64
#: Pieces that one task packs together.
SHARD_PIECES = 40_000


def open_size(n: int, waiting: np.ndarray, placed: int, lengths: tuple[int, ...], overhead: int) -> int:
    """The bin size of least cost per token for a first piece of n tokens, the longest that isn't placed yet.

    waiting[r]: total length of all pieces of at most r tokens; placed: that of the placed pieces of n tokens, this one
    included. What is left of a bin can be filled by waiting pieces of at most that length alone.
    """
    costs = []
    for size in lengths:
        if size >= n:
            room = size - n
            fill = int(waiting[min(room, n)]) - (placed if room >= n else 0)
            costs.append(((size + overhead) / (n + min(room, fill)), size))
    return min(costs)[1]


def pack_pieces(pieces: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (given longest first), and the final size of each bin.

    Best fit: a piece goes to the open bin with the least room that takes it. Where none does, the size of least cost is
    opened. In the end every bin gets the least permitted size that holds its contents.
    """
    waiting = np.cumsum(np.bincount(pieces, weights=pieces, minlength=lengths[-1] + 1))
    bins, offsets, held, rooms, by_room = [], [], [], [], {}
    last, placed = None, 0
    for n in pieces:
        placed = placed + n if n == last else n
        last = n
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            k = by_room[room].pop()
            if not by_room[room]:
                del rooms[at], by_room[room]
        else:
            k, room = len(held), open_size(n, waiting, placed, lengths, overhead)
            held.append(0)
        bins.append(k)
        offsets.append(held[k])
        held[k] += n
        if rest := room - n:
            if rest not in by_room:
                insort(rooms, rest)
                by_room[rest] = []
            by_room[rest].append(k)
    return bins, offsets, [lengths[bisect_left(lengths, h)] for h in held]


def pack(
    docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, shard_pieces: int = SHARD_PIECES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Packs every text whole into sequences; a row for each piece.

    A text's tokens are its runs of non-blank characters and one for its end. Texts longer than the largest permitted length
    are split into full pieces and a rest. Pieces are dealt evenly to shards of about shard_pieces rows, which are packed
    independently: only (id, piece, length) move, a shard is bounded, and its waste is that of its last bins.

    Result: id, row (a number of the input row, as repeated ids are rows of their own), piece (from 0), piece_start (tokens
    of the text before it), n_tokens, shard, bin (unique within the shard), bin_size, bin_offset. Null and empty texts have
    one token (the end). An empty table gives an empty result. Other columns are not carried. Rows are numbered by the task
    that reads them, so shards and bins also depend on how the table is split; what they hold in sum doesn't.
    """
    lengths = tuple(sorted(lengths))
    most, kind = lengths[-1], docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), (n_words(F.col(text_col)) + 1).cast("long").alias("n"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most).cast("int")))
    pieces = rows.withColumn("piece", piece).withColumn("piece_start", (F.col("piece") * most).cast("long"))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece_start"))).drop("n")
    pieces = written(pieces, "pack-pieces")  # row numbers stay as they are from here
    shards = max(1, -(-pieces.count() // shard_pieces))

    def of_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "row", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, sizes = pack_pieces(pdf["n_tokens"].tolist(), lengths, overhead)
        return pdf.assign(bin=np.array(bins, np.int64), bin_size=np.array(sizes, np.int64)[bins], bin_offset=np.array(offsets, np.int64))

    # ids travel as text: pandas would turn nullable numbers into floats
    dealt = pieces.withColumn("id", F.col("id").cast("string")).withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int"))
    schema = "id string, row long, piece int, piece_start long, n_tokens long, shard int, bin long, bin_size long, bin_offset long"
    packed = dealt.select("id", "row", "piece", "piece_start", "n_tokens", "shard").groupBy("shard").applyInPandas(of_shard, schema)
    return packed.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
