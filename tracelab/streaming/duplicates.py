"""Extension: quality checks over a stream, with the tag of traces whose id was seen before."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import variants as V
from ..operators import quality

SEEN = "line long, value string, again boolean"


class Seen(StatefulProcessor):
    """One flag for each trace id, which expires. Rows stream through: of a batch's rows of an id only the one with the least
    line so far is held back."""

    def __init__(self, days: float):
        self.ttl = int(days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "seen boolean", ttlDurationMs=self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, first = self.before.exists(), None
        for part in rows:
            own = part[["line", "value"]]
            own = own if first is None else pd.concat([first, own])
            at = int(own["line"].to_numpy().argmin())
            first = own.iloc[[at]]
            later = own.drop(own.index[at]) if own.index.is_unique else own.reset_index(drop=True).drop(at)
            if len(later):
                yield later.assign(again=True)
        if first is not None:
            yield first.assign(again=known)
        # each row starts the time to live anew
        self.before.update((True,))

    def close(self) -> None:
        pass


def seen_before(lines: DataFrame, days: float = 7.0) -> DataFrame:
    """A stream of lines (line, value: a trace as JSON) with `again`: whether the trace's id was seen in an earlier row, which is one of an
    earlier batch, or of a smaller line in the same batch.

    An id is forgotten `days` after its last row, so the state holds the ids of that time, a flag each. It is kept in RocksDB
    and comes back after a restart from the checkpoint. Needs the RocksDB state store; the library must be importable on the
    driver's own Python workers as well. With the trigger availableNow, switch off spark.sql.streaming.noDataMicroBatches, since
    state that expires asks for such batches without end.
    """
    trace_id = F.coalesce(V.string(F.try_parse_json("value"), "$.trace_id"), F.lit("unknown"))
    keyed = lines.select("line", "value", trace_id.alias("trace_id"))
    return keyed.groupBy("trace_id").transformWithStateInPandas(Seen(days), SEEN, "Append", "ProcessingTime")


def check_stream(lines: DataFrame, days: float = 7.0) -> DataFrame:
    """quality.check() over a stream of lines (line, value): later rows of an id are tagged, not dropped. Lines that aren't
    JSON objects are left out."""
    rows = seen_before(lines, days).withColumn("trace", F.try_parse_json("value")).where(V.is_object(F.col("trace")))
    checked = quality.check_alone(rows.select("trace", F.struct("line", "again").alias("line")))
    own = checked.withColumns({"again": F.col("line.again"), "line": F.col("line.line")})
    return quality.tagged(own, F.col("again"))
