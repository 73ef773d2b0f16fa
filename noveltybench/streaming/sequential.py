"""Sequential statistics on streams of (entity, event_time, score), state kept by entity.

Rows of a micro-batch are put in time order for each entity before they are
folded; rows later than the watermark are dropped by Spark.  Between
micro-batches rows are folded in order of arrival: a row that is late, but not
beyond the watermark, counts where it arrives.  An entity's state goes after
``idle`` of event time without a row, if that is given; it starts afresh then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from noveltybench.operators.stateful import Evidence, Gated, Quarantined


def windowed_sums(stream: DataFrame, width: str, delay: str) -> DataFrame:
    """(window start, entity, total, n): tumbling event-time windows behind a watermark."""
    held = stream.withWatermark("event_time", delay)
    return held.groupBy(F.window("event_time", width).alias("w"), "entity").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "entity", "total", "n")


def _until(state: GroupState, rows: pd.DataFrame, idle_ms: int | None) -> None:
    if idle_ms:
        latest = int(rows["event_time"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.EventTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout


def gated(stream: DataFrame, rule: Gated | Quarantined, delay: str = "1 day", idle_ms: int | None = None) -> DataFrame:
    """(entity, event_time, p, m, alarm) of the gated reference, or of a quarantined pool (see `noveltybench.operators.stateful`), step by step.

    A step's tie-breaking uniform comes from the entity and the number of steps before it.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = Evidence(*(tuple(v) if isinstance(v, (list, tuple)) else v for v in state.get)) if state.exists else Evidence()
        rows = pd.concat(list(batches)).sort_values(["event_time", "score"], kind="stable")
        steps = []
        for x in rows["score"]:
            u = int(hashlib.md5(f"{key[0]}:{kept.seen}".encode()).hexdigest()[:8], 16) / 2**32
            kept, step = rule(kept, float(x), u)
            steps.append(step)
        state.update((kept.seen, kept.m, list(kept.values), list(kept.usable), list(kept.pool), kept.closed_until, kept.ma, list(kept.anchor)))
        _until(state, rows, idle_ms)
        yield pd.concat([rows[["entity", "event_time"]].reset_index(drop=True), pd.DataFrame(steps)[["p", "m", "alarm"]]], axis=1)

    held = stream.withWatermark("event_time", delay)
    state = "seen int, m double, values array<double>, usable array<boolean>, pool array<double>, closed_until int, ma double, anchor array<double>"
    return held.groupBy("entity").applyInPandasWithState(fold, "entity long, event_time timestamp, p double, m double, alarm boolean", state, "append", _timeout(idle_ms))


def cusum(stream: DataFrame, drift: float, level: float, delay: str = "1 day", idle_ms: int | None = None) -> DataFrame:
    """(entity, event_time, path, alarm) of S = max(0, S + score - drift), restarted after each alarm at ``level``."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values(["event_time", "score"], kind="stable")
        path, alarm = [], []
        for x in rows["score"]:
            s = max(0.0, s + x - drift)
            path.append(s)
            alarm.append(s >= level)
            if alarm[-1]:
                s = 0.0
        state.update((s,))
        _until(state, rows, idle_ms)
        yield pd.DataFrame({"entity": rows["entity"], "event_time": rows["event_time"], "path": path, "alarm": alarm})

    held = stream.withWatermark("event_time", delay)
    return held.groupBy("entity").applyInPandasWithState(fold, "entity long, event_time timestamp, path double, alarm boolean", "s double", "append", _timeout(idle_ms))


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over all there is now into Parquet below ``path`` and reads the result."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
