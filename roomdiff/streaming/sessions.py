"""Zoom sessions, the action log and standing alerts over streams; each works the same on a batch."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roomdiff.functions.scalar import fixed
from roomdiff.operators.actions import DOLLY_SETTLE_MS, MOTION_EPS_M, dolly_sessions, number


ZOOM = "session string, started_us bigint, ended_us bigint, d0 double, d1 double, ticks bigint"


def _zooms(key, frames, held: GroupState):
    """Zooms of one session that are over. Kept are the open zoom and the gestures the watermark has not passed, since earlier ones may
    still come between them."""
    zoom, waiting = json.loads(held.get[0]) if held.exists else (None, [])
    for pdf in frames:
        waiting += [list(r) for r in zip(pdf["us"].tolist(), pdf["verb"].tolist(), pdf["d0"].tolist(), pdf["d1"].tolist())]
    waiting.sort(key=lambda r: r[0])
    passed_ms, out = held.getCurrentWatermarkMs(), []
    while waiting and waiting[0][0] <= passed_ms * 1000:
        us, verb, d0, d1 = waiting.pop(0)
        if zoom and verb == "dolly" and us - zoom[1] < DOLLY_SETTLE_MS * 1000:
            zoom[1], zoom[3], zoom[4] = us, d1, zoom[4] + 1
            continue
        if zoom:
            out.append([key[0], *zoom])
        zoom = [us, us, d0, d1, 1] if verb == "dolly" else None
    if zoom and zoom[1] + DOLLY_SETTLE_MS * 1000 <= passed_ms * 1000:
        out.append([key[0], *zoom])
        zoom = None
    if zoom or waiting:
        held.update((json.dumps([zoom, waiting]),))
        wake = min(([waiting[0][0] // 1000 + 1] if waiting else []) + ([zoom[1] // 1000 + DOLLY_SETTLE_MS] if zoom else []))
        held.setTimeoutTimestamp(max(wake, passed_ms + 1))
    else:
        held.remove()
    yield pd.DataFrame(out, columns=["session", "started_us", "ended_us", "d0", "d1", "ticks"])


def zoom_sessions(moves: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Wheel ticks of ``moves(session, ts, verb, d0, d1)`` less than 800 ms apart as one zoom, which any other gesture ends too. On a stream
    a zoom is emitted once the watermark has passed it, and gestures later than ``late`` are dropped."""
    if not moves.isStreaming:
        return dolly_sessions(moves)
    rows = moves.withWatermark("ts", late).select("session", "ts", F.unix_micros("ts").alias("us"), "verb", "d0", "d1")
    zooms = rows.groupBy("session").applyInPandasWithState(_zooms, ZOOM, "held string", "append", GroupStateTimeout.EventTimeTimeout)
    text = F.concat(fixed(F.col("d0"), 2), F.lit(" → "), fixed(F.col("d1"), 2), F.lit(" m"))
    return zooms.filter(F.abs(F.col("d1") - F.col("d0")) >= MOTION_EPS_M).select(
        "session", F.timestamp_micros("started_us").alias("started"), F.timestamp_micros("ended_us").alias("ts"), "d0", "d1", "ticks", text.alias("detail"))


class ActionLog:
    """The action log as a stream's sink: ``rows`` with a partition for each batch, and ``heads``, the last id of each session that a batch touched.

    A batch is numbered on from the heads of the batches before it and overwrites its own partitions, so a batch that runs again after a
    failure, half written or whole, leaves what it would have left the first time. Each batch writes in the order of its own rows.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str = "session string, ts timestamp, verb string, detail string, snap string"):
        self.spark, self.rows, self.heads, self.schema = spark, f"{folder}/rows", f"{folder}/heads", schema

    def start(self, fresh: DataFrame, checkpoint: str, **trigger):
        """Takes up the stream ``fresh(session, ts, verb, detail, snap)``."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        return fresh.select(*names).writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.take).trigger(**(trigger or {"availableNow": True})).start()

    def take(self, batch: DataFrame, n: int) -> None:
        """Appends the rows of batch ``n``."""
        own = lambda df, path: (df.withColumn("batch", F.lit(n).cast("long")).write.partitionBy("batch").mode("overwrite")
                                .option("partitionOverwriteMode", "dynamic").parquet(path))
        spark = batch.sparkSession
        if n == 0:
            own(spark.createDataFrame([], "session string, top long"), self.heads)        # so that there is a folder to read
        heads = spark.read.schema("session string, top long, batch long").parquet(self.heads).filter(F.col("batch") < n)
        own(number(batch, heads.groupBy("session").agg(F.max("top").alias("top"))), self.rows)
        mine = spark.read.schema("session string, id long, batch long").parquet(self.rows).filter(F.col("batch") == n)
        own(mine.groupBy("session").agg(F.max("id").alias("top")), self.heads)

    def read(self) -> DataFrame:
        """(session, id, ts, verb, detail, snap) of all batches."""
        rows = self.spark.read.schema(f"{self.schema}, id long, batch long").parquet(self.rows)
        return rows.select("session", "id", *[c for c in rows.columns if c not in ("session", "id", "batch")])


ALERT = "set_id string, root bigint, state int, before string, now string"


def _changes(key, frames, held: GroupState):
    last_state, last = held.get if held.exists else (-1, None)
    out = []
    for pdf in frames:
        for state, k in sorted(zip(pdf["state"].tolist(), pdf["k"].tolist())):
            if state <= last_state:
                continue                                       # a state at or before the last one seen is late
            if last is not None and k != last:
                out.append((key[0], int(key[1]), int(state), last, k))
            last_state, last = int(state), k
    held.update((last_state, last))
    yield pd.DataFrame(out, columns=["set_id", "root", "state", "before", "now"])


def standing_alerts(standings: DataFrame) -> DataFrame:
    """``standings(set_id, root, state, k)``: a row whenever a thing's standing differs from the one at the state before it. One value is
    kept per thing; a group is a thing's new states, never its history."""
    rows = standings.select("set_id", "root", "state", "k")
    if rows.isStreaming:
        return rows.groupBy("set_id", "root").applyInPandasWithState(_changes, ALERT, "state int, k string", "append", GroupStateTimeout.NoTimeout)
    before = F.lag("k").over(Window.partitionBy("set_id", "root").orderBy("state"))
    return rows.withColumn("before", before).filter("before <> k").select("set_id", "root", "state", "before", F.col("k").alias("now"))
