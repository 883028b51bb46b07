"""The action log: gestures, amendments, zoom sessions, restores.

``actions(session, id, ts, verb, detail, snap)`` only ever grows; ``snap`` describes the scene after the action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomdiff.functions.scalar import fixed, padded_id
from roomdiff.functions.stage import written

CLICK_MS = 250           # a press shorter than this is a click …
CLICK_SLOP_M = 0.05      # … unless it moved this far
MOTION_EPS_M = 0.01      # below this nothing moved
DOLLY_SETTLE_MS = 800    # wheel ticks closer than this are one zoom
ID_CHUNK = 1 << 16       # ids one task compares at a time


def append(log: DataFrame, fresh: DataFrame) -> DataFrame:
    """``fresh(session, ts, verb, detail, snap)`` numbered on from each session's last id, in the order of time, verb and detail."""
    return number(fresh, log.groupBy("session").agg(F.max("id").alias("top"))).select(*log.columns)


def number(fresh: DataFrame, tops: DataFrame) -> DataFrame:
    """``fresh`` with ``id``, counted on from ``tops(session, top)`` or from 1. Rows are sorted inside the hours of a session, and its hours are strung together by
    their counts, so a session with most of the rows is not sorted in one task. Rows without a time come first."""
    hour = F.coalesce(F.date_trunc("hour", "ts"), F.to_timestamp(F.lit("0001-01-01 00:00:00"))).alias("_hour")
    rows = fresh.select("*", hour)
    held = rows.groupBy(F.col("session").alias("_session"), F.col("_hour").alias("_of")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_session").orderBy("_of").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    held = held.withColumn("_before", before)
    tops = tops.select(F.col("session").alias("_whose"), F.col("top").alias("_top"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("session", "_hour").orderBy("ts", "verb", "detail")))
    rows = rows.join(held, rows["session"].eqNullSafe(held["_session"]) & (rows["_hour"] == held["_of"])).join(tops, rows["session"].eqNullSafe(tops["_whose"]), "left")
    return rows.select(*[F.col(c) for c in fresh.columns], (F.coalesce("_top", F.lit(0)) + F.col("_before") + F.col("_nth")).cast("long").alias("id"))


def runs(df: DataFrame, keys: list[str], order: str, chunk: Column, value: str, joined: Column | None = None) -> DataFrame:
    """Adds ``run``: a number shared by consecutive rows (in ``order``) with the same ``value``. ``joined`` says more about when a row
    with its predecessor's value belongs to it, through the columns ``prev`` (the predecessor's order) and its own.

    Rows are compared inside chunks of the order, then the chunks of a key are strung together from one summary row each, so
    a key with most of the rows is not sorted in one task.
    """
    joined = F.lit(True) if joined is None else joined
    rows = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    same = F.col(value).eqNullSafe(F.col("_before")) & F.coalesce(joined, F.lit(False))
    rows = rows.withColumn("prev", F.lag(order).over(w)).withColumn("_before", F.lag(value).over(w))
    rows = rows.withColumn("_fresh", F.when(F.col("prev").isNotNull() & ~same, 1).otherwise(0)).drop("_before", "prev")
    rows = rows.withColumn("_in", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(*keys, "_chunk").agg(F.min_by(F.struct(order, value), order).alias("a"), F.max_by(F.struct(order, value), order).alias("z"), F.max("_in").alias("m"))
    c = Window.partitionBy(*keys).orderBy("_chunk")
    ends = ends.select(*keys, "_chunk", "m", F.col(f"a.{order}").alias(order), F.col(f"a.{value}").alias(value),
                       F.lag(F.col(f"z.{order}")).over(c).alias("prev"), F.lag(F.col(f"z.{value}")).over(c).alias("_before"))
    ends = ends.withColumn("_step", F.when(F.col("prev").isNotNull() & same, 0).otherwise(1))
    base = (F.sum(F.col("m") + F.col("_step")).over(c.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m"))
    ends = ends.select(*keys, "_chunk", base.alias("_base"))
    return rows.join(ends, [*keys, "_chunk"]).withColumn("run", F.col("_base") + F.col("_in")).drop("_chunk", "_in", "_base", "_fresh")


def amend(log: DataFrame) -> DataFrame:
    """Runs of the same verb folded into one row: the first id, the last time, detail and snapshot, and how many it took."""
    numbered = runs(log, ["session"], "id", F.floor(F.col("id") / ID_CHUNK), "verb")
    rest = [c for c in log.columns if c not in ("session", "id", "verb")]
    last = F.max_by(F.struct(*rest), "id").alias("last")
    return numbered.groupBy("session", "run").agg(F.min("id").alias("id"), F.first("verb").alias("verb"), F.count("*").alias("folded"),
                                              F.min("ts").alias("started"), last).select("session", "id", "verb", "folded", "started", "last.*")


def _away(a: Column, b: Column) -> list[Column]:
    return [a[i] - b[i] for i in range(3)]


def _norm(v: list[Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def classify(gestures: DataFrame) -> DataFrame:
    """``gestures(session, t0, t1, pos0, target0, pos1, target1)`` -> pan, dolly or orbit by the largest motion in metres (ties in
    that order). Clicks and gestures that moved nothing are dropped."""
    arm0, arm1 = _away(F.col("pos0"), F.col("target0")), _away(F.col("pos1"), F.col("target1"))
    d0, d1 = _norm(arm0), _norm(arm1)
    dot = arm0[0] * arm1[0] + arm0[1] * arm1[1] + arm0[2] * arm1[2]
    size = d0 * d1
    cosine = F.when(size > 0, F.least(F.greatest(dot / size, F.lit(-1.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    rows = gestures.select("*", d0.alias("d0"), d1.alias("d1"), F.acos(cosine).alias("angle")).select(
        "*", _norm(_away(F.col("target1"), F.col("target0"))).alias("pan_m"), F.abs(F.col("d1") - F.col("d0")).alias("dolly_m"),
        (F.col("angle") * F.col("d0")).alias("orbit_m"))
    rows = rows.withColumn("most", F.greatest("pan_m", "dolly_m", "orbit_m"))
    held_ms = (F.unix_micros("t1") - F.unix_micros("t0")) / 1000.0
    floor = F.when(held_ms < CLICK_MS, CLICK_SLOP_M).otherwise(MOTION_EPS_M)
    most = F.col("most")
    verb = F.when(most == F.col("pan_m"), "pan").when(most == F.col("dolly_m"), "dolly").otherwise("orbit")
    spot = lambda at: F.concat_ws(" ", *[fixed(F.col(at)[i], 2) for i in range(3)])
    detail = (F.when(verb == "pan", F.concat(F.lit("→ "), spot("target1")))
              .when(verb == "orbit", F.concat(fixed(F.degrees("angle"), 0), F.lit("°  "), spot("pos1"))))
    return rows.filter(most >= floor).select("session", F.col("t1").alias("ts"), verb.alias("verb"), "most", "d0", "d1", detail.alias("detail"))


def _zoom_text() -> Column:
    return F.concat(fixed(F.col("d0"), 2), F.lit(" → "), fixed(F.col("d1"), 2), F.lit(" m"))


def dolly_sessions(moves: DataFrame) -> DataFrame:
    """Zooms of ``moves(session, ts, verb, d0, d1, …)``: wheel ticks less than 800 ms apart are one; any other gesture ends a zoom; one
    whose net motion is under a centimetre is dropped."""
    gap_ms = (F.unix_micros("ts") - F.unix_micros("prev")) / 1000.0
    numbered = runs(moves, ["session"], "ts", F.date_trunc("hour", "ts"), "verb", (F.col("verb") == "dolly") & (gap_ms < DOLLY_SETTLE_MS))
    zooms = numbered.filter("verb = 'dolly'").groupBy("session", "run").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ts"), F.min_by("d0", "ts").alias("d0"), F.max_by("d1", "ts").alias("d1"), F.count("*").alias("ticks"))
    return zooms.filter(F.abs(F.col("d1") - F.col("d0")) >= MOTION_EPS_M).select(
        "session", "started", "ts", "d0", "d1", "ticks", _zoom_text().alias("detail"))


def camera_log(moves: DataFrame) -> DataFrame:
    """The log a stretch of gestures leaves: pans and orbits one row each, zooms of consecutive sessions folded into one row that
    runs from the first start to the last end."""
    moves = written(moves, "moves")
    zooms = dolly_sessions(moves).select("session", "started", "ts", F.lit("dolly").alias("verb"), "d0", "d1", "detail")
    plain = moves.filter("verb <> 'dolly'").select("session", F.col("ts").alias("started"), "ts", "verb", "d0", "d1", "detail")
    rows = written(zooms.unionByName(plain), "camera")
    numbered = runs(rows, ["session"], "ts", F.date_trunc("hour", "ts"), "verb", F.col("verb") == "dolly")
    out = numbered.groupBy("session", "run").agg(F.min("started").alias("started"), F.max("ts").alias("ts"), F.first("verb").alias("verb"),
                                             F.min_by("d0", "ts").alias("d0"), F.max_by("d1", "ts").alias("d1"), F.max_by("detail", "ts").alias("detail"))
    return out.select("session", "started", "ts", "verb", F.when(F.col("verb") == "dolly", _zoom_text()).otherwise(F.col("detail")).alias("detail"))


def restore(log: DataFrame, asked: DataFrame, branches: DataFrame) -> DataFrame:
    """Rows to append for ``asked(session, id, set_id, ts)``: the named row's snapshot again. The last row of a session is left alone, and a
    draft whose branch is gone reopens unsaved. ``snap`` holds draft STRUCT<id, …>."""
    last = log.groupBy("session").agg(F.max("id").alias("last"))
    named = asked.join(log.select("session", "id", "verb", "snap"), ["session", "id"]).join(last, "session").filter(F.col("id") < F.col("last"))
    alive = branches.select("set_id", F.col("id").alias("branch"), F.lit(True).alias("alive"))
    rows = named.withColumn("branch", F.col("snap.draft.id")).join(alive, ["set_id", "branch"], "left")
    draft = F.when(F.col("snap.draft").isNotNull(), F.col("snap.draft").withField("id", F.when(F.col("alive"), F.col("branch"))))
    return rows.select("session", (F.col("last") + 1).alias("id"), "ts", F.lit("restore").alias("verb"),
                       F.concat(F.lit("#"), padded_id(F.col("id")), F.lit(" "), F.col("verb")).alias("detail"),
                       F.col("snap").withField("draft", draft).alias("snap"))


def state_as_of(log: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(session, at)``: the snapshot in force at a time, by the last action not after it."""
    ticks = log.select("session", "ts", F.lit(0).alias("kind"), F.struct("ts", "id", "snap").alias("row")).unionByName(
        asked.select("session", F.col("at").alias("ts"), F.lit(1).alias("kind"), F.lit(None).alias("row")), allowMissingColumns=True)
    w = Window.partitionBy("session").orderBy("ts", "kind", "row.id").rowsBetween(Window.unboundedPreceding, 0)
    return ticks.withColumn("seen", F.last("row", ignorenulls=True).over(w)).filter("kind = 1").select(
        "session", F.col("ts").alias("at"), F.col("seen.id").alias("id"), F.col("seen.snap").alias("snap"))
