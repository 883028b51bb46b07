"""Acceptance of a run against known truth: where frames landed, whether objects were found, whether boxes make sense."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomdiff.functions import geometry as g

MAX_CORNER_MM = 15.0
FLOOR_BAND_M = 0.15
MIN_COVERED = 0.75
SIZE_TOLERANCE, ROOM_TOLERANCE = 0.05, 0.06


def room_corners(rooms: DataFrame) -> DataFrame:
    """``rooms(set_id, wide, deep, high)`` -> the eight corners (set_id, corner, x, y, z), z up, centred on the floor."""
    side = lambda c, s: F.col(c) * (s / 2)
    corners = F.array(*[F.struct(F.lit(n).alias("corner"), side("wide", sx).alias("x"), side("deep", sy).alias("y"), (F.col("high") * sz).alias("z"))
                        for n, (sx, sy, sz) in enumerate((sx, sy, sz) for sx in (-1, 1) for sy in (-1, 1) for sz in (0, 1))])
    return rooms.select("set_id", F.inline(corners))


def corner_errors(corners: DataFrame, truth: DataFrame, transforms: DataFrame) -> DataFrame:
    """(set_id, state, error_mm, ok): how far, on average, the registered corners of each capture lie from the first one's.
    ``truth(set_id, state, m)`` takes room metres into each capture's raw frame."""
    first = truth.filter("state = 0").select("set_id", F.col("m").alias("m0"))
    rows = (corners.join(truth.filter("state > 0").select("set_id", "state", F.col("m").alias("mt")), "set_id").join(first, "set_id")
            .join(transforms.select("set_id", "state", "m"), ["set_id", "state"]))
    want = g.place(F.col("m0"), F.col("x"), F.col("y"), F.col("z"))
    got = g.place(F.col("m"), *g.place(F.col("mt"), F.col("x"), F.col("y"), F.col("z")))
    gap = F.sqrt(sum(((a - b) ** 2 for a, b in zip(want, got)), F.lit(0.0))) / g.uniform_scale(F.col("m0")) * 1000
    out = rows.withColumn("gap", gap).groupBy("set_id", "state").agg(F.avg("gap").alias("error_mm"))
    return out.withColumn("ok", F.col("error_mm") < MAX_CORNER_MM)


def world_frame(corners: DataFrame, truth: DataFrame, rooms: DataFrame, published: DataFrame) -> DataFrame:
    """(set_id, floor_off, ceiling_off, room_off, ok): whether the published world is metric, y up, with its floor at zero, and the room
    box the size of the room. ``published(set_id, world_from_ref, room)``."""
    first = truth.filter("state = 0").select("set_id", F.col("m").alias("m0"))
    rows = corners.join(first, "set_id").join(published, "set_id").join(rooms, "set_id")
    y = g.place(F.col("world_from_ref"), *g.place(F.col("m0"), F.col("x"), F.col("y"), F.col("z")))[1]
    off = rows.withColumn("y", y).groupBy("set_id").agg(
        F.max(F.when(F.col("z") == 0, F.abs("y"))).alias("floor_off"), F.max(F.when(F.col("z") > 0, F.abs(F.col("y") - F.col("high")))).alias("ceiling_off"))
    size = lambda n: g.size_along(F.col("room"), n)
    have = F.array_sort(F.array(*[size(n) for n in range(3)]))
    want = F.array_sort(F.array("wide", "deep", "high"))
    worst = F.array_max(F.zip_with(have, want, lambda a, b: F.abs(a - b) / b))
    out = off.join(published.join(rooms, "set_id").select("set_id", "high", worst.alias("room_off")), "set_id")
    ok = (F.col("floor_off") < SIZE_TOLERANCE * F.col("high")) & (F.col("ceiling_off") < SIZE_TOLERANCE * F.col("high")) & (F.col("room_off") < ROOM_TOLERANCE)
    return out.select("set_id", "floor_off", "ceiling_off", "room_off", ok.alias("ok"))


def coverage(parts: DataFrame, objects: DataFrame, cell_m: float = 1.0) -> DataFrame:
    """(set_id, object, state, share, ok): the share of a true object's points in parts whose centre lies in a box present in that state.
    ``parts(set_id, object, state, part, x, y, z, points, top)`` in world metres; parts flat on the floor do not count. Boxes are met
    by floor tile, not one by one."""
    counted = parts.filter(F.col("top") >= FLOOR_BAND_M)
    lo, hi = F.col("bbox.lo"), F.col("bbox.hi")
    tile = lambda c: F.floor(c / cell_m)
    boxes = objects.select("set_id", "bbox", F.explode("present").alias("state")).withColumn("tx", F.explode(F.sequence(tile(lo[0]), tile(hi[0])))).withColumn("tz", F.explode(F.sequence(tile(lo[2]), tile(hi[2]))))
    met = counted.withColumn("tx", tile(F.col("x"))).withColumn("tz", tile(F.col("z"))).join(boxes, ["set_id", "state", "tx", "tz"])
    inside = F.col("x").between(lo[0], hi[0]) & F.col("y").between(lo[1], hi[1]) & F.col("z").between(lo[2], hi[2])
    hit = met.filter(inside).select("set_id", "object", "state", "part").distinct().withColumn("hit", F.lit(True))
    rows = counted.join(hit, ["set_id", "object", "state", "part"], "left")
    out = rows.groupBy("set_id", "object", "state").agg((F.sum(F.when(F.col("hit"), F.col("points")).otherwise(0)) / F.sum("points")).alias("share"))
    return out.withColumn("ok", F.col("share") >= MIN_COVERED)


def boxes_outside(objects: DataFrame, rooms: DataFrame) -> DataFrame:
    """Objects wholly below the floor or above the ceiling. ``rooms(set_id, high)``."""
    return objects.join(rooms.select("set_id", "high"), "set_id").filter((F.col("bbox.hi")[1] <= 0) | (F.col("bbox.lo")[1] >= F.col("high"))).select("set_id", "id", "bbox")
