"""The world frame of a single capture: which way is up, level, floor, walls square to the axes, centre."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomdiff.functions import geometry as g
from roomdiff.functions import scalar as s
from roomdiff.functions.stage import written
from roomdiff.operators import stats

SOLID = 0.35
FLOOR_BIN_M, WALL_BIN_M = 0.01, 0.03
TALL_M, SHORT_M, ENOUGH = (1.25, 1.9), 0.3, 500
ROOM_PAD_M, CEILING_MIN_M = 0.25, 2.6
COARSE = 1 << 14            # bins that a turn of the walls is first counted in
# Fixed rotations taking each raw axis onto +y.
UP = {"+y": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "-y": [[1, 0, 0], [0, -1, 0], [0, 0, -1]], "+z": [[1, 0, 0], [0, 0, 1], [0, -1, 0]],
      "-z": [[1, 0, 0], [0, 0, -1], [0, 1, 0]], "+x": [[0, 1, 0], [1, 0, 0], [0, 0, -1]], "-x": [[0, -1, 0], [-1, 0, 0], [0, 0, -1]]}
K = ["set_id"]


def _padded(rows):
    return g.matrix([[*r, 0.0] for r in rows] + [[0.0, 0.0, 0.0, 1.0]])


def solid_cropped(splats: DataFrame) -> DataFrame:
    return stats.crop(splats.filter(F.col("opacity") > SOLID).select("set_id", "x", "y", "z"), K, ["x", "y", "z"], 0.02, 0.98, 0.2)


def histogram(long: DataFrame, keys: list[str], bins) -> DataFrame:
    """(keys, bin, n, lo, hi, bins) of ``long(keys, value)``: equal bins over each key's range; ``bins(lo, hi)`` gives their number."""
    span = long.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    span = written(span.withColumn("bins", bins(F.col("lo"), F.col("hi"))), "span")
    at = s.equal_bin(F.col("value"), F.col("lo"), F.col("hi"), F.col("bins"))
    return long.join(span, keys).groupBy(*keys, at.alias("bin"), "lo", "hi", "bins").agg(F.count("*").alias("n"))


def find_up(points: DataFrame) -> DataFrame:
    """(set_id, up, share): the axis with the sharpest peak among 80 bins; a peak in the lower half means up is its positive end."""
    long = points.select("set_id", F.explode(F.create_map(*[x for n, c in enumerate("xyz") for x in (F.lit(n), F.col(c))])).alias("axis", "value"))
    top = stats.top_bin(histogram(long, ["set_id", "axis"], lambda lo, hi: F.lit(80)), ["set_id", "axis"], "n", [F.asc("bin")])
    best = stats.top_bin(top, K, "n", [F.asc("axis")])
    total = points.groupBy("set_id").agg(F.count("*").alias("total"))
    name = F.concat(F.when(F.col("bin") < 40, "+").otherwise("-"), F.substring(F.lit("xyz"), F.col("axis") + 1, F.lit(1)))
    return best.join(total, "set_id").select("set_id", name.alias("up"), (F.col("n") / F.col("total")).alias("share"))


def find_floor(points: DataFrame) -> DataFrame:
    """(set_id, floor): the middle of the densest centimetre of height, the lowest on ties."""
    bins = lambda lo, hi: F.greatest(F.lit(1), F.ceil((hi - lo) / FLOOR_BIN_M).cast("int"))
    top = stats.top_bin(histogram(points.select("set_id", F.col("y").alias("value")), K, bins), K, "n", [F.asc("bin")])
    return top.select("set_id", (F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / F.col("bins")).alias("floor"))


def level(points: DataFrame, floors: DataFrame, band: float = 0.04) -> DataFrame:
    """(set_id, m, tilt_deg): the rotation that takes the least-squares floor plane's normal onto +y."""
    f = points.join(floors, "set_id").filter(F.abs(F.col("y") - F.col("floor")) < band)
    c = f.groupBy("set_id").agg(F.var_pop("x").alias("xx"), F.var_pop("z").alias("zz"), F.covar_pop("x", "z").alias("xz"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("z", "y").alias("zy"))
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    a = F.when(det > 0, (F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz")) / det).otherwise(0.0)
    b = F.when(det > 0, (F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz")) / det).otherwise(0.0)
    n = c.select("set_id", a.alias("a"), b.alias("b")).withColumn("len", F.sqrt(F.col("a") ** 2 + 1 + F.col("b") ** 2))
    n = n.select("set_id", (-F.col("a") / F.col("len")).alias("nx"), (1 / F.col("len")).alias("ny"), (-F.col("b") / F.col("len")).alias("nz"))
    nx, ny, nz = F.col("nx"), F.col("ny"), F.col("nz")
    w = 1 / (1 + ny)                                             # turning n onto +y about their cross product; ny is positive
    rows = [[1 - nx * nx * w, -nx, -nx * nz * w], [nx, ny, nz], [-nx * nz * w, -nz, 1 - nz * nz * w]]
    return n.select("set_id", _padded(rows).alias("m"), F.degrees(F.acos(s.clip(ny, F.lit(-1.0), F.lit(1.0)))).alias("tilt_deg"))


def _placed(table: pa.Table, spans: list, turns: np.ndarray, most: int):
    """For each turn, the bin of every point across z and the width of a coarse bin in bins; ``spans``: each turn's extent."""
    x, z = (table.column(c).to_numpy() for c in ("x", "z"))
    for turn, span in enumerate(spans):
        bins = int(max(1, np.floor((span["hi"] - span["lo"]) / WALL_BIN_M)))
        wide = span["hi"] - span["lo"] if span["hi"] > span["lo"] else 1.0
        place = np.floor((np.sin(turns[turn]) * x + np.cos(turns[turn]) * z - span["lo"]) / wide * bins).astype(np.int64)
        yield turn, np.clip(place, 0, bins - 1), -(-bins // most)


def _per_turn(name: str | None, parts: list) -> pa.Table:
    """(set_id, turn, bin, n) of (turn, bins, counts)."""
    columns = [[np.full(len(bins), turn) for turn, bins, _ in parts], *[[p[k] for p in parts] for k in (1, 2)]]
    columns = [pa.array(np.concatenate([np.empty(0, np.int64), *c]), k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64()))]
    return pa.Table.from_arrays([pa.repeat(pa.scalar(name, pa.string()), len(columns[0])), *columns], names=["set_id", "turn", "bin", "n"])


def find_yaw(points: DataFrame, step: float = 0.25, chunk: int = 1 << 20, most: int = COARSE) -> DataFrame:
    """(set_id, yaw_deg): the turn in 0..90° that stacks the tall points into the thinnest slab across z, the smallest on ties.

    A task turns the points of an Arrow batch, or of ``chunk`` points of a set, through all angles: the first pass sends each angle's
    extent, the second its histogram, and these are merged by set and angle. No point becomes a row for each angle. A histogram has at most
    ``most`` bins, whatever a room's width. Where the true bins are finer, coarse ones bound them from above: the angle with the fullest is
    counted finely, and after it only those coarse bins that hold as many points as the best bin so far."""
    y = F.col("y")
    n_tall = points.groupBy("set_id").agg(F.count_if((y > TALL_M[0]) & (y < TALL_M[1])).alias("n_tall"))
    tall = points.join(n_tall, "set_id").filter(F.when(F.col("n_tall") >= ENOUGH, (y > TALL_M[0]) & (y < TALL_M[1])).otherwise(y > SHORT_M))
    tall = written(tall.select("set_id", F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z")), "tall")
    turns = np.radians(np.arange(round(90 / step)) * step)

    def extents(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for key in pc.unique(table.column("set_id")):
                part = table.filter(pc.equal(table.column("set_id"), key))
                x, z = (part.column(c).to_numpy() for c in ("x", "z"))
                swept = [(s.min(), s.max()) for s in (np.sin(t) * x + np.cos(t) * z for t in turns)]
                low, high = np.array(swept).T
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(turns), pa.string()), pa.array(np.arange(len(turns), dtype=np.int32)), pa.array(low), pa.array(high)],
                                                 names=["set_id", "turn", "lo", "hi"])

    span = tall.mapInArrow(extents, "set_id string, turn int, lo double, hi double").groupBy("set_id", "turn").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    span = written(span, "turns")
    spans = span.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("turn", "lo", "hi"))).alias("spans"))
    spans = written(spans.join(tall.groupBy("set_id").agg(F.count(F.lit(1)).alias("tall")), "set_id"), "span")

    def counted(sets: DataFrame, of: int, count) -> DataFrame:
        """(set_id, turn, bin, n) by ``count(points, row of sets)`` over parts of about ``of`` points."""
        sets = sets.withColumn("parts", F.expr(f"tall div {of} + 1"))
        dealt = tall.join(sets.select("set_id", "parts"), "set_id").withColumn("part", F.pmod(F.xxhash64("x", "z"), F.col("parts"))).drop("parts")
        each = sets.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts", "tall")
        got = dealt.groupBy("set_id", "part").cogroup(each.groupBy("set_id", "part")).applyInArrow(count, "set_id string, turn int, bin bigint, n bigint")
        return got.groupBy("set_id", "turn", "bin").agg(F.sum("n").alias("n"))

    def coarse(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _per_turn(None, [])
        parts = []
        for turn, place, width in _placed(left, right.column("spans")[0].as_py(), turns, most):
            n = np.bincount(place // width)
            parts.append((turn, np.flatnonzero(n), n[n > 0]))
        return _per_turn(right.column("set_id")[0].as_py(), parts)

    def fine(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _per_turn(None, [])
        turn_of, bin_of = np.divmod(pc.list_flatten(right.column("asked")).to_numpy(), most)
        parts = []
        for turn, place, width in _placed(left, right.column("spans")[0].as_py(), turns, most):
            wanted = np.zeros(most, bool)
            wanted[bin_of[turn_of == turn]] = True
            parts.append((turn, *np.unique(place[wanted[place // width]], return_counts=True)))
        return _per_turn(right.column("set_id")[0].as_py(), parts)

    def refined(asked: DataFrame) -> DataFrame:
        """(set_id, turn, n): the fullest bin of each turn in the coarse bins ``asked(set_id, turn, bin)``."""
        codes = asked.groupBy("set_id").agg(F.collect_list(F.col("turn").cast("bigint") * most + F.col("bin")).alias("asked"))
        return written(counted(spans.join(codes, "set_id"), max(1, chunk >> 4), fine).groupBy("set_id", "turn").agg(F.max("n").alias("n")), "fine")

    counts = written(counted(spans, chunk, coarse), "bins")
    is_fine = F.floor((F.col("hi") - F.col("lo")) / WALL_BIN_M) <= most
    top = written(counts.groupBy("set_id", "turn").agg(F.max("n").alias("n")).join(span.select("set_id", "turn", is_fine.alias("fine")), ["set_id", "turn"]), "top")
    exact, wide = top.filter("fine").drop("fine"), top.filter("not fine").drop("fine")
    if not wide.isEmpty():
        fullest = stats.top_bin(wide, K, "n", [F.asc("turn")]).select("set_id", "turn")
        exact = exact.unionByName(refined(counts.join(fullest, ["set_id", "turn"], "left_semi")))
        least = exact.groupBy("set_id").agg(F.max("n").alias("least"))
        left = counts.join(wide.select("set_id", "turn"), ["set_id", "turn"], "left_semi").join(fullest, ["set_id", "turn"], "left_anti")
        exact = exact.unionByName(refined(left.join(least, "set_id").filter(F.col("n") >= F.col("least"))))
    return stats.top_bin(exact, K, "n", [F.asc("turn")]).select("set_id", (F.col("turn") * step).alias("yaw_deg"))


def under(points: DataFrame, matrices: DataFrame) -> DataFrame:
    x, y, z = g.place(F.col("m"), F.col("x"), F.col("y"), F.col("z"))
    return points.join(matrices.select("set_id", "m"), "set_id").select("set_id", x.alias("x"), y.alias("y"), z.alias("z"))


def resolve_frame(splats: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """(set_id, world_from_raw, up, yaw_deg, centre, floor_raw, tilt_deg) for every set; ``pins(set_id, up, yaw_deg, centre)`` fixes what is
    not null in it. Between the passes only one small row per set is written."""
    sets = splats.select("set_id").distinct()
    if pins is None:
        pins = sets.select("set_id", F.lit(None).cast("string").alias("up"), F.lit(None).cast("double").alias("yaw_deg"), F.lit(None).cast("array<double>").alias("centre"))
    pin = pins.select("set_id", F.col("up").alias("p_up"), F.col("yaw_deg").alias("p_yaw"), F.col("centre").alias("p_centre"))
    p = written(solid_cropped(splats), "cropped")
    up = find_up(p).join(pin, "set_id", "left").select("set_id", F.coalesce("p_up", "up").alias("up"), "p_yaw", "p_centre")
    turned = F.element_at(F.create_map(*[x for name, rows in UP.items() for x in (F.lit(name), _padded(rows))]), F.col("up"))
    r1 = written(up.withColumn("m", turned), "up")
    p1 = under(p, r1)
    r2 = written(level(p1, written(find_floor(p1), "floor")), "level")
    m2 = written(r1.withColumnRenamed("m", "a").join(r2, "set_id").withColumn("m", g.multiply(F.col("m"), F.col("a"))).drop("a"), "m2")
    p2 = under(p, m2)
    floor = written(find_floor(p2), "floor")
    down = g.matrix([[1, 0, 0, 0], [0, 1, 0, -F.col("floor")], [0, 0, 1, 0], [0, 0, 0, 1]])
    m3 = written(m2.withColumnRenamed("m", "a").join(floor, "set_id").withColumn("m", g.multiply(down, F.col("a"))).drop("a"), "m3")
    yaw = find_yaw(under(p, m3))
    t = F.radians("yaw_deg")
    spin = g.matrix([[F.cos(t), 0, -F.sin(t), 0], [0, 1, 0, 0], [F.sin(t), 0, F.cos(t), 0], [0, 0, 0, 1]])
    m4 = m3.join(yaw, "set_id", "left").withColumn("yaw_deg", F.coalesce("p_yaw", "yaw_deg")).withColumnRenamed("m", "a").withColumn("m", g.multiply(spin, F.col("a"))).drop("a")
    m4 = written(m4, "m4")
    ends = stats.wide(stats.percentiles(under(p, m4), K, {"x": [0.02, 0.98], "z": [0.02, 0.98]}), K, {("x", 0.02): "x0", ("x", 0.98): "x1", ("z", 0.02): "z0", ("z", 0.98): "z1"})
    mid = F.array(F.bround((F.col("x0") + F.col("x1")) / 2, 3), F.bround((F.col("z0") + F.col("z1")) / 2, 3))
    out = m4.join(ends, "set_id").withColumn("centre", F.coalesce("p_centre", mid))
    shift = g.matrix([[1, 0, 0, -F.col("centre")[0]], [0, 1, 0, 0], [0, 0, 1, -F.col("centre")[1]], [0, 0, 0, 1]])
    return out.select("set_id", g.multiply(shift, F.col("m")).alias("world_from_raw"), "up", "yaw_deg", "centre", F.col("floor").alias("floor_raw"), "tilt_deg")


def auto_room(solid: DataFrame) -> DataFrame:
    """(set_id, room): walls a little outside the solid splats of a capture in its world frame, a ceiling to look down from."""
    q = {"x": [0.01, 0.99], "z": [0.01, 0.99], "y": [0.995]}
    e = stats.wide(stats.percentiles(solid, K, q), K, {("x", 0.01): "x0", ("x", 0.99): "x1", ("z", 0.01): "z0", ("z", 0.99): "z1", ("y", 0.995): "top"})
    r = lambda c: F.bround(c, 2)
    return e.select("set_id", g.box([r(F.col("x0") - ROOM_PAD_M), F.lit(0.0), r(F.col("z0") - ROOM_PAD_M)],
                                    [r(F.col("x1") + ROOM_PAD_M), r(F.greatest(F.lit(CEILING_MIN_M), F.col("top") + 0.5)), r(F.col("z1") + ROOM_PAD_M)]).alias("room"))
