"""Captures of a room into the frame of its first one, for every set and state in one job.

A capture is put into a unit room frame by its largest plane and its walls. What is left open is the symmetry of a box: eight
starts, scored together. The best is refined with a shrinking capture radius. Loops are over iterations only; each iteration is
one pass over the clouds of all the captures still moving, and writes one matrix per capture. At every radius a point meets its nearest
of all target points (``clouds.nearest_within``); a task holds the targets of one cube and the points of a bounded number of captures.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomdiff.functions import geometry as g
from roomdiff.functions.stage import written
from roomdiff.operators import clouds as cl
from roomdiff.operators import stats
from roomdiff.sources.configs import RegisterParams

SOLID = 0.35
PLANE_FRAC = 0.004           # plane thickness and thinning, as a fraction of the cloud's diagonal
CANDIDATE_CELL = 0.008
CANDIDATE_RADIUS = 0.015
CANDIDATE_STEPS = 30
MAX_WALLS, PEELS, FEWEST_POINTS, WALL_HITS, WALL_TILT = 8, 12, 300, 80, 0.3
DISTINCT_POSE_DEG = 20.0
REFINE_CELL, REFINE_START, REFINE_FLOOR, REFINE_SHRINK, REFINE_STEPS, REFINE_STILL, REFINE_FEWEST = 0.0015, 0.04, 0.003, 0.7, 40, 1e-5, 500
INLIER_FRAC = 0.005
S = ["set_id", "state"]


def clouds_of(splats: DataFrame) -> DataFrame:
    """Solid splats of each capture, cropped to the room."""
    return stats.crop(splats.filter(F.col("opacity") > SOLID).select(*S, "x", "y", "z"), S, ["x", "y", "z"], 0.05, 0.95, 0.2)


def under(points: DataFrame, matrices: DataFrame, keys: list[str]) -> DataFrame:
    x, y, z = g.place(F.col("m"), F.col("x"), F.col("y"), F.col("z"))
    return points.join(matrices.select(*keys, "m"), keys).select(*points.columns[: -3], x.alias("x"), y.alias("y"), z.alias("z"))


def _upright(a, b, c):
    """The rotation taking the unit vector (a, b, c) onto +z."""
    w = 1 / (1 + c)
    turned = g.matrix([[1 - a * a * w, -a * b * w, -a, 0], [-a * b * w, 1 - b * b * w, -b, 0], [a, b, c, 0], [0, 0, 0, 1]])
    return F.when(c < -1 + 1e-12, g.matrix([[1, 0, 0, 0], [0, -1, 0, 0], [0, 0, -1, 0], [0, 0, 0, 1]])).otherwise(turned)


def _spin(t):
    return g.matrix([[F.cos(t), -F.sin(t), 0, 0], [F.sin(t), F.cos(t), 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])


def canonicalize(points: DataFrame) -> DataFrame:
    """(set_id, state, m, wall_planes): raw -> unit room frame. The largest plane is z = 0 with the room above it, the walls are square
    to x, +x is the denser half, the middle of the room is the origin and its longer side is 1."""
    ext = written(cl.extents(points, S).select(*S, (F.col("diagonal") * PLANE_FRAC).alias("thr")), "extent")
    thin = written(cl.downsample(points.join(ext, S), [*S, "thr"], F.col("thr")), "thin")
    planes = written(cl.patch_planes(thin, S, F.col("thr") * 10), "planes")
    members = written(cl.plane_members(thin, planes, S), "members")
    single = planes.select(*S, F.explode("planes").alias("p")).select(*S, "p.*")
    floor = written(cl.refit_planes(members, cl.best_planes(members, S).join(single, [*S, "id"]), S), "floor")
    # Peel planes off the rest, largest first; those that stand upright vote on the yaw.
    used = floor.select(*S, F.array("id").alias("used"))
    votes = None
    left = members
    for _ in range(PEELS):
        left = members.join(used, S).filter(~F.arrays_overlap("on", "used"))
        enough = left.groupBy(*S).agg(F.count("*").alias("n")).filter(F.col("n") >= FEWEST_POINTS)
        best = written(cl.best_planes(left, S).join(enough, S, "left_semi").join(single, [*S, "id"]), "peel")
        if best.isEmpty():
            break
        fitted = written(cl.refit_planes(left, best, S), "wall")
        votes = fitted if votes is None else votes.unionByName(fitted)
        used = written(used.join(best.select(*S, F.col("id").alias("_id")), S, "left").select(
            *S, F.when(F.col("_id").isNull(), F.col("used")).otherwise(F.array_append("used", F.col("_id"))).alias("used")), "used")
    # The normal points into the room: most of the other points lie on its side.
    off = members.join(floor, S).filter(~F.array_contains("on", F.col("id"))).groupBy(*S).agg(
        F.avg(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d")).alias("side"))
    sign = F.when(F.col("side") < 0, -1.0).otherwise(1.0)
    up = floor.join(off, S, "left").select(*S, *[(F.col(c) * sign).alias(c) for c in "abc"])
    r1 = written(up.select(*S, _upright(F.col("a"), F.col("b"), F.col("c")).alias("m")), "r1")
    flat = under(thin.select(*S, "x", "y", "z"), r1, S)
    if votes is not None:
        nx, ny, nz = g.turn(F.col("m"), F.col("a"), F.col("b"), F.col("c"))
        walls = votes.join(r1, S).select(*S, "hits", nx.alias("nx"), ny.alias("ny"), nz.alias("nz")).filter((F.abs("nz") < WALL_TILT) & (F.col("hits") > WALL_HITS))
        rank = F.row_number().over(Window.partitionBy(*S).orderBy(F.desc("hits"), "nx"))
        walls = walls.withColumn("rank", rank).filter(F.col("rank") <= MAX_WALLS)
        t = F.atan2("ny", "nx") * 4
        yaw = walls.groupBy(*S).agg((-F.atan2(F.sum(F.col("hits") * F.sin(t)), F.sum(F.col("hits") * F.cos(t))) / 4).alias("yaw"), F.count("*").alias("wall_planes"))
    else:
        yaw = r1.select(*S, F.lit(None).cast("double").alias("yaw"), F.lit(0).cast("bigint").alias("wall_planes"))
    spread = flat.groupBy(*S).agg(F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"))
    thin_way = -(F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2 + math.pi / 2)      # no wall found: square to the narrow direction
    yaw = spread.join(yaw, S, "left").select(*S, F.coalesce("yaw", thin_way).alias("yaw"), F.coalesce("wall_planes", F.lit(0)).alias("wall_planes"))
    yaw = written(yaw, "yaw")
    turned = under(flat, yaw.select(*S, _spin(F.col("yaw")).alias("m")), S)
    ends = stats.wide(stats.percentiles(turned, S, {"x": [0.02, 0.98]}), S, {("x", 0.02): "x0", ("x", 0.98): "x1"})
    half = turned.join(written(ends, "ends"), S).groupBy(*S).agg((F.count_if(F.col("x") > (F.col("x0") + F.col("x1")) / 2) < F.count_if(F.col("x") < (F.col("x0") + F.col("x1")) / 2)).alias("back"))
    yaw = written(yaw.join(half, S).select(*S, (F.col("yaw") + F.when(F.col("back"), math.pi).otherwise(0.0)).alias("yaw"), "wall_planes"), "yaw")
    square = under(flat, yaw.select(*S, _spin(F.col("yaw")).alias("m")), S)
    q = stats.wide(stats.percentiles(square, S, {c: [0.02, 0.98] for c in "xyz"}), S, {(c, p): f"{c}{n}" for c in "xyz" for n, p in enumerate((0.02, 0.98))})
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    unit = g.matrix([[*[(1 / span if r == c else 0) for c in range(3)], -(F.col(f"{a}0") + F.col(f"{a}1")) / 2 / span] for r, a in enumerate("xyz")] + [[0, 0, 0, 1]])
    out = r1.withColumnRenamed("m", "r1").join(yaw, S).join(q, S)
    return written(out.select(*S, g.multiply(unit, g.multiply(_spin(F.col("yaw")), F.col("r1"))).alias("m"), "wall_planes"), "canon")


def resolve_up(points: DataFrame, canon: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """(set_id, canon, flipped, bottom, top, floor_z) from each set's first capture: the denser end of the height is the floor unless
    ``modes(set_id, up)`` says keep or flip; the floor goes to z = 0."""
    q = under(points.filter("state = 0").select(*S, "x", "y", "z"), canon.filter("state = 0"), S)
    q = q.filter((F.abs("x") < 0.75) & (F.abs("y") < 0.75) & (F.abs("z") < 0.75)).select("set_id", "z")
    e = written(stats.wide(stats.percentiles(q, ["set_id"], {"z": [0.02, 0.98]}), ["set_id"], {("z", 0.02): "z0", ("z", 0.98): "z1"}), "ends")
    h = F.col("z1") - F.col("z0")
    n = q.join(e, "set_id").groupBy("set_id", "z0", "z1").agg(F.count_if(F.col("z") < F.col("z0") + 0.15 * h).alias("bottom"), F.count_if(F.col("z") > F.col("z1") - 0.15 * h).alias("top"))
    n = n.withColumn("up", F.lit("auto")) if modes is None else n.join(modes.select("set_id", "up"), "set_id", "left").withColumn("up", F.coalesce("up", F.lit("auto")))
    flip = F.when(F.col("up") == "auto", F.col("top") > F.col("bottom")).otherwise(F.col("up") == "flip")
    n = n.withColumn("flipped", flip).withColumn("floor_z", F.when(flip, -F.col("z1")).otherwise(F.col("z0")))
    s = F.when(F.col("flipped"), -1.0).otherwise(1.0)
    up = g.matrix([[1, 0, 0, 0], [0, s, 0, 0], [0, 0, s, -F.col("floor_z")], [0, 0, 0, 1]])
    return n.join(canon.filter("state = 0").select("set_id", "m"), "set_id").select("set_id", g.multiply(up, F.col("m")).alias("canon"), "flipped", "bottom", "top", "floor_z")


def box_symmetries() -> list[list[list[float]]]:
    """Four quarter turns about z, upright and turned over about x."""
    out = []
    for s in (1.0, -1.0):
        for c, d in ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)):
            out.append([[c, -d * s, 0.0, 0.0], [d, c * s, 0.0, 0.0], [0.0, 0.0, s, 0.0], [0.0, 0.0, 0.0, 1.0]])
    return out


def _held(cloud: DataFrame, keys: list[str], cell) -> DataFrame:
    """The cloud with one point in each cell, in its own coordinates (px, py, pz)."""
    return cl.downsample(cloud, keys, cell).select(*keys, *[F.col(c).alias(f"p{c}") for c in "xyz"])


def _moved(source: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    x, y, z = g.place(F.col("m"), F.col("px"), F.col("py"), F.col("pz"))
    return source.join(estimates, keys).select("*", x.alias("x"), y.alias("y"), z.alias("z"))


def score_candidates(source: DataFrame, reference: DataFrame, steps: int = CANDIDATE_STEPS) -> DataFrame:
    """(set_id, state, cand, m, fitness, rmse): the eight starts after a short fit in the unit frame, capture radius 4t, 2t, t.
    ``source(set_id, state, x, y, z)`` and ``reference(set_id, x, y, z)`` are in their unit frames, with one point in a cell."""
    keys = [*S, "cand"]
    starts = F.array(*[g.matrix(m) for m in box_symmetries()])
    n_targets = reference.groupBy("set_id").agg(F.count("*").alias("n_targets"))
    sizes = source.groupBy(*S).agg(F.count("*").alias("n")).join(n_targets, "set_id", "left").select(*S, (F.col("n") + F.coalesce("n_targets", F.lit(0)) <= cl.WHOLE).alias("whole"))
    est = written(sizes.select(*S, "whole", F.posexplode(starts).alias("cand", "m")), "est")
    src = source.select(*S, *[F.col(c).alias(f"p{c}") for c in "xyz"])
    radii = [CANDIDATE_RADIUS * scale for scale in (4.0, 2.0, 1.0)]
    # A cloud that one task can hold is fitted there through all steps; a larger one is dealt out to cubes at each step.
    scores = cl.settle_whole(src, reference, est.filter("whole").select(*keys, "m"), ["set_id"], keys, CANDIDATE_CELL, radii, steps)
    large = est.filter("not whole").select(*keys, "m")
    if not large.isEmpty():
        scores = scores.unionByName(_score_by_cubes(src, reference, large, radii, steps))
    return written(scores, "scores")


def _score_by_cubes(src: DataFrame, reference: DataFrame, est: DataFrame, radii: list[float], steps: int) -> DataFrame:
    """``cl.settle`` for clouds of any size: a step is one pass over the points of all clouds that still move."""
    keys = [*S, "cand"]
    batch, batches = (written(x, "batch") for x in cl.batched(est, ["set_id"], keys))
    est = written(est.join(batch, keys), "est")
    own = [*keys, "batch"]
    sized = lambda df, r: df.withColumn("cell", F.lit(CANDIDATE_CELL)).withColumn("radius", F.lit(r))
    rms = F.sqrt(F.try_divide("err", "n"))
    for r in radii:
        cubes = written(cl.target_cubes(sized(reference, r), ["set_id"], batches), "cubes")
        # Starts whose score no longer moves drop out, so that a step has only those that still do.
        active = est.select(*own, "m", *(F.lit(None).cast("double").alias(c) for c in ("fitness", "rmse")))
        done = None
        for _ in range(steps):
            fit = cl.fit_similarity(cl.match_sums(sized(_moved(src, active.select(*own, "m"), S), r), cubes, ["set_id"], keys), [*keys, "n", "total", "err"])
            fit = fit.select(*keys, F.col("m").alias("f"), (F.col("n") / F.col("total")).alias("f1"), rms.alias("r1"))
            still = (F.abs(F.col("f1") - F.col("fitness")) <= cl.STILL) & (F.abs(F.col("r1") - F.col("rmse")) <= cl.STILL)
            new = active.join(fit, keys, "left").select(*own, F.coalesce("f", "m").alias("m"), F.col("f1").alias("fitness"), F.col("r1").alias("rmse"),
                                                        (F.coalesce(still, F.lit(False)) | F.col("f").isNull()).alias("still"))
            new = written(new, "est")
            ended, active = new.filter("still").select(*own, "m"), new.filter("not still").drop("still")
            done = ended if done is None else done.unionByName(ended)
            if active.isEmpty():
                break
        last = active.select(*own, "m")
        est = written(last if done is None else done.unionByName(last), "est")
    # Scores are taken at the final estimate; the cubes are those of the last radius.
    sums = cl.match_sums(sized(_moved(src, est, S), radii[-1]), cubes, ["set_id"], keys)
    return sums.join(est, keys).select(*keys, "m", (F.col("n") / F.col("total")).alias("fitness"), F.coalesce(rms, F.lit(0.0)).alias("rmse"))


def pick_candidate(scores: DataFrame) -> DataFrame:
    """(set_id, state, m, fitness, runner_up): the best start, and the best fitness among those that end in a different pose."""
    w = Window.partitionBy(*S).orderBy(F.desc("fitness"), "rmse", "cand")
    ranked = scores.withColumn("rank", F.row_number().over(w))
    best = ranked.filter("rank = 1").select(*S, F.col("m").alias("best"), F.col("fitness").alias("top"))
    other = F.when(g.rotation_angle_deg(F.col("best"), F.col("m")) > DISTINCT_POSE_DEG, F.col("fitness"))
    rows = ranked.join(best, S).withColumn("other", F.when(F.col("rank") > 1, other))
    return rows.groupBy(*S).agg(F.first("best").alias("m"), F.first("top").alias("fitness"), F.coalesce(F.max("other"), F.lit(0.0)).alias("runner_up"))


def refine(source: DataFrame, reference: DataFrame, starts: DataFrame, steps: int = REFINE_STEPS, fewest: int = REFINE_FEWEST) -> DataFrame:
    """(set_id, state, m, inlier_frac, rms_frac_span): trimmed matching with a radius that shrinks from 4 % of the room's diagonal to
    0.3 %, then holds until nothing moves. A capture that is still, or matches fewer than ``fewest`` points, drops out.
    ``starts(set_id, state, m)``, raw -> reference raw. Both clouds have one point in a cell of .15 % of the diagonal, at every radius."""
    spans = written(cl.extents(reference, ["set_id"]).withColumnRenamed("diagonal", "span").withColumn("cell", F.col("span") * REFINE_CELL), "span")
    own = source.join(spans, "set_id")
    src = written(_held(own, [*S, "span", "cell"], F.col("cell")), "source")
    ref = written(cl.downsample(reference.join(spans, "set_id"), ["set_id", "span", "cell"], F.col("cell")), "target")
    batch, batches = (written(x, "batch") for x in cl.batched(starts, ["set_id"], S))
    probe = written(source.groupBy(*S).agg(*[fn(c).alias(f"{n}{c}") for n, fn in (("lo", F.min), ("hi", F.max)) for c in "xyz"]), "probe")
    active = written(starts.select(*S, "m"), "est")
    done, frac, cubes, level = None, REFINE_START, None, None

    def sums(estimates: DataFrame, frac: float, cubes: DataFrame) -> DataFrame:
        moved = _moved(src, estimates.join(batch, S), S).withColumn("radius", F.col("span") * frac)
        return cl.match_sums(moved, cubes, ["set_id"], S)

    cut = lambda frac: written(cl.target_cubes(ref.withColumn("radius", F.col("span") * frac), ["set_id"], batches), "cubes")
    for _ in range(steps):
        if level != frac:
            cubes, level = cut(frac), frac
        fit = cl.fit_similarity(sums(active, frac, cubes), [*S, "n"])
        new = active.join(fit.select(*S, "n", F.col("m").alias("f")), S, "left").join(probe, S).join(spans, "set_id")
        corners = []
        for bits in range(8):
            p = [F.col(("lo", "hi")[bits >> n & 1] + c) for n, c in enumerate("xyz")]
            a, b = g.place(F.col("m"), *p), g.place(F.col("f"), *p)
            corners.append(F.sqrt(sum(((u - v) ** 2 for u, v in zip(a, b)), F.lit(0.0))))
        still = (F.greatest(*corners) < REFINE_STILL * F.col("span")) if frac <= REFINE_FLOOR else F.lit(False)
        few = F.coalesce(F.col("n"), F.lit(0.0)) < fewest
        new = written(new.select(*S, F.when(few | F.col("f").isNull(), F.col("m")).otherwise(F.col("f")).alias("m"), (F.coalesce(still, F.lit(False)) | few).alias("end")), "est")
        ended = new.filter("end").select(*S, "m")
        done = ended if done is None else done.unionByName(ended)
        active = new.filter("not end").select(*S, "m")
        if active.isEmpty():
            break
        frac = max(REFINE_FLOOR, frac * REFINE_SHRINK)
    final = written(done.unionByName(active), "final")
    q = sums(final, INLIER_FRAC, cut(INLIER_FRAC)).join(spans, "set_id").select(
        *S, (F.col("n") / F.col("total")).alias("inlier_frac"), (F.sqrt(F.col("err") / F.col("n")) / F.col("span")).alias("rms_frac_span"))
    return final.join(q, S)


@dataclass
class Registered:
    transforms: DataFrame      # set_id, state, m: raw -> the first capture's raw frame
    canons: DataFrame          # set_id, canon and what decided which way is up
    report: DataFrame
    violations: DataFrame


def judged(report: DataFrame, params: RegisterParams = RegisterParams(), tuning: DataFrame | None = None) -> DataFrame:
    """Adds ``few`` and ``unclear``: too few points matched, or the best start not clear of the next. ``report(set_id, inlier_frac, margin)``;
    ``tuning(set_id, params MAP<STRING, DOUBLE>)`` replaces the limits of ``params`` for the sets it names."""
    given = lambda n: F.lit(getattr(params, n))
    if tuning is None:
        return report.withColumn("few", F.col("inlier_frac") < given("min_inlier_frac")).withColumn("unclear", F.col("margin") < given("min_candidate_margin"))
    limit = lambda n: F.coalesce(F.col("_own")[n], given(n))
    rows = report.join(tuning.select("set_id", F.col("params").alias("_own")), "set_id", "left")
    return rows.withColumn("few", F.col("inlier_frac") < limit("min_inlier_frac")).withColumn("unclear", F.col("margin") < limit("min_candidate_margin")).drop("_own")


def run(splats: DataFrame, params: RegisterParams = RegisterParams(), modes: DataFrame | None = None, candidate_steps: int = CANDIDATE_STEPS,
        tuning: DataFrame | None = None) -> Registered:
    """Every capture onto state 0 of its set. A capture that matches too few points, or whose best start does not clearly beat the next,
    is left out of ``transforms`` and listed in ``violations``. ``tuning`` as for ``judged``."""
    points = written(clouds_of(splats), "cloud")
    canon = canonicalize(points)
    ups = written(resolve_up(points, canon, modes), "ups")
    unit = written(cl.downsample(under(points, canon, S), S, CANDIDATE_CELL), "unit")
    first = unit.filter("state = 0").select("set_id", "x", "y", "z")
    best = written(pick_candidate(score_candidates(unit.filter("state > 0"), first, candidate_steps)), "best")
    c0 = canon.filter("state = 0").select("set_id", F.col("m").alias("c0"))
    starts = best.join(canon.select(*S, F.col("m").alias("cs")), S).join(c0, "set_id").select(*S, g.multiply(g.inverse(F.col("c0")), g.multiply(F.col("m"), F.col("cs"))).alias("m"))
    got = written(refine(points.filter("state > 0"), points.filter("state = 0").select("set_id", "x", "y", "z"), written(starts, "starts")), "refined")
    r = lambda c, n: F.bround(c, n)
    matched = got.join(best.drop("m"), S).withColumn("margin", F.col("fitness") - F.col("runner_up"))
    report = written(judged(matched, params, tuning).join(canon.select(*S, "wall_planes"), S).select(
        *S, r(F.col("fitness"), 3).alias("candidate_fitness"), r(F.col("runner_up"), 3).alias("runner_up_fitness"), r(F.col("margin"), 3).alias("candidate_margin"),
        r(F.col("inlier_frac"), 3).alias("inlier_frac"), r(F.col("rms_frac_span"), 5).alias("rms_frac_span"), r(g.uniform_scale(F.col("m")), 4).alias("scale"), "wall_planes",
        "few", "unclear", "m"), "report")
    where = F.concat(F.lit("c"), F.col("state").cast("string"))
    why = F.when(F.col("few"), F.concat(F.lit("registration rejected, inlier fraction "), F.col("inlier_frac").cast("string"))).otherwise(
        F.concat(F.lit("registration ambiguous, margin "), F.col("candidate_margin").cast("string")))
    bad = report.filter("few or unclear").select("set_id", where.alias("path"), why.alias("message"))
    base = c0.select("set_id", F.lit(0).alias("state"), g.identity().alias("m"))
    return Registered(base.unionByName(report.filter("not (few or unclear)").select(*S, "m")), ups, report.drop("few", "unclear", "m"), bad)
