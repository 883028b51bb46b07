"""Ingest, frames, clouds, curation and publishing, on the given tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from checks import mapped as m
from checks.registry import query
from checks.scene_queries import W
from checks.voxel_queries import LABELS, _boxes, _labels, ijk
from roomdiff.functions import geometry as g
from roomdiff.functions import scalar as sc
from roomdiff.functions.stage import new_folder
from roomdiff.operators import clouds as cl
from roomdiff.operators import frame as fr
from roomdiff.operators import quality as ql
from roomdiff.operators import splats as sp
from roomdiff.operators import stats as st
from roomdiff.plans import diff as dj
from roomdiff.plans import publish as pub
from roomdiff.plans import register as reg
from roomdiff.sources import captures as cap
from roomdiff.sources import manifests as mf
from roomdiff.streaming import sessions as ss

SP = "WITH " + m.SPLATS


# ---- ingest and transforms -----------------------------------------------------------------------------------------

def _full(spark, sf):
    one = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<float>")
    return m.splats(spark, sf).select("set_id", "state", "splat_id", "x", "y", "z", sc.logit(F.col("opacity")).cast("float").alias("opacity_logit"), "opacity",
                                      one(0.1, 0.2, 0.3).alias("scale"), one(1.0, 0.0, 0.0, 0.0).alias("rot"), one(0.0, 0.0, 0.0).alias("f_dc"), one(*range(9)).alias("f_rest"))


def _matrices(spark, sf):
    a = F.col("state") * 0.3
    return m.splats(spark, sf).select("set_id", "state").distinct().select("set_id", "state", g.matrix([
        [F.cos(a) * 1.5, -F.sin(a) * 1.5, 0, 1.0], [F.sin(a) * 1.5, F.cos(a) * 1.5, 0, -2.0], [0, 0, 1.5, 0.5], [0, 0, 0, 1]]).alias("m"))


@query("slim_ingest", SP + " SELECT set_id, state, splat_id, x, y, z FROM splats WHERE opacity > 0.05 AND opacity < 1")
def slim_ingest(spark, sf):
    return cap.slim(_full(spark, sf)).select("set_id", "state", "splat_id", "x", "y", "z")


@query("similarity_transform", SP + """ SELECT set_id, state, splat_id, round(cos(state * 0.3) * 1.5 * x - sin(state * 0.3) * 1.5 * y + 1, 5) AS x, round(sin(state * 0.3) * 1.5 * x + cos(state * 0.3) * 1.5 * y - 2, 5) AS y,
  round(1.5 * z + 0.5, 5) AS z, round(0.1 + ln(1.5), 4) AS scale, round(cos(state * 0.15), 4) AS qw, round(sin(state * 0.15), 4) AS qz FROM splats WHERE opacity >= 0.05""")
def similarity_transform(spark, sf):
    out = sp.bake(_full(spark, sf), _matrices(spark, sf), 0.05)
    r = lambda c, n, name: F.round(c.cast("double"), n).alias(name)
    return out.select("set_id", "state", "splat_id", r(F.col("x"), 5, "x"), r(F.col("y"), 5, "y"), r(F.col("z"), 5, "z"), r(F.col("scale")[0], 4, "scale"), r(F.col("rot")[0], 4, "qw"), r(F.col("rot")[3], 4, "qz"))


@query("transform_inverse", SP + " SELECT set_id, state, count(*) AS n, 0.0 AS off FROM splats GROUP BY set_id, state")
def transform_inverse(spark, sf):
    there = _matrices(spark, sf)
    back = there.select("set_id", "state", g.inverse(F.col("m")).alias("m"))
    s = m.splats(spark, sf)
    twice = dj.into_frame(dj.into_frame(s, there), back).groupBy("set_id", "state").agg(F.sum("x").alias("x2"))
    return s.groupBy("set_id", "state").agg(F.count("*").alias("n"), F.sum("x").alias("x")).join(twice, ["set_id", "state"]).select("set_id", "state", "n", F.abs(F.round(F.col("x") - F.col("x2"), 4)).alias("off"))


@query("coefficient_counts", SP + " SELECT DISTINCT set_id, state, 3 AS coefficients, 'only degrees 0 and 1 are supported' AS problem FROM splats")
def coefficient_counts(spark, sf):
    return cap.coefficient_counts(_full(spark, sf), 2)


@query("content_hash", SP + " SELECT DISTINCT set_id, state, TRUE AS same_in_any_order, TRUE AS other_when_changed FROM splats")
def content_hash(spark, sf):
    """The hash of a capture, of its rows and columns in another order, and of the capture moved by a millimetre."""
    s = m.splats(spark, sf)
    turned = s.select(*reversed(s.columns)).repartition(5, "x")
    moved = s.withColumn("x", F.col("x") + 0.001)
    named = [cap.content_hash(df).withColumnRenamed("hash", n) for df, n in ((s, "h"), (turned, "t"), (moved, "o"))]
    both = named[0].join(named[1], ["set_id", "state"]).join(named[2], ["set_id", "state"])
    return both.select("set_id", "state", (F.col("h") == F.col("t")).alias("same_in_any_order"), (F.col("h") != F.col("o")).alias("other_when_changed"))


# ---- order statistics and frames -----------------------------------------------------------------------------------

@query("percentiles", SP + """ SELECT set_id, t.p, round(CASE t.p WHEN 0.02 THEN quantile_cont(y, 0.02) WHEN 0.5 THEN quantile_cont(y, 0.5) ELSE quantile_cont(y, 0.98) END, 6) AS value FROM splats, (VALUES (0.02), (0.5), (0.98)) t(p) GROUP BY set_id, t.p""")
def percentiles(spark, sf):
    return st.percentiles(m.splats(spark, sf), ["set_id"], {"y": [0.02, 0.5, 0.98]}).select("set_id", "p", F.round("value", 6).alias("value"))


CROP = SP + """, e AS (SELECT set_id, quantile_cont(x, 0.02) AS x0, quantile_cont(x, 0.98) AS x1, quantile_cont(y, 0.02) AS y0, quantile_cont(y, 0.98) AS y1, quantile_cont(z, 0.02) AS z0, quantile_cont(z, 0.98) AS z1 FROM splats WHERE opacity > 0.35 GROUP BY set_id),
c AS (SELECT s.set_id, x, y, z FROM splats s JOIN e ON e.set_id = s.set_id WHERE opacity > 0.35 AND x > x0 - (x1 - x0) * 0.2 AND x < x1 + (x1 - x0) * 0.2 AND y > y0 - (y1 - y0) * 0.2 AND y < y1 + (y1 - y0) * 0.2 AND z > z0 - (z1 - z0) * 0.2 AND z < z1 + (z1 - z0) * 0.2)"""


@query("percentile_crop", CROP + " SELECT set_id, count(*) AS n, round(sum(x + y + z), 3) AS total FROM c GROUP BY set_id")
def percentile_crop(spark, sf):
    return fr.solid_cropped(m.splats(spark, sf)).groupBy("set_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x") + F.col("y") + F.col("z")), 3).alias("total"))


@query("find_up", CROP + """, l AS (SELECT set_id, 0 AS axis, x AS v FROM c UNION ALL SELECT set_id, 1, y FROM c UNION ALL SELECT set_id, 2, z FROM c),
r AS (SELECT set_id, axis, min(v) AS lo, max(v) AS hi FROM l GROUP BY set_id, axis), h AS (SELECT l.set_id, l.axis, least(floor((v - lo) / (hi - lo) * 80), 79) AS bin, count(*) AS n FROM l JOIN r ON r.set_id = l.set_id AND r.axis = l.axis GROUP BY ALL),
t AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY n DESC, axis, bin) = 1)
SELECT t.set_id, CASE WHEN bin < 40 THEN '+' ELSE '-' END || substr('xyz', axis + 1, 1) AS up, round(n / (SELECT count(*) FROM c WHERE c.set_id = t.set_id), 6) AS share FROM t""")
def find_up(spark, sf):
    return fr.find_up(fr.solid_cropped(m.splats(spark, sf))).withColumn("share", F.round("share", 6))


FLOOR = CROP + """, r AS (SELECT set_id, min(y) AS lo, max(y) AS hi, greatest(1, CAST(ceil((max(y) - min(y)) / 0.01) AS INTEGER)) AS bins FROM c GROUP BY set_id),
h AS (SELECT c.set_id, lo, hi, bins, least(floor((y - lo) / (hi - lo) * bins), bins - 1) AS bin, count(*) AS n FROM c JOIN r ON r.set_id = c.set_id GROUP BY ALL),
fl AS (SELECT set_id, lo + (bin + 0.5) * (hi - lo) / bins AS floor FROM h QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY n DESC, bin) = 1)"""


@query("find_floor", FLOOR + " SELECT set_id, round(floor, 6) AS floor FROM fl")
def find_floor(spark, sf):
    return fr.find_floor(fr.solid_cropped(m.splats(spark, sf))).withColumn("floor", F.round("floor", 6))


@query("level_floor", FLOOR + """, b AS (SELECT c.* FROM c JOIN fl ON fl.set_id = c.set_id WHERE abs(y - floor) < 4), v AS (SELECT set_id, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM b GROUP BY set_id),
p AS (SELECT set_id, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b FROM v) SELECT set_id, round(degrees(acos(1 / sqrt(a * a + 1 + b * b))), 4) AS tilt_deg FROM p""")
def level_floor(spark, sf):
    p = fr.solid_cropped(m.splats(spark, sf))
    return fr.level(p, fr.find_floor(p), band=4.0).select("set_id", F.round("tilt_deg", 4).alias("tilt_deg"))


@query("auto_room", SP + """ SELECT set_id, round_even(quantile_cont(x, 0.01) - 0.25, 2) AS x0, round_even(quantile_cont(z, 0.99) + 0.25, 2) AS z1, round_even(greatest(2.6, quantile_cont(y, 0.995) + 0.5), 2) AS top FROM splats WHERE opacity > 0.35 GROUP BY set_id""")
def auto_room(spark, sf):
    s = m.splats(spark, sf).filter("opacity > 0.35").select("set_id", "x", "y", "z")
    return fr.auto_room(s).select("set_id", F.col("room.lo")[0].alias("x0"), F.col("room.hi")[2].alias("z1"), F.col("room.hi")[1].alias("top"))


@query("resolve_frame")
def resolve_frame(spark, sf):
    return fr.resolve_frame(m.splats(spark, sf)).select("set_id", "up", "yaw_deg", F.round("tilt_deg", 6).alias("tilt_deg"))


@query("room_frame")
def room_frame(spark, sf):
    """The unit room frame of every capture and which way is up in its set."""
    pts = reg.clouds_of(m.splats(spark, sf))
    canon = reg.canonicalize(pts)
    return reg.resolve_up(pts, canon).select("set_id", "flipped", "bottom", "top")


@query("grid_spec", SP + """, q AS (SELECT set_id, x, y, z FROM splats WHERE state = 0 AND opacity > 0.35 AND abs(x / 100) < 0.75 AND abs(y / 100) < 0.75 AND abs(z / 100) < 0.75),
e AS (SELECT set_id, 0.8 AS voxel, quantile_cont(x, 0.01) AS a, quantile_cont(x, 0.99) AS b, quantile_cont(z, 0.98) / 100 AS ceiling, quantile_cont(x, 0.02) / 100 AS w FROM q GROUP BY set_id)
SELECT set_id, voxel, round(a - (b - a) * 0.08 - 1.6, 6) AS x0, CAST(ceil((b + (b - a) * 0.08 + 1.6 - (a - (b - a) * 0.08 - 1.6)) / voxel) + 1 AS INTEGER) AS sx, round(ceiling, 6) AS ceiling, round(w, 6) AS wall FROM e""")
def grid_spec(spark, sf):
    s = m.splats(spark, sf)
    canons = s.select("set_id").distinct().select("set_id", g.matrix([[0.01, 0, 0, 0], [0, 0.01, 0, 0], [0, 0, 0.01, 0], [0, 0, 0, 1]]).alias("canon"), F.lit(4.0).alias("calibration_m"))
    grid = dj.grid_spec(dj.room_points(s.filter("state = 0").select("set_id", "state", "x", "y", "z", "opacity"), canons), canons)
    return grid.select("set_id", F.round("voxel", 6).alias("voxel"), F.round(F.col("origin")[0], 6).alias("x0"), F.col("shape")[0].alias("sx"), F.round(F.col("room_canon.hi")[2], 6).alias("ceiling"), F.round(F.col("room_lo")[0], 6).alias("wall"))


# ---- clouds --------------------------------------------------------------------------------------------------------

PT = "WITH pt AS (SELECT CAST(label AS STRING) AS set_id, vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS u, embedding[5]::DOUBLE AS v, embedding[6]::DOUBLE AS w FROM embeddings)"


def _points(spark, sf):
    e = lambda n: F.col("embedding")[n].cast("double")
    return m.table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("set_id"), F.col("vec_id").alias("pid"), *[e(n).alias(c) for n, c in enumerate("xyzuvw")])


@query("downsample", PT + " SELECT set_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM pt GROUP BY set_id, floor(x / 0.1), floor(y / 0.1), floor(z / 0.1)")
def downsample(spark, sf):
    d = cl.downsample(_points(spark, sf), ["set_id"], 0.1)
    return d.select("set_id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("nearest_points", PT + """ SELECT a.set_id, a.pid, round(min(sqrt((a.x - b.u) * (a.x - b.u) + (a.y - b.v) * (a.y - b.v) + (a.z - b.w) * (a.z - b.w))) FILTER (sqrt((a.x - b.u) * (a.x - b.u) + (a.y - b.v) * (a.y - b.v) + (a.z - b.w) * (a.z - b.w)) <= 0.08), 6) AS distance
  FROM pt a JOIN pt b ON b.set_id = a.set_id GROUP BY a.set_id, a.pid""")
def nearest_points(spark, sf):
    p = _points(spark, sf)
    other = p.select("set_id", F.col("u").alias("x"), F.col("v").alias("y"), F.col("w").alias("z"))
    return cl.nearest(p.select("set_id", "pid", "x", "y", "z"), other, ["set_id"], "pid", 0.08).select("set_id", "pid", F.round("distance", 6).alias("distance"))


@query("fitness", PT + """, d AS (SELECT a.set_id, a.pid, min(sqrt((a.x - b.u) * (a.x - b.u) + (a.y - b.v) * (a.y - b.v) + (a.z - b.w) * (a.z - b.w))) AS d FROM pt a JOIN pt b ON b.set_id = a.set_id GROUP BY a.set_id, a.pid)
SELECT set_id, round(avg(CASE WHEN d <= 0.08 THEN 1.0 ELSE 0.0 END), 6) AS fitness, round(sqrt(avg(CASE WHEN d <= 0.08 THEN d * d END)), 6) AS rms FROM d GROUP BY set_id""")
def fitness(spark, sf):
    p = _points(spark, sf)
    other = p.select("set_id", F.col("u").alias("x"), F.col("v").alias("y"), F.col("w").alias("z"))
    d = cl.nearest(p.select("set_id", "pid", "x", "y", "z"), other, ["set_id"], "pid", 0.08)
    return d.groupBy("set_id").agg(F.round(F.avg(F.col("distance").isNotNull().cast("double")), 6).alias("fitness"), F.round(F.sqrt(F.avg(F.col("distance") ** 2)), 6).alias("rms"))


@query("similarity_fit", PT + " SELECT set_id, round(2 * cos(0.7), 6) AS a, round(-2 * sin(0.7), 6) AS b, 2.0 AS s, 3.0 AS t FROM pt GROUP BY set_id")
def similarity_fit(spark, sf):
    p = _points(spark, sf)
    c, s = F.cos(F.lit(0.7)), F.sin(F.lit(0.7))
    pairs = p.select("set_id", "x", "y", "z", (2 * (c * F.col("x") - s * F.col("y")) + 3).alias("tx"), (2 * (s * F.col("x") + c * F.col("y"))).alias("ty"), (2 * F.col("z")).alias("tz"))
    fit = cl.fit_similarity(cl.pair_sums(pairs, ["set_id"]), ["set_id"])
    return fit.select("set_id", F.round(F.col("m")[0][0], 6).alias("a"), F.round(F.col("m")[0][1], 6).alias("b"), F.round(g.uniform_scale(F.col("m")), 6).alias("s"), F.round(F.col("m")[0][3], 6).alias("t"))


# ---- curation and publishing ---------------------------------------------------------------------------------------

def _tracked(spark, sf):
    return m.objects(spark, sf).select("set_id", "id", "added_in", F.lit(None).cast("int").alias("removed_in"), "present", F.lit(10).cast("bigint").alias("voxels"), F.lit(0.5).alias("volume_vox_m3"),
                                       "moved_from", "moved_to", F.col("bbox").alias("bbox_canon"))


def _curation(spark, sf):
    o = m.objects(spark, sf).select("set_id", "id")
    null = F.lit(None).cast("string")
    names = o.filter("id % 4 <> 0").select("set_id", "id", F.when(F.col("id") % 2 == 0, "Even").otherwise("Odd").alias("name"), null.alias("kind"), null.alias("sub"), null.alias("doc"), null.alias("by"))
    return names, o.filter("id % 11 = 0"), o.filter("id % 5 = 0").select("set_id", "id", F.lit(3).alias("state"))


CUR = """, named AS (SELECT *, CASE WHEN id % 4 <> 0 THEN CASE WHEN id % 2 = 0 THEN 'Even' ELSE 'Odd' END END AS name, lead(id) OVER (PARTITION BY set_id, thing ORDER BY id) AS moved_to FROM obj),
cut AS (SELECT n.*, p.name AS p_name, q.name AS q_name FROM named n LEFT JOIN named p ON p.set_id = n.set_id AND p.id = n.moved_from LEFT JOIN named q ON q.set_id = n.set_id AND q.id = n.moved_to),
ids AS (SELECT set_id, id, row_number() OVER (PARTITION BY set_id ORDER BY id) - 1 AS nid FROM obj WHERE id % 11 <> 0),
seen2 AS (SELECT set_id, id, count(*) AS n, count(*) FILTER (state < 3) AS early FROM worn GROUP BY set_id, id),
pubd AS (SELECT c.set_id, i.nid AS id, c.id AS source_id, coalesce(c.name, 'Object ' || CASE WHEN i.nid < 10 THEN '0' ELSE '' END || i.nid) AS name, CASE WHEN c.id % 5 = 0 AND s.early < s.n THEN 3 END AS removed_in,
  CASE WHEN c.id % 5 = 0 THEN s.early ELSE s.n END AS n_present, CASE WHEN c.p_name <> c.name THEN NULL ELSE pi.nid END AS moved_from, CASE WHEN c.q_name <> c.name THEN NULL ELSE qi.nid END AS moved_to, round((c.x - 0.2) * 2, 4) AS x0
  FROM cut c JOIN ids i ON i.set_id = c.set_id AND i.id = c.id JOIN seen2 s ON s.set_id = c.set_id AND s.id = c.id LEFT JOIN ids pi ON pi.set_id = c.set_id AND pi.id = c.moved_from LEFT JOIN ids qi ON qi.set_id = c.set_id AND qi.id = c.moved_to)"""


def _published(spark, sf):
    def make():
        cal = m.sizes(spark, sf).select("set_id", F.lit(2.0).alias("calibration_m"))
        return pub.curate(_tracked(spark, sf), *_curation(spark, sf), cal)
    return m._once(spark, sf, "published", make)


@query("curate", W + CUR + " SELECT * FROM pubd")
def curate(spark, sf):
    return _published(spark, sf).select("set_id", "id", "source_id", "name", "removed_in", F.size("present").alias("n_present"), "moved_from", "moved_to", F.round(F.col("bbox.lo")[0], 4).alias("x0"))


@query("unknown_curated_ids", W + " SELECT set_id, 'objects[' || (id + 1000000) || ']' AS path FROM obj WHERE id % 11 = 0")
def unknown_curated_ids(spark, sf):
    _, gone, _ = _curation(spark, sf)
    return pub.unknown_ids(m.objects(spark, sf), gone, gone.select("set_id", (F.col("id") + 1000000).alias("id"))).select("set_id", "path")


@query("manifest_round_trip", W + CUR + " SELECT set_id, count(*) AS objects, count(moved_from) AS moves, sum(n_present) AS present, 5 AS n_states, 2 AS standard, 0 AS problems FROM pubd GROUP BY set_id")
def manifest_round_trip(spark, sf):
    """Objects published as one document per set, read back and checked."""
    st8 = m.states(spark, sf).withColumn("message", F.lit("m"))
    keys = st8.select("set_id", "state")
    rows = pub.state_rows(st8, keys.withColumn("splats", F.lit(1)), keys.withColumn("hash", F.lit("abcdef0")))
    box = g.box([F.lit(0.0)] * 3, [F.lit(1.0)] * 3)
    room = m.sizes(spark, sf).select("set_id", F.lit(0.1).alias("voxel"), F.array(*[F.lit(0.0)] * 3).alias("origin"), F.array(F.lit(4), F.lit(4), F.lit(4)).alias("shape"), F.lit(2.0).alias("calibration_m"), g.identity().alias("world_from_ref"), box.alias("room"))
    sets = m.sizes(spark, sf).select("set_id", F.lit(2.0).alias("calibration_m"), F.lit(2).alias("standard"), F.lit(None).cast("string").alias("door"))
    entries = m.pairs(spark, sf).select("set_id", "a", "b", F.lit("d").alias("doc"), F.lit("b").alias("by"))
    sites = m.sizes(spark, sf).select("set_id", F.lit(0).alias("at"), F.lit("s").alias("id"), F.lit("S").alias("name"), F.lit(1).alias("count"), F.lit(None).cast("string").alias("set"))
    back = mf.parse(m._once(spark, sf, "documents", lambda: pub.manifests(rows, _published(spark, sf), room, sets, entries, sites)))
    per = back.objects.groupBy("set_id").agg(F.count("*").alias("objects"), F.count("moved_from").alias("moves"), F.sum(F.size("present")).alias("present"))
    bad = back.violations.groupBy("set_id").agg(F.count("*").alias("bad"))
    return per.join(back.sets.select("set_id", "n_states", "standard"), "set_id").join(bad, "set_id", "left").select("set_id", "objects", "moves", "present", "n_states", "standard", F.coalesce("bad", F.lit(0)).alias("problems"))


@query("publish_labels", LABELS + """, ids AS (SELECT set_id, id, row_number() OVER (PARTITION BY set_id ORDER BY id) - 1 AS nid FROM box WHERE id % 5 <> 0)
SELECT l.set_id, l.state, l.i, l.j, l.k, nid AS object_id FROM lab l JOIN ids ON ids.set_id = l.set_id AND ids.id = l.object_id WHERE NOT (l.object_id % 7 = 0 AND l.state >= 2)""")
def publish_labels(spark, sf):
    o = _boxes(spark, sf).select("set_id", "id")
    ids = pub.new_ids(o, o.filter("id % 5 = 0"))
    return ijk(pub.publish_labels(_labels(spark, sf), ids, o.filter("id % 7 = 0").withColumn("state", F.lit(2))))


@query("label_problems", LABELS + " SELECT set_id, 'labels[' || state || ']' AS path, 'no such object: ' || max(object_id) AS message FROM lab WHERE object_id >= 900 GROUP BY set_id, state")
def label_problems(spark, sf):
    return pub.label_problems(_labels(spark, sf), _boxes(spark, sf).filter("id < 900"), m.splat_grids(spark, sf))


@query("single_objects", LABELS + """, c AS (SELECT DISTINCT set_id, i, j, k FROM occ), w AS (SELECT c.set_id, c.i, c.j, c.k, max(b.id) AS id FROM c JOIN dims d ON d.set_id = c.set_id JOIN box b ON b.set_id = c.set_id AND c.i >= greatest(floor(x0), 0) AND c.i < least(ceil(x1), 25)
  AND c.j >= greatest(floor(y0), 0) AND c.j < least(ceil(y1), sy) AND c.k >= floor(z0) AND c.k < least(ceil(z1), 5) GROUP BY ALL), n AS (SELECT b.set_id, b.id, count(w.id) AS voxels FROM box b LEFT JOIN w ON w.set_id = b.set_id AND w.id = b.id GROUP BY b.set_id, b.id)
SELECT set_id, id, 'Object ' || CASE WHEN id < 10 THEN '0' ELSE '' END || id AS name, voxels, round(voxels * 0.125, 4) AS volume_vox_m3 FROM n""")
def single_objects(spark, sf):
    from roomdiff.operators import voxels as vx
    from checks.voxel_queries import _occ
    boxes = _boxes(spark, sf)
    null = F.lit(None).cast("string")
    names = boxes.filter("false").select("set_id", "id", null.alias("name"), null.alias("kind"), null.alias("sub"), null.alias("doc"), null.alias("by"))
    return pub.single_objects(boxes, names, vx.occupied_in_objects(_occ(spark, sf), boxes, m.splat_grids(spark, sf)), 0.5).select("set_id", "id", "name", "voxels", "volume_vox_m3")


@query("boxes_to_world", W + " SELECT set_id, id, round((x - 0.2) * 3, 4) AS x0, 0.0 - round((z + 0.2) * 0, 4) AS y0_zero, round(0 - 1.0 * 3, 4) AS z0 FROM obj")
def boxes_to_world(spark, sf):
    b = g.box_under(g.world_from_canon(F.lit(3.0)), F.col("bbox"))
    return m.objects(spark, sf).select("set_id", "id", b.alias("b")).select("set_id", "id", F.col("b.lo")[0].alias("x0"), F.lit(0.0).alias("y0_zero"), F.col("b.lo")[2].alias("z0"))


# ---- truth and alerts ----------------------------------------------------------------------------------------------

@query("truth_coverage", W + """ SELECT set_id, 'Thing ' || thing AS object, state, 1.0 AS share, TRUE AS ok FROM worn""")
def truth_coverage(spark, sf):
    o = m.objects(spark, sf)
    at = lambda n: g.middle(F.col("bbox"), n)
    parts = o.select("set_id", F.col("name").alias("object"), F.explode("present").alias("state"), F.lit(0).alias("part"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.lit(5).alias("points"), F.lit(1.0).alias("top"))
    return ql.coverage(parts, o)


@query("standing_alerts", W + """, k AS (SELECT t.set_id, t.root, s.state, CASE WHEN p.id IS NULL THEN 'extra' WHEN q.id IS NULL THEN 'missing' WHEN sqrt((p.x - q.x) * (p.x - q.x) + (p.z - q.z) * (p.z - q.z)) > 0.05 THEN 'off' ELSE 'match' END AS k
  FROM (SELECT DISTINCT set_id, root FROM chain) t JOIN states s ON s.set_id = t.set_id LEFT JOIN place p ON p.set_id = t.set_id AND p.root = t.root AND p.state = 2 LEFT JOIN place q ON q.set_id = t.set_id AND q.root = t.root AND q.state = s.state),
l AS (SELECT *, lag(k) OVER (PARTITION BY set_id, root ORDER BY state) AS before FROM k) SELECT set_id, root, state, before, k AS now FROM l WHERE before <> k""")
def standing_alerts(spark, sf):
    from roomdiff.operators import scene
    asked = m.roots(spark, sf).filter("id = root").select("set_id", "id").join(m.heads(spark, sf), "set_id")
    k = scene.standing(asked, m.roots(spark, sf), m.positions(spark, sf)).withColumnRenamed("head", "state")
    return ss.standing_alerts(k)


@query("zoom_sessions", """WITH t AS (SELECT CAST(user_id AS STRING) AS session, epoch_us(ts) // 100000 AS us, value FROM events), f AS (SELECT *, CASE WHEN us - lag(us) OVER w < 800000 THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY session ORDER BY us)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY us) AS run FROM f), z AS (SELECT session, run, min(us) AS s, max(us) AS e, arg_min(value, us) AS d0, arg_max(value + 1, us) AS d1, count(*) AS ticks FROM r GROUP BY session, run)
SELECT session, s // 1000 AS started, e // 1000 AS ended, ticks FROM z WHERE abs(d1 - d0) >= 0.01""")
def zoom_sessions(spark, sf):
    a = m.actions(spark, sf).select("session", "ts", F.lit("dolly").alias("verb"), F.col("value").alias("d0"), (F.col("value") + 1).alias("d1"))
    return ss.zoom_sessions(a).select("session", F.unix_millis("started").alias("started"), F.unix_millis("ts").alias("ended"), "ticks")


# ---- capture files -------------------------------------------------------------------------------------------------

PLY = ["x", "y", "z", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3", "f_dc_0", "f_dc_1", "f_dc_2"]


def _files(spark, sf):
    """The folder of capture files written from lineitem, one for each set and year; (set_id, state, n) of what was written is kept."""
    rows = m.sql(spark, sf, "s AS (SELECT CAST(l_suppkey % 5 AS STRING) AS set_id, year(l_shipdate) - 1992 AS state, CAST(l_partkey AS FLOAT) AS x, CAST(l_suppkey AS FLOAT) AS y, CAST(l_linenumber AS FLOAT) AS z, CAST(l_quantity - 25 AS FLOAT) AS opacity FROM lineitem)",
                 "SELECT * FROM s", "lineitem")
    folder = new_folder(spark, "captures")

    def write(key, table):
        set_id, state = key[0].as_py(), key[1].as_py()
        body = np.zeros((table.num_rows, len(PLY)), "<f4")
        for n, c in enumerate(PLY[:4]):
            body[:, n] = table.column(c).to_numpy()
        head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(body)}\n" + "".join(f"property float {n}\n" for n in PLY) + "end_header\n"
        system, where = cap._file_system(folder)
        system.create_dir(f"{where}/{set_id}/raw", recursive=True)
        with system.open_output_stream(f"{where}/{set_id}/raw/c{state}.ply") as out:
            out.write(head.encode())
            out.write(body.tobytes())
        return pa.table({"n": [table.num_rows]})

    m._once(spark, sf, "capture_files", lambda: rows.groupBy("set_id", "state").applyInArrow(write, "n bigint").withColumn("folder", F.lit(folder)))
    return m._once(spark, sf, "capture_files", lambda: None).first().folder


@query("capture_scan", """SELECT CAST(l_suppkey % 5 AS STRING) AS set_id, CAST(year(l_shipdate) - 1992 AS INTEGER) AS state, count(*) AS n, CAST(sum(l_partkey) AS DOUBLE) AS x, CAST(sum(l_suppkey) AS DOUBLE) AS y, CAST(sum(l_linenumber) AS DOUBLE) AS z,
  count(*) FILTER (l_quantity - 25 >= 0) AS solid, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS ids, count(*) * 4 AS turns FROM lineitem WHERE year(l_shipdate) >= 1993 AND l_suppkey % 5 IN (0, 1, 3) GROUP BY ALL""")
def capture_scan(spark, sf):
    files = cap.list_captures(spark, _files(spark, sf)).filter("state >= 1 and set_id in ('0', '1', '3')")
    rows = cap.read_captures(spark, files, range_bytes=1 << 16, columns=["set_id", "state", "splat_id", "x", "y", "z", "opacity", "rot"])
    return rows.groupBy("set_id", "state").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "xyz"], F.count_if(F.col("opacity") >= 0.5).alias("solid"), F.sum("splat_id").alias("ids"), F.sum(F.size("rot")).cast("bigint").alias("turns"))


# ---- acceptance against truth --------------------------------------------------------------------------------------

# A nation is a room of known size whose captures are turned about z, scaled and shifted; what was registered and published is off by a scale q and a shift e.
ROOM = """room AS (SELECT CAST(n_nationkey AS STRING) AS set_id, n_nationkey AS n, 4.0 + n_nationkey % 3 AS wide, 3.0 + n_nationkey % 2 * 0.5 AS deep, 2.5 + n_nationkey % 4 * 0.1 AS high,
  n_nationkey % 5 * 0.002 AS q, n_nationkey % 7 * 0.004 - 0.012 AS e FROM nation),
capture AS (SELECT room.*, s.state, 0.3 + 0.2 * s.state + n % 6 * 0.1 AS turn, 1.5 - 0.25 * s.state + n % 2 AS scale, n * 0.5 - s.state AS dx, 2.0 + s.state AS dy, n % 3 * 0.7 AS dz
  FROM room, (SELECT 0 AS state UNION ALL SELECT 1 UNION ALL SELECT 2) s)"""
CORNER = """, sx AS (SELECT -0.5 AS a UNION ALL SELECT 0.5), sz AS (SELECT 0 AS c UNION ALL SELECT 1), corner AS (SELECT set_id, x.a * wide AS x, y.a * deep AS y, c * high AS z FROM room, sx x, sx y, sz)"""


def _rooms(spark, sf):
    """(rooms, captures with their true matrix m)."""
    double = lambda df: df.select(*[F.col(c) if c in ("set_id", "n", "state") else F.col(c).cast("double").alias(c) for c in df.columns])
    c, s, k = F.cos("turn") * F.col("scale"), F.sin("turn") * F.col("scale"), F.col("scale")
    true = g.matrix([[c, -s, 0, F.col("dx")], [s, c, 0, F.col("dy")], [0, 0, k, F.col("dz")], [0, 0, 0, 1]])
    captures = m._once(spark, sf, "nation_captures", lambda: double(m.sql(spark, sf, ROOM, "SELECT * FROM capture", "nation")).select("*", true.alias("m")))
    captures = m._once(spark, sf, "nation_back", lambda: captures.select("*", g.inverse(F.col("m")).alias("back")))
    return double(m.sql(spark, sf, ROOM, "SELECT * FROM room", "nation")), captures


@query("corner_errors", "WITH " + ROOM + CORNER + """, ref AS (SELECT corner.set_id, k.scale, cos(turn) * k.scale * x - sin(turn) * k.scale * y + dx AS x, sin(turn) * k.scale * x + cos(turn) * k.scale * y + dy AS y, k.scale * z + dz AS z FROM corner JOIN capture k ON k.set_id = corner.set_id AND state = 0),
off AS (SELECT k.set_id, k.state, avg(sqrt(power(q * x + e * k.state, 2) + power(q * y, 2) + power(q * z, 2)) / ref.scale * 1000) AS error_mm FROM ref JOIN capture k ON k.set_id = ref.set_id AND k.state > 0 GROUP BY k.set_id, k.state)
SELECT set_id, CAST(state AS INTEGER) AS state, round(error_mm, 4) AS error_mm, error_mm < 15 AS ok FROM off""")
def corner_errors(spark, sf):
    rooms, captures = _rooms(spark, sf)
    first = captures.filter("state = 0").select("set_id", F.col("m").alias("m0"))
    grow = 1 + F.col("q")
    wrong = g.matrix([[grow, 0, 0, F.col("e") * F.col("state")], [0, grow, 0, 0], [0, 0, grow, 0], [0, 0, 0, 1]])
    onto = m._once(spark, sf, "nation_onto", lambda: captures.filter("state > 0").join(first, "set_id").select("set_id", "state", "q", "e", g.multiply(F.col("m0"), F.col("back")).alias("m")))
    found = m._once(spark, sf, "nation_found", lambda: onto.select("set_id", "state", g.multiply(wrong, F.col("m")).alias("m")))
    got = ql.corner_errors(ql.room_corners(rooms), captures.select("set_id", "state", "m"), found)
    return got.select("set_id", "state", F.round("error_mm", 4).alias("error_mm"), "ok")


@query("world_frame", "WITH " + ROOM + """, off AS (SELECT set_id, high, abs(e * 10) AS floor_off, abs(high * q * 10 + e * 10) AS ceiling_off, q * 20 AS room_off FROM room)
SELECT set_id, round(floor_off, 6) AS floor_off, round(ceiling_off, 6) AS ceiling_off, round(room_off, 6) AS room_off, floor_off < 0.05 * high AND ceiling_off < 0.05 * high AND room_off < 0.06 AS ok FROM off""")
def world_frame(spark, sf):
    rooms, captures = _rooms(spark, sf)
    to_world = g.matrix([[1, 0, 0, 0], [0, 0, 1 + F.col("q") * 10, F.col("e") * 10], [0, -1, 0, 0], [0, 0, 0, 1]])
    zero, grow = F.lit(0.0), 1 + F.col("q") * 20
    room = g.box([zero, zero, zero], [F.col("wide") * grow, F.col("high") * grow, F.col("deep") * grow])
    published = m._once(spark, sf, "nation_published", lambda: captures.filter("state = 0").select("set_id", g.multiply(to_world, F.col("back")).alias("world_from_ref"), room.alias("room")))
    got = ql.world_frame(ql.room_corners(rooms), captures.select("set_id", "state", "m"), rooms.select("set_id", "wide", "deep", "high"), published)
    return got.select("set_id", *[F.round(c, 6).alias(c) for c in ("floor_off", "ceiling_off", "room_off")], "ok")


@query("boxes_outside", "WITH " + ROOM + """, b AS (SELECT CAST(p_partkey % 25 AS STRING) AS set_id, p_partkey AS id, p_size / 10 - 1.0 AS lo, p_size / 10 - 1.0 + p_partkey % 4 * 0.25 AS hi FROM part)
SELECT b.set_id, b.id, round(lo, 6) AS lo, round(hi, 6) AS hi FROM b JOIN room ON room.set_id = b.set_id WHERE hi <= 0 OR lo >= high""")
def boxes_outside(spark, sf):
    rooms, _ = _rooms(spark, sf)
    low, zero, one = F.col("p_size") / 10 - 1.0, F.lit(0.0), F.lit(1.0)
    objects = m.table(spark, sf, "part").select((F.col("p_partkey") % 25).cast("string").alias("set_id"), F.col("p_partkey").alias("id"),
                                                g.box([zero, low, zero], [one, low + F.col("p_partkey") % 4 * 0.25, one]).alias("bbox"))
    return ql.boxes_outside(objects, rooms).select("set_id", "id", F.round(F.col("bbox.lo")[1], 6).alias("lo"), F.round(F.col("bbox.hi")[1], 6).alias("hi"))
