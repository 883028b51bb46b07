"""Splats, voxels, components and tracking, on the lineitem table read as splats."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import mapped as m
from checks.registry import query
from roomdiff.functions import voxel as v
from roomdiff.operators import components as cc
from roomdiff.operators import tracker as tk
from roomdiff.operators import voxels as vx

S = "WITH " + m.SPLATS + """,
cell AS (SELECT *, CAST(floor(x) AS INTEGER) AS i, CAST(floor(y) AS INTEGER) AS j, CAST(floor(z) AS INTEGER) AS k FROM splats),
dims AS (SELECT set_id, CAST(ceil(max(y)) AS INTEGER) AS sy, CAST(max(state) + 1 AS INTEGER) AS n_states FROM splats GROUP BY set_id),
occ AS (SELECT set_id, state, i, j, k, count(*) AS n FROM cell WHERE opacity > 0.2 GROUP BY set_id, state, i, j, k HAVING count(*) >= 2)"""
BITS = 3


def _occ(spark, sf):
    return m._once(spark, sf, "occ", lambda: vx.occupancy(m.splats(spark, sf), m.splat_grids(spark, sf)))


def ijk(df, *more):
    i, j, k = v.unpack(F.col("vox"))
    keys = [c for c in df.columns if c != "vox"]
    return df.select(*keys, i.alias("i"), j.alias("j"), k.alias("k"), *more)


@query("occupancy", S + " SELECT * FROM occ")
def occupancy(spark, sf):
    return ijk(vx.occupancy(m.splats(spark, sf), m.splat_grids(spark, sf)))


@query("voxel_index", S + " SELECT c.set_id, state, CASE WHEN i < 25 AND j < sy AND k < 5 THEN (i * sy + j) * 5 + k ELSE -1 END AS flat, count(*) AS n FROM cell c JOIN dims d ON d.set_id = c.set_id GROUP BY ALL")
def voxel_index(spark, sf):
    g = m.splat_grids(spark, sf)
    rows = vx.with_voxel(m.splats(spark, sf), g).join(g.select("set_id", "shape"), "set_id")
    return rows.select("set_id", "state", v.flat(F.col("i"), F.col("j"), F.col("k"), F.col("shape")).alias("flat")).groupBy("set_id", "state", "flat").agg(F.count("*").alias("n"))


@query("splat_filters", S + """ SELECT set_id, state, count(*) FILTER (opacity > 0.35) AS solid, count(*) FILTER (opacity >= 0.05) AS pruned, count(*) AS splats FROM splats GROUP BY set_id, state""")
def splat_filters(spark, sf):
    s = m.splats(spark, sf)
    per = lambda df, name: df.groupBy("set_id", "state").agg(F.count("*").alias(name))
    return per(vx.solid(s, 0.35), "solid").join(per(vx.prune(s, 0.05), "pruned"), ["set_id", "state"]).join(vx.splat_counts(s), ["set_id", "state"])


CHANGES = S + """, up AS (SELECT set_id, state, i, j, k FROM occ WHERE k + 0.5 > 1),
side AS (SELECT set_id, state AS step, 'added' AS kind, i, j, k FROM up WHERE state >= 1 UNION ALL SELECT u.set_id, state + 1, 'removed', i, j, k FROM up u JOIN dims d ON d.set_id = u.set_id WHERE state + 1 < n_states),
other AS (SELECT set_id, state + 1 AS step, 'added' AS kind, i, j, k FROM up UNION ALL SELECT set_id, state, 'removed', i, j, k FROM up),
ball AS (SELECT a.o AS di, b.o AS dj, c.o AS dk FROM range(-2, 3) a(o), range(-2, 3) b(o), range(-2, 3) c(o) WHERE a.o * a.o + b.o * b.o + c.o * c.o <= 4),
near AS (SELECT DISTINCT s.* FROM side s, ball, other o WHERE o.set_id = s.set_id AND o.step = s.step AND o.kind = s.kind AND o.i = s.i + di AND o.j = s.j + dj AND o.k = s.k + dk),
changed AS (SELECT * FROM side EXCEPT SELECT * FROM near)"""


def _changes(spark, sf):
    return m._once(spark, sf, "changed", lambda: vx.changes(_occ(spark, sf), m.splat_sizes(spark, sf), m.splat_grids(spark, sf), 1, 2, BITS))


@query("voxel_changes", CHANGES + " SELECT * FROM changed")
def voxel_changes(spark, sf):
    return ijk(vx.changes(_occ(spark, sf), m.splat_sizes(spark, sf), m.splat_grids(spark, sf), 1, 2))


@query("voxel_distance", S + """, ball AS (SELECT a.o AS di, b.o AS dj, c.o AS dk, a.o * a.o + b.o * b.o + c.o * c.o AS d2 FROM range(-2, 3) a(o), range(-2, 3) b(o), range(-2, 3) c(o) WHERE a.o * a.o + b.o * b.o + c.o * c.o <= 4)
SELECT s.set_id, s.state, s.i, s.j, s.k, (SELECT min(d2) FROM ball JOIN occ o ON o.set_id = s.set_id AND o.state = s.state + 1 AND o.i = s.i + di AND o.j = s.j + dj AND o.k = s.k + dk) AS d2 FROM occ s""")
def voxel_distance(spark, sf):
    occ = _occ(spark, sf).select("set_id", "state", "vox")
    later = occ.filter("state >= 1").select("set_id", (F.col("state") - 1).alias("state"), "vox")
    d = vx.distances(occ, later, 2)
    return ijk(d)


@query("dilation", CHANGES + """, o AS (SELECT a.o AS di, b.o AS dj, c.o AS dk FROM range(-1, 2) a(o), range(-1, 2) b(o), range(-1, 2) c(o))
SELECT c.set_id, c.step, c.kind, count(DISTINCT (c.i + di, c.j + dj, c.k + dk)) AS n FROM changed c, o, dims d WHERE d.set_id = c.set_id AND c.i + di BETWEEN 0 AND 24 AND c.j + dj BETWEEN 0 AND sy - 1 AND c.k + dk BETWEEN 0 AND 4 GROUP BY ALL""")
def dilation(spark, sf):
    return vx.dilate(_changes(spark, sf), m.splat_grids(spark, sf)).groupBy("set_id", "step", "kind").agg(F.count("*").alias("n"))


@query("dilation_faces", S + """, o AS (SELECT a.o AS di, b.o AS dj, c.o AS dk FROM range(-2, 3) a(o), range(-2, 3) b(o), range(-2, 3) c(o) WHERE abs(a.o) + abs(b.o) + abs(c.o) <= 2)
SELECT c.set_id, c.state, count(DISTINCT (c.i + di, c.j + dj, c.k + dk)) AS n FROM occ c, o, dims d WHERE d.set_id = c.set_id AND c.i + di BETWEEN 0 AND 24 AND c.j + dj BETWEEN 0 AND sy - 1 AND c.k + dk BETWEEN 0 AND 4 GROUP BY ALL""")
def dilation_faces(spark, sf):
    return vx.dilate_faces(_occ(spark, sf).select("set_id", "state", "vox"), m.splat_grids(spark, sf), 2).groupBy("set_id", "state").agg(F.count("*").alias("n"))


# Lowest raster index per component, spread over neighbouring voxels until nothing changes.
COMP = """, o AS (SELECT a.o AS di, b.o AS dj, c.o AS dk FROM range(-1, 2) a(o), range(-1, 2) b(o), range(-1, 2) c(o) WHERE NOT (a.o = 0 AND b.o = 0 AND c.o = 0)),
node AS (SELECT row_number() OVER (ORDER BY set_id, state, i, j, k) AS n, set_id, state, i, j, k FROM occ),
edge AS (SELECT a.n AS u, b.n AS w FROM node a, o, node b WHERE b.set_id = a.set_id AND b.state = a.state AND b.i = a.i + di AND b.j = a.j + dj AND b.k = a.k + dk),
cc(n, c) USING KEY (n) AS (SELECT n, n FROM node UNION SELECT e.u, min(cc.c) FROM cc JOIN edge e ON e.w = cc.n JOIN recurring.cc mine ON mine.n = e.u WHERE cc.c < mine.c GROUP BY e.u)"""


@query("components", S.replace("WITH ", "WITH RECURSIVE ") + COMP + " SELECT a.set_id, a.state, a.i, a.j, a.k, b.i AS ci, b.j AS cj, b.k AS ck FROM cc JOIN node a ON a.n = cc.n JOIN node b ON b.n = cc.c")
def components(spark, sf):
    got = cc.components(_occ(spark, sf).select("set_id", "state", "vox"))
    i, j, k = v.unpack(F.col("comp"))
    return ijk(got, i.alias("ci"), j.alias("cj"), k.alias("ck")).drop("comp")


@query("grow_support", S.replace("WITH ", "WITH RECURSIVE ") + COMP + """, hit AS (SELECT DISTINCT cc.c FROM cc JOIN node ON node.n = cc.n WHERE k = 2)
SELECT node.set_id, node.state, count(*) AS n FROM cc JOIN node ON node.n = cc.n WHERE cc.c IN (SELECT c FROM hit) GROUP BY node.set_id, node.state""")
def grow_support(spark, sf):
    occ = _occ(spark, sf).select("set_id", "state", "vox")
    seed = occ.filter(v.unpack(F.col("vox"))[2] == 2)
    return cc.grow(seed, cc.components(occ), ["set_id", "state"]).groupBy("set_id", "state").agg(F.count("*").alias("n"))


P = tk.DiffParams(min_voxels=6, jitter_voxels=2, coverage_voxels=3, floor_band_voxels=1, ceiling_band_voxels=0)


def _split(spark, sf):
    return m._once(spark, sf, "split", lambda: tk.change_blobs(_changes(spark, sf), m.splat_grids(spark, sf)))


def _cands(spark, sf):
    return m._once(spark, sf, "cands", lambda: tk.candidates(_split(spark, sf), _occ(spark, sf), m.splat_grids(spark, sf), m.splat_sizes(spark, sf), P))


# Two changed voxels share a blob when their dilations touch: no axis apart by more than three.
BLOBS = CHANGES.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT a.o AS di, b.o AS dj, c.o AS dk FROM range(-3, 4) a(o), range(-3, 4) b(o), range(-3, 4) c(o)),
node AS (SELECT row_number() OVER (ORDER BY set_id, step, kind, i, j, k) AS n, * FROM changed),
edge AS (SELECT a.n AS u, b.n AS w FROM node a, o, node b WHERE b.set_id = a.set_id AND b.step = a.step AND b.kind = a.kind AND b.i = a.i + di AND b.j = a.j + dj AND b.k = a.k + dk AND b.n <> a.n),
cc(n, c) USING KEY (n) AS (SELECT n, n FROM node UNION SELECT e.u, min(cc.c) FROM cc JOIN edge e ON e.w = cc.n JOIN recurring.cc mine ON mine.n = e.u WHERE cc.c < mine.c GROUP BY e.u),
core AS (SELECT node.*, cc.c, node.k + 0.5 AS h FROM cc JOIN node ON node.n = cc.n),
ball3 AS (SELECT a.o AS di, b.o AS dj, c.o AS dk FROM range(-3, 4) a(o), range(-3, 4) b(o), range(-3, 4) c(o) WHERE a.o * a.o + b.o * b.o + c.o * c.o <= 9),
stat AS (SELECT set_id, step, kind, c, count(*) AS size, count(*) FILTER (h <= 1) AS near_floor, median(h) AS median_height, max(h) AS max_height, avg(i + 0.5) AS cx, avg(j + 0.5) AS cy FROM core GROUP BY ALL),
seen AS (SELECT core.c, count(DISTINCT core.n) AS covered FROM core JOIN stat ON stat.c = core.c AND stat.size >= 6, ball3, occ o WHERE o.set_id = core.set_id AND o.state = CASE WHEN core.kind = 'added' THEN core.step - 1 ELSE core.step END
  AND o.i = core.i + di AND o.j = core.j + dj AND o.k = core.k + dk GROUP BY core.c),
cand AS (SELECT stat.*, coalesce(covered, 0) AS covered, CASE WHEN size < 6 THEN 'size' WHEN coalesce(covered, 0) < 0.25 * size THEN 'coverage' WHEN near_floor / size >= 0.8 OR median_height <= 1 THEN 'floor'
  WHEN median_height >= 100 OR max_height > 101 THEN 'ceiling' END AS reason FROM stat LEFT JOIN seen ON seen.c = stat.c)"""


@query("change_candidates", BLOBS + " SELECT set_id, step, kind, size, covered, near_floor, median_height, max_height, round(cx, 6) AS cx, round(cy, 6) AS cy, coalesce(reason, 'kept') AS reason FROM cand")
def change_candidates(spark, sf):
    return _cands(spark, sf).select("set_id", "step", "kind", "size", "covered", "near_floor", "median_height", "max_height", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"),
                                    F.coalesce("reject_reason", F.lit("kept")).alias("reason"))


@query("rejection_counts", BLOBS + " SELECT set_id, step, kind, coalesce(reason, 'kept') AS reason, count(*) AS n FROM cand GROUP BY ALL")
def rejection_counts(spark, sf):
    return tk.rejection_counts(_cands(spark, sf))


# Sets with values of their own in one run: opacity, jitter, coverage, smallest size and wall margin go with the set's number.
N = "CAST({}set_id AS INTEGER)"
TUNED = (BLOBS.replace("opacity > 0.2", f"opacity > 0.1 + 0.15 * ({N.format('')} % 3)")
         .replace("AND o.k = s.k + dk)", f"AND o.k = s.k + dk AND di * di + dj * dj + dk * dk <= power(1 + {N.format('s.')} % 2, 2))")
         .replace("AND o.k = core.k + dk GROUP", f"AND o.k = core.k + dk AND di * di + dj * dj + dk * dk <= power(3 - {N.format('core.')} % 2, 2) GROUP")
         .replace("stat.size >= 6", f"stat.size >= 4 + {N.format('stat.')}").replace("size < 6", f"size < 4 + {N.format('stat.')}")
         .replace("max_height > 101 THEN 'ceiling' END", f"""max_height > 101 THEN 'ceiling' WHEN {N.format('stat.')} > 0 AND (cx < 1.37 * {N.format('stat.')} OR cx > 25 - 1.37 * {N.format('stat.')}
    OR cy < 1.37 * {N.format('stat.')} OR cy > high - 1.37 * {N.format('stat.')}) THEN 'wall' END""")
         .replace("LEFT JOIN seen ON seen.c = stat.c", "LEFT JOIN seen ON seen.c = stat.c JOIN (SELECT set_id AS room, max(y) AS high FROM splats GROUP BY set_id) ON room = stat.set_id"))


@query("tuned_candidates", TUNED + " SELECT set_id, step, kind, coalesce(reason, 'kept') AS reason, count(*) AS n, sum(size) AS voxels, sum(covered) AS covered FROM cand GROUP BY ALL")
def tuned_candidates(spark, sf):
    n = F.col("set_id").cast("int").cast("double")
    values = {"opacity_solid": 0.1 + 0.15 * (n % 3), "jitter_voxels": 1 + n % 2, "coverage_voxels": 3 - n % 2, "min_voxels": 4 + n, "wall_margin_m": 1.37 * n}
    own = m.splat_sizes(spark, sf).select("set_id", F.create_map(*[x for k, c in values.items() for x in (F.lit(k), c)]).alias("params"))
    table = m._once(spark, sf, "tuning", lambda: tk.tuning_table(m.splat_sizes(spark, sf), own, P))
    p, grids, sizes = tk.per_set(table), m.splat_grids(spark, sf).join(table, "set_id"), m.splat_sizes(spark, sf)
    occ = m._once(spark, sf, "tuned_occ", lambda: vx.occupancy(m.splats(spark, sf), grids, p.opacity_solid, p.min_count))
    changed = m._once(spark, sf, "tuned_changed", lambda: vx.changes(occ, sizes, grids, p.floor_band_voxels, p.jitter_voxels, BITS))
    split = m._once(spark, sf, "tuned_split", lambda: tk.change_blobs(changed, grids))
    return tk.candidates(split, occ, grids, sizes, p).groupBy("set_id", "step", "kind", F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(
        F.count("*").alias("n"), F.sum("size").alias("voxels"), F.sum("covered").alias("covered"))


@query("change_objects")
def change_objects(spark, sf):
    blobs = m._once(spark, sf, "blobs", lambda: tk.kept_blobs(_split(spark, sf), _cands(spark, sf)))
    objects, _ = tk.track(_occ(spark, sf), blobs, m.splat_grids(spark, sf), m.splat_sizes(spark, sf), P, with_labels=False)
    return objects.select("set_id", "id", "added_in", "removed_in", F.concat_ws(",", F.col("present").cast("array<string>")).alias("present"), "voxels", "volume_vox_m3", "moved_from", "moved_to")


@query("change_labels")
def change_labels(spark, sf):
    """The label tables of the tracked objects: the longest of the queries, several short jobs per state."""
    blobs = m._once(spark, sf, "blobs", lambda: tk.kept_blobs(_split(spark, sf), _cands(spark, sf)))
    _, labels = tk.track(_occ(spark, sf), blobs, m.splat_grids(spark, sf), m.splat_sizes(spark, sf), P)
    return ijk(labels)


# ---- hand boxes and labels -----------------------------------------------------------------------------------------

BOXES = """box AS (SELECT s.set_id, p_partkey AS id, p_partkey % 24 - 0.3 AS x0, p_partkey % 24 + p_size % 3 + 0.4 AS x1, floor(p_partkey / 24) - 0.3 AS y0, floor(p_partkey / 24) + p_size % 2 + 0.4 AS y1, 1.0 AS z0, 2.5 + p_size % 2 AS z1
  FROM part, (SELECT DISTINCT CAST(l_suppkey % 4 AS STRING) AS set_id FROM lineitem) s)"""
LABELS = S + ", " + BOXES + """, lab AS (SELECT o.set_id, o.state, o.i, o.j, o.k, max(b.id) AS object_id FROM occ o JOIN dims d ON d.set_id = o.set_id JOIN box b ON b.set_id = o.set_id AND o.i >= greatest(floor(x0), 0) AND o.i < least(ceil(x1), 25)
  AND o.j >= greatest(floor(y0), 0) AND o.j < least(ceil(y1), sy) AND o.k >= floor(z0) AND o.k < least(ceil(z1), 5) GROUP BY ALL)"""


def _boxes(spark, sf):
    m.table(spark, sf, "part").createOrReplaceTempView("part")
    rows = m.sql(spark, sf, BOXES, "SELECT * FROM box", "lineitem")
    d = lambda *cs: F.array(*[F.col(c).cast("double") for c in cs])
    return rows.select("set_id", "id", d("x0", "y0", "z0").alias("lo"), d("x1", "y1", "z1").alias("hi"))


def _labels(spark, sf):
    return m._once(spark, sf, "labels", lambda: vx.voxels_in_boxes(_occ(spark, sf).select("set_id", "state", "vox"), _boxes(spark, sf), m.splat_grids(spark, sf)))


def _label_splats(spark, sf):
    return vx.label_splats(m.splats(spark, sf), _labels(spark, sf), m.splat_grids(spark, sf))


@query("voxels_in_boxes", LABELS + " SELECT * FROM lab")
def voxels_in_boxes(spark, sf):
    return ijk(vx.voxels_in_boxes(_occ(spark, sf).select("set_id", "state", "vox"), _boxes(spark, sf), m.splat_grids(spark, sf)))


@query("occupied_in_objects", LABELS + """, c AS (SELECT DISTINCT set_id, i, j, k FROM occ), w AS (SELECT c.set_id, c.i, c.j, c.k, max(b.id) AS id FROM c JOIN dims d ON d.set_id = c.set_id JOIN box b ON b.set_id = c.set_id AND c.i >= greatest(floor(x0), 0) AND c.i < least(ceil(x1), 25)
  AND c.j >= greatest(floor(y0), 0) AND c.j < least(ceil(y1), sy) AND c.k >= floor(z0) AND c.k < least(ceil(z1), 5) GROUP BY ALL)
SELECT b.set_id, b.id, count(w.id) AS voxels FROM box b LEFT JOIN w ON w.set_id = b.set_id AND w.id = b.id GROUP BY b.set_id, b.id""")
def occupied_in_objects(spark, sf):
    return vx.occupied_in_objects(_occ(spark, sf), _boxes(spark, sf), m.splat_grids(spark, sf))


LS = LABELS + ", ls AS (SELECT c.*, coalesce(l.object_id + 1, 0) AS label FROM cell c LEFT JOIN lab l ON l.set_id = c.set_id AND l.state = c.state AND l.i = c.i AND l.j = c.j AND l.k = c.k)"


@query("label_splats", LS + " SELECT set_id, state, label, count(*) AS n, round(sum(x), 3) AS x FROM ls GROUP BY ALL")
def label_splats(spark, sf):
    return _label_splats(spark, sf).groupBy("set_id", "state", "label").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("x"))


@query("layer_stats", LS + " SELECT set_id, state, count(*) AS splats, count(*) FILTER (label > 0) AS labelled FROM ls GROUP BY ALL")
def layer_stats(spark, sf):
    return vx.layer_stats(_label_splats(spark, sf))


@query("extract_object", LS + " SELECT set_id, state, splat_id, label FROM ls WHERE label > 0")
def extract_object(spark, sf):
    return vx.labelled(_label_splats(spark, sf)).select("set_id", "state", "splat_id", "label")


@query("object_sample", LS + " SELECT set_id, state, label, splat_id, n FROM (SELECT *, row_number() OVER (PARTITION BY set_id, state, label ORDER BY splat_id) AS n FROM ls WHERE label > 0) WHERE n % 3 = 0")
def object_sample(spark, sf):
    return vx.every_third(_label_splats(spark, sf), chunk=1 << 44).select("set_id", "state", "label", "splat_id", "n")


@query("outline_points", LS + """, s AS (SELECT *, n / 3 - 1 AS at_, count(*) OVER (PARTITION BY set_id, state, label) AS total FROM (SELECT *, row_number() OVER (PARTITION BY set_id, state, label ORDER BY splat_id) AS n FROM ls WHERE label > 0) WHERE n % 3 = 0)
SELECT set_id, state, label, splat_id FROM s WHERE CAST(at_ AS BIGINT) % greatest(1, total // 2) = 0""")
def outline_points(spark, sf):
    return vx.outline_points(vx.every_third(_label_splats(spark, sf), chunk=1 << 44), most=2).select("set_id", "state", "label", "splat_id")


@query("top_view", S + """, px AS (SELECT set_id, state, CAST(floor(x * 2) AS INTEGER) AS u, CAST(floor(z * 2) AS INTEGER) AS w FROM splats WHERE opacity > 0.35 AND y > 0.12 AND y < 50 AND x * 2 < 40 AND z * 2 < 8),
c AS (SELECT set_id, state, u, 7 - w AS v, count(*) AS n FROM px GROUP BY ALL) SELECT set_id, state, u, v, n, round(ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY set_id, state)) * 255, 4) AS value FROM c""")
def top_view(spark, sf):
    from roomdiff.functions import geometry as g
    zero = F.lit(0.0)
    rooms = m.splat_grids(spark, sf).select("set_id", g.box([zero, zero, zero], [F.lit(20.0), F.lit(50.0), F.lit(4.0)]).alias("room"))
    return vx.top_view(m.splats(spark, sf), rooms, ppm=2).withColumn("value", F.round("value", 4))
