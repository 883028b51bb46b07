"""Tracking and registration on scenes whose answer is known: suppliers as boxes that come, shrink and go, parts as points under known motions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import mapped as m
from checks.registry import query
from roomdiff.functions import geometry as g
from roomdiff.functions import voxel as v
from roomdiff.operators import frame as fr
from roomdiff.operators import tracker as tk
from roomdiff.plans import diff, register

# ---- tracking ------------------------------------------------------------------------------------------------------

# A supplier is a box of a * b * h voxels on its own plot, there from state f until it goes at state r (null: it stays). Some lose all but two layers in x one
# state after they came. Under each plot lies a floor. Five states.
BOX = """plot AS (SELECT CAST(s_suppkey % 4 AS STRING) AS set_id, CAST(s_suppkey % 4 AS INTEGER) AS q, CAST(floor(s_suppkey / 4) AS INTEGER) AS n FROM supplier),
life AS (SELECT set_id, n, 6 + (n % 16) * 24 AS x0, CAST(6 + floor(n / 16) * 24 AS INTEGER) AS y0, 4 AS z0, 4 + (n * 7 + q) % 5 AS a, 4 + (n * 3) % 4 AS b, 4 + n % 3 AS h, n % 4 AS f,
  CASE WHEN n % 4 + 1 + CAST(floor(n / 4) AS INTEGER) % 4 <= 4 THEN n % 4 + 1 + CAST(floor(n / 4) AS INTEGER) % 4 END AS r FROM plot),
box AS (SELECT *, n % 7 = 3 AND a >= 7 AND f > 0 AND f < 4 AND (r IS NULL OR r >= f + 2) AS cut FROM life)"""
P = tk.DiffParams(min_voxels=20, floor_band_voxels=1)


def _boxes(spark, sf):
    return m._once(spark, sf, "supplier_boxes", lambda: m.sql(spark, sf, BOX, "SELECT * FROM box", "supplier"))


def _room(spark, sf):
    """(occupancy, grids, sizes)."""
    box = _boxes(spark, sf)
    at = lambda lo, n: F.explode(F.sequence(lo, lo + n - 1))
    states = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("state")
    solid = box.select("*", at(F.col("x0"), F.col("a")).alias("i")).select("*", at(F.col("y0"), F.col("b")).alias("j")).select("*", at(F.col("z0"), F.col("h")).alias("k"))
    solid = solid.select("*", states).filter("state >= f and (r is null or state < r) and (not cut or state = f or i < x0 + 2)")
    pad = box.select("set_id", "x0", "y0", at(F.col("x0") - 2, 16).alias("i")).select("*", at(F.col("y0") - 2, 16).alias("j")).select("*", F.lit(0).alias("k"), states)
    occ = m._once(spark, sf, "supplier_occ", lambda: solid.select("set_id", "state", v.pack(F.col("i"), F.col("j"), F.col("k")).alias("vox")).unionByName(
        pad.select("set_id", "state", v.pack(F.col("i"), F.col("j"), F.col("k")).alias("vox"))))
    c = F.lit(0.01)
    grids = m._once(spark, sf, "supplier_grids", lambda: box.groupBy("set_id").agg(F.max("y0").alias("y")).select(
        "set_id", F.lit(1.0).alias("voxel"), F.array(*[F.lit(0.0)] * 3).alias("origin"), F.array(F.lit(400), F.col("y") + 24, F.lit(20)).alias("shape"),
        g.matrix([[c, 0, 0, 0], [0, c, 0, 0], [0, 0, c, 0], [0, 0, 0, 1]]).alias("canon"), F.lit(10.0).alias("calibration_m"), F.lit(100.0).alias("span"),
        F.lit(100.0).alias("ceiling_vox"), F.array(F.lit(-1.0), F.lit(-1.0)).alias("room_lo"), F.array(F.lit(99.0), F.lit(99.0)).alias("room_hi")))
    return occ, grids, grids.select("set_id", F.lit(5).alias("n_states"))


def _tracked(spark, sf, part):
    """Objects or labels, from one run."""
    def make():
        occ, grids, sizes = _room(spark, sf)
        done = diff.run_on_voxels(occ, grids, sizes, P)
        m._once(spark, sf, "supplier_labels", lambda: done.labels)
        return done.objects
    objects = m._once(spark, sf, "supplier_objects", make)
    return objects if part == "objects" else m._once(spark, sf, "supplier_labels", lambda: None)


# A box there from the first state is found when it goes, before those that come in the same step; ids follow steps, then the boxes' first voxels.
# Closed and opened objects of a step are paired by relative size, then ids, each once.
FOUND = "WITH RECURSIVE " + BOX + """,
found AS (SELECT *, CASE WHEN f = 0 THEN r ELSE f END AS step, f = 0 AS late, (a + 2) * (b + 2) * (h + 2) AS voxels FROM box WHERE f > 0 OR r IS NOT NULL),
named AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY step, late DESC, x0, y0) - 1 AS id FROM found),
pair AS (SELECT c.set_id, c.r AS step, c.id AS c, o.id AS o, row_number() OVER (PARTITION BY c.set_id, c.r ORDER BY abs(o.voxels - c.voxels) / c.voxels, c.id, o.id) AS nth
  FROM named c JOIN named o ON o.set_id = c.set_id AND o.step = c.r AND NOT o.late AND abs(o.voxels - c.voxels) <= 0.3 * c.voxels),
pick(set_id, step, nth, cs, os) AS (SELECT DISTINCT set_id, step, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM pair UNION ALL
  SELECT k.set_id, k.step, p.nth, CASE WHEN list_contains(cs, c) OR list_contains(os, o) THEN cs ELSE list_append(cs, c) END,
    CASE WHEN list_contains(cs, c) OR list_contains(os, o) THEN os ELSE list_append(os, o) END FROM pick k JOIN pair p ON p.set_id = k.set_id AND p.step = k.step AND p.nth = k.nth + 1),
last AS (SELECT set_id, unnest(cs) AS c, unnest(os) AS o FROM pick WHERE (set_id, step, nth) IN (SELECT (set_id, step, max(nth)) FROM pick GROUP BY set_id, step))"""


@query("tracked_objects", FOUND + """
SELECT n.set_id, n.id, f AS added_in, r AS removed_in, array_to_string(range(f, coalesce(r, 5)), ',') AS present, voxels, round(voxels * 0.001, 4) AS volume_vox_m3, b.c AS moved_from, t.o AS moved_to,
  round(x0 / 100, 4) AS lx, round(y0 / 100, 4) AS ly, round(z0 / 100, 4) AS lz, round((x0 + a) / 100, 4) AS hx, round((y0 + b) / 100, 4) AS hy, round((z0 + h) / 100, 4) AS hz
FROM named n LEFT JOIN last t ON t.set_id = n.set_id AND t.c = n.id LEFT JOIN last b ON b.set_id = n.set_id AND b.o = n.id""".replace("n.id, f AS", "n.id, n.f AS").replace("(y0 + b)", "(y0 + n.b)"))
def tracked_objects(spark, sf):
    box = lambda side, n, name: F.round(F.col(f"bbox_canon.{side}")[n], 4).alias(name)
    return _tracked(spark, sf, "objects").select(
        "set_id", "id", "added_in", "removed_in", F.concat_ws(",", F.col("present").cast("array<string>")).alias("present"), "voxels", "volume_vox_m3", "moved_from", "moved_to",
        box("lo", 0, "lx"), box("lo", 1, "ly"), box("lo", 2, "lz"), box("hi", 0, "hx"), box("hi", 1, "hy"), box("hi", 2, "hz"))


@query("object_lifetimes", FOUND + " SELECT set_id, id, f AS added_in, r AS removed_in, f AS first, coalesce(r, 5) - 1 AS last, coalesce(r, 5) - f AS n_states FROM named")
def object_lifetimes(spark, sf):
    return tk.lifetimes(_tracked(spark, sf, "objects"))


# A label reaches two steps through faces beyond the box and its rim, but not into the floor's neighbourhood (k < 2). A box cut down keeps two layers and their rim.
@query("tracked_labels", FOUND + """,
spot AS (SELECT n.set_id, n.id, s.state, x0 - 1 AS i0, y0 - 1 AS j0, z0 - 1 AS k0, CASE WHEN cut AND s.state > f THEN x0 + 2 ELSE x0 + a END AS i1, y0 + b AS j1, z0 + h AS k1
  FROM named n, range(5) s(state) WHERE s.state >= f AND (r IS NULL OR s.state < r)),
reach AS (SELECT set_id, id, state, i.i, j.j, k.k FROM spot, LATERAL (SELECT unnest(range(i0 - 2, i1 + 3)) AS i) i, LATERAL (SELECT unnest(range(j0 - 2, j1 + 3)) AS j) j, LATERAL (SELECT unnest(range(k0 - 2, k1 + 3)) AS k) k
  WHERE greatest(i0 - i.i, i.i - i1, 0) + greatest(j0 - j.j, j.j - j1, 0) + greatest(k0 - k.k, k.k - k1, 0) <= 2 AND k.k >= 2)
SELECT set_id, CAST(state AS INTEGER) AS state, id AS object_id, count(*) AS n, sum(i * 1000003 + j * 1009 + k) AS places FROM reach GROUP BY ALL""")
def tracked_labels(spark, sf):
    i, j, k = v.unpack(F.col("vox"))
    labels = _tracked(spark, sf, "labels").select("set_id", "state", "object_id", (i.cast("bigint") * 1000003 + j * 1009 + k).alias("at"))
    return labels.groupBy("set_id", "state", "object_id").agg(F.count("*").alias("n"), F.sum("at").alias("places"))


# A nation is a set of three states; some have no transform for a state, some a refused capture.
HOLES = """state AS (SELECT CAST(n_nationkey AS STRING) AS set_id, n_nationkey AS n, s.state FROM nation, (SELECT 0 AS state UNION ALL SELECT 1 UNION ALL SELECT 2) s),
hole AS (SELECT set_id, concat('no transform for state ', state) AS reason FROM state WHERE (n + state) % 7 = 0 UNION ALL SELECT set_id, 'capture refused at state 1' FROM state WHERE n % 5 = 1 AND state = 1)"""


@query("left_out_sets", "WITH " + HOLES + " SELECT set_id, min(reason) AS reason FROM hole GROUP BY set_id")
def left_out_sets(spark, sf):
    states = m.sql(spark, sf, HOLES, "SELECT * FROM state", "nation")
    known = states.withColumn("m", F.when(F.expr("(n + state) % 7 <> 0"), g.identity()))
    refused = states.filter("n % 5 = 1 and state = 1").select("set_id", "state")
    return diff.left_out(states.groupBy("set_id").agg(F.lit(3).alias("n_states")), known, refused)


# ---- the turn of a room --------------------------------------------------------------------------------------------

# Parts as tall points on the walls of rooms 6 by 4, one room for each residue by five, each turned by its own angle. The SQL tries every angle.
WALLS = """wall AS (SELECT CAST(p_partkey % 5 AS STRING) AS set_id, radians(p_partkey % 5 * 14.25 + 7.5) AS t, p_partkey % 4 AS side, (p_partkey * 7919 % 1009) / 1009 AS along, (p_partkey * 31 % 97) / 97 * 0.02 AS off FROM part),
flat AS (SELECT set_id, t, CASE side WHEN 0 THEN along * 6 WHEN 1 THEN along * 6 WHEN 2 THEN off ELSE 6 + off END AS a, CASE side WHEN 0 THEN off WHEN 1 THEN 4 + off ELSE along * 4 END AS b FROM wall),
turned AS (SELECT set_id, cos(t) * a + sin(t) * b AS x, 1.5 AS y, cos(t) * b - sin(t) * a AS z FROM flat)"""


@query("room_yaw", "WITH " + WALLS + """, swept AS (SELECT set_id, turn, sin(radians(turn * 0.25)) * x + cos(radians(turn * 0.25)) * z AS v FROM turned, range(360) r(turn)),
span AS (SELECT set_id, turn, min(v) AS lo, max(v) AS hi, greatest(1, floor((max(v) - min(v)) / 0.03)) AS bins FROM swept GROUP BY ALL),
bin AS (SELECT set_id, turn, least(bins - 1, floor((v - lo) / (hi - lo) * bins)) AS bin, count(*) AS n FROM swept JOIN span USING (set_id, turn) GROUP BY ALL),
top AS (SELECT set_id, turn, max(n) AS n FROM bin GROUP BY ALL)
SELECT set_id, turn * 0.25 AS yaw_deg FROM top QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY n DESC, turn) = 1""")
def room_yaw(spark, sf):
    return fr.find_yaw(m.sql(spark, sf, WALLS, "SELECT set_id, x, CAST(y AS DOUBLE) AS y, z FROM turned", "part"))


# ---- registration --------------------------------------------------------------------------------------------------

# Parts as points, at least .6 apart in the plane, in rooms of 40 by 25; two captures of each set are turned, scaled and moved. A fifth of the points of a
# capture is not in the first one.
POINT = """point AS (SELECT CAST(p_partkey % 2 AS STRING) AS set_id, CAST(floor(p_partkey / 2) AS INTEGER) AS n,
  floor(p_partkey / 2) % 40 + (p_partkey * 7919 % 1009) / 1009 * 0.4 AS x, floor(floor(p_partkey / 2) / 40) % 25 + (p_partkey * 104729 % 1013) / 1013 * 0.4 AS y,
  floor(floor(p_partkey / 2) / 1000) * 8 + (p_partkey * 31 % 97) / 97 * 6 AS z FROM part)"""
MOTION = {1: (0.9, 0.6, (3.0, -1.0, 2.0)), 2: (-2.2, 1.1, (-40.0, 12.5, 0.5))}          # turn about z, scale, shift


def _points(spark, sf):
    return m._once(spark, sf, "part_points", lambda: m.sql(spark, sf, POINT, "SELECT * FROM point", "part"))


def _motion(turn: float, scale: float, shift: tuple) -> list:
    c, s = F.cos(F.lit(turn)) * scale, F.sin(F.lit(turn)) * scale
    return g.matrix([[c, -s, 0, shift[0]], [s, c, 0, shift[1]], [0, 0, scale, shift[2]], [0, 0, 0, 1]])


def _captures(spark, sf):
    p = _points(spark, sf)
    moved = None
    for state, how in MOTION.items():
        x, y, z = g.place(_motion(*how), F.col("x"), F.col("y"), F.col("z"))
        one = p.select("set_id", F.lit(state).alias("state"), x.alias("x"), y.alias("y"), z.alias("z"))
        moved = one if moved is None else moved.unionByName(one)
    return moved, p.filter("n % 5 <> 0").select("set_id", "x", "y", "z")


BACK = " UNION ALL ".join(f"SELECT {k} AS state, cos({t}) / {s} AS c, sin({t}) / {s} AS s, 1 / {s} AS scale, {d[0]} AS dx, {d[1]} AS dy, {d[2]} AS dz" for k, (t, s, d) in MOTION.items())


@query("registration", "WITH " + POINT + f""", back AS ({BACK})
SELECT set_id, state, round(avg(CASE WHEN n % 5 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS inlier_frac, 0.0 AS rms_frac_span, round(min(c), 5) AS m00, round(min(s), 5) AS m01, round(min(-c * dx - s * dy), 4) AS m03,
  round(min(s * dx - c * dy), 4) AS m13, round(min(scale), 5) AS m22, round(min(-scale * dz), 4) AS m23 FROM point, back GROUP BY set_id, state HAVING count(*) FILTER (n % 5 <> 0) >= 500""")
def registration(spark, sf):
    """Refinement from starts that are off by .004 in the turn and .1 in the shift."""
    moved, first = _captures(spark, sf)
    near = None
    for state, (turn, scale, (dx, dy, dz)) in MOTION.items():
        start = g.inverse(_motion(turn + 0.004, scale, (dx + 0.1 * scale, dy - 0.1 * scale, dz + 0.05 * scale)))
        one = first.select("set_id").distinct().select("set_id", F.lit(state).alias("state"), start.alias("m"))
        near = one if near is None else near.unionByName(one)
    got = register.refine(moved, first, near)
    enough = first.groupBy("set_id").agg(F.count("*").alias("n")).filter(F.col("n") >= register.REFINE_FEWEST)
    cell = lambda r, c, digits: F.round(F.col("m")[r][c], digits).alias(f"m{r}{c}")
    return got.join(enough, "set_id", "left_semi").select("set_id", "state", F.round("inlier_frac", 6).alias("inlier_frac"), F.round("rms_frac_span", 6).alias("rms_frac_span"),
                                                          cell(0, 0, 5), cell(0, 1, 5), cell(0, 3, 4), cell(1, 3, 4), cell(2, 2, 5), cell(2, 3, 4))


@query("registration_start", "WITH " + POINT + """ SELECT set_id, 1 AS state, 1.0 AS fitness, 0.0 AS m00, 1.0 AS m01, -1.0 AS m10, 1.0 AS m22 FROM point GROUP BY set_id""")
def registration_start(spark, sf):
    """The best of the eight starts for captures that are a quarter turn off."""
    unit = _points(spark, sf).select("set_id", ((F.col("x") - 20) / 40).alias("x"), ((F.col("y") - 12.5) / 40).alias("y"), (F.col("z") / 40).alias("z"))
    turned = unit.select("set_id", F.lit(1).alias("state"), (-F.col("y")).alias("x"), F.col("x").alias("y"), "z")
    best = register.pick_candidate(register.score_candidates(turned, unit))
    cell = lambda r, c: (F.round(F.col("m")[r][c], 4) + 0.0).alias(f"m{r}{c}")
    return best.select("set_id", "state", F.round("fitness", 6).alias("fitness"), cell(0, 0), cell(0, 1), cell(1, 0), cell(2, 2))
