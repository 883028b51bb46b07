"""Questions over things, states and the standard, on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import mapped as m
from checks.registry import query
from roomdiff.operators import scene

# The same answers worked out in SQL: links from the order of ids, chains by recursion, places by the first id worn.
CHAIN = m.WORN + """,
obj AS (SELECT set_id, thing, id, x, z, min(state) AS added_in, count(*) AS n_present, lag(id) OVER (PARTITION BY set_id, thing ORDER BY id) AS moved_from
  FROM worn GROUP BY set_id, thing, id, x, z),
chain AS (SELECT set_id, thing, id AS root, id, 0 AS pos FROM obj WHERE moved_from IS NULL
  UNION ALL SELECT c.set_id, c.thing, c.root, o.id, c.pos + 1 FROM chain c JOIN obj o ON o.set_id = c.set_id AND o.moved_from = c.id),
place AS (SELECT DISTINCT ON (c.set_id, c.root, w.state) c.set_id, c.thing, c.root, w.state, w.id, w.x, w.z FROM chain c JOIN worn w ON w.set_id = c.set_id AND w.id = c.id
  ORDER BY c.set_id, c.root, w.state, c.pos),
states AS (SELECT DISTINCT set_id, state FROM worn),
pair AS (SELECT DISTINCT set_id, CASE WHEN state > 2 THEN 2 WHEN state = 0 THEN 0 ELSE state - 1 END AS a, CASE WHEN state = 0 THEN 1 ELSE state END AS b FROM states),
both_ AS (SELECT coalesce(p.set_id, q.set_id) AS set_id, coalesce(p.a, q.a) AS a, coalesce(p.b, q.b) AS b, coalesce(p.root, q.root) AS root, coalesce(p.thing, q.thing) AS thing,
  p.id AS p_id, q.id AS q_id, p.x AS px, p.z AS pz, sqrt((p.x - q.x) * (p.x - q.x) + (p.z - q.z) * (p.z - q.z)) AS gap
  FROM (SELECT pair.a, pair.b, place.* FROM pair JOIN place ON place.set_id = pair.set_id AND place.state = pair.a) p
  FULL JOIN (SELECT pair.a, pair.b, place.* FROM pair JOIN place ON place.set_id = pair.set_id AND place.state = pair.b) q
  ON p.set_id = q.set_id AND p.a = q.a AND p.b = q.b AND p.root = q.root),
change AS (SELECT set_id, a, b, root, 'Thing ' || thing AS name, CASE WHEN p_id IS NULL THEN 'added' WHEN q_id IS NULL THEN 'removed' WHEN gap > 0.05 THEN 'moved' ELSE 'same' END AS kind,
  coalesce(q_id, p_id) AS id, p_id, gap, px, pz, thing FROM both_),
drift AS (SELECT set_id, a AS standard, b AS head, root, name, CASE kind WHEN 'same' THEN 'keep' WHEN 'moved' THEN 'move' WHEN 'added' THEN 'remove' ELSE 'add' END AS k,
  CASE WHEN kind <> 'removed' THEN id END AS id, CASE WHEN kind IN ('moved', 'removed') THEN p_id END AS std_id, CASE WHEN kind = 'moved' THEN gap END AS metres,
  CASE WHEN kind IN ('moved', 'removed') THEN px END AS from_x, CASE WHEN kind IN ('moved', 'removed') THEN pz END AS from_z
  FROM (SELECT coalesce(p.set_id, q.set_id) AS set_id, 2 AS a, coalesce(p.b, q.b) AS b, coalesce(p.root, q.root) AS root, 'Thing ' || coalesce(p.thing, q.thing) AS name,
    CASE WHEN p.id IS NULL THEN 'added' WHEN q.id IS NULL THEN 'removed' WHEN sqrt((p.x - q.x) * (p.x - q.x) + (p.z - q.z) * (p.z - q.z)) > 0.05 THEN 'moved' ELSE 'same' END AS kind,
    coalesce(q.id, p.id) AS id, p.id AS p_id, sqrt((p.x - q.x) * (p.x - q.x) + (p.z - q.z) * (p.z - q.z)) AS gap, p.x AS px, p.z AS pz
    FROM (SELECT s.state AS b, place.* FROM states s JOIN place ON place.set_id = s.set_id AND place.state = 2 WHERE s.state <> 2) p
    FULL JOIN (SELECT state AS b, place.* FROM place WHERE state <> 2) q ON p.set_id = q.set_id AND p.b = q.b AND p.root = q.root) d),
roll AS (SELECT s.set_id, 2 AS standard, s.state AS head, s.state = 2 AS is_standard, count(*) FILTER (k = 'move') AS off, count(*) FILTER (k = 'add') AS missing,
  count(*) FILTER (k = 'remove') AS extra, avg(CASE WHEN k = 'move' THEN metres END) AS mean_m
  FROM states s LEFT JOIN drift d ON d.set_id = s.set_id AND d.head = s.state GROUP BY s.set_id, s.state)
"""
W = "WITH RECURSIVE " + CHAIN
R6 = lambda c: F.round(c, 6).alias(c)


def _diff(spark, sf):
    return scene.diff(m.positions(spark, sf), m.pairs(spark, sf), m.names(spark, sf))


def _drift(spark, sf):
    return scene.drift(m.positions(spark, sf), m.heads(spark, sf), m.names(spark, sf))


def _roll(spark, sf):
    return scene.drift_rollup(_drift(spark, sf), m.heads(spark, sf))


@query("drift_rollup", W + "SELECT set_id, standard, head, is_standard, off, missing, extra, round(mean_m, 6) AS mean_m FROM roll")
def drift_rollup(spark, sf):
    return _roll(spark, sf).withColumn("mean_m", F.round("mean_m", 6))


@query("drift", W + "SELECT set_id, standard, head, root, name, k, id, std_id, round(metres, 6) AS metres, round(from_x, 6) AS from_x, round(from_z, 6) AS from_z FROM drift")
def drift(spark, sf):
    return _drift(spark, sf).select("set_id", "standard", "head", "root", "name", "k", "id", "std_id", R6("metres"), R6("from_x"), R6("from_z"))


@query("drift_order", W + """SELECT set_id, head, root, row_number() OVER (PARTITION BY set_id, head ORDER BY CASE k WHEN 'keep' THEN 0 WHEN 'move' THEN 1 WHEN 'remove' THEN 2 ELSE 3 END, root) AS line FROM drift""")
def drift_order(spark, sf):
    from pyspark.sql import Window
    return _drift(spark, sf).select("set_id", "head", "root", F.row_number().over(Window.partitionBy("set_id", "head").orderBy("rank", "root")).alias("line"))


@query("drift_report", W + """SELECT set_id, standard, head, root, CASE k WHEN 'keep' THEN '=' WHEN 'move' THEN 'Δ' WHEN 'remove' THEN '−' ELSE '+' END AS sign, name,
  CASE k WHEN 'keep' THEN 'keep' WHEN 'move' THEN 'must move ' || format('{:.1f} m', metres) WHEN 'remove' THEN 'must remove' ELSE 'must add' END AS value FROM drift""")
def drift_report(spark, sf):
    return scene.drift_report(_drift(spark, sf), m.heads(spark, sf)).drop("rank")


@query("things", W + "SELECT set_id, root, 'Thing ' || min(thing) AS name, string_agg(id, ',' ORDER BY pos) AS ids FROM chain GROUP BY set_id, root")
def things(spark, sf):
    return scene.things(m.objects(spark, sf), m.chain(spark, sf)).select("set_id", "root", "name", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))


@query("thing_of", W + "SELECT c.set_id, c.id, c.root, d.pos, d.id AS member FROM chain c JOIN chain d ON d.set_id = c.set_id AND d.root = c.root")
def thing_of(spark, sf):
    return scene.thing_of(m.roots(spark, sf), m.chain(spark, sf))


@query("objects_at", W + "SELECT set_id, state, id FROM worn")
def objects_at(spark, sf):
    return scene.objects_at(m.objects(spark, sf), m.states(spark, sf)).select("set_id", "state", "id")


@query("id_at", W + "SELECT c.set_id, c.id, s.state, p.id AS worn FROM chain c JOIN states s ON s.set_id = c.set_id LEFT JOIN place p ON p.set_id = c.set_id AND p.root = c.root AND p.state = s.state")
def id_at(spark, sf):
    asked = m.objects(spark, sf).select("set_id", "id").join(m.states(spark, sf).select("set_id", "state"), "set_id")
    return scene.id_at(asked, m.roots(spark, sf), m.positions(spark, sf))


@query("carry", W + """SELECT c.set_id, c.id AS selected, arg_min(w.id, d.pos) AS kept FROM chain c JOIN chain d ON d.set_id = c.set_id AND d.root = c.root
  LEFT JOIN worn w ON w.set_id = d.set_id AND w.id = d.id AND w.state IN (2, 4) GROUP BY c.set_id, c.id""")
def carry(spark, sf):
    asked = m.objects(spark, sf).select("set_id", F.col("id").alias("selected"), F.array(F.lit(2), F.lit(4)).alias("shown"))
    return scene.carry(asked, m.objects(spark, sf), m.roots(spark, sf), m.chain(spark, sf)).drop("shown")


@query("diff", W + "SELECT set_id, a, b, root, name, kind, id, CASE WHEN kind = 'moved' THEN p_id END AS from_id, CASE WHEN kind = 'moved' THEN round(gap, 6) END AS metres FROM change")
def diff(spark, sf):
    return _diff(spark, sf).select("set_id", "a", "b", "root", "name", "kind", "id", "from_id", R6("metres"))


@query("diff_groups", W + """SELECT set_id, a, b, t.title, count(*) FILTER (change.kind = t.kind) AS n FROM change, (VALUES ('same', 'UNCHANGED'), ('moved', 'MOVED'), ('removed', 'REMOVED'), ('added', 'ADDED')) t(kind, title)
  GROUP BY set_id, a, b, t.title""")
def diff_groups(spark, sf):
    return scene.diff_groups(_diff(spark, sf)).select("set_id", "a", "b", "title", "n")


@query("diff_report", W + """SELECT c.set_id, c.a, c.b, c.root, c.name, c.id, CASE kind WHEN 'same' THEN '=' WHEN 'moved' THEN 'Δ' WHEN 'removed' THEN '−' ELSE '+' END AS sign,
  CASE WHEN kind = 'moved' THEN format('{:.1f} m', gap) ELSE '' END AS value, CASE WHEN c.a = 2 THEN 'since the standard' ELSE 'No entry.' END AS doc FROM change c""")
def diff_report(spark, sf):
    entries = m.pairs(spark, sf).filter("a = 2").select("set_id", "a", "b", F.lit("since the standard").alias("doc"), F.lit("ops").alias("by"))
    return scene.diff_report(_diff(spark, sf), entries).drop("title", "by")


@query("status", W + """SELECT set_id, head, standard, CASE WHEN head = 2 THEN 'Standard' WHEN head < 2 THEN 'Before standard' WHEN off + missing > 0 THEN 'Off standard' ELSE 'On standard' END AS text,
  CASE WHEN head = 2 THEN 'std' WHEN head < 2 THEN 'before' WHEN off + missing > 0 THEN 'off' ELSE 'on' END AS cls FROM roll""")
def status(spark, sf):
    return scene.status(m.heads(spark, sf), _roll(spark, sf))


STANDING = """, stood AS (SELECT c.set_id, c.id, s.state AS head, 2 AS standard, c.root, sqrt((p.x - q.x) * (p.x - q.x) + (p.z - q.z) * (p.z - q.z)) AS gap, p.id AS p, q.id AS q
  FROM chain c JOIN states s ON s.set_id = c.set_id LEFT JOIN place p ON p.set_id = c.set_id AND p.root = c.root AND p.state = 2
  LEFT JOIN place q ON q.set_id = c.set_id AND q.root = c.root AND q.state = s.state)"""


@query("standing", W + STANDING + """ SELECT set_id, id, head, standard, root, CASE WHEN p IS NULL THEN 'extra' WHEN q IS NULL THEN 'missing' WHEN gap > 0.05 THEN 'off' ELSE 'match' END AS k,
  CASE WHEN gap > 0.05 THEN round(gap, 6) END AS metres, CASE WHEN p IS NULL THEN 'Not in the standard' WHEN q IS NULL THEN 'Missing from this state'
  WHEN gap > 0.05 THEN format('{:.1f} m from the standard', gap) ELSE 'Where the standard has it' END AS t FROM stood""")
def standing(spark, sf):
    asked = m.objects(spark, sf).select("set_id", "id").join(m.heads(spark, sf), "set_id")
    return scene.standing(asked, m.roots(spark, sf), m.positions(spark, sf)).withColumn("metres", F.round("metres", 6))


@query("months", W + """, first_ AS (SELECT c.set_id, c.root, min(o.added_in) AS first FROM chain c JOIN obj o ON o.set_id = c.set_id AND o.id = c.id GROUP BY c.set_id, c.root),
n AS (SELECT set_id, max(state) + 1 AS n FROM worn GROUP BY set_id),
line AS (SELECT f.set_id, f.root, f.first, t.state, p.id, p.x, p.z FROM first_ f JOIN n ON n.set_id = f.set_id, LATERAL (SELECT unnest(range(n.n))::INTEGER AS state) t
  LEFT JOIN place p ON p.set_id = f.set_id AND p.root = f.root AND p.state = t.state),
gap AS (SELECT *, lag(id) OVER w AS pid, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)) AS d FROM line WINDOW w AS (PARTITION BY set_id, root ORDER BY state))
SELECT set_id, root, state, id, CASE WHEN id IS NULL THEN 'not in room' WHEN pid IS NOT NULL AND d > 0.05 THEN 'moved' WHEN pid IS NULL AND state = first THEN 'arrived' ELSE 'in room' END AS mark,
  CASE WHEN id IS NOT NULL AND d > 0.05 THEN round(d, 6) END AS metres FROM gap""")
def months(spark, sf):
    return scene.months(m.objects(spark, sf), m.chain(spark, sf), m.positions(spark, sf), m.sizes(spark, sf)).withColumn("metres", F.round("metres", 6))


@query("default_pair", W + "SELECT set_id, state AS head, 2 AS standard, CASE WHEN state > 2 THEN 2 WHEN state = 0 THEN 0 ELSE state - 1 END AS a, CASE WHEN state = 0 THEN 1 ELSE state END AS b FROM states")
def default_pair(spark, sf):
    return scene.default_pair(m.heads(spark, sf))


@query("make_standard", """WITH marks AS (SELECT CAST(user_id % 25 AS STRING) AS set_id, CAST(floor((day(ts) - 1) / 6) AS INTEGER) AS state, event_id AS made FROM events)
  SELECT set_id, arg_max(state, made) AS standard FROM marks GROUP BY set_id""")
def make_standard(spark, sf):
    marks = m.table(spark, sf, "events").select((F.col("user_id") % 25).cast("string").alias("set_id"), F.floor((F.dayofmonth("ts") - 1) / 6).cast("int").alias("state"), F.col("event_id").alias("at"))
    return scene.latest_standard(marks)


@query("object_card", W + """SELECT set_id, id, 'Thing ' || thing AS name, '0.4 × 0.4 × 1.0 m' AS dims, CASE WHEN thing % 2 = 0 THEN 'note ' || thing ELSE 'No entry.' END AS doc FROM obj""")
def object_card(spark, sf):
    return scene.object_card(m.objects(spark, sf)).drop("by")


@query("state_details", W + """, day_ AS (SELECT CAST(user_id % 25 AS STRING) AS set_id, CAST(floor((day(ts) - 1) / 6) AS INTEGER) AS state, min(CAST(ts AS DATE)) AS d, count(*) AS n FROM events GROUP BY 1, 2),
held AS (SELECT set_id, state, count(*) AS n_objects FROM worn GROUP BY set_id, state)
SELECT r.set_id, r.head AS state, CASE WHEN r.head = 0 THEN 'UNDATED' ELSE upper(strftime(d, '%-d %b %Y')) END AS date, (r.head + 1) || ' / ' || count(*) OVER (PARTITION BY r.set_id) AS sequence,
  CASE WHEN head = 2 THEN 'STANDARD' WHEN head < 2 THEN 'BEFORE STANDARD' WHEN off + missing > 0 THEN 'OFF STANDARD' ELSE 'ON STANDARD' END AS status,
  CAST(n AS STRING) AS output, '—' AS stoppages, '—' AS changeover, n_objects, CASE WHEN r.head % 2 = 0 THEN 'entry' ELSE 'No entry.' END AS doc
FROM roll r JOIN day_ ON day_.set_id = r.set_id AND day_.state = r.head JOIN held h ON h.set_id = r.set_id AND h.state = r.head""")
def state_details(spark, sf):
    return scene.state_details(m.states(spark, sf), m.objects(spark, sf), scene.status(m.heads(spark, sf), _roll(spark, sf)))


@query("timeline_tags", W + "SELECT set_id, state, CASE WHEN state = 2 THEN 'STANDARD' WHEN state > 2 THEN 'OFF STANDARD' ELSE (state + 1) || ' / ' || count(*) OVER (PARTITION BY set_id) END AS tag FROM states")
def timeline_tags(spark, sf):
    return scene.timeline_tags(m.states(spark, sf), m.heads(spark, sf).select("set_id", "standard").distinct())


MARK = ["id", "label", "tone", "dashed", "faint", "pickable", "link_label"]


@query("plan_view_state", W + "SELECT set_id, state, id, 'Thing ' || thing AS label, 'neutral' AS tone FROM worn")
def plan_view_state(spark, sf):
    return scene.state_marks(m.objects(spark, sf), m.states(spark, sf)).select("set_id", "state", "id", "label", "tone")


@query("plan_view_diff", W + """, day_ AS (SELECT CAST(user_id % 25 AS STRING) AS set_id, CAST(floor((day(ts) - 1) / 6) AS INTEGER) AS state, min(CAST(ts AS DATE)) AS d FROM events GROUP BY 1, 2)
SELECT set_id, a, b, id, CASE kind WHEN 'same' THEN '= ' WHEN 'moved' THEN 'Δ ' WHEN 'removed' THEN '− ' ELSE '+ ' END || name AS label,
  CASE kind WHEN 'added' THEN 'add' WHEN 'removed' THEN 'rem' ELSE 'neutral' END AS tone, kind = 'removed' AS dashed, kind = 'same' AS faint, TRUE AS pickable,
  CASE WHEN kind = 'moved' THEN format('{:.1f} m', gap) END AS link_label FROM change
UNION ALL SELECT c.set_id, a, b, p_id, CASE WHEN a = 0 THEN '—' ELSE strftime(d, '%b') END, 'ghost', TRUE, TRUE, FALSE, NULL FROM change c JOIN day_ ON day_.set_id = c.set_id AND day_.state = a WHERE kind = 'moved'""")
def plan_view_diff(spark, sf):
    return scene.diff_marks(_diff(spark, sf), m.objects(spark, sf), m.states(spark, sf)).select("set_id", "a", "b", *MARK)


@query("plan_view_drift", W + """SELECT set_id, standard, head, id, CASE k WHEN 'keep' THEN '= ' WHEN 'move' THEN 'Δ ' ELSE '− ' END || name AS label, CASE WHEN k = 'keep' THEN 'std' ELSE 'neutral' END AS tone,
  FALSE AS dashed, FALSE AS faint, TRUE AS pickable, CASE WHEN k = 'move' THEN format('{:.1f} m', metres) END AS link_label FROM drift WHERE k <> 'add'
UNION ALL SELECT set_id, standard, head, std_id, CASE WHEN k = 'move' THEN name ELSE '+ ' || name END, 'std', TRUE, FALSE, FALSE, NULL FROM drift WHERE k IN ('move', 'add')""")
def plan_view_drift(spark, sf):
    return scene.drift_marks(_drift(spark, sf), m.objects(spark, sf)).select("set_id", "standard", "head", *MARK)


@query("smallest_mark", m.WORN.join(["WITH ", ""]) + """, pt AS (SELECT CAST(user_id % 25 AS STRING) AS set_id, event_id AS point, value / 10 AS x, (event_id % 60) / 10.0 AS z FROM events),
box AS (SELECT DISTINCT set_id, id, x - 0.2 AS x0, x + 0.2 AS x1, z - 0.2 - (id % 7) / 100.0 AS z0, z + 0.2 AS z1 FROM worn),
hit AS (SELECT pt.set_id, pt.point, b.id, round((b.x1 - b.x0) * (b.z1 - b.z0), 9) AS area FROM pt JOIN box b ON b.set_id = pt.set_id AND pt.x BETWEEN b.x0 AND b.x1 AND pt.z BETWEEN b.z0 AND b.z1)
SELECT pt.set_id, pt.point, round(min(h.area), 6) AS area FROM pt LEFT JOIN hit h ON h.set_id = pt.set_id AND h.point = pt.point GROUP BY pt.set_id, pt.point""")
def smallest_mark(spark, sf):
    o = m.objects(spark, sf)
    deep = F.col("bbox").withField("lo", F.array(F.col("bbox.lo")[0], F.lit(0.0), F.col("bbox.lo")[2] - (F.col("id") % 7) / 100.0))
    marks = o.select("set_id", "id", deep.alias("bbox"), F.lit(True).alias("pickable"), F.lit(0.0).alias("shift_x"), F.lit(0.0).alias("shift_z"))
    pts = m.table(spark, sf, "events").select((F.col("user_id") % 25).cast("string").alias("set_id"), F.col("event_id").alias("point"), (F.col("value") / 10).alias("x"), ((F.col("event_id") % 60) / 10.0).alias("z"))
    hit = scene.smallest_mark_at(pts, marks)
    area = ((F.col("bbox.hi")[0] - F.col("bbox.lo")[0]) * (F.col("bbox.hi")[2] - F.col("bbox.lo")[2]))
    return hit.join(marks.select("set_id", "id", F.round(area, 6).alias("area")), ["set_id", "id"], "left").select("set_id", "point", "area")


@query("site_counts", W + "SELECT set_id, max(state) + 1 AS n_states, count(*) AS present FROM worn GROUP BY set_id")
def site_counts(spark, sf):
    held = scene.presence(m.objects(spark, sf)).groupBy("set_id").agg(F.count("*").alias("present"))
    return m.sizes(spark, sf).join(held, "set_id")


@query("captured_dates", """WITH d AS (SELECT event_id, ts FROM events) SELECT event_id, strftime(ts, '%-d %b %Y') AS date, strftime(ts, '%-d %b') AS short, strftime(ts, '%b') AS month, strftime(ts, '%Y') AS year,
  strftime(ts, '%H:%M') AS clock, CASE WHEN event_id * 977 >= 1000000 THEN format('{:.1f} M', event_id * 977 / 1000000.0) WHEN event_id * 977 >= 1000 THEN CAST(CAST(round(event_id * 977 / 1000.0) AS BIGINT) AS STRING) || ' k' ELSE CAST(event_id * 977 AS STRING) END AS count FROM d""")
def captured_dates(spark, sf):
    from roomdiff.functions import scalar as s
    e = m.table(spark, sf, "events")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return e.select("event_id", s.date_text(at).alias("date"), s.short_date_text(at).alias("short"), s.month_text(at).alias("month"), s.year_text(at).alias("year"),
                    s.clock_text(F.expr("0L") + F.floor(m.micros() / 1000)).alias("clock"), s.compact(F.col("event_id") * 977).alias("count"))
