"""Drafts and the action log, on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import mapped as m
from checks.registry import query
from checks.scene_queries import CHAIN
from roomdiff.functions.stage import new_folder
from roomdiff.operators import actions as act
from roomdiff.operators import drafts as dr
from roomdiff.operators import scene
from roomdiff.streaming import sessions

P = "WITH " + m.WORN + ", " + m.PUT
WP = "WITH RECURSIVE " + CHAIN.rstrip() + ", " + m.PUT


def _reviewed(spark, sf):
    return dr.review(m.drafts(spark, sf), m.branches(spark, sf), m.stores(spark, sf), m.objects(spark, sf))


@query("draft_seeds", "WITH " + m.WORN + " SELECT set_id, state AS base, count(*) AS n, round(sum(x), 4) AS x, round(sum(z), 4) AS z FROM worn GROUP BY set_id, state")
def draft_seeds(spark, sf):
    bases = m.states(spark, sf).select("set_id", F.col("state").alias("base"))
    put = dr.seeds(m.objects(spark, sf), bases).select("set_id", "base", F.inline("seed"))
    return put.groupBy("set_id", "base").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("x"), F.round(F.sum("z"), 4).alias("z"))


REVIEW = """, lay AS (SELECT set_id, draft, id, base, list({'o': object, 'x': x, 'z': z} ORDER BY nth) AS l FROM put GROUP BY set_id, draft, id, base),
seed AS (SELECT set_id, state AS base, list({'o': id, 'x': x, 'z': z} ORDER BY id) AS l FROM worn GROUP BY set_id, state),
top AS (SELECT set_id, max(coalesce(id, 0)) AS seq FROM lay GROUP BY set_id),
rev AS (SELECT lay.set_id, lay.draft, lay.id, lay.base, CASE WHEN lay.id IS NULL THEN 'Draft ' || (seq + 1) ELSE 'Draft ' || lay.id END AS name,
  CASE WHEN lay.id IS NULL THEN lay.l IS DISTINCT FROM seed.l ELSE lay.id % 7 = 0 OR lay.id % 3 = 0 END AS dirty, lay.id IS NOT NULL AS saved
  FROM lay JOIN top ON top.set_id = lay.set_id LEFT JOIN seed ON seed.set_id = lay.set_id AND seed.base = lay.base)"""


@query("draft_review", P + REVIEW + " SELECT set_id, draft, id, base, name, dirty, id IS NULL OR dirty AS can_save, saved FROM rev")
def draft_review(spark, sf):
    return _reviewed(spark, sf)


@query("draft_save", P + REVIEW + """, new AS (SELECT r.set_id, seq + row_number() OVER (PARTITION BY r.set_id ORDER BY draft) AS id FROM rev r JOIN top ON top.set_id = r.set_id WHERE r.id IS NULL)
SELECT set_id, id, 'Draft ' || id AS name FROM new UNION ALL SELECT set_id, id, name FROM rev WHERE id IS NOT NULL""")
def draft_save(spark, sf):
    open_drafts = m.drafts(spark, sf).withColumn("at", F.lit(1).cast("bigint"))
    merged, _ = dr.save(m.branches(spark, sf), m.stores(spark, sf), open_drafts, _reviewed(spark, sf))
    return merged.select("set_id", "id", "name")


@query("placed_by_object", P + " SELECT set_id, draft, object AS id, count(*) AS n FROM put GROUP BY set_id, draft, object")
def placed_by_object(spark, sf):
    return dr.placed_by_object(m.drafts(spark, sf))


@query("placed_by_thing", WP + " SELECT p.set_id, p.draft, c.root, 'Thing ' || c.thing AS name, count(*) AS n FROM put p JOIN chain c ON c.set_id = p.set_id AND c.id = p.object GROUP BY p.set_id, p.draft, c.root, c.thing")
def placed_by_thing(spark, sf):
    return dr.placed_by_thing(m.drafts(spark, sf), m.objects(spark, sf), m.chain(spark, sf))


@query("plan_view_draft", P + """, num AS (SELECT *, count(*) OVER (PARTITION BY set_id, draft, object) AS c, row_number() OVER (PARTITION BY set_id, draft, object ORDER BY nth) AS i FROM put),
home AS (SELECT DISTINCT set_id, id, thing, x, z FROM worn)
SELECT n.set_id, n.draft, n.object AS id, 'Thing ' || thing || CASE WHEN c > 1 THEN ' ' || i ELSE '' END AS label, round(n.x - h.x, 6) AS shift_x, round(n.z - h.z, 6) AS shift_z
FROM num n JOIN home h ON h.set_id = n.set_id AND h.id = n.object""")
def plan_view_draft(spark, sf):
    rows = scene.draft_marks(m.drafts(spark, sf).drop("id"). withColumn("id", F.col("draft")), m.objects(spark, sf))
    return rows.select("set_id", "draft", "id", "label", F.round("shift_x", 6).alias("shift_x"), F.round("shift_z", 6).alias("shift_z"))


@query("draft_fit", P + """, kept AS (SELECT p.set_id, p.draft AS id, min(p.base) AS base, count(*) AS had, count(*) FILTER (object % 16 = 0) AS n FROM put p WHERE p.id IS NOT NULL GROUP BY p.set_id, p.draft)
SELECT set_id, id, CASE WHEN base + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END < 4 THEN base + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END END AS base, n,
  n <> had OR base + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END >= 4 AS changed FROM kept""")
def draft_fit(spark, sf):
    known = m.objects(spark, sf).withColumn("id", F.when(F.col("id") % 16 == 0, F.col("id")).otherwise(F.lit(-1)))
    sizes = m.sizes(spark, sf).select("set_id", F.lit(4).alias("n_states"))
    return dr.fit(m.branches(spark, sf), known, sizes).select("set_id", "id", "base", F.size("placements").cast("bigint").alias("n"), "changed")


@query("draft_measure", P + " SELECT set_id, draft, count(*) || ' placed' AS text, 1 AS n FROM put GROUP BY set_id, draft")
def draft_measure(spark, sf):
    return dr.measure(m.drafts(spark, sf)).select("set_id", "draft", F.inline("attempts"))


@query("draft_summary", P + REVIEW + """ SELECT set_id, draft, name, len(l) || ' placed · ' || CASE WHEN NOT saved THEN 'not saved yet' WHEN dirty THEN 'unsaved changes' ELSE 'saved 00:00' END AS status
FROM rev JOIN lay USING (set_id, draft)""")
def draft_summary(spark, sf):
    return dr.summary(m.drafts(spark, sf), _reviewed(spark, sf), m.branches(spark, sf))


REPLAY = """
WITH RECURSIVE raw AS (SELECT CAST(user_id % 25 AS VARCHAR) AS set_id, user_id // 25 AS draft, event_id AS seq, CAST(floor(value) AS BIGINT) AS key, value AS x,
    CASE WHEN event_type = 'error' THEN 'drop' WHEN event_type = 'view' THEN 'pick' ELSE 'place' END AS verb,
    min(event_id) OVER (PARTITION BY user_id, CAST(floor(value) AS BIGINT)) AS first FROM events),
life AS (SELECT set_id, draft, key % 7 AS id, key, min(seq) AS first, min(seq) FILTER (verb = 'drop' AND seq > first) AS dropped, max(seq) AS seq,
    arg_max(CASE WHEN seq = first THEN 'place' ELSE verb END, seq) AS verb, arg_max(x, seq) AS x FROM raw GROUP BY set_id, draft, key),
tick AS (SELECT *, row_number() OVER (PARTITION BY set_id, draft, id ORDER BY seq, kind, key) AS n
         FROM (SELECT set_id, draft, id, key, first AS seq, 1 AS kind FROM life UNION ALL SELECT set_id, draft, id, key, dropped, 0 FROM life WHERE dropped IS NOT NULL)),
fold AS (SELECT DISTINCT set_id, draft, id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS down, CAST([] AS BIGINT[]) AS ok FROM life
    UNION ALL SELECT f.set_id, f.draft, f.id, t.n,
        CASE WHEN kind = 0 THEN list_filter(down, lambda k: k <> t.key) WHEN len(down) < 4 THEN list_append(down, t.key) ELSE down END,
        CASE WHEN kind = 1 AND len(down) < 4 THEN list_append(ok, t.key) ELSE ok END
    FROM fold f JOIN tick t ON t.set_id = f.set_id AND t.draft = f.draft AND t.id = f.id AND t.n = f.n + 1),
final AS (SELECT set_id, draft, id, arg_max(ok, n) AS ok FROM fold GROUP BY set_id, draft, id)
SELECT l.set_id, l.draft, l.key, l.id, l.x, 0.0 AS z, l.seq FROM life l JOIN final f ON f.set_id = l.set_id AND f.draft = l.draft AND f.id = l.id
WHERE l.verb = 'place' AND list_contains(f.ok, l.key)"""


@query("draft_replay", REPLAY)
def draft_replay(spark, sf):
    e = m.table(spark, sf, "events")
    verb = F.when(F.col("event_type").isin("error"), "drop").when(F.col("event_type") == "view", "pick").otherwise("place")
    rows = e.select((F.col("user_id") % 25).cast("string").alias("set_id"), F.floor(F.col("user_id") / 25).alias("draft"), F.col("event_id").alias("seq"), verb.alias("verb"),
                    F.floor(F.col("value")).cast("bigint").alias("key"), (F.floor(F.col("value")) % 7).cast("bigint").alias("id"), F.col("value").alias("x"), F.lit(0.0).alias("z"))
    first = rows.groupBy("set_id", "draft", "key").agg(F.min("seq").alias("first"))
    opened = rows.join(first, ["set_id", "draft", "key"]).withColumn("verb", F.when(F.col("seq") == F.col("first"), "place").otherwise(F.col("verb"))).drop("first")
    return dr.replay(opened)


@query("next_picks", """WITH e AS (SELECT CAST(user_id % 25 AS STRING) AS set_id, CAST(floor(user_id / 25) AS BIGINT) AS draft, event_id AS seq, CASE WHEN event_type = 'view' THEN event_id END AS pick FROM events)
SELECT set_id, draft, seq, min(pick) OVER (PARTITION BY set_id, draft ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_pick FROM e""")
def next_picks(spark, sf):
    """For each event of a draft, when the hand takes up its next one; chunks are small here so that the answer often lies in a later one."""
    rows = m.table(spark, sf, "events").select((F.col("user_id") % 25).cast("string").alias("set_id"), F.floor(F.col("user_id") / 25).alias("draft"), F.col("event_id").alias("seq"),
                                               F.when(F.col("event_type") == "view", "pick").otherwise("place").alias("verb"))
    return dr.with_next_pick(rows, 1 << 8).select("set_id", "draft", "seq", "next_pick")


@query("store_scan", P + """, b AS (SELECT set_id, draft, any_value(base) AS base, count(*) AS n FROM put GROUP BY set_id, draft) SELECT set_id, draft AS id, 'Draft ' || draft AS name, CASE WHEN draft % 2 = 0 THEN base END AS base, n - n // 3 AS n,
  1 AS tries, max(draft) OVER (PARTITION BY set_id) AS seq FROM b""")
def store_scan(spark, sf):
    """The drafts written out as one JSON document per set with junk mixed in, and read back."""
    d = m.drafts(spark, sf)
    good = F.transform("placements", lambda p, i: F.when((i + 1) % 3 == 0, F.format_string('{"id": "bad", "x": %s}', p["x"].cast("string")))
                       .otherwise(F.format_string('{"id": %d, "x": %s, "z": %s}', p["id"], p["x"].cast("string"), p["z"].cast("string"))))
    one = F.format_string('{"id": %d, "name": "Draft %d", "base": %s, "placements": [%s], "attempts": ["1 placed", 4], "savedAt": 5}', "draft", "draft",
                          F.when(F.col("draft") % 2 == 0, F.col("base").cast("string")).otherwise('"none"'), F.array_join(good, ", "))
    raw = d.select("set_id", one.alias("j")).groupBy("set_id").agg(F.concat(F.lit('{"seq": 1, "drafts": [{"id": "no"}, 7, '), F.array_join(F.collect_list("j"), ", "), F.lit("]}")).alias("json"))
    stores, branches = dr.parse_stores(raw)
    return branches.join(stores, "set_id").select("set_id", "id", "name", "base", F.size("placements").alias("n"), F.size("attempts").alias("tries"), "seq")


# ---- actions -------------------------------------------------------------------------------------------------------

LOG = """WITH log AS (SELECT CAST(user_id AS STRING) AS session, event_id AS id, epoch_us(ts) // 100000 AS us, event_type AS verb, props AS detail, value FROM events)"""


@query("amend", LOG + """, f AS (SELECT *, CASE WHEN verb = lag(verb) OVER w THEN 0 ELSE 1 END AS fresh FROM log WINDOW w AS (PARTITION BY session ORDER BY id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY id) AS run FROM f)
SELECT session, min(id) AS id, min(verb) AS verb, count(*) AS folded, arg_max(detail, id) AS detail, arg_max(us, id) // 1000 AS ms FROM r GROUP BY session, run""")
def amend(spark, sf):
    return act.amend(m.actions(spark, sf)).select("session", "id", "verb", "folded", "detail", F.unix_millis("ts").alias("ms"))


G = LOG + """, g AS (SELECT *, value / 10.0 + 1.0 AS px, CASE WHEN verb = 'click' THEN value / 50.0 ELSE 0.0 END AS d, CASE WHEN verb IN ('view', 'signup') THEN 1.0 + value / 100.0 ELSE 1.0 END AS gr,
  verb IN ('error', 'purchase') AS swing, (id % 10) * 60 AS held FROM log),
h AS (SELECT *, CASE WHEN swing THEN 2.0 ELSE px * gr + d END AS qx, 1.6 * gr AS qy, CASE WHEN swing THEN -px ELSE 2.0 * gr END AS qz FROM g),
k AS (SELECT *, sqrt(px * px + 1.6 * 1.6 + 4.0) AS d0, sqrt((qx - d) * (qx - d) + qy * qy + qz * qz) AS d1, px * (qx - d) + 1.6 * qy + 2.0 * qz AS dot FROM h),
mo AS (SELECT *, d AS pan, abs(d1 - d0) AS dolly, acos(least(greatest(dot / (d0 * d1), -1.0), 1.0)) * d0 AS orbit FROM k),
cl AS (SELECT session, id, us + held * 1000 AS us, d0, d1, greatest(pan, dolly, orbit) AS most, CASE WHEN pan >= dolly AND pan >= orbit THEN 'pan' WHEN dolly >= orbit THEN 'dolly' ELSE 'orbit' END AS moved_verb, held,
  CASE WHEN pan >= dolly AND pan >= orbit THEN '→ ' || format('{:.2f} 0.00 0.00', CASE WHEN d * 8 = floor(d * 8) AND CAST(d * 8 AS BIGINT) % 2 = 1 THEN d * (1 + 1e-12) ELSE d END) END AS detail FROM mo),
moves AS (SELECT * FROM cl WHERE most >= CASE WHEN held < 250 THEN 0.05 ELSE 0.01 END)"""


@query("gestures", G + " SELECT session, us // 1000 AS ms, moved_verb AS verb, round(most, 6) AS most, round(d0, 6) AS d0, round(d1, 6) AS d1, detail AS pan FROM moves")
def gestures(spark, sf):
    moves = act.classify(m.gestures(spark, sf))
    return moves.select("session", F.unix_millis("ts").alias("ms"), "verb", F.round("most", 6).alias("most"), F.round("d0", 6).alias("d0"), F.round("d1", 6).alias("d1"),
                        F.when(F.col("verb") == "pan", F.col("detail")).alias("pan"))


ZOOM = G + """, f AS (SELECT *, CASE WHEN moved_verb = 'dolly' AND lag(moved_verb) OVER w = 'dolly' AND us - lag(us) OVER w < 800000 THEN 0 ELSE 1 END AS fresh FROM moves WINDOW w AS (PARTITION BY session ORDER BY us)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY us) AS run FROM f),
z AS (SELECT session, run, min(us) AS s, max(us) AS e, arg_min(d0, us) AS d0, arg_max(d1, us) AS d1, count(*) AS ticks FROM r WHERE moved_verb = 'dolly' GROUP BY session, run)"""


@query("dolly_sessions", ZOOM + " SELECT session, s // 1000 AS started, e // 1000 AS ended, round(d0, 6) AS d0, round(d1, 6) AS d1, ticks FROM z WHERE abs(d1 - d0) >= 0.01")
def dolly_sessions(spark, sf):
    z = act.dolly_sessions(act.classify(m.gestures(spark, sf)))
    return z.select("session", F.unix_millis("started").alias("started"), F.unix_millis("ts").alias("ended"), F.round("d0", 6).alias("d0"), F.round("d1", 6).alias("d1"), "ticks")


@query("camera_log", ZOOM + """, rows_ AS (SELECT session, s, e, 'dolly' AS verb, d0, d1 FROM z WHERE abs(d1 - d0) >= 0.01 UNION ALL SELECT session, us, us, moved_verb, d0, d1 FROM moves WHERE moved_verb <> 'dolly'),
ff AS (SELECT *, CASE WHEN verb = 'dolly' AND lag(verb) OVER w = 'dolly' THEN 0 ELSE 1 END AS fresh FROM rows_ WINDOW w AS (PARTITION BY session ORDER BY e)),
rr AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY e) AS run FROM ff)
SELECT session, min(s) // 1000 AS started, max(e) // 1000 AS ended, min(verb) AS verb FROM rr GROUP BY session, run""")
def camera_log(spark, sf):
    log = act.camera_log(act.classify(m.gestures(spark, sf)))
    return log.select("session", F.unix_millis("started").alias("started"), F.unix_millis("ts").alias("ended"), "verb")


@query("last_actions", LOG + " SELECT session, id, n FROM (SELECT session, id, row_number() OVER (PARTITION BY session ORDER BY id DESC) AS n FROM log) WHERE n <= 5")
def last_actions(spark, sf):
    return scene.last_actions(m.actions(spark, sf), 5).select("session", "id", "n")


def _snapped(spark, sf):
    a = m.actions(spark, sf)
    draft = F.when(F.col("id") % 2 == 0, F.struct((F.col("session").cast("bigint")).alias("id"), (F.col("id") % 5).cast("int").alias("base")))
    return a.select("session", "id", "ts", "verb", "detail", F.struct((F.col("id") % 5).cast("int").alias("head"), draft.alias("draft")).alias("snap"))


@query("restore", LOG + """, top AS (SELECT session, max(id) AS last, min(id) AS first FROM log GROUP BY session) SELECT l.session, last + 1 AS id, 'restore' AS verb, '#' || lpad(CAST(l.id AS STRING), CAST(greatest(2, length(CAST(l.id AS STRING))) AS INTEGER), '0') || ' ' || l.verb AS detail,
 CAST(l.id % 5 AS INTEGER) AS head, CASE WHEN l.id % 2 = 0 AND CAST(l.session AS BIGINT) % 4 <> 0 THEN CAST(l.session AS BIGINT) END AS branch FROM top JOIN log l ON l.session = top.session AND l.id = top.first WHERE last > first""")
def restore(spark, sf):
    log = _snapped(spark, sf)
    asked = log.groupBy("session").agg(F.min("id").alias("id")).select("session", "id", (F.col("session").cast("bigint") % 25).cast("string").alias("set_id"), F.current_timestamp().alias("ts"))
    return act.restore(log, asked, m.branches(spark, sf)).select("session", "id", "verb", "detail", F.col("snap.head").alias("head"), F.col("snap.draft.id").alias("branch"))


@query("state_as_of", LOG + """, q AS (SELECT session, min(us) + 1000000 AS t FROM log GROUP BY session) SELECT q.session, arg_max(l.id, l.us) AS id FROM q JOIN log l ON l.session = q.session AND l.us <= q.t GROUP BY q.session""")
def state_as_of(spark, sf):
    log = _snapped(spark, sf)
    asked = log.groupBy("session").agg(F.timestamp_micros(F.min(F.unix_micros("ts")) + 1000000).alias("at"))
    return act.state_as_of(log, asked).select("session", "id")


@query("action_append", LOG + """, n AS (SELECT session, count(*) AS n, max(id) AS top FROM log GROUP BY session) SELECT session, top + n AS id, n FROM n""")
def action_append(spark, sf):
    log = _snapped(spark, sf)
    more = act.append(log, log.drop("id"))
    return more.groupBy("session").agg(F.max("id").alias("id"), F.count_distinct("id").alias("n"))


@query("action_stream", LOG + """ SELECT session, row_number() OVER (PARTITION BY session ORDER BY id % 3 <> 0, us, verb, detail) AS id, verb, detail FROM log""")
def action_stream(spark, sf):
    """The log as a stream in two runs: a third of the events first, then the others, numbered on from where each session stood."""
    a = _snapped(spark, sf).select("session", "id", "ts", "verb", "detail", F.lit(None).cast("string").alias("snap"))
    inbox, check = new_folder(spark, "inbox"), new_folder(spark, "check")
    log = sessions.ActionLog(spark, new_folder(spark, "log"))
    for part in ("id % 3 = 0", "id % 3 <> 0"):
        a.filter(part).drop("id").write.mode("append").parquet(inbox)
        log.start(spark.readStream.schema(a.drop("id").schema).parquet(inbox), check).awaitTermination()
    return log.read().select("session", "id", "verb", "detail")
