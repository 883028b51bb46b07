"""Golden answers on a small hand-written room: four states, the third the standard, seven things in nine ids, two of which move in the last."""

import pytest
from pyspark.sql import functions as F

from roomdiff.operators import drafts as dr
from roomdiff.operators import scene

SCHEMA = ("set_id string, id bigint, name string, present array<int>, added_in int, moved_from bigint, moved_to bigint, x double, z double, doc string, by string")


def objects(spark, rows):
    df = spark.createDataFrame([("a", i, n, p, min(p), f, t, float(x), float(z), None, None) for i, n, p, f, t, x, z in rows], SCHEMA)
    side = lambda d: F.array(F.col("x") + d, F.lit(0.0 if d < 0 else 1.0), F.col("z") + d)
    return df.withColumn("bbox", F.struct(side(-0.2).alias("lo"), side(0.2).alias("hi"))).drop("x", "z").cache()


ROOM = [(0, "Tall plant", [0, 1, 2], None, None, 0, 0), (1, "Small plant", [0, 1, 2], None, None, 1, 0), (2, "Knot", [0, 1, 2, 3], None, None, 2, 0), (3, "Monstera", [1, 2], None, 7, 0, 2),
        (4, "Fan", [2], None, 8, 3, 2), (5, "Lamp", [2, 3], None, None, 1, 3), (6, "Suitcase", [2], None, None, 2, 3), (7, "Monstera", [3], 3, None, 2.6, 2), (8, "Fan", [3], 4, None, 3, 3.4)]


@pytest.fixture(scope="module")
def room(spark):
    o = objects(spark, ROOM)
    r = scene.roots(o).cache()
    c = scene.chains(o, r).cache()
    return o, r, c, scene.positions(o, c).cache(), scene.thing_names(o)


def heads(spark, *rows):
    return spark.createDataFrame([("a", *r) for r in rows], "set_id string, standard int, head int")


def test_things(room):
    o, r, c, _, _ = room
    got = scene.things(o, c).orderBy("root").collect()
    assert [t.name for t in got] == ["Tall plant", "Small plant", "Knot", "Monstera", "Fan", "Lamp", "Suitcase"]
    assert [t.ids for t in got if t.name == "Monstera"] == [[3, 7]]


def test_diff_and_its_mirror(spark, room):
    _, _, _, p, n = room
    pairs = spark.createDataFrame([("a", 2, 3), ("a", 1, 2), ("a", 3, 2)], "set_id string, a int, b int")
    rows = scene.diff(p, pairs, n).orderBy("root").collect()
    of = lambda a, b, k: [(r.name, None if r.metres is None else round(r.metres, 1)) for r in rows if (r.a, r.b, r.kind) == (a, b, k)]
    assert of(2, 3, "moved") == [("Monstera", 2.6), ("Fan", 1.4)]
    assert [x[0] for x in of(2, 3, "removed")] == ["Tall plant", "Small plant", "Suitcase"] and of(2, 3, "added") == []
    assert [x[0] for x in of(1, 2, "added")] == ["Fan", "Lamp", "Suitcase"] and len(of(1, 2, "same")) == 4
    assert of(3, 2, "added") == of(2, 3, "removed") and of(3, 2, "moved") == of(2, 3, "moved")


def test_drift_status_standing_months(spark, room):
    o, r, c, p, n = room
    h = heads(spark, (2, 3), (2, 2), (2, 1))
    lines = scene.drift(p, h, n)
    assert [x.k for x in lines.filter("head = 3").orderBy("rank", "root").collect()] == ["keep", "keep", "move", "move", "add", "add", "add"]
    roll = scene.drift_rollup(lines, h)
    got = {x.head: x for x in roll.collect()}
    assert (got[3].off, got[3].missing, got[3].extra, round(got[3].mean_m, 1)) == (2, 3, 0, 2.0)
    assert got[2].is_standard and got[2].mean_m is None and (got[1].extra, got[1].missing) == (0, 3)
    none = spark.createDataFrame([("a", None, 3)], h.schema)
    assert {(x.head, x.standard, x.text) for x in scene.status(h.unionByName(none), roll).collect()} == {(3, 2, "Off standard"), (2, 2, "Standard"), (1, 2, "Before standard"), (3, None, "—")}
    asked = spark.createDataFrame([("a", i, 3, 2) for i in (7, 6, 2)], "set_id string, id bigint, head int, standard int")
    assert {x.id: x.t for x in scene.standing(asked, r, p).collect()} == {7: "2.6 m from the standard", 6: "Missing from this state", 2: "Where the standard has it"}
    sizes = spark.createDataFrame([("a", 4)], "set_id string, n_states int")
    assert [x.mark for x in scene.months(o, c, p, sizes).filter("root = 3").orderBy("state").collect()] == ["not in room", "arrived", "in room", "moved"]
    kept = scene.carry(spark.createDataFrame([("a", 3, [3]), ("a", 6, [3])], "set_id string, selected bigint, shown array<int>"), o, r, c)
    assert {x.selected: x.kept for x in kept.collect()} == {3: 7, 6: None}


def test_two_hops_are_one_move_and_a_relabel_is_none(spark):
    o = objects(spark, [(0, "Cart", [0], None, 1, 0, 0), (1, "Cart", [1], 0, 2, 1, 0), (2, "Cart", [2], 1, None, 2, 0), (3, "Rack", [0], None, 4, -2, -2), (4, "Rack", [1, 2], 3, None, -2.02, -2.01)])
    p = scene.positions(o, scene.chains(o))
    rows = scene.diff(p, spark.createDataFrame([("a", 0, 2)], "set_id string, a int, b int"), scene.thing_names(o)).collect()
    assert {(r.name, r.kind, r.from_id, r.metres and round(r.metres, 5)) for r in rows} == {("Cart", "moved", 0, 2.0), ("Rack", "same", None, None)}


def walk(links, start, back):
    seen, cur = [], start
    while cur not in seen:
        seen.append(cur)
        nxt = links.get(cur, {}).get(back)
        if nxt is None or nxt not in links:
            return seen, cur
        cur = nxt
    return seen, cur


def test_bad_links_stop_every_walk(spark):
    rows = [(0, 2, 1), (1, 0, 2), (2, 1, 0), (3, 0, None), (4, 99, 5), (5, 4, 98), (6, None, 7), (7, None, None), (8, 9, None), (9, None, None), *[(n, n - 1 if n > 20 else None, n + 1 if n < 29 else None) for n in range(20, 30)]]
    o = objects(spark, [(i, str(i), [0], f, t, 0, 0) for i, f, t in rows])
    links = {i: {"f": f, "t": t} for i, f, t in rows}
    want_root = {i: walk(links, i, "f")[1] for i in links}
    assert {r.id: r.root for r in scene.roots(o).collect()} == want_root
    got = {}
    for r in scene.chains(o).orderBy("root", "pos").collect():
        got.setdefault(r.root, []).append(r.id)
    assert got == {i: walk(links, i, "t")[0] for i in links if want_root[i] == i}


def test_drafts(spark, room):
    o, _, c, _, _ = room
    seed = dr.seeds(o, spark.createDataFrame([("a", 3), ("a", None)], "set_id string, base int")).collect()
    at3 = next(r.seed for r in seed if r.base == 3)
    assert [p.id for p in at3] == [2, 5, 7, 8] and next(r.seed for r in seed if r.base is None) == []
    put = [(p.id, p.x, p.z) for p in at3]
    schema = "set_id string, draft int, id bigint, base int, placements array<struct<id:bigint,x:double,z:double>>, attempts array<struct<n:int,text:string>>"
    moved = [(put[0][0], put[0][1] + 1, put[0][2]), *put[1:]]
    drafts = spark.createDataFrame([("a", 1, None, 3, put, []), ("a", 2, None, 3, moved, []), ("a", 3, None, 3, put, [(1, "4 placed")]), ("a", 4, 1, 3, [(0, 1.0, 2.0)], []), ("a", 5, 7, 3, put, []),
                                    ("a", 6, 1, 3, [(0, 1.5, 2.0)], [])], schema)
    branches = spark.createDataFrame([("a", 1, "Draft 1", 3, [(0, 1.0, 2.0)], [], 5)], "set_id string, id bigint, name string, base int, placements array<struct<id:bigint,x:double,z:double>>, attempts array<string>, saved_at bigint")
    stores = spark.createDataFrame([("a", 2)], "set_id string, seq bigint")
    rev = dr.review(drafts, branches, stores, o).cache()
    assert {r.draft: (r.name, r.dirty, r.can_save) for r in rev.collect()} == {
        1: ("Draft 3", False, True), 2: ("Draft 3", True, True), 3: ("Draft 3", True, True), 4: ("Draft 1", False, False), 5: ("Draft 3", False, False), 6: ("Draft 1", True, True)}
    merged, after = dr.save(branches, stores, drafts.withColumn("at", F.lit(9).cast("bigint")), rev)
    assert {r.name for r in merged.collect()} == {"Draft 1", "Draft 3", "Draft 4", "Draft 5"} and after.first().seq == 5
    two = spark.createDataFrame([("a", 1, None, None, [(3, 0.0, 0.0), (7, 1.0, 0.0)], [])], schema)
    assert [(r.name, r.n) for r in dr.placed_by_thing(two, o, c).collect()] == [("Monstera", 2)]
    assert dr.open_branch(branches, spark.createDataFrame([("a", 9, 1)], "set_id string, draft int, id bigint")).first().placements[0].key == 1
    assert dr.delete(branches, branches.select("set_id", "id")).isEmpty()


def test_stored_junk_is_dropped(spark):
    docs = ["null", '"x"', '{"seq": "1", "drafts": []}', "{", '{"seq": 1, "drafts": [{"id": 2, "name": "Draft 2", "base": 3, "placements": [{"id": 0, "x": 1, "z": 2}, {"id": "bad"}], "attempts": ["1 placed", 4], "savedAt": 5}, {"id": "no"}]}']
    stores, branches = dr.parse_stores(spark.createDataFrame([(str(n), d) for n, d in enumerate(docs)], "set_id string, json string"))
    assert {r.set_id: r.seq for r in stores.collect()} == {"0": 0, "1": 0, "2": 0, "3": 0, "4": 2}
    r = branches.first()
    assert (r.id, r.base, [tuple(p) for p in r.placements], r.attempts, r.saved_at) == (2, 3, [(0, 1.0, 2.0)], ["1 placed"], 5) and branches.count() == 1


def test_a_fifth_copy_is_refused_until_one_is_dropped(spark):
    e = [("place", k, 1) for k in range(1, 6)] + [("drop", 1, 1), ("place", 6, 1), ("pick", 2, 1), ("place", 2, 1), ("pick", 3, 1), ("place", 7, 2)]
    df = spark.createDataFrame([("a", 1, n, v, k, i, float(n), 0.0) for n, (v, k, i) in enumerate(e)], "set_id string, draft int, seq int, verb string, key bigint, id bigint, x double, z double")
    assert {(r.key, r.x) for r in dr.replay(df).collect()} == {(4, 3.0), (6, 6.0), (2, 8.0), (7, 10.0)}


def test_an_object_replaced_in_the_hand_frees_its_slot(spark):
    e = [("pick", 1, 7), ("pick", 2, 8), ("place", 2, 8)] + [x for k in range(3, 7) for x in (("pick", k, 7), ("place", k, 7))] + [("pick", 7, 7), ("place", 7, 7)]
    df = spark.createDataFrame([("a", 1, n, v, k, i, float(n), 0.0) for n, (v, k, i) in enumerate(e)], "set_id string, draft int, seq int, verb string, key bigint, id bigint, x double, z double")
    assert {(r.id, r.key) for r in dr.replay(df).collect()} == {(8, 2), (7, 3), (7, 4), (7, 5), (7, 6)}      # the fifth copy of 7 is one too many


def test_the_smallest_mark_without_pairs(spark, monkeypatch):
    """Crowded tiles: a point meets footprints inside a task, no join makes a row for each pair."""
    import numpy as np
    monkeypatch.setattr(scene, "MOST_POINTS", 64)
    rng = np.random.default_rng(4)
    boxes = [(str(n % 2), n, float(x), float(z), float(x + w), float(z + d)) for n, (x, z, w, d) in enumerate(zip(*rng.uniform(0, 1.8, (2, 300)), *np.round(rng.uniform(0.05, 0.4, (2, 300)), 1)))]
    spots = [(str(n % 3), n // 2, float(x), float(z)) for n, (x, z) in enumerate(rng.uniform(0, 2, (400, 2)))] + [("0", None, 0.5, 0.5), (None, 7, 0.5, 0.5), ("1", 999, None, 0.5)]
    marks = spark.createDataFrame(boxes, "set_id string, id bigint, x0 double, z0 double, x1 double, z1 double").select(
        "set_id", "id", F.struct(F.array("x0", F.lit(0.0), "z0").alias("lo"), F.array("x1", F.lit(1.0), "z1").alias("hi")).alias("bbox"), F.lit(True).alias("pickable"), F.lit(0.0).alias("shift_x"), F.lit(0.0).alias("shift_z"))
    want = {}
    for s, p, x, z in spots:
        hit = [((b[4] - b[2]) * (b[5] - b[3]), b[1]) for b in boxes if b[0] == s and x is not None and b[2] <= x <= b[4] and b[3] <= z <= b[5]]
        want.setdefault((s, p), []).extend(hit)
    out = scene.smallest_mark_at(spark.createDataFrame(spots, "set_id string, point bigint, x double, z double"), marks)
    assert {(r.set_id, r.point): r.id for r in out.collect()} == {k: min(h)[1] if h else None for k, h in want.items()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and not any("Join" in line and "x0" in line for line in plan.splitlines())


def test_tables_that_grow_with_the_input_are_not_broadcast(spark, room):
    o, r, c, places, names = room
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (scene.roots(o), scene.positions(o, c)):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)
    lines = scene.diff(places, heads(spark, (2, 3)).select("set_id", F.col("standard").alias("a"), F.col("head").alias("b")), names)
    assert "Exchange hashpartitioning(set_id" in plan(lines) and plan(lines).count("SortMergeJoin") >= 1
