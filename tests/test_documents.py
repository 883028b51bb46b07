import json

import pytest
from pyspark.sql import functions as F

from roomdiff.plans import publish as pub
from roomdiff.sources import configs, manifests

EYE = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]
EYE = [[float(x) for x in r] for r in EYE]


def commit(i, **more):
    return {"id": f"c{i}", "index": i, "hash": "abc", "message": "m", "captured": "2024-05-01", "file": f"commits/c{i}.spz", "labels": f"c{i}.bin", "splats": 10, "doc": "", "by": None, **more}


def obj(i, **more):
    return {"id": i, "name": f"N{i}", "added_in": 0, "removed_in": None, "present": [0], "moved_from": None, "moved_to": None, "bbox": [[0, 0, 0], [1, 1, 1]], "voxels": 3, "volume_vox_m3": 0.1, **more}


def doc(**more):
    return {"commits": [commit(0), commit(1, stats={"output": 7, "stoppages": "2"})], "objects": [obj(0), obj(1, name="")], "voxel": 0.05, "origin": [0, 0, 0], "shape": [4, 4, 4],
            "world_from_ref": EYE, "calibration_m": 3.0, "standard": 1, "diffs": {"0-1": {"doc": "x", "by": ""}}, "sites": [{"id": "s", "name": "S", "set": "a"}], **more}


def parsed(spark, *docs):
    raw = spark.createDataFrame([(str(n), d if isinstance(d, str) else json.dumps(d)) for n, d in enumerate(docs)], "set_id string, json string")
    return manifests.parse(raw)


def test_good_manifest_spreads_into_tables(spark):
    m = parsed(spark, doc())
    assert m.violations.collect() == []
    states = {r.state: r for r in m.states.collect()}
    assert states[0].doc is None and states[0].stats is None and states[1].stats == {"output": "7", "stoppages": "2", "changeover": "—"}
    assert [r.name for r in m.objects.orderBy("id").collect()] == ["N0", "object 1"]
    s = m.sets.first()
    assert (s.standard, s.n_states, s.shape, s.room) == (1, 2, [4, 4, 4], None)
    assert tuple(m.diff_entries.first())[1:] == (0, 1, "x", None)
    box = manifests.room_boxes(m.sets).first().room
    assert [round(x, 6) for x in box.hi] == [0.2, 0.2, 0.2]


BROKEN = [
    ("nonsense", ""), (doc(commits=[]), "commits"), (doc(commits=[commit(1)]), "commits[0].index"), (doc(commits=[commit(0, hash="")]), "commits[0].hash"),
    (doc(commits=[commit(0, file="../x"), commit(1)]), "commits[0]"), (doc(objects=[obj(1)]), "objects[0].id"), (doc(objects=[obj(0, present=[5])]), "objects[0].present"),
    (doc(objects=[obj(0, moved_to=4)]), "objects[0].moved_to"), (doc(objects=[obj(0, bbox=[[0, 0], [1, 1, 1]])]), "objects[0].bbox"), (doc(shape=[4, 4, 0.5]), "shape"),
    (doc(world_from_ref=[[1, 0, 0]] * 3), "world_from_ref"), (doc(voxel=0), "voxel"), (doc(room=[[0, 0, 0]]), "room"), (doc(view={"pos": [1, 2, 3]}), "view"),
    (doc(diffs={"1-0": {}}), "diffs.1-0"), (doc(sites=[{"id": "a", "name": "b", "set": "x/y"}]), "sites[0].set")]


def test_each_broken_field_is_named(spark):
    got = {(r.set_id, r.path) for r in parsed(spark, *[bad for bad, _ in BROKEN]).violations.collect()}
    assert not {(str(n), path) for n, (_, path) in enumerate(BROKEN)} - got


def config(**more):
    return {"calibration_m": 4.0, "commits": [{"file": "a.ply", "message": "m", "captured": "2024-05-01"}] * 3, "diff": {"min_voxels": "30"}, "objects": {"0": "Fan", "2": {"name": "Rack", "kind": "thing"}},
            "exclude": [1], "removed": {"0": 2}, "standard": 1, "diffs": {"0-2": {"doc": "d"}}, **more}


def read(spark, *docs, **kw):
    return configs.parse(spark.createDataFrame([(str(n), json.dumps(d)) for n, d in enumerate(docs)], "set_id string, json string"), **kw)


def test_config_tables_and_defaults(spark):
    c = read(spark, config())
    assert c.violations.collect() == []
    d = c.params["diff"].first()
    assert (d.min_voxels, d.jitter_voxels, d.coverage_frac) == (30, 2, 0.25)
    assert {(r.id, r.name, r.kind) for r in c.names.collect()} == {(0, "Fan", None), (2, "Rack", "thing")}
    assert [tuple(r) for r in c.removed.collect()] == [("0", 0, 2)] and [tuple(r) for r in c.exclude.collect()] == [("0", 1)]
    files = spark.createDataFrame([("0", "b.ply")], "set_id string, file string")
    assert read(spark, config(), known_files=files).violations.count() == 3


BROKEN_CONFIGS = [
    (config(calibration_m=-1), "calibration_m"), (config(calibration_m="tall"), "calibration_m"), (config(commits=[]), "commits"), (config(diff={"nope": 1}), "diff"),
    (config(diff={"min_voxels": "x"}), "diff.min_voxels"), (config(registration={"up": "left"}), "registration.up"), (config(door="up"), "door"), (config(standard=3), "standard"),
    (config(exclude=["a"]), "exclude"), (config(removed={"a": 1}), "removed"), (config(objects={"x": "n"}), "objects[x]"), (config(objects={"0": {"kind": "thing"}}), "objects[0]"),
    (config(diffs={"2-1": {}}), "diffs.2-1"), (config(commits=[{"file": "a"}]), "commits[0]"), (config(objects={"0": {"name": "a", "box": [[0, 0, 0], [1, 0, 1]]}}), "objects[0].box")]


def test_each_broken_key_is_named(spark):
    bad = read(spark, *[c for c, _ in BROKEN_CONFIGS]).violations
    got = {(r.set_id, r.path) for r in bad.collect()}
    assert not {(str(n), path) for n, (_, path) in enumerate(BROKEN_CONFIGS)} - got
    with pytest.raises(ValueError):
        configs.refuse(bad)


def tracked(spark):
    rows = [("a", 0, 0, None, [0, 1, 2], 50, None, 3), ("a", 1, 0, 2, [0, 1], 9, None, None), ("a", 2, 1, None, [1, 2], 20, None, None), ("a", 3, 2, None, [2], 50, 0, None)]
    df = spark.createDataFrame(rows, "set_id string, id bigint, added_in int, removed_in int, present array<int>, voxels bigint, moved_from bigint, moved_to bigint")
    box = F.struct(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.0)]).alias("lo"), F.array(*[F.lit(x) for x in (0.5, 0.5, 0.125)]).alias("hi"))
    return df.withColumn("volume_vox_m3", F.lit(0.5)).withColumn("bbox_canon", box)


def test_curation_and_round_trip(spark):
    c = read(spark, config(objects={"0": "Fan", "3": "Rack", "2": "Lamp"}))
    ids = c.names.select("set_id", "id").withColumn("set_id", F.lit("a"))
    fix = lambda df: df.withColumn("set_id", F.lit("a"))
    o = tracked(spark)
    assert pub.unknown_ids(o, ids, fix(c.exclude)).count() == 0
    assert pub.unknown_ids(o, spark.createDataFrame([("a", 9)], "set_id string, id bigint")).first().path == "objects[9]"
    out = pub.curate(o, fix(c.names), fix(c.exclude), fix(c.removed), fix(c.sets))
    rows = {r.source_id: r for r in out.collect()}
    assert {s: r.id for s, r in rows.items()} == {0: 0, 2: 1, 3: 2}
    assert rows[0].present == [0, 1] and rows[0].removed_in == 2
    assert rows[0].moved_to is None and rows[3].moved_from is None            # Fan is not Rack
    assert rows[2].bbox.lo == [0.0, 0.0, -2.0] and rows[2].bbox.hi == [2.0, 0.5, -1.0]
    same = pub.curate(o, fix(c.names).filter("id = 2"), fix(c.exclude), fix(c.removed), fix(c.sets)).collect()
    assert {r.source_id: (r.moved_from, r.moved_to, r.name) for r in same}[3] == (0, None, "Object 02")
    lab = spark.createDataFrame([("a", 1, 5, 0), ("a", 2, 5, 0), ("a", 1, 6, 1), ("a", 1, 7, 3)], "set_id string, state int, vox bigint, object_id bigint")
    got = pub.publish_labels(lab, pub.new_ids(o, fix(c.exclude)), fix(c.removed)).collect()
    assert {(r.state, r.vox, r.object_id) for r in got} == {(1, 5, 0), (1, 7, 2)}
    counts = spark.createDataFrame([("a", n, 10) for n in range(3)], "set_id string, state int, splats bigint")
    hashes = counts.select("set_id", "state", F.lit("1234567").alias("hash"))
    states = pub.state_rows(fix(c.states), counts, hashes)
    grid = spark.createDataFrame([("a", 0.1, [0.0] * 3, [4, 4, 4], EYE, 4.0)], "set_id string, voxel double, origin array<double>, shape array<int>, canon array<array<double>>, calibration_m double")
    grid = grid.withColumn("room_canon", F.struct(F.array(*[F.lit(0.0)] * 3).alias("lo"), F.array(*[F.lit(1.0)] * 3).alias("hi")))
    docs = pub.manifests(states, out, pub.rooms(grid), fix(c.sets), fix(c.diff_entries), fix(c.sites))
    back = manifests.parse(docs)
    assert back.violations.collect() == []
    assert {(r.id, r.name, r.present[0], r.source_id) for r in back.objects.collect()} == {(0, "Fan", 0, 0), (1, "Lamp", 1, 2), (2, "Rack", 2, 3)}
    assert back.sets.first().standard == 1 and back.states.count() == 3
    assert tuple(back.diff_entries.first())[1:] == (0, 2, "d", None)


def test_one_way_links_are_reported(spark):
    m = parsed(spark, doc(objects=[obj(0, moved_to=1), obj(1)]))
    assert m.violations.collect() == [] and manifests.link_warnings(m.objects).count() == 1
