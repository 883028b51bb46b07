import itertools

import numpy as np
import pytest
from brute import Room
from pyspark.sql import functions as F

from roomdiff.functions import voxel as v
from roomdiff.operators import tracker as tk
from roomdiff.operators.labels import LabelLog
from roomdiff.plans import diff as job
from roomdiff.sources import configs

SHAPE = (20, 20, 10)
P = tk.DiffParams(min_voxels=4, jitter_voxels=1, coverage_voxels=4, label_dilate_voxels=1, floor_band_voxels=1, ceiling_band_voxels=0)


def cube(x, y, z, w, d, h):
    return set(itertools.product(range(x, x + w), range(y, y + d), range(z, z + h)))


FLOOR = cube(0, 0, 0, 20, 20, 1)
GRID = "set_id string, voxel double, origin array<double>, shape array<int>, canon array<array<double>>, calibration_m double, span double, ceiling_vox double, room_lo array<double>, room_hi array<double>"


def tables(spark, rooms):
    eye = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]
    eye = [[float(x) for x in r] for r in eye]
    grids = spark.createDataFrame([(s, 1.0, [0.0] * 3, list(SHAPE), eye, 1.0, 1.0, 100.0, [0.0, 0.0], [20.0, 20.0]) for s in rooms], GRID)
    rows = [(s, n, *c) for s, states in rooms.items() for n, cells in enumerate(states) for c in cells]
    occ = spark.createDataFrame(rows, "set_id string, state int, i int, j int, k int")
    occ = occ.select("set_id", "state", v.pack(F.col("i"), F.col("j"), F.col("k")).alias("vox"))
    sizes = spark.createDataFrame([(s, len(states)) for s, states in rooms.items()], "set_id string, n_states int")
    return occ.cache(), grids.cache(), sizes.cache()


def rooms():
    box, rack = cube(3, 3, 1, 4, 4, 4), cube(12, 3, 1, 3, 3, 5)
    moved = cube(12, 13, 1, 4, 4, 4)
    half = cube(3, 3, 1, 4, 4, 2)
    late = cube(3, 14, 1, 3, 3, 4)
    tale = [FLOOR | late, FLOOR | late | box, FLOOR | box | rack, FLOOR | half | rack, FLOOR | moved, FLOOR | moved]
    rng = np.random.default_rng(5)
    noisy = []
    pool = [cube(*rng.integers(1, 14, 2), 1, *rng.integers(2, 5, 3)) for _ in range(7)]
    for _ in range(4):
        state = set(FLOOR)
        for c in pool:
            if rng.random() < 0.55:
                state |= {x for x in c if rng.random() < 0.9}
        noisy.append(state)
    return {"tale": tale, "noisy": noisy}


def test_tracking_and_labels_match_the_direct_loop(spark):
    cast = rooms()
    occ, grids, sizes = tables(spark, cast)
    got = job.run_on_voxels(occ, grids, sizes, P, bits=3)
    objects = got.objects.cache()
    i, j, k = v.unpack(F.col("vox"))
    labels = got.labels.select("set_id", "state", F.array(i, j, k), "object_id").collect()
    for name, states in cast.items():
        want = Room(SHAPE, states, P)
        rows = sorted(objects.filter(F.col("set_id") == name).collect(), key=lambda r: r.id)
        assert [{c: r[c] for c in ("id", "added_in", "removed_in", "present", "voxels", "moved_from", "moved_to")} for r in rows] == want.objects
        assert len(rows) > 2
        for n, lab in enumerate(want.labels):
            assert {tuple(r[2]): r[3] for r in labels if r[0] == name and r[1] == n} == lab, (name, n)
    tale = {r.id: r for r in objects.filter("set_id = 'tale'").collect()}
    assert any(r.moved_to is not None for r in tale.values())
    assert any(r.added_in == 0 for r in tale.values())


def test_late_objects_that_want_the_same_voxels_go_by_turn(spark):
    """Two late objects reach the same open voxels of an earlier state: together, in rounds, they get what they get one after the other."""
    before = FLOOR | cube(4, 5, 1, 10, 3, 3)
    occ, grids, _ = tables(spark, {"a": [before, FLOOR]})
    spots = {1: cube(4, 5, 1, 3, 3, 3), 2: cube(10, 5, 1, 4, 3, 3)}
    cells = spark.createDataFrame([("a", n, *c) for n, cs in spots.items() for c in cs], "set_id string, id bigint, i int, j int, k int")
    cells = cells.select("set_id", "id", v.pack(F.col("i"), F.col("j"), F.col("k")).alias("vox"))
    now_occ = occ.filter("state = 1").select("set_id", "vox")

    def labelled(*groups):
        log = LabelLog(spark)
        for ids in groups:
            late = spark.createDataFrame([("a", n, n, 0, 1) for n in ids], "set_id string, id bigint, turn int, added_in int, step int")
            tk.backfill(late, cells.filter(F.col("id").isin(*ids)), occ, now_occ, log, grids, P, bits=3)
        return {(r.state, r.vox): r.object_id for r in log.read().collect()}

    together = labelled([1, 2])
    assert together == labelled([1], [2])
    assert sorted(set(together.values())) == [1, 2] and list(together.values()).count(2) == 12      # the second keeps its lowest layer


def test_moves_match_greedy_pairing(spark):
    rng = np.random.default_rng(11)
    closed, opened, want = [], [], set()
    for case in range(60):
        r = [(i, int(s)) for i, s in enumerate(rng.integers(6, 6 + 3 * (1 + case % 6), rng.integers(0, 7)))]
        a = [(100 + i, int(s)) for i, s in enumerate(rng.integers(6, 6 + 3 * (1 + case % 6), rng.integers(0, 7)))]
        closed += [(str(case), 1, *x) for x in r]
        opened += [(str(case), 1, *x) for x in a]
        used = set()
        for _, i, n in sorted((abs(va - vr) / vr, i, n) for i, vr in r for n, va in a if abs(va - vr) <= 0.3 * vr):
            if i not in used and n not in used:
                used |= {i, n}
                want.add((str(case), i, n))
    schema = "set_id string, step int, id bigint, voxels bigint"
    got = tk.match_moves(spark.createDataFrame(closed, schema), spark.createDataFrame(opened, schema))
    assert {(r.set_id, r.moved_from, r.moved_to) for r in got.collect()} == want


def test_one_reason_per_rejected_blob(spark):
    states = [FLOOR | cube(0, 0, 0, 2, 2, 1), FLOOR | cube(9, 9, 4, 1, 1, 1) | cube(3, 3, 2, 3, 3, 1) | cube(14, 3, 2, 3, 3, 5) | cube(3, 13, 7, 3, 3, 3) | cube(15, 14, 2, 4, 3, 3)]
    occ, grids, sizes = tables(spark, {"r": states})
    grids = grids.withColumn("ceiling_vox", F.lit(9.0)).withColumn("room_hi", F.array(F.lit(18.0), F.lit(20.0)))
    p = tk.DiffParams(min_voxels=4, jitter_voxels=1, coverage_voxels=8, coverage_frac=0.25, floor_band_voxels=1, ceiling_band_voxels=1, wall_margin_m=1.5)
    changed = job.vx.changes(occ, sizes, grids, 1, 1, 3)
    split = tk.change_blobs(changed, grids, 3)
    cands = tk.candidates(split, occ, grids, sizes, p, 4)
    rows = {(round(r.cx), round(r.cy)): r.reject_reason for r in cands.collect()}
    assert rows[(10, 10)] == "size"
    assert rows[(4, 4)] is None
    assert rows[(4, 14)] == "ceiling"
    assert rows[(17, 16)] == "wall"
    counts = {(r.reason, r.n) for r in tk.rejection_counts(cands).collect()}
    assert ("size", 1) in counts and ("kept", 2) in counts
    far = tk.candidates(split, occ, grids, sizes, tk.DiffParams(min_voxels=4, coverage_voxels=1, floor_band_voxels=1), 3)
    assert {r.reject_reason for r in far.collect()} >= {"coverage"}
    low = tk.candidates(split, occ, grids, sizes, tk.DiffParams(min_voxels=4, coverage_voxels=6, floor_band_voxels=3), 3)
    assert {round(r.cy): r.reject_reason for r in low.collect() if round(r.cx) == 4}[4] == "floor"


def test_sets_with_a_refused_or_missing_capture_are_left_out(spark):
    eye = [[float(r == c) for c in range(4)] for r in range(4)]
    sizes = spark.createDataFrame([("whole", 2), ("hole", 3), ("refused", 2)], "set_id string, n_states int")
    transforms = spark.createDataFrame([("whole", 0, eye), ("whole", 1, eye), ("hole", 0, eye), ("hole", 2, eye), ("refused", 0, eye), ("refused", 1, eye)], "set_id string, state int, m array<array<double>>")
    refused = spark.createDataFrame([("refused", 1)], "set_id string, state int")
    got = {r.set_id: r.reason for r in job.left_out(sizes, transforms, refused).collect()}
    assert got == {"hole": "no transform for state 1", "refused": "capture refused at state 1"}
    rng = np.random.default_rng(2)
    pts = rng.uniform(-0.4, 0.4, (3000, 3))
    splats = spark.createDataFrame([(s, n, *map(float, p)) for s, n in (("whole", 0), ("whole", 1), ("hole", 0), ("hole", 2), ("refused", 0)) for p in pts], "set_id string, state int, x double, y double, z double").withColumn("opacity", F.lit(0.9))
    canons = spark.createDataFrame([(s, eye, 1.0) for s in ("whole", "hole", "refused")], "set_id string, canon array<array<double>>, calibration_m double")
    tuning = spark.createDataFrame([("whole", {"voxel_frac": 0.1, "min_count": 1.0, "unknown": 3.0}), ("hole", {"voxel_frac": 0.2})], "set_id string, params map<string,double>")
    out = job.run_tuned(splats, transforms, canons, sizes, tuning, P, refused)
    assert {r.set_id for r in out.left_out.collect()} == {"hole", "refused"}
    grids = out.grids.collect()
    assert [g.set_id for g in grids] == ["whole"] and abs(grids[0].voxel / grids[0].span - 0.1) < 1e-9


def test_own_values_replace_those_of_the_run(spark):
    sets = spark.createDataFrame([("a",), ("b",)], "set_id string")
    own = spark.createDataFrame([("a", {"min_voxels": 9.0, "wall_margin_m": 0.6, "other": 1.0, "floor_frac": None}), ("z", {"min_count": 7.0})], "set_id string, params map<string,double>")
    got = {r.set_id: r.tuning for r in tk.tuning_table(sets, own, P).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].min_voxels, got["a"].wall_margin_m, got["a"].jitter_voxels, got["a"].floor_frac) == (9, 0.6, 1, 0.8)
    assert got["b"].asDict() == {n: getattr(P, n) for n in got["b"].asDict()}
    section = spark.createDataFrame([("a", "flip", 3, 0.5)], "set_id string, up string, min_count int, floor_frac double")
    a = tk.tuning_table(sets, configs.as_tuning(section), P).filter("set_id = 'a'").first().tuning
    assert (a.min_count, a.floor_frac, a.min_voxels) == (3, 0.5, 4)
    p = tk.per_set(tk.tuning_table(sets, own, P))
    assert p.coverage_voxels.most == 4 and {r.reach for r in p.jitter_voxels.table.collect()} == {1}


def test_sets_of_different_tuning_go_through_one_run(spark):
    """Each set gives what a run of its own with its values gives."""
    import dataclasses

    cast = {"near": rooms()["tale"][:3], "wide": rooms()["noisy"][:3]}
    values = {"near": {}, "wide": {"min_voxels": 9.0, "jitter_voxels": 2.0, "coverage_voxels": 3.0, "label_dilate_voxels": 2.0, "floor_band_voxels": 0.0}}
    occ, grids, sizes = tables(spark, cast)
    table = tk.tuning_table(sizes, spark.createDataFrame(list(values.items()), "set_id string, params map<string,double>"), P).cache()
    got = job.run_on_voxels(occ, grids.join(table, "set_id"), sizes, tk.per_set(table), bits=3)
    objects = got.objects.collect()
    i, j, k = v.unpack(F.col("vox"))
    labels = got.labels.select("set_id", "state", F.array(i, j, k), "object_id").collect()
    for name, states in cast.items():
        want = Room(SHAPE, states, dataclasses.replace(P, **{n: int(x) for n, x in values[name].items()}))
        rows = sorted((r for r in objects if r.set_id == name), key=lambda r: r.id)
        assert [{c: r[c] for c in ("id", "added_in", "removed_in", "present", "voxels", "moved_from", "moved_to")} for r in rows] == want.objects
        for n, lab in enumerate(want.labels):
            assert {tuple(r[2]): r[3] for r in labels if r[0] == name and r[1] == n} == lab, (name, n)
    assert len({r.set_id for r in objects}) == 2


def test_blob_statistics_with_layers_and_without(spark):
    """Medians against numpy: one height for a whole layer, all different in a layer, middle ranks on both sides of a layer's end, negative ones."""
    rng = np.random.default_rng(5)
    blobs = {1: rng.normal(0, 2, 501).tolist(), 2: [1.5, 2.5], 3: [0.25], 4: [7.0] * 40 + [8.0] * 40, 5: (3 + rng.random(300)).tolist(), 6: [-0.5, -0.25, 4.0, 4.5], 7: [2.0, 2.0, 2.25, 2.75, 9.0]}
    rows = [(c, h, float(n), float(-n)) for c, hs in blobs.items() for n, h in enumerate(hs)]
    got = tk.blob_stats(spark.createDataFrame(rows, "comp int, height_vox double, cx double, cy double").repartition(5), ["comp"], 1).collect()
    assert len(got) == len(blobs)
    for r in got:
        h = np.array(blobs[r.comp])
        assert (r.size, r.near_floor, r.max_height) == (len(h), int((abs(h) <= 1).sum()), h.max())
        assert r.median_height == pytest.approx(np.median(h), abs=1e-12)
        assert (r.cx, r.cy) == (pytest.approx((len(h) - 1) / 2), pytest.approx(-(len(h) - 1) / 2))


def test_tied_sizes_are_paired_in_few_rounds(spark, monkeypatch):
    """Forty objects midway between two sizes: one pair a round would take forty rounds."""
    rng = np.random.default_rng(5)
    ids = [int(i) for i in rng.permutation(200)]
    closed = [("a", 1, ids.pop(), 100) for _ in range(40)] + [("b", 1, ids.pop(), s) for s in (80, 120) for _ in range(20)]
    opened = [("a", 1, ids.pop(), s) for s in (90, 110) for _ in range(20)] + [("b", 1, ids.pop(), 96) for _ in range(40)]
    want = set()
    for case in "ab":
        used = set()
        pairs = [(abs(o[3] - c[3]) / c[3], c[2], o[2]) for c in closed for o in opened if c[0] == o[0] == case and abs(o[3] - c[3]) <= 0.3 * c[3]]
        for _, i, n in sorted(pairs):
            if i not in used and n not in used:
                used |= {i, n}
                want.add((case, i, n))
    rounds = []
    monkeypatch.setattr(tk, "written", lambda df, name, real=tk.written: (rounds.append(name), real(df, name))[1])
    schema = "set_id string, step int, id bigint, voxels bigint"
    got = tk.match_moves(spark.createDataFrame(closed, schema), spark.createDataFrame(opened, schema))
    assert {(r.set_id, r.moved_from, r.moved_to) for r in got.collect()} == want
    assert len(rounds) < 20
