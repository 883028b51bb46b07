import numpy as np
from pyspark.sql import functions as F

from roomdiff.plans import register as reg
from test_frames import turn


def furnished(rng):
    """A 6 × 4 × 2.5 m room with a ceiling left bare and lopsided furniture."""
    u = rng.uniform
    n = 4500
    floor = np.c_[u(0, 6, n), u(0, 4, n), rng.normal(0, 0.003, n)]
    walls = [np.c_[u(0, 6, n // 2), rng.normal(y, 0.003, n // 2), u(0, 2.5, n // 2)] for y in (0, 4)] + [np.c_[rng.normal(x, 0.003, n // 3), u(0, 4, n // 3), u(0, 2.5, n // 3)] for x in (0, 6)]
    boxes = []
    for lo, size in (((0.5, 0.4, 0), (1.2, 0.8, 1.6)), ((4.2, 2.9, 0), (0.9, 0.7, 0.8)), ((2.6, 0.3, 0.9), (1.4, 0.4, 0.7))):
        for axis in range(3):
            for end in (0, 1):
                f = u(0, 1, (350, 3))
                f[:, axis] = end
                boxes.append(np.array(lo) + f * size)
    return np.vstack([floor, *walls, *boxes])


def test_a_turned_capture_comes_into_the_first_ones_frame(spark):
    rng = np.random.default_rng(8)
    room = furnished(rng)
    motion = {0: (np.eye(3), 1.0, [0, 0, 0]), 1: (turn(2, 2.2) @ turn(0, 0.4), 0.6, [3, -1, 2])}
    rows = []
    for state, (R, s, t) in motion.items():
        pts = (s * (room + rng.normal(0, 0.004, room.shape)) @ R.T + t)
        rows += [("a", state, *map(float, p)) for p in pts]
    df = spark.createDataFrame(rows, "set_id string, state int, x double, y double, z double").withColumn("opacity", F.lit(0.9))
    got = reg.run(df, candidate_steps=30)
    report = got.report.first()
    assert got.violations.collect() == []
    assert report.inlier_frac > 0.7 and abs(report.scale - 1 / 0.6) < 0.01 and report.candidate_margin > 0.05
    m = np.array({r.state: r.m for r in got.transforms.collect()}[1])
    R, s, t = motion[1]
    corners = np.array([[x, y, z] for x in (0, 6) for y in (0, 4) for z in (0, 2.5)], float)
    back = (s * corners @ R.T + t) @ m[:3, :3].T + m[:3, 3]
    assert np.linalg.norm(back - corners, axis=1).mean() < 0.015
    c = np.array(got.canons.first().canon)
    q = corners @ c[:3, :3].T + c[:3, 3]
    assert abs(np.abs(q[corners[:, 2] == 0][:, 2]).max()) < 0.01
    assert abs(np.ptp(q[:, :2], axis=0).max() - 1.0) < 0.08


def test_runner_up_must_be_another_pose(spark):
    same = reg.box_symmetries()
    rows = [("a", 1, 0, same[0], 0.8, 0.1), ("a", 1, 1, same[0], 0.79, 0.1), ("a", 1, 2, same[1], 0.5, 0.1), ("a", 1, 3, same[2], 0.3, 0.1)]
    df = spark.createDataFrame(rows, "set_id string, state int, cand int, m array<array<double>>, fitness double, rmse double")
    r = reg.pick_candidate(df).first()
    assert (r.fitness, r.runner_up) == (0.8, 0.5)


def test_the_floor_is_fitted_to_all_that_lies_on_it(spark):
    """A noisy room turned by a known rotation: the frame's up is within a tenth of a degree of the true one."""
    rng = np.random.default_rng(3)
    R = turn(0, 0.3) @ turn(1, -0.5)
    pts = (furnished(rng) + rng.normal(0, 0.01, (1, 3))) @ R.T + [10.0, -4.0, 7.0]
    pts = pts + rng.normal(0, 0.008, pts.shape)
    df = spark.createDataFrame([("a", 0, *map(float, p)) for p in pts], "set_id string, state int, x double, y double, z double")
    m = np.array(reg.canonicalize(df).first().m)
    up = m[2, :3] / np.linalg.norm(m[2, :3])
    assert np.degrees(np.arccos(min(1.0, abs(up @ R[:, 2])))) < 0.1


def test_limits_of_each_set(spark):
    report = spark.createDataFrame([(s, 1, 0.5, 0.1) for s in "abc"], "set_id string, state int, inlier_frac double, margin double")
    own = spark.createDataFrame([("a", {"min_inlier_frac": 0.6}), ("b", {"min_candidate_margin": 0.2, "other": 1.0})], "set_id string, params map<string,double>")
    got = {r.set_id: (r.few, r.unclear) for r in reg.judged(report, tuning=own).collect()}
    assert got == {"a": (True, False), "b": (False, True), "c": (False, False)}
    assert not any(r.few or r.unclear for r in reg.judged(report).collect())


def test_bake_prunes_by_each_set(spark):
    from roomdiff.operators import splats as sp

    eye = [[float(r == c) for c in range(4)] for r in range(4)]
    rows = [(s, 0, 0.0, 0.0, 0.0, o, [0.0] * 3, [1.0, 0.0, 0.0, 0.0], []) for s in "ab" for o in (0.01, 0.1, 0.3)]
    df = spark.createDataFrame(rows, "set_id string, state int, x double, y double, z double, opacity double, scale array<float>, rot array<float>, f_rest array<float>")
    t = spark.createDataFrame([(s, 0, eye) for s in "ab"], "set_id string, state int, m array<array<double>>")
    own = spark.createDataFrame([("a", {"prune_opacity": 0.2})], "set_id string, params map<string,double>")
    got = sp.bake(df, t, tuning=own)
    assert sorted((r.set_id, r.opacity) for r in got.collect()) == [("a", 0.3), ("b", 0.1), ("b", 0.3)] and got.columns == df.columns


def _clouds(spark, n=120, far=0.0):
    """(source, reference): points .1 apart or more, and the same a quarter turn off, shifted by ``far``."""
    rng = np.random.default_rng(5)
    pts = np.stack(np.meshgrid(np.arange(8), np.arange(5), np.arange(4)), -1).reshape(-1, 3)[:n] / 8 + rng.uniform(0, 0.03, (n, 3)) - [0.45, 0.3, 0]
    rows = [("a", 1, *map(float, (-y + far, x, z))) for x, y, z in pts]
    return (spark.createDataFrame(rows, "set_id string, state int, x double, y double, z double"),
            spark.createDataFrame([("a", *map(float, p)) for p in pts], "set_id string, x double, y double, z double"))


def test_small_clouds_are_fitted_without_jobs_for_each_step(spark):
    source, reference = _clouds(spark)
    spark.sparkContext.setJobGroup("starts", "starts")
    try:
        best = reg.pick_candidate(reg.score_candidates(source, reference)).first()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("starts"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert best.fitness == 1.0 and np.allclose(np.array(best.m)[:3, :3], [[0, 1, 0], [-1, 0, 0], [0, 0, 1]], atol=1e-6)
    assert 0 < jobs < 40


def test_clouds_in_one_task_and_in_cubes_are_fitted_alike(spark, monkeypatch):
    source, reference = _clouds(spark)
    scores = lambda: {r.cand: (r.fitness, r.rmse, np.array(r.m)) for r in reg.score_candidates(source, reference, steps=4).collect()}
    whole = scores()
    monkeypatch.setattr(reg.cl, "WHOLE", 0)
    cubes = scores()
    assert sorted(whole) == sorted(cubes) == list(range(8))
    for cand, (fitness, rmse, m) in whole.items():
        assert fitness == cubes[cand][0] and abs(rmse - cubes[cand][1]) < 1e-9 and np.allclose(m, cubes[cand][2], atol=1e-9)


def test_a_cloud_that_meets_no_target_scores_nothing(spark, monkeypatch):
    source, reference = _clouds(spark, n=40, far=9.0)
    for most in (reg.cl.WHOLE, 0):
        monkeypatch.setattr(reg.cl, "WHOLE", most)
        got = reg.score_candidates(source, reference, steps=2).collect()
        assert len(got) == 8 and {(r.fitness, r.rmse) for r in got} == {(0.0, 0.0)}


def test_clouds_of_hundreds_of_thousands_are_fitted_without_jobs_for_each_step(spark):
    n = 140_000
    pts = spark.range(n).select(*[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1 << 20)) / (1 << 20) - 0.5).alias(c) for c in "xyz"])
    source, reference = (pts.select(F.lit("a").alias("set_id"), *own) for own in ([F.lit(1).alias("state"), (-F.col("y")).alias("x"), F.col("x").alias("y"), "z"], "xyz"))
    group = "large starts"
    spark.sparkContext.setJobGroup(group, group)
    try:
        best = reg.pick_candidate(reg.score_candidates(source, reference, steps=2)).first()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert best.fitness == 1.0 and np.allclose(np.array(best.m)[:3, :3], [[0, 1, 0], [-1, 0, 0], [0, 0, 1]], atol=1e-6)
    assert 0 < jobs < 40


def test_cells_left_out_do_not_change_the_nearest():
    rng = np.random.default_rng(7)
    source, target = rng.uniform(0, 1, (300, 3)), rng.uniform(0, 1, (400, 3)).round(1)
    far, at = reg.cl.nearest_within(source, target, 0.01, 0.2)
    levels = reg.cl.Pyramid(target)
    for start in (0.0, 0.03, 0.1, 5.0):
        d2, hit = reg.cl.nearest_within(source, levels, 0.01, 0.2, start=start)
        assert (d2 == far).all() and (hit == at).all()
    gap = ((source[:, None] - target[None]) ** 2).sum(axis=2)
    assert (np.where(gap.min(axis=1) <= 0.04, gap.argmin(axis=1), -1) == at).all()
