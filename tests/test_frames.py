import numpy as np
import pytest
from pyspark.sql import functions as F

from roomdiff.operators import clouds, frame, stats


def cloud(spark, pts, **keys):
    return spark.createDataFrame([(*keys.values(), n, *map(float, p)) for n, p in enumerate(pts)], [*keys, "pid", "x", "y", "z"])


def turn(axis, a):
    k = np.zeros((3, 3))
    k[(axis + 1) % 3, (axis + 2) % 3], k[(axis + 2) % 3, (axis + 1) % 3] = -1, 1
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    a = {"p": rng.normal(size=3000), "q": np.r_[np.zeros(900), rng.integers(0, 4, 101)], "one": np.array([5.0])}
    a |= {f"n{n}": rng.normal(size=n) for n in (2, 3, 7, 52, 399, 401, 2505)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in a.items() for v in vs], "set_id string, v double")
    ps = [0.0, 0.01, 0.25, 0.5, 0.98, 1.0]
    got = {(r.set_id, r.p): r.value for r in stats.percentiles(df, ["set_id"], {"v": ps}, accuracy=200).collect()}
    for k, vs in a.items():
        np.testing.assert_allclose([got[k, p] for p in ps], np.percentile(vs, [100 * p for p in ps]))


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((300, 3)), rng.random((400, 3))
    got = clouds.nearest(cloud(spark, a, set_id="s"), cloud(spark, b, set_id="s").drop("pid"), ["set_id"], "pid", 0.1).orderBy("pid").toPandas()
    d = np.linalg.norm(a[:, None] - b[None], axis=2).min(axis=1)
    np.testing.assert_allclose(got["distance"].to_numpy(float), np.where(d <= 0.1, d, np.nan))


def test_similarity_is_recovered(spark):
    rng = np.random.default_rng(4)
    a = rng.random((500, 3))
    b = 1.7 * a @ (turn(0, 0.3) @ turn(2, 2.0)).T + [1, 2, 3]
    pairs = cloud(spark, a, set_id="s").join(cloud(spark, b, set_id="s").selectExpr("pid", "x as tx", "y as ty", "z as tz"), "pid")
    m = np.array(clouds.fit_similarity(clouds.pair_sums(pairs, ["set_id"]), ["set_id"]).first().m)
    np.testing.assert_allclose(m[:3, :3], 1.7 * turn(0, 0.3) @ turn(2, 2.0), atol=1e-9)
    np.testing.assert_allclose(m[:3, 3], [1, 2, 3], atol=1e-9)


def scan(rng, n=9000):
    """A 5 × 2.5 × 3 m room, y up, the floor seen best; one wall longer than the other."""
    floor = np.c_[rng.uniform(0, 5, n // 2), rng.normal(0, 0.002, n // 2), rng.uniform(0, 3, n // 2)]
    wall = np.c_[rng.uniform(0, 5, n // 4), rng.uniform(0, 2.5, n // 4), rng.normal(0, 0.003, n // 4)]
    side = np.c_[rng.normal(0, 0.003, n // 6), rng.uniform(0, 2.5, n // 6), rng.uniform(0, 3, n // 6)]
    return np.vstack([floor, wall, side])


@pytest.mark.parametrize("up", ["+z"])
def test_frame_of_a_single_capture(spark, up):
    rng = np.random.default_rng(6)
    world = scan(rng) @ turn(1, np.radians(17.0)).T @ turn(0, np.radians(1.2)).T
    raw = np.c_[world[:, 0], -world[:, 2], world[:, 1]]           # +z up
    far = rng.uniform(-80, 80, (40, 3))
    df = cloud(spark, np.vstack([raw, far]), set_id="a").withColumn("opacity", F.lit(0.9))
    r = frame.resolve_frame(df).first()
    assert r.up == up and abs(r.tilt_deg - 1.2) < 0.1
    assert min(abs((r.yaw_deg - 17) % 90), abs((r.yaw_deg + 17) % 90), abs(90 - (r.yaw_deg + 17) % 90)) <= 0.5
    m = np.array(r.world_from_raw)
    w = raw @ m[:3, :3].T + m[:3, 3]
    assert abs(np.median(w[: 4500, 1])) < 0.01
    span = np.percentile(w[:, [0, 2]], 98, axis=0) - np.percentile(w[:, [0, 2]], 2, axis=0)
    assert sorted(np.round(span)) == [3, 5]
    pinned = spark.createDataFrame([("a", "+z", 0.0, [1.0, 2.0])], "set_id string, up string, yaw_deg double, centre array<double>")
    r2 = frame.resolve_frame(df, pinned).first()
    assert (r2.yaw_deg, r2.centre) == (0.0, [1.0, 2.0])
    room = frame.auto_room(frame.under(df, spark.createDataFrame([("a", m.tolist())], "set_id string, m array<array<double>>"))).first().room
    assert room.lo[1] == 0.0 and room.hi[1] >= 2.6


def test_the_pyramid_finds_every_nearest_point():
    rng = np.random.default_rng(6)
    for n, m, cell, radius in [(300, 500, 0.01, 0.2), (300, 5, 0.05, 0.04), (200, 2000, 0.003, 3.0), (50, 0, 0.1, 1.0), (0, 9, 0.1, 1.0), (200, 400, 0.05, 0.05)]:
        a, b = rng.normal(0, 0.4, (n, 3)), rng.normal(0, 0.4, (m, 3))
        b[: m // 3] = b[m // 3: 2 * (m // 3)]                       # ties: the first place wins
        d2, at = clouds.nearest_within(a, b, cell, radius, most=777)
        want = ((a[:, None] - b[None]) ** 2).sum(2) if m else np.full((n, 1), np.inf)
        best = want.min(axis=1) if n else np.empty(0)
        ok = best <= radius ** 2
        assert np.allclose(d2[ok], best[ok]) and (at[~ok] == -1).all() and np.isinf(d2[~ok]).all()
        assert (at[ok] == want.argmin(axis=1)[ok]).all() if m else True


def brute_yaw(x, z, step=0.25):
    most = []
    for t in np.radians(np.arange(round(90 / step)) * step):
        across = np.sin(t) * x + np.cos(t) * z
        lo, hi = across.min(), across.max()
        bins = int(max(1, np.floor((hi - lo) / frame.WALL_BIN_M)))
        at = np.clip(np.floor((across - lo) / (hi - lo) * bins).astype(np.int64), 0, bins - 1)
        most.append(np.unique(at, return_counts=True)[1].max())
    return int(np.argmax(most)) * step


@pytest.mark.parametrize("coarse, chunk, wide", [(8, 64, 6.0), (frame.COARSE, 1 << 20, 2e7), (frame.COARSE, 1 << 20, 6.0)])
def test_yaw_of_rooms_of_any_width(spark, coarse, chunk, wide):
    """A histogram of all bins of a room 20 000 km wide would need terabytes."""
    rng = np.random.default_rng(21)
    rows, want = [], {}
    for name, a in (("a", 0.31), ("b", 1.2)):
        x, z = rng.uniform(0, wide, 400), rng.uniform(0, 4, 400)
        z[:150] = np.round(z[:150])                                    # walls
        x, z = np.cos(a) * x - np.sin(a) * z, np.sin(a) * x + np.cos(a) * z
        rows += [(name, float(p), 1.5, float(q)) for p, q in zip(x, z)]
        want[name] = brute_yaw(x, z)
    got = frame.find_yaw(spark.createDataFrame(rows, "set_id string, x double, y double, z double").repartition(3), chunk=chunk, most=coarse)
    assert {r.set_id: r.yaw_deg for r in got.collect()} == want
