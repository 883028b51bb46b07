"""Point clouds: thinning, nearest neighbours, planes and similarity fits.

Clouds are tables of keys and x, y, z. The 3×3 algebra runs on one row per cloud (or per patch); points only meet arithmetic.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
SUMS = ["n", *[f"s{c}" for c in XYZ], *[f"d{c}" for c in XYZ], *[f"{a}{b}" for a in XYZ for b in XYZ], "ss"]


def _cells(size: Column, prefix: str = "") -> list[Column]:
    return [F.floor(F.col(prefix + c) / size) for c in XYZ]


def downsample(cloud: DataFrame, keys: list[str], size: Column | float) -> DataFrame:
    """One point per occupied cell: the mean of its points."""
    size = F.lit(size) if isinstance(size, (int, float)) else size
    cell = [c.alias(f"_{n}") for n, c in enumerate(_cells(size))]
    return cloud.groupBy(*keys, *cell).agg(*[F.avg(c).alias(c) for c in XYZ]).select(*keys, *XYZ)


def extents(cloud: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, diagonal): length of the bounding box's diagonal."""
    box = cloud.groupBy(*keys).agg(*[(F.max(c) - F.min(c)).alias(c) for c in XYZ])
    return box.select(*keys, F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("diagonal"))


def nearest(source: DataFrame, target: DataFrame, keys: list[str], point: str, radius: float) -> DataFrame:
    """``source`` with the nearest target point within ``radius`` (tx, ty, tz, distance), null when none. Exact: targets go to the 27 cells
    around them, a source point meets those of its own cell, and the closest is kept while pairs are still on the map side."""
    r = F.lit(float(radius))
    own = source.select(*keys, point, *XYZ, *[c.alias(f"_{n}") for n, c in enumerate(_cells(r))])
    hops = F.array(*[F.struct(*[F.lit(v).alias(f"o{n}") for n, v in enumerate(o)]) for o in itertools.product((-1, 0, 1), repeat=3)])
    t = target.select(*keys, *[F.col(c).alias(f"t{c}") for c in XYZ], F.explode(hops).alias("o"))
    t = t.select(*keys, "tx", "ty", "tz", *[(F.floor(F.col(f"t{c}") / r) + F.col(f"o.o{n}")).alias(f"_{n}") for n, c in enumerate(XYZ)])
    gap = F.sqrt(sum(((F.col(c) - F.col(f"t{c}")) ** 2 for c in XYZ), F.lit(0.0)))
    pairs = own.join(t, [*keys, "_0", "_1", "_2"]).withColumn("distance", gap).filter(F.col("distance") <= r)
    best = pairs.groupBy(*keys, point).agg(F.min(F.struct("distance", "tx", "ty", "tz")).alias("b")).select(*keys, point, "b.*")
    return source.join(best, [*keys, point], "left")


class Pyramid:
    """Targets in the order of their cells, worked out once for each size of cells."""

    def __init__(self, target: np.ndarray):
        self.target, self.sizes = target, {}

    def at(self, size: float) -> tuple:
        """(lowest corner, number of cells along each axis with two more round them, order, keys in that order)."""
        if size not in self.sizes:
            base = self.target.min(axis=0)
            cells = np.floor((self.target - base) / size).astype(np.int64)
            wide = cells.max(axis=0) + 3
            key = _cell_key(cells, wide)
            order = np.argsort(key, kind="stable")
            self.sizes[size] = (base, wide, order, key[order])
        return self.sizes[size]


def _cell_key(c: np.ndarray, wide: np.ndarray) -> np.ndarray:
    return ((c[:, 0] + 1) * wide[1] + c[:, 1] + 1) * wide[2] + c[:, 2] + 1


def nearest_within(source: np.ndarray, target: np.ndarray | Pyramid, cell: float, radius: float, most: int = 1 << 20, start: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, place in ``target``) of each source point's nearest target within ``radius``; infinite and -1 where there is none. Exact; of
    targets equally near the first one. A pyramid of cells: a point looks into the 27 cells around it, which hold all that is nearer than a
a cell's side, and only points that found nothing so near are carried to cells twice as large. ``most`` bounds the pairs compared at once.
    Cells smaller than ``start`` are left out, which changes the time it takes and nothing else."""
    far, at = np.full(len(source), np.inf), np.full(len(source), -1)
    todo, size = np.arange(len(source)), cell
    levels = target if isinstance(target, Pyramid) else Pyramid(target)
    target = levels.target
    if not len(target):
        return far, at
    while size < min(start, radius):
        size = min(2 * size, max(radius, cell))
    while len(todo):
        base, wide, order, held = levels.at(size)
        own = np.floor((source[todo] - base) / size).astype(np.int64)
        around = ((own >= -1) & (own <= wide - 2)).all(axis=1)              # others have no target in a neighbouring cell
        who, own = todo[around], own[around]
        for di in (-1, 0, 1):
            for dj in (-1, 0, 1):
                i, j = own[:, 0] + di, own[:, 1] + dj
                ok = (i >= 0) & (i <= wide[0] - 3) & (j >= 0) & (j <= wide[1] - 3)
                row = ((i + 1) * wide[1] + j + 1) * wide[2]
                first = np.searchsorted(held, row + np.maximum(own[:, 2], 1))
                n = np.where(ok, np.searchsorted(held, row + own[:, 2] + 2, side="right") - first, 0)
                for part in np.split(np.arange(len(who)), np.searchsorted(np.cumsum(n), np.arange(most, n.sum() + 1, most))):
                    _closer(source, target, order, who[part], first[part], n[part], far, at)
        # What lies within a cell's side is among the 27 cells, so a point that found something so near has its nearest.
        todo = todo[far[todo] > size * size] if size < radius else todo[:0]
        size = min(2 * size, max(radius, cell))
    out = far > radius * radius
    far[out], at[out] = np.inf, -1
    return far, at


def _closer(source: np.ndarray, target: np.ndarray, order: np.ndarray, who: np.ndarray, first: np.ndarray, n: np.ndarray, far: np.ndarray, at: np.ndarray) -> None:
    """Takes the nearest of ``n`` targets from ``first`` on in ``order`` for each of ``who``, where nearer than what it has."""
    some = n > 0
    who, first, n = who[some], first[some], n[some]
    if not len(who):
        return
    starts = np.cumsum(n) - n
    t = order[np.arange(n.sum()) - np.repeat(starts - first, n)]
    d2 = ((target[t] - np.repeat(source[who], n, axis=0)) ** 2).sum(axis=1)
    best = np.minimum.reduceat(d2, starts)
    pick = np.minimum.reduceat(np.where(d2 == np.repeat(best, n), t, len(target)), starts)
    nearer = (best < far[who]) | ((best == far[who]) & (pick < at[who]))
    far[who[nearer]], at[who[nearer]] = best[nearer], pick[nearer]


CUBE = 64                   # cells along the side of what one task holds
BATCH = 16                  # moving clouds that share a task's targets


def target_cubes(target: DataFrame, keys: list[str], batches: DataFrame) -> DataFrame:
    """``target(keys, x, y, z, cell, radius)`` dealt out to cubes of ``CUBE`` cells, once for each of the batches in ``batches(keys, batches)``: a cube
    holds what lies within the radius of it. With one point in a cell, a cube's points are bounded."""
    rows = target.join(batches, keys).withColumn("side", F.col("cell") * CUBE)
    for n, c in enumerate(XYZ):
        low, high = (F.floor((F.col(c) + way * F.col("radius")) / F.col("side")) for way in (-1, 1))
        rows = rows.withColumn(f"c{n}", F.explode(F.sequence(low, high)))
    return rows.select(*keys, F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch"), "c0", "c1", "c2", *XYZ)


def _targets(table: pa.Table) -> np.ndarray:
    target = np.stack([table.column(c).to_numpy() for c in XYZ], axis=1).astype(float)
    return target[np.lexsort(target.T)]


def _match(target: np.ndarray, at: np.ndarray, own: np.ndarray, cell: float, radius: float) -> np.ndarray:
    """For each point, which is ``at`` under the estimate and ``own`` as captured: whether it has a target nearer than ``radius``, the squared distance,
    and what a fit sums up."""
    d2, hit = nearest_within(at, target, cell, radius)
    ok = d2 < radius ** 2
    d = np.zeros((len(own), 3))
    d[ok] = target[hit[ok]]
    one = ok.astype(float)[:, None]
    return np.hstack([one, np.where(ok, d2, 0)[:, None], own * one, d, (d[:, :, None] * own[:, None, :]).reshape(-1, 9) * one, (own ** 2).sum(1)[:, None] * one])


def match_sums(moved: DataFrame, cubes: DataFrame, join_on: list[str], keys: list[str]) -> DataFrame:
    """Sums a similarity fit needs, per key, over source points with a target nearer than ``radius``. ``moved`` carries px, py, pz (as captured),
    x, y, z (under the current estimate), cell, radius and batch, and ``cubes`` comes from ``target_cubes``. A task holds one cube's points,
    finds every point's nearest target by a pyramid of cells and sends one row of sums for each key."""
    at = [F.floor(F.col(c) / (F.col("cell") * CUBE)).alias(f"c{n}") for n, c in enumerate(XYZ)]
    group = [*join_on, "batch", "c0", "c1", "c2"]
    own = [k for k in keys if k not in join_on]
    rows = moved.select(*join_on, "batch", *at, *own, *XYZ, *[f"p{c}" for c in XYZ], "cell", "radius")
    fields = {f.name: f.dataType.simpleString() for f in moved.schema}
    names = ["total", "n", "err", *[f"s{c}" for c in XYZ], *[f"d{c}" for c in XYZ], *[a + b for a in XYZ for b in XYZ], "ss"]
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", " + ", ".join(f"{n} {'bigint' if n == 'total' else 'double'}" for n in names)

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        target, held = _targets(right), left.to_pandas()
        cell, radius = (float(held[c].iloc[0]) if len(held) else 1.0 for c in ("cell", "radius"))
        parts = _match(target, held[list(XYZ)].to_numpy(float), held[[f"p{c}" for c in XYZ]].to_numpy(float), cell, radius)
        sums = held[keys].assign(total=1, **dict(zip(names[1:], parts.T))).groupby(keys, sort=False, as_index=False).sum()
        return pa.Table.from_pandas(sums[[*keys, *names]], schema=wanted, preserve_index=False)

    wanted = pa.schema([*[(k, _arrow(fields[k])) for k in keys], *[(n, pa.int64() if n == "total" else pa.float64()) for n in names]])
    parts = rows.groupBy(*group).cogroup(cubes.groupBy(*group)).applyInArrow(solve, schema)
    return parts.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind]


def batched(clouds: DataFrame, join_on: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``clouds``, one row for each key, with ``batch``; (join_on, batches)): at most ``BATCH`` moving clouds meet in one task."""
    w = Window.partitionBy(*join_on).orderBy(*[k for k in keys if k not in join_on])
    rows = clouds.select(*keys).distinct().withColumn("batch", F.floor((F.row_number().over(w) - 1) / BATCH).cast("int"))
    return rows, rows.groupBy(*join_on).agg((F.max("batch") + 1).alias("batches"))


WHOLE = 1 << 21             # points of a moving cloud and of its targets, together, that one task may hold through all steps
STILL = 1e-6                # a score that moves by no more is still


def settle(target: np.ndarray, own: np.ndarray, m: np.ndarray, cell: float, radii: list[float], steps: int) -> tuple[np.ndarray, float, float]:
    """(matrix, share of points matched, root mean square distance) of one cloud, fitted at each radius until its score is still or nothing fits, at
    most ``steps`` times. The score is taken at the final matrix and the last radius."""
    levels, far = Pyramid(target), 0.0

    def sums(radius: float) -> tuple[float, float, np.ndarray]:
        """(points matched, their squared distances, ``SUMS``). The search begins with cells as wide as half of the last matches were far."""
        nonlocal far
        d2, hit = nearest_within(own @ m[:3, :3].T + m[:3, 3], levels, cell, radius, start=far)
        ok = d2 < radius ** 2
        far = float(np.sqrt(np.median(d2[ok]))) if ok.any() else radius
        p, d = own[ok], target[hit[ok]]
        return float(len(p)), float(d2[ok].sum()), np.concatenate([[len(p)], p.sum(axis=0), d.sum(axis=0), (d.T @ p).ravel(), [(p ** 2).sum()]])

    for radius in radii:
        # Points that lie together stand together, so that those looked up one after the other are near one another.
        own = own[np.lexsort(np.floor((own @ m[:3, :3].T + m[:3, 3]) / radius).T[::-1])]
        before = None
        for _ in range(steps):
            n, err, a = sums(radius)
            found, ok = _similarities(a[None])
            if not ok[0]:
                break
            now = np.array([n / len(own), np.sqrt(err / n)])
            m, still = found[0], before is not None and (np.abs(now - before) <= STILL).all()
            if still:
                break
            before = now
    n, err, _ = sums(radii[-1])
    return m, n / len(own), np.sqrt(err / max(n, 1))


def settle_whole(source: DataFrame, target: DataFrame, starts: DataFrame, join_on: list[str], keys: list[str], cell: float, radii: list[float], steps: int) -> DataFrame:
    """(keys, m, fitness, rmse): ``settle`` for each of ``starts(keys, m)``, one cloud and its targets to a group. For clouds of at most ``WHOLE`` points, which
    the caller sees to; ``match_sums`` takes those of any size, a step at a time."""
    spread = 16 * source.sparkSession.sparkContext.defaultParallelism
    fields = {f.name: f.dataType.simpleString() for f in starts.schema}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", m array<array<double>>, fitness double, rmse double"
    wanted = pa.schema([*[(k, _arrow(fields[k])) for k in keys], ("m", pa.list_(pa.list_(pa.float64()))), ("fitness", pa.float64()), ("rmse", pa.float64())])

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        is_start = right.column("m").is_valid()
        begin = right.filter(is_start)
        if not left.num_rows or not begin.num_rows:
            return wanted.empty_table()
        own = np.stack([left.column(f"p{c}").to_numpy() for c in XYZ], axis=1).astype(float)
        target = _targets(right.filter(pc.invert(is_start)))
        m, fitness, rmse = settle(target, own, np.array(begin.column("m")[0].as_py(), float), cell, radii, steps)
        return pa.Table.from_pylist([{**{k: left.column(k)[0].as_py() for k in keys}, "m": m.tolist(), "fitness": float(fitness), "rmse": float(rmse)}], schema=wanted)

    rows = source.join(starts.select(*keys), [k for k in keys if k in source.columns]).select(*keys, *[f"p{c}" for c in XYZ])
    nowhere = [F.lit(None).cast("double").alias(c) for c in XYZ]
    targets = target.select(*join_on, *XYZ).join(starts.select(*keys), join_on).select(*[F.col(c).alias(c) for c in [*keys, *XYZ]], F.lit(None).cast(fields["m"]).alias("m"))
    targets = targets.unionByName(starts.select(*keys, *nowhere, "m"))          # the matrix goes once, not with every point
    return rows.repartition(spread, *keys).groupBy(*keys).cogroup(targets.repartition(spread, *keys).groupBy(*keys)).applyInArrow(solve, schema)


def pair_sums(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The same sums over given pairs (x, y, z) -> (tx, ty, tz)."""
    s, d = F.col, (lambda c: F.col(f"t{c}"))
    return pairs.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), *[F.sum(s(c)).alias(f"s{c}") for c in XYZ], *[F.sum(d(c)).alias(f"d{c}") for c in XYZ],
                                    *[F.sum(d(a) * s(b)).alias(f"{a}{b}") for a in XYZ for b in XYZ], F.sum(s("x") ** 2 + s("y") ** 2 + s("z") ** 2).alias("ss"))


def _similarities(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrices, whether there is one) for rows of ``SUMS``."""
    n = np.maximum(a[:, 0], 1)[:, None]
    ms, md = a[:, 1:4] / n, a[:, 4:7] / n
    cov = a[:, 7:16].reshape(-1, 3, 3) / n[:, :, None] - md[:, :, None] * ms[:, None, :]
    var = a[:, 16] / n[:, 0] - (ms ** 2).sum(1)
    ok = (a[:, 0] >= 3) & (var > 0) & np.isfinite(a).all(1)
    u, sig, vt = np.linalg.svd(np.where(ok[:, None, None], cov, np.eye(3)))
    flip = np.ones_like(sig)
    flip[:, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    rot = (u * flip[:, None, :]) @ vt
    scale = (sig * flip).sum(1) / np.where(ok, var, 1)
    lin = scale[:, None, None] * rot
    m = np.tile(np.eye(4), (len(a), 1, 1))
    m[:, :3, :3], m[:, :3, 3] = lin, md - np.einsum("nij,nj->ni", lin, ms)
    return m, ok


def fit_similarity(sums: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``m``: the least-squares similarity (Umeyama 1991) taking sources to targets, from one row of sums per cloud; null
    under three pairs."""
    fields = {f.name: f.dataType.simpleString() for f in sums.schema}
    schema = ", ".join(f"{c} {fields[c]}" for c in keep) + ", m array<array<double>>"

    def solve(frames):
        for pdf in frames:
            m, ok = _similarities(pdf[SUMS].to_numpy(float))
            yield pdf[keep].assign(m=[[list(map(float, r)) for r in x] if good else None for x, good in zip(m, ok)])

    return sums.mapInPandas(solve, schema)


def _thin_direction(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, eigenvalues, unit normals) of rows of mx, my, mz and mean products xx … zz: the normal is the thin direction of the covariance."""
    mean = pdf[[f"m{c}" for c in XYZ]].to_numpy(float)
    cov = np.empty((len(pdf), 3, 3))
    for i, a in enumerate(XYZ):
        for j, b in enumerate(XYZ):
            cov[:, i, j] = pdf[min(a, b) + max(a, b)].to_numpy(float) - mean[:, i] * mean[:, j]
    w, vec = np.linalg.eigh(cov)
    return mean, w, vec[:, :, 0]


def _moments(shift: dict[str, Column] | None = None) -> list[Column]:
    at = {c: F.col(c) - shift[c] if shift else F.col(c) for c in XYZ}
    return [F.avg(at[c]).alias(f"m{c}") for c in XYZ] + [F.avg(at[a] * at[b]).alias(a + b) for n, a in enumerate(XYZ) for b in XYZ[n:]]


def patch_planes(cloud: DataFrame, keys: list[str], size: Column, least: int = 4, turn: float = 0.05) -> DataFrame:
    """(keys, planes array<struct<id, a, b, c, d>>): plane hypotheses, one from each patch of a coarse grid. A patch is summed in Spark; its
    normal is the thin direction of its 3×3 covariance. Patches of like normal (to ``turn``) and offset (to ``thr``) are one hypothesis, that of
    the flattest and fullest of them, so there are as many as the room has surfaces; none is left out."""
    cell = [c.alias(f"_{n}") for n, c in enumerate(_cells(size))]
    sums = cloud.groupBy(*keys, "thr", *cell).agg(F.count("*").alias("n"), *_moments()).filter(F.col("n") >= least)
    fields = {f.name: f.dataType.simpleString() for f in sums.schema}
    schema = ", ".join(f"{c} {fields[c]}" for c in keys) + ", thr double, n bigint, flat boolean, a double, b double, c double, d double"

    def solve(frames):
        for pdf in frames:
            mean, w, nrm = _thin_direction(pdf)
            lead = np.abs(nrm).argmax(axis=1)
            nrm = nrm * np.sign(nrm[np.arange(len(nrm)), lead])[:, None]         # of the two normals, the one whose largest part is positive
            flat = (pdf["n"].to_numpy() >= 12) & (np.sqrt(np.maximum(w[:, 0], 0)) <= pdf["thr"].to_numpy(float)) & (w[:, 1] > 4 * np.maximum(w[:, 0], 0))
            yield pdf[[*keys, "thr", "n"]].assign(flat=flat, a=nrm[:, 0], b=nrm[:, 1], c=nrm[:, 2], d=-(nrm * mean).sum(1))

    found = sums.mapInPandas(solve, schema)
    like = [F.round(F.col(c) / turn).alias(f"_{c}") for c in "abc"] + [F.round(F.col("d") / F.col("thr")).alias("_d")]
    merged = found.groupBy(*keys, *like).agg(F.max(F.struct("flat", "n", "a", "b", "c", "d")).alias("p")).select(*keys, "p.*")
    ranked = merged.withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("flat"), F.desc("n"), "a", "b", "c", "d")))
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("id", "a", "b", "c", "d"))).alias("planes"))


def refit_planes(members: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """``chosen(keys, id, a, b, c, d, …)`` with each plane fitted anew to all points that lie on it, facing the way it faced. One grouped covariance,
    about a point of the old plane so that no digits are lost far from the origin."""
    old = chosen.select(*keys, "id", *[(-F.col("d") * F.col(n)).alias(f"_{x}") for n, x in zip("abc", XYZ)])
    on = members.join(old, keys).filter(F.array_contains("on", F.col("id")))
    sums = on.groupBy(*keys, "id", "_x", "_y", "_z").agg(*_moments({c: F.col(f"_{c}") for c in XYZ})).join(chosen.select(*keys, "id", "a", "b", "c"), [*keys, "id"])
    fields = {f.name: f.dataType.simpleString() for f in sums.schema}
    schema = ", ".join(f"{c} {fields[c]}" for c in [*keys, "id"]) + ", a double, b double, c double, d double"

    def solve(frames):
        for pdf in frames:
            mean, _, nrm = _thin_direction(pdf)
            before = pdf[["a", "b", "c"]].to_numpy(float)
            nrm = nrm * np.where((nrm * before).sum(1) < 0, -1.0, 1.0)[:, None]
            centre = mean + pdf[["_x", "_y", "_z"]].to_numpy(float)
            yield pdf[[*keys, "id"]].assign(a=nrm[:, 0], b=nrm[:, 1], c=nrm[:, 2], d=-(nrm * centre).sum(1))

    fitted = sums.mapInPandas(solve, schema)
    rest = [c for c in chosen.columns if c not in ("a", "b", "c", "d")]
    return chosen.select(*rest).join(fitted, [*keys, "id"])


def plane_members(cloud: DataFrame, planes: DataFrame, keys: list[str]) -> DataFrame:
    """Cloud points with ``on``: ids of the planes within ``thr`` of them."""
    away = lambda p: F.abs(p["a"] * F.col("x") + p["b"] * F.col("y") + p["c"] * F.col("z") + p["d"])
    return cloud.join(planes, keys).select(*cloud.columns, F.transform(F.filter("planes", lambda p: away(p) <= F.col("thr")), lambda p: p["id"]).alias("on"))


def best_planes(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, hits): the plane that holds most points, lowest id on ties."""
    hits = members.select(*keys, F.explode("on").alias("id")).groupBy(*keys, "id").agg(F.count("*").alias("hits"))
    return hits.groupBy(*keys).agg(F.max_by(F.struct("id", "hits"), F.struct("hits", -F.col("id"))).alias("b")).select(*keys, "b.id", "b.hits")
