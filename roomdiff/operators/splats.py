"""Splats under a similarity transform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomdiff.functions import geometry as g
from roomdiff.functions.stage import written


def bad_transforms(transforms: DataFrame) -> DataFrame:
    """(set_id, state, det) of matrices that mirror or flatten; nothing may be moved by them."""
    return transforms.select("set_id", "state", g.determinant(F.col("m")).alias("det")).filter(~(F.col("det") > 0))


def _banded(rest: Column, m: Column) -> Column:
    """f_rest with band 1 of each channel turned: a band (c0, c1, c2) stands for the direction (−c2, −c0, c1)."""
    per = F.floor(F.size(rest) / 3).cast("int")
    parts = []
    for channel in range(3):
        at = lambda c: F.get(rest, per * channel + c).cast("double")
        x, y, z = g.turn(m, -at(2), -at(0), at(1))
        parts.append(F.array(-y, z, -x).cast("array<float>"))
        parts.append(F.slice(rest, per * channel + 4, F.greatest(per - 3, F.lit(0))))
    return F.when(per >= 3, F.concat(*parts)).otherwise(rest)


def transform(splats: DataFrame, transforms: DataFrame) -> DataFrame:
    """Positions, log-scales, orientations and first-band colour under each state's similarity; higher bands are left as they are.
    The matrix is taken apart once per state, the splats only see arithmetic."""
    m = F.col("m")
    scale = g.uniform_scale(m)
    unit = g.matrix([[g.cell(m, r, c) / scale if c < 3 else F.lit(0.0) for c in range(4)] for r in range(3)] + [[0.0, 0.0, 0.0, 1.0]])
    if not bad_transforms(transforms).isEmpty():
        raise ValueError("a transform is not a proper similarity: see bad_transforms()")
    per = transforms.select("set_id", "state", "m", F.log(scale).alias("grow"), unit.alias("unit"))
    per = written(per.select("*", g.quaternion(F.col("unit")).alias("q")), "transforms")
    x, y, z = g.place(F.col("m"), F.col("x"), F.col("y"), F.col("z"))
    moved = {"x": x, "y": y, "z": z,
             "scale": F.transform("scale", lambda v: (v + F.col("grow").cast("float")).cast("float")),
             "rot": g.quaternion_product(F.col("q"), F.col("rot").cast("array<double>")).cast("array<float>"),
             "f_rest": _banded(F.col("f_rest"), F.col("unit"))}
    return splats.join(per, ["set_id", "state"]).select(*[moved[c].alias(c) if c in moved else F.col(c) for c in splats.columns])


def bake(splats: DataFrame, transforms: DataFrame, prune_opacity: float = 0.05, tuning: DataFrame | None = None) -> DataFrame:
    """Faint splats dropped before anything is computed, the rest aligned. ``tuning(set_id, params MAP<STRING, DOUBLE>)`` replaces
    ``prune_opacity`` for the sets whose ``params`` name it."""
    from roomdiff.operators.voxels import prune

    if tuning is None:
        return transform(prune(splats, prune_opacity), transforms)
    own = splats.join(tuning.select("set_id", F.col("params")["prune_opacity"].alias("_own")), "set_id", "left")
    return transform(prune(own, F.coalesce("_own", F.lit(prune_opacity))).select(*splats.columns), transforms)
