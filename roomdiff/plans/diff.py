"""Captures in one frame -> objects and labels, for every set in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomdiff.functions import geometry as g
from roomdiff.functions.stage import written
from roomdiff.operators import stats
from roomdiff.operators import tracker as tk
from roomdiff.operators import voxels as vx

ROOM_OPACITY = 0.35
ROOM_HALF = 0.75      # canonical units: what lies farther out is background


def into_frame(splats: DataFrame, transforms: DataFrame) -> DataFrame:
    """Positions under each state's transform; only what the comparison needs is kept."""
    x, y, z = g.place(F.col("m"), F.col("x"), F.col("y"), F.col("z"))
    rows = splats.select("set_id", "state", "x", "y", "z", "opacity").join(transforms.select("set_id", "state", "m"), ["set_id", "state"])
    return rows.select("set_id", "state", x.alias("x"), y.alias("y"), z.alias("z"), "opacity")


def room_points(splats: DataFrame, canons: DataFrame) -> DataFrame:
    """Solid splats inside the room, with their canonical coordinates qx, qy, qz. ``canons(set_id, canon)``."""
    rows = splats.filter(F.col("opacity") > ROOM_OPACITY).join(canons.select("set_id", "canon"), "set_id")
    q = g.place(F.col("canon"), F.col("x"), F.col("y"), F.col("z"))
    rows = rows.select(*splats.columns, *[c.alias(n) for c, n in zip(q, ("qx", "qy", "qz"))])
    return rows.filter((F.abs("qx") < ROOM_HALF) & (F.abs("qy") < ROOM_HALF) & (F.abs("qz") < ROOM_HALF))


def grid_spec(room0: DataFrame, canons: DataFrame, p: tk.DiffParams = tk.DiffParams()) -> DataFrame:
    """One grid per set from the room points of its first state. ``canons(set_id, canon, calibration_m)``, with ``tuning`` where sets have their own."""
    tails = {c: [0.01, 0.99] for c in "xyz"} | {"qx": [0.02, 0.98], "qy": [0.02, 0.98], "qz": [0.98]}
    names = {(c, q): f"{c}{n}" for c in "xyz" for n, q in enumerate((0.01, 0.99))} | {
        ("qx", 0.02): "wx0", ("qx", 0.98): "wx1", ("qy", 0.02): "wy0", ("qy", 0.98): "wy1", ("qz", 0.98): "ceiling"}
    own = [c for c in canons.columns if c == "tuning"]
    row = stats.wide(stats.percentiles(room0, ["set_id"], tails), ["set_id"], names).join(canons.select("set_id", "canon", "calibration_m", *own), "set_id")
    span = g.room_span(F.col("canon"))
    row = row.withColumn("span", span).withColumn("voxel", F.col("span") * p.voxel_frac)
    pad = lambda c: (F.col(f"{c}1") - F.col(f"{c}0")) * 0.08
    lo = [F.col(f"{c}0") - pad(c) - 2 * F.col("voxel") for c in "xyz"]
    cells = [(F.ceil((F.col(f"{c}1") + pad(c) + 2 * F.col("voxel") - low) / F.col("voxel")) + 1).cast("int") for c, low in zip("xyz", lo)]
    zero = F.lit(0.0)
    return row.select(
        "set_id", "voxel", F.array(*lo).alias("origin"), F.array(*cells).alias("shape"), "canon", "calibration_m", "span",
        (F.col("ceiling") * F.col("span") / F.col("voxel")).alias("ceiling_vox"), F.array("wx0", "wy0").alias("room_lo"), F.array("wx1", "wy1").alias("room_hi"),
        g.box([F.col("wx0"), F.col("wy0"), zero], [F.col("wx1"), F.col("wy1"), F.col("ceiling")]).alias("room_canon"), *own)


@dataclass
class DiffTables:
    grids: DataFrame
    occ: DataFrame
    candidates: DataFrame
    objects: DataFrame
    labels: DataFrame
    left_out: DataFrame | None = None       # (set_id, reason) of the sets that were not compared


def left_out(sizes: DataFrame, transforms: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """(set_id, reason): sets with a refused capture, and sets of which a state has no transform. A room with a hole in its history
    would show everything as gone and come again, so such a set is not compared at all."""
    known = transforms.filter("m is not null").select("set_id", "state").distinct()
    states = sizes.select("set_id", F.explode(F.sequence(F.lit(0), F.col("n_states") - 1)).alias("state"))
    holes = states.join(known, ["set_id", "state"], "left_anti").select("set_id", F.concat(F.lit("no transform for state "), F.col("state").cast("string")).alias("reason"))
    if refused is not None:
        holes = holes.unionByName(refused.select("set_id", F.concat(F.lit("capture refused at state "), F.col("state").cast("string")).alias("reason")))
    return holes.groupBy("set_id").agg(F.min("reason").alias("reason"))


def run(splats: DataFrame, transforms: DataFrame, canons: DataFrame, sizes: DataFrame, p: tk.DiffParams = tk.DiffParams(), refused: DataFrame | None = None) -> DiffTables:
    """The whole comparison of raw captures: one pass over the splats for the grids, one for the occupancy, the rest on voxels.

    ``refused(set_id, state)`` are captures that registration would not place; their sets, and those with a state that has no transform,
    are listed in ``left_out`` and compared no further."""
    out = written(left_out(sizes, transforms, refused), "left_out")
    whole = sizes.join(out, "set_id", "left_anti")
    aligned = into_frame(splats.join(whole.select("set_id"), "set_id", "left_semi"), transforms)
    done = _run_whole(aligned, canons, whole, p)
    done.left_out = out
    return done


def run_tuned(splats: DataFrame, transforms: DataFrame, canons: DataFrame, sizes: DataFrame, tuning: DataFrame, p: tk.DiffParams = tk.DiffParams(),
              refused: DataFrame | None = None) -> DiffTables:
    """``run`` with each set's own values: ``tuning(set_id, params MAP<STRING, DOUBLE>)``, a row for a set, replaces those of ``p`` it names; a set
    without a row has ``p``. The values travel as columns with the sets' grids, so all sets go through one run, however many tunings there are."""
    table = written(tk.tuning_table(sizes, tuning, p), "tuning")
    return run(splats, transforms, canons.join(table, "set_id"), sizes, tk.per_set(table), refused)


def _run_whole(aligned: DataFrame, canons: DataFrame, sizes: DataFrame, p: tk.DiffParams) -> DiffTables:
    grids = written(grid_spec(room_points(aligned.filter("state = 0"), canons), canons, p), "grids")
    occ = written(vx.occupancy(aligned, grids, p.opacity_solid, p.min_count), "occ")
    return run_on_voxels(occ, grids, sizes, p)


def run_on_voxels(occ: DataFrame, grids: DataFrame, sizes: DataFrame, p: tk.DiffParams = tk.DiffParams(), bits: int = vx.BLOCK_BITS) -> DiffTables:
    changed = vx.changes(occ, sizes, grids, p.floor_band_voxels, p.jitter_voxels, bits)
    split = written(tk.change_blobs(written(changed, "changed"), grids, bits), "split")
    cands = written(tk.candidates(split, occ, grids, sizes, p, bits), "candidates")
    blobs = written(tk.kept_blobs(split, cands), "blobs")
    objects, labels = tk.track(occ, blobs, grids, sizes, p, bits)
    return DiffTables(grids, occ, cands, objects, labels)
