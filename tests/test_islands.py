import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_tracker import FLOOR, P, cube, tables

from roomdiff.operators import components as cc
from roomdiff.operators import islands as isl
from roomdiff.operators import tracker as tk
from roomdiff.operators import voxels as vx


def _blobs(spark, occ, grids, sizes):
    changed = vx.changes(occ, sizes, grids, 1, 1, 3)
    split = tk.change_blobs(changed, grids, 3).cache()
    return tk.kept_blobs(split, tk.candidates(split, occ, grids, sizes, P, 4)).cache()


@pytest.mark.parametrize("with_labels", [True, False])
def test_islands_in_tasks_and_states_in_turn_give_the_same_with_far_fewer_jobs(spark, monkeypatch, with_labels):
    """Boxes that come, go, shrink, touch and come again; a set ends early, one has an empty state, and without labels some voxels are in the table twice."""
    rng = np.random.default_rng(9)
    pool = [cube(x, y, 1, *rng.integers(2, 5, 3)) for x in (1, 8, 14) for y in (1, 5, 13)]
    cast = {s: [FLOOR | {c for b in pool if rng.random() < 0.5 for c in b if rng.random() < 0.95} for _ in range(n)] for s, n in (("a", 3), ("b", 2))}
    cast["c"] = [FLOOR | pool[0], set(), FLOOR | pool[0] | pool[8]]
    occ, grids, sizes = tables(spark, cast)
    occ = occ if with_labels else occ.unionByName(occ.filter(F.col("vox") % 5 == 0)).cache()
    blobs = _blobs(spark, occ, grids, sizes)

    def tracked():
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "track")
        try:
            objects, labels = tk.track(occ, blobs, grids, sizes, P, 3, with_labels)
            jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        names = [c for c in objects.columns if c != "bbox_canon"]
        return sorted(map(repr, objects.select(*names, "bbox_canon.lo", "bbox_canon.hi").collect())), [] if labels is None else sorted(map(tuple, labels.select("set_id", "state", "vox", "object_id").collect())), jobs

    whole = tracked()
    monkeypatch.setattr(isl, "BATCH", 1)
    monkeypatch.setattr(isl, "WHOLE", 0)
    by_states = tracked()
    assert whole[0] == by_states[0] and whole[1] == by_states[1]
    assert len(whole[0]) > 5 and (len(whole[1]) > 300) == with_labels
    assert 0 < whole[2] < 100 < by_states[2]


def test_boxes_are_dealt_to_grids_of_bounded_size(monkeypatch):
    monkeypatch.setattr(isl, "WHOLE", 1000)
    width = np.array([[5, 9, 9], [3, 2, 2], [4, 2, 2], [5, 9, 9], [90, 1, 1], [5, 9, 9]])
    parts = isl._parts(width)
    assert sorted(n for p in parts for n in p) == list(range(len(width)))
    assert all(width[p][:, 0].sum() * width[p][:, 1].max() * width[p][:, 2].max() <= 1000 for p in parts)


def test_moves_in_rounds_match_moves_in_a_task(spark, monkeypatch):
    rng = np.random.default_rng(4)
    schema = "set_id string, step int, id bigint, voxels bigint"
    one = lambda first: [(str(case), 1, first + n, int(x)) for case in range(25) for n, x in enumerate(rng.integers(6, 20, rng.integers(0, 8)))]
    closed, opened = (spark.createDataFrame(one(first), schema) for first in (0, 100))
    found = lambda: sorted(map(tuple, tk.match_moves(closed, opened).select("set_id", "moved_from", "moved_to").collect()))
    task = found()
    monkeypatch.setattr(tk, "MOVES", 0)
    assert task == found() and len(task) > 20


def test_a_small_graph_is_contracted_in_one_job(spark, monkeypatch):
    rng = np.random.default_rng(2)
    edges = [(str(k % 3), k % 2, int(u), int(w)) for k in range(400) for u, w in [rng.integers(0, 150, 2)]] + [("chain", 0, n, n + 1) for n in range(300)]
    df = spark.createDataFrame(edges, "set_id string, step int, u bigint, w bigint")
    found = lambda small: sorted(map(tuple, cc.connect(df, ["set_id", "step"], small).select("set_id", "step", "node", "comp").collect()))
    written = []
    monkeypatch.setattr(cc, "written", lambda df, name, real=cc.written: (written.append(name), real(df, name))[1])
    small = found(cc.SMALL)
    assert written == ["edges", "connected"] and ("chain", 0, 300, 0) in small
    assert small == found(0)
