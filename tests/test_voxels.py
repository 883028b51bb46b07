import numpy as np
import pytest
from pyspark.sql import functions as F

from roomdiff.functions import voxel as v
from roomdiff.operators import components as cc
from roomdiff.operators import voxels as vx


def as_df(spark, cells, **keys):
    cols = {**keys}
    rows = [(*cols.values(), int(i), int(j), int(k)) for i, j, k in cells]
    df = spark.createDataFrame(rows, [*cols, "i", "j", "k"])
    return df.select(*cols, v.pack(F.col("i"), F.col("j"), F.col("k")).alias("vox"))


def brute_components(cells):
    cells = {tuple(c) for c in cells}
    label, out = {}, {}
    for start in sorted(cells):
        if start in label:
            continue
        stack = [start]
        label[start] = start
        while stack:
            c = stack.pop()
            for o in v.AROUND:
                n = tuple(a + b for a, b in zip(c, o))
                if n in cells and n not in label:
                    label[n] = start
                    stack.append(n)
    return label


@pytest.mark.parametrize("density", [0.02, 0.08, 0.3])
def test_components_match_flood_fill(spark, density):
    rng = np.random.default_rng(7)
    cells = np.argwhere(rng.random((20, 20, 12)) < density)
    df = as_df(spark, cells, set_id="a").repartition(3)
    got = cc.components(df, bits=3)
    i, j, k = v.unpack(F.col("vox"))
    a, b, c = v.unpack(F.col("comp"))
    rows = got.select(F.array(i, j, k), F.array(a, b, c)).collect()
    assert {tuple(x): tuple(y) for x, y in rows} == brute_components(map(tuple, cells.tolist()))


@pytest.mark.parametrize("reach", [1, 2, 5])
def test_distances_match_brute_force(spark, reach):
    rng = np.random.default_rng(3)
    mask = np.argwhere(rng.random((20, 20, 12)) < 0.01)
    ask = np.argwhere(rng.random((20, 20, 12)) < 0.2)
    got = vx.distances(as_df(spark, ask, set_id="a"), as_df(spark, mask, set_id="a"), reach, bits=3)
    i, j, k = v.unpack(F.col("vox"))
    rows = {tuple(p): d for p, d in got.select(F.array(i, j, k), "d2").collect()}
    assert len(rows) == len(ask)
    for p in ask:
        d2 = int(((mask - p) ** 2).sum(axis=1).min())
        assert rows[tuple(p.tolist())] == (d2 if d2 <= reach * reach else None)


def test_no_mask_means_far(spark):
    ask = as_df(spark, [(1, 1, 1)], set_id="a")
    assert vx.far(ask, ask.filter("false"), 2).count() == 1


def test_boxes_overlap_highest_id_wins(spark):
    grids = spark.createDataFrame([("a", 1.0, [0.0, 0.0, 0.0], [20, 20, 20])], "set_id string, voxel double, origin array<double>, shape array<int>")
    boxes = spark.createDataFrame([("a", 0, [0.0] * 3, [10.0] * 3), ("a", 1, [5.2] * 3, [12.0] * 3)], "set_id string, id bigint, lo array<double>, hi array<double>")
    cells = as_df(spark, [(0, 0, 0), (5, 5, 5), (9, 9, 9), (11, 11, 11), (12, 12, 12), (4, 5, 5)], set_id="a")
    i = v.unpack(F.col("vox"))[0]
    rows = vx.voxels_in_boxes(cells, boxes, grids).select(i, "object_id").collect()
    assert {tuple(r) for r in rows} == {(0, 0), (5, 1), (9, 1), (11, 1), (4, 0)}


def test_keys_sort_in_raster_order_and_never_borrow(spark):
    df = as_df(spark, [(0, 0, 0), (0, 1, 0), (1, 0, 0)], set_id="a")
    i, j, k = v.unpack(F.col("vox") + v.step((0, 0, -1)))
    assert [tuple(r) for r in df.orderBy("vox").select(i, j, k).collect()] == [(0, 0, -1), (0, 1, -1), (1, 0, -1)]


@pytest.mark.parametrize("reach", [0, 1, 2, 3])
def test_dilations_match_brute_force(spark, reach):
    """Grids longer than a word along the last axis, voxels on word ends and grid faces, repeated rows, one set with a reach of its own."""
    rng = np.random.default_rng(reach)
    shape = (9, 8, 150)
    cells = {"a": np.argwhere(rng.random(shape) < 0.01).tolist() + [[0, 0, 0], [8, 7, 149], [4, 4, 63], [4, 4, 64], [4, 4, 127], [4, 4, 128], [4, 4, 128]],
             "b": np.argwhere(rng.random(shape) < 0.02).tolist()}
    df = as_df(spark, cells["a"], set_id="a").unionByName(as_df(spark, cells["b"], set_id="b")).repartition(4)
    grids = spark.createDataFrame([("a", list(shape)), ("b", list(shape))], "set_id string, shape array<int>")
    inside = lambda p: all(0 <= c < n for c, n in zip(p, shape))

    def moved(sets, offsets):
        return sorted((s, *p) for s in sets for p in {tuple(a + b for a, b in zip(c, o)) for c in cells[s] for o in offsets[s]} if inside(p))

    def rows(got):
        return sorted((r[0], *r[1]) for r in got.select("set_id", F.array(*v.unpack(F.col("vox")))).collect())

    ball = lambda most: [o for o in np.ndindex(*[2 * most + 1] * 3) if sum(abs(x - most) for x in o) <= most]
    around = lambda most: [tuple(x - most for x in o) for o in ball(most)]
    assert rows(vx.dilate_faces(df, grids, reach)) == moved("ab", {s: around(reach) for s in "ab"})
    own = vx.Reach(spark.createDataFrame([("a", reach), ("b", 1)], "set_id string, reach int"), max(reach, 1))
    assert rows(vx.dilate_faces(df, grids, own)) == moved("ab", {"a": around(reach), "b": around(1)})
    if reach == 1:
        assert rows(vx.dilate(df, grids)) == moved("ab", {s: [(0, 0, 0)] + v.AROUND for s in "ab"})


def test_distances_and_components_across_cubes(spark):
    """Small cubes asked for are not worked on one by one, and nothing is lost at the seams of those that are."""
    assert vx.cube_bits(3, 2) == vx.BLOCK_BITS and vx.cube_bits(6, 2) == 6 and vx.cube_bits(3, 100) == 7
    rng = np.random.default_rng(8)
    mask, ask = (np.unique(rng.integers(0, (100, 70, 5), (n, 3)), axis=0) for n in (300, 900))
    got = vx.distances(as_df(spark, ask, set_id="a"), as_df(spark, mask, set_id="a"), 4, bits=3)
    rows = {tuple(p): d for p, d in got.select(F.array(*v.unpack(F.col("vox"))), "d2").collect()}
    for p in ask:
        d2 = int(((mask - p) ** 2).sum(axis=1).min())
        assert rows[tuple(p.tolist())] == (d2 if d2 <= 16 else None)
    line = np.argwhere(rng.random((90, 3, 2)) < 0.4)
    found = cc.components(as_df(spark, line, set_id="a")).select(F.array(*v.unpack(F.col("vox"))), F.array(*v.unpack(F.col("comp")))).collect()
    assert {tuple(x): tuple(y) for x, y in found} == brute_components(map(tuple, line.tolist()))
