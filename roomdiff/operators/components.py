"""Connected components of voxel sets and of small graphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomdiff.functions import voxel as v
from roomdiff.functions.stage import written
from roomdiff.operators.voxels import BLOCK_BITS, _bounds, _local

FORWARD = [o for o in v.AROUND if v.step(o) > 0]      # one of each pair of opposite neighbours


def _label_cube(mask: np.ndarray) -> np.ndarray:
    """For each set cell, the lowest flat index of its 26-connected component."""
    shape = mask.shape
    cells = np.flatnonzero(mask)
    rank = np.full(mask.size, -1, np.int64)
    rank[cells] = np.arange(len(cells))
    rank = rank.reshape(shape)
    pairs = []
    for off in FORWARD:
        a = tuple(slice(max(0, -o), s - max(0, o)) for o, s in zip(off, shape))
        b = tuple(slice(max(0, o), s - max(0, -o)) for o, s in zip(off, shape))
        both = (rank[a] >= 0) & (rank[b] >= 0)
        pairs.append(np.stack([rank[a][both], rank[b][both]]))
    u, w = np.concatenate(pairs, axis=1)
    return cells[lowest(len(cells), u, w)]


def lowest(n: int, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the lowest one of its component under the edges ``u``, ``w`` (hooking and pointer jumping)."""
    root = np.arange(n)
    while True:
        ru, rw = root[u], root[w]
        apart = ru != rw
        if not apart.any():
            return root
        u, w, ru, rw = u[apart], w[apart], ru[apart], rw[apart]
        np.minimum.at(root, np.maximum(ru, rw), np.minimum(ru, rw))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


SMALL = 1 << 20             # edges that one task may hold


def _connect_small(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``connect`` for few edges: the edges of a key are in one task, which contracts all it has at once."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.select(*keys).schema) + ", node bigint, comp bigint"

    def solve(batches):
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        code = table.select(keys).to_pandas().groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        node = np.concatenate([table.column(c).to_numpy() for c in "uw"])
        both = np.concatenate([code, code])
        order = np.lexsort((node, both))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(node[order]) != 0) | (np.diff(both[order]) != 0)
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        first = order[new]
        u, w = at.reshape(2, -1)
        own = table.select(keys).take(pa.array(first % table.num_rows))
        found = pa.Table.from_arrays([*own.columns, pa.array(node[first]), pa.array(node[first][lowest(len(first), u, w)])], names=[*keys, "node", "comp"])
        yield from found.to_batches()

    return edges.repartition(*keys).mapInArrow(solve, schema)


def connect(edges: DataFrame, keys: list[str], small: int = 0) -> DataFrame:
    """(keys, node, comp): the lowest node of each component of ``edges(keys, u, w)``, by alternating large and small stars
    (Kiveris et al. 2014). A star is one grouping for the lowest neighbour and one join back; no neighbour list is collected. At most ``small``
    edges are contracted without stars, in one job."""
    cur = written(edges.filter("u <> w").select(*keys, F.greatest("u", "w").alias("u"), F.least("u", "w").alias("w")).distinct(), "edges")

    def fingerprint(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "w").cast("decimal(38,0)"))).first()

    seen = fingerprint(cur)
    if 0 < seen[0] <= small:
        return written(_connect_small(cur, keys), "connected")
    while seen[0]:
        both = cur.unionByName(cur.select(*keys, F.col("w").alias("u"), F.col("u").alias("w")))
        low = both.groupBy(*keys, "u").agg(F.least(F.min("w"), F.first("u")).alias("m"))
        large = both.join(low, [*keys, "u"]).filter(F.col("w") > F.col("u")).select(*keys, F.col("w").alias("u"), F.col("m").alias("w"))
        down = large.filter("u <> w").select(*keys, F.greatest("u", "w").alias("u"), F.least("u", "w").alias("w")).distinct()
        low = down.groupBy(*keys, "u").agg(F.min("w").alias("m"))
        linked = down.join(low, [*keys, "u"])
        small = linked.select(*keys, F.col("w").alias("u"), F.col("m").alias("w")).unionByName(low.select(*keys, "u", F.col("m").alias("w")))
        cur = written(small.filter("u <> w").distinct(), "edges")
        now = fingerprint(cur)
        if now == seen:
            break
        seen = now
    ends = cur.select(*keys, F.col("u").alias("node"), F.col("w").alias("comp"))
    return ends.unionByName(cur.select(*keys, F.col("w").alias("node"), F.col("w").alias("comp")).distinct())


def components(voxels: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """``voxels`` (distinct keys and vox) with ``comp``: the first voxel, in raster order, of its 26-connected component.

    Components are found inside cubes of 2**bits voxels (a bounded group), then only the voxels on cube faces are joined to find
    which local components touch, and that far smaller graph is contracted.
    """
    keys = [c for c in voxels.columns if c != "vox"]
    side = 1 << bits

    def solve(key, table):
        vox = np.sort(table.column("vox").to_numpy())
        base, shape = _bounds(vox)
        at = _local(vox, base)
        grid = np.zeros(shape, bool)
        grid[at] = True
        first = np.empty(grid.size, np.int64)
        flat = np.ravel_multi_index(at, grid.shape)
        first[flat] = vox
        out = [pa.array([k.as_py()] * len(vox), type=k.type) for k in key[:-1]]
        return pa.Table.from_arrays(out + [pa.array(vox), pa.array(first[_label_cube(grid)])], names=[*keys, "vox", "local"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in voxels.select(*keys).schema) + ", vox bigint, local bigint"
    local = written(voxels.withColumn("cube", v.block(F.col("vox"), bits)).groupBy(*keys, "cube").applyInArrow(solve, schema), "local")
    rim = None
    for c in v.shifted(F.col("vox")):
        on = c.bitwiseAND(side - 1).isin(0, side - 1)
        rim = on if rim is None else rim | on
    edge_voxels = local.filter(rim)
    hops = F.transform(F.array(*[F.lit(v.step(o)).cast("long") for o in FORWARD]), lambda m: m + F.col("vox"))
    out_of_cube = edge_voxels.select(*keys, F.col("vox").alias("from"), F.col("local").alias("u"), F.explode(hops).alias("vox")).filter(
        v.block(F.col("from"), bits) != v.block(F.col("vox"), bits))
    touching = out_of_cube.join(edge_voxels.withColumnRenamed("local", "w"), [*keys, "vox"]).select(*keys, "u", "w")
    merged = connect(touching, keys, SMALL).select(*keys, F.col("node").alias("local"), "comp")
    return local.join(merged, [*keys, "local"], "left").select(*keys, "vox", F.coalesce("comp", "local").alias("comp"))


def grow(seed: DataFrame, labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Seed voxels and every component of ``labelled(keys, vox, comp)`` they touch."""
    touched = labelled.join(seed.select(*keys, "vox"), [*keys, "vox"], "left_semi").select(*keys, "comp").distinct()
    return labelled.join(touched, [*keys, "comp"], "left_semi").select(*keys, "vox").unionByName(seed.select(*keys, "vox")).distinct()
