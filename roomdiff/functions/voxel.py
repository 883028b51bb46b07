"""Voxel keys. A voxel (i, j, k) travels as one LONG that sorts in raster order; coordinates are shifted by a margin so that
stepping off the low side of a grid never borrows from the next axis."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 21
MARGIN = 64
MASK = (1 << BITS) - 1
STRIDE = (1 << (2 * BITS), 1 << BITS, 1)

FACES = [o for o in itertools.product((-1, 0, 1), repeat=3) if sum(map(abs, o)) == 1]
AROUND = [o for o in itertools.product((-1, 0, 1), repeat=3) if o != (0, 0, 0)]


def step(offset: tuple[int, int, int]) -> int:
    """What to add to a key to move by the offset."""
    return sum(o * s for o, s in zip(offset, STRIDE))


def pack(i: Column, j: Column, k: Column) -> Column:
    axes = [(c.cast("long") + MARGIN) * s for c, s in zip((i, j, k), STRIDE)]
    return axes[0] + axes[1] + axes[2]


def shifted(vox: Column) -> tuple[Column, Column, Column]:
    """The three coordinates with the margin still on."""
    return (F.shiftright(vox, 2 * BITS), F.shiftright(vox, BITS).bitwiseAND(MASK), vox.bitwiseAND(MASK))


def unpack(vox: Column) -> tuple[Column, Column, Column]:
    return tuple((c - MARGIN).cast("int") for c in shifted(vox))


def inside(vox: Column, shape: Column) -> Column:
    i, j, k = unpack(vox)
    return (i >= 0) & (j >= 0) & (k >= 0) & (i < shape[0]) & (j < shape[1]) & (k < shape[2])


def flat(i: Column, j: Column, k: Column, shape: Column) -> Column:
    """Row-major index of a voxel in its grid, or -1 outside."""
    ok = (i >= 0) & (j >= 0) & (k >= 0) & (i < shape[0]) & (j < shape[1]) & (k < shape[2])
    return F.when(ok, (i.cast("long") * shape[1] + j) * shape[2] + k).otherwise(F.lit(-1).cast("long"))


def index_of(p: Column, origin: Column, size: Column) -> Column:
    return F.floor((p - origin) / size).cast("int")


def block(vox: Column, bits: int, shift: tuple[int, int, int] = (0, 0, 0)) -> Column:
    """Key of the cube of 2**bits voxels a side that holds the voxel moved by ``shift``."""
    axes = [F.shiftright(c + d, bits) * s for c, d, s in zip(shifted(vox), shift, STRIDE)]
    return axes[0] + axes[1] + axes[2]


def blocks_within(vox: Column, bits: int, reach: int | Column, most: int | None = None) -> Column:
    """Keys of every cube that has a voxel within ``reach`` of this one along each axis (reach below the cube's side). Of a column ``most`` is
    the largest."""
    ends = (-reach, reach) if 2 * (reach if most is None else most) < 1 << bits else (-reach, 0, reach)
    return F.array_distinct(F.array(*[block(vox, bits, shift) for shift in itertools.product(ends, repeat=3)]))
