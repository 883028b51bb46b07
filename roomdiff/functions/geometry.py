"""Matrices, quaternions, boxes and floor places as column expressions.

A matrix is ARRAY<ARRAY<DOUBLE>> with four rows of four, a box is STRUCT<lo: ARRAY<DOUBLE>, hi: ARRAY<DOUBLE>>.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell(m: Column, r: int, c: int) -> Column:
    return m[r][c]


def matrix(rows: list[list[Column | float]]) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.array(*[F.array(*[lit(v).cast("double") for v in row]) for row in rows])


def identity() -> Column:
    return matrix([[float(r == c) for c in range(4)] for r in range(4)])


def multiply(a: Column, b: Column) -> Column:
    return matrix([[sum((cell(a, r, k) * cell(b, k, c) for k in range(1, 4)), cell(a, r, 0) * cell(b, 0, c))
                    for c in range(4)] for r in range(4)])


def place(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The point (x, y, z) under m."""
    return tuple(cell(m, r, 0) * x + cell(m, r, 1) * y + cell(m, r, 2) * z + cell(m, r, 3) for r in range(3))


def turn(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The direction (x, y, z) under the 3×3 part of m."""
    return tuple(cell(m, r, 0) * x + cell(m, r, 1) * y + cell(m, r, 2) * z for r in range(3))


def _minor(m: Column, r: int, c: int) -> Column:
    (r0, r1), (c0, c1) = [[i for i in range(3) if i != k] for k in (r, c)]
    return cell(m, r0, c0) * cell(m, r1, c1) - cell(m, r0, c1) * cell(m, r1, c0)


def determinant(m: Column) -> Column:
    """Determinant of the 3×3 part."""
    return cell(m, 0, 0) * _minor(m, 0, 0) - cell(m, 0, 1) * _minor(m, 0, 1) + cell(m, 0, 2) * _minor(m, 0, 2)


def uniform_scale(m: Column) -> Column:
    return F.cbrt(F.abs(determinant(m)))


def inverse(m: Column) -> Column:
    """Inverse of an affine matrix."""
    det = determinant(m)
    inv = [[(_minor(m, c, r) * (1.0 if (r + c) % 2 == 0 else -1.0)) / det for c in range(3)] for r in range(3)]
    rows = [inv[r] + [-(inv[r][0] * cell(m, 0, 3) + inv[r][1] * cell(m, 1, 3) + inv[r][2] * cell(m, 2, 3))] for r in range(3)]
    return matrix(rows + [[0.0, 0.0, 0.0, 1.0]])


def metres_per_unit(canon: Column, calibration_m: Column) -> Column:
    """Metres per reference unit: the canonical frame divides by the room's span, which measures calibration_m."""
    return calibration_m * uniform_scale(canon)


def room_span(canon: Column) -> Column:
    return 1.0 / uniform_scale(canon)


def world_from_canon(calibration_m: Column) -> Column:
    """Unit room frame, z up -> metres, y up."""
    c = calibration_m
    return matrix([[c, 0, 0, 0], [0, 0, c, 0], [0, -c, 0, 0], [0, 0, 0, 1]])


def world_from_ref(canon: Column, calibration_m: Column) -> Column:
    return multiply(world_from_canon(calibration_m), canon)


# ---- rotations -----------------------------------------------------------------------------------------------------

def quaternion(m: Column) -> Column:
    """Unit quaternion (w, x, y, z) of a rotation matrix: solved from the largest of its four components."""
    a = lambda r, c: cell(m, r, c)
    squares = {
        "w": 1.0 + a(0, 0) + a(1, 1) + a(2, 2),
        "x": 1.0 + a(0, 0) - a(1, 1) - a(2, 2),
        "y": 1.0 - a(0, 0) + a(1, 1) - a(2, 2),
        "z": 1.0 - a(0, 0) - a(1, 1) + a(2, 2),
    }
    skew = [a(2, 1) - a(1, 2), a(0, 2) - a(2, 0), a(1, 0) - a(0, 1)]
    pair = {("x", "y"): a(0, 1) + a(1, 0), ("x", "z"): a(0, 2) + a(2, 0), ("y", "z"): a(1, 2) + a(2, 1)}

    def solved(lead: str) -> Column:
        size = F.sqrt(squares[lead])                      # twice the leading component
        parts = []
        for axis in "wxyz":
            if axis == lead:
                parts.append(size / 2)
            elif "w" in (axis, lead):
                parts.append(skew["xyz".index(axis if lead == "w" else lead)] / (2 * size))
            else:
                parts.append(pair[tuple(sorted((axis, lead)))] / (2 * size))
        return F.array(*parts)

    trace = a(0, 0) + a(1, 1) + a(2, 2)
    return (
        F.when(trace > 0, solved("w"))
        .when((a(0, 0) >= a(1, 1)) & (a(0, 0) >= a(2, 2)), solved("x"))
        .when(a(1, 1) >= a(2, 2), solved("y"))
        .otherwise(solved("z"))
    )


def quaternion_product(p: Column, q: Column) -> Column:
    """Hamilton product of two (w, x, y, z) arrays."""
    w, x, y, z = (p[i] for i in range(4))
    s, a, b, c = (q[i] for i in range(4))
    return F.array(w * s - x * a - y * b - z * c, w * a + x * s + y * c - z * b,
                   w * b + y * s + z * a - x * c, w * c + z * s + x * b - y * a)


def rotation_angle_deg(a: Column, b: Column) -> Column:
    """Angle between the rotations of two similarities."""
    trace = sum((cell(a, r, c) * cell(b, r, c) for r, c in itertools.product(range(3), repeat=2)), F.lit(0.0))
    cosine = (trace / F.cbrt(determinant(a)) / F.cbrt(determinant(b)) - 1.0) / 2.0
    return F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))


# ---- boxes and places on the floor ----------------------------------------------------------------------------------

def box(lo: list[Column], hi: list[Column]) -> Column:
    return F.struct(F.array(*lo).alias("lo"), F.array(*hi).alias("hi"))


def box_under(m: Column, b: Column, digits: int | None = 4) -> Column:
    """Axis-aligned box around the eight corners of b under m."""
    corners = [place(m, *(b[side][axis] for axis, side in enumerate(sides))) for sides in itertools.product(("lo", "hi"), repeat=3)]
    done = (lambda c: F.bround(c, digits)) if digits is not None else (lambda c: c)
    lo = [done(F.least(*[c[axis] for c in corners])) for axis in range(3)]
    hi = [done(F.greatest(*[c[axis] for c in corners])) for axis in range(3)]
    return box(lo, hi)


def middle(b: Column, axis: int) -> Column:
    return (b["lo"][axis] + b["hi"][axis]) / 2.0


def floor_distance(x0: Column, z0: Column, x1: Column, z1: Column) -> Column:
    return F.hypot(x0 - x1, z0 - z1)


def size_along(b: Column, axis: int) -> Column:
    return b["hi"][axis] - b["lo"][axis]
