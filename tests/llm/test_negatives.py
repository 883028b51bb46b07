"""Hard negatives against all inner products, and the search's bounds against plain scores."""

import math

import numpy as np
import pyarrow as pa
import pytest

from roomdiff.llm import negatives
from tests.llm.helpers import rows

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, window string, score double"


def plain(data, anchors, positives=5, need=5, lowest=80, highest=100, scale=256):
    def sound(r):
        i, v, label = r[:3]
        return i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda v: [math.floor(scale * float(np.float32(x))) for x in v]
    held = [(i, label, whole(v)) for i, v, label, *_ in filter(sound, data)]
    asked = {(i, label, tuple(whole(v))) for i, v, label, *_ in filter(sound, anchors)}
    out = []
    for i, label, v in asked:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in held)
        for s, j, _ in [x for x in scores if x[2] == label and x[1] != i][:positives]:
            near = [(t, k) for t, k, m in scores if m != label and lowest * -s <= 100 * -t <= highest * -s][:need]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(near)]
    return sorted(out)


def table(spark, data):
    return spark.createDataFrame([(*r, "x", "y", 0.5) for r in data], SCHEMA).repartition(4)


def got(found):
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(seed, n, width, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [(k, [float(x) for x in centres[k % 6] * 0.4 + rng.normal(size=width) * 0.3], int(rng.integers(labels))) for k in range(n)]


@pytest.mark.parametrize("sample,chunk", [(2048, 4 << 20), (7, 700)])
def test_against_all_products(spark, sample, chunk):
    data = vectors(1, 260, 9)
    hot = data[20][1]
    data += [(1000 + k, hot, k % 3) for k in range(150)]                                    # one vector in many rows: ties by id
    data += [(None, hot, 1), (301, None, 1), (302, [0.5, None], 1), (303, [float("nan")] * 9, 1), (304, [float("inf")] * 9, 2), (305, hot, None), (306, [], 1), (307, hot[:4], 2),
             (20, hot, data[20][2]), (40, [-x for x in hot], 0), (500, [1.0] * 9, 77), (501, [0.0] * 9, 3)]
    anchors = [r for r in data if r[0] is not None and r[0] % 20 == 0]
    found = negatives.mine(table(spark, data), table(spark, anchors), sample=sample, chunk_bytes=chunk)
    assert got(found) == plain(data, anchors)


def test_parameters(spark):
    data = vectors(2, 120, 5, labels=2)
    anchors = data[::30]
    found = negatives.mine(table(spark, data), table(spark, anchors), positives=2, negatives=9, lowest=-50, highest=120, scale=100)
    assert got(found) == plain(data, anchors, 2, 9, -50, 120, 100)


def test_empty(spark):
    none, some = table(spark, vectors(3, 1, 4)).filter("vec_id < 0"), table(spark, vectors(3, 30, 4))
    for a, b in [(none, none), (some, none), (none, some)]:
        assert rows(negatives.mine(a, b), "anchor_id") == []


def test_bounds_lose_nothing():
    rng = np.random.default_rng(4)
    for width in (1, 16, 23, 64):
        r = rng.integers(-60, 60, (500, width)).astype(float) * (0.9 ** np.arange(width))
        q = rng.integers(-60, 60, (70, width)).astype(float) * (0.9 ** np.arange(width))
        score = q @ r.T
        for part in (0.5, 0.9, 0.99):
            floor = np.quantile(score, part, axis=1)
            who, row = negatives.above(q, floor, r, float(floor.min()))
            assert len(set(zip(who, row))) == len(who)
            assert {(int(a), int(b)) for a, b in zip(*np.nonzero(score >= floor[:, None]))} <= set(zip(who.tolist(), row.tolist()))
            assert part < 0.9 or len(who) < 0.7 * score.size


def test_lists_of_uneven_length():
    column = pa.array([[1, 2, 3], [], [4]], pa.list_(pa.int64()))
    assert negatives.matrix(column, 3).tolist() == [[1, 2, 3], [0, 0, 0], [4, 0, 0]]
    assert negatives.matrix(column.slice(2), 3).tolist() == [[4, 0, 0]]
    assert sorted(negatives.best(np.array([1, 0, 1, 1]), np.array([5, 9, 5, 7]), np.array([3, 1, 2, 8]), 2).tolist()) == [1, 2, 3]
