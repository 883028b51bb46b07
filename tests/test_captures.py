import numpy as np
import pytest
from pyspark.sql import functions as F

from roomdiff.operators import splats as sp
from roomdiff.sources import captures as cap

NAMES = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", *[f"f_rest_{i}" for i in range(9)], "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]


def write(path, rows, names=NAMES, head="ply", fmt="binary_little_endian", kind="float", element="vertex", short=0):
    text = f"{head}\nformat {fmt} 1.0\nelement {element} {len(rows)}\n" + "".join(f"property {kind} {n}\n" for n in names) + "end_header\n"
    path.write_bytes(text.encode() + np.ascontiguousarray(rows, "<f4").tobytes()[: len(rows) * len(names) * 4 - short])
    return str(path)


@pytest.fixture()
def rows():
    return np.random.default_rng(1).normal(size=(500, len(NAMES))).astype("f4")


def test_reads_every_row_in_ranges(spark, tmp_path, rows):
    df = cap.read_captures(spark, [("a", 0, write(tmp_path / "c0.ply", rows)), ("a", 1, write(tmp_path / "c1.ply", rows[:7]))], range_bytes=4096)
    assert df.rdd.getNumPartitions() > 5
    got = df.filter("state = 0").orderBy("splat_id").toPandas()
    assert len(got) == 500 and df.count() == 507
    np.testing.assert_array_equal(got["x"], rows[:, 0].astype(float))
    np.testing.assert_allclose(got["opacity"], 1 / (1 + np.exp(-rows[:, NAMES.index("opacity")].astype(float))))
    assert list(got["f_rest"][3]) == list(rows[3, 6:15]) and list(got["rot"][4]) == list(rows[4, -4:])


def test_many_small_ranges_share_tasks(spark, tmp_path, rows):
    many = np.tile(rows, (8, 1))
    files = [("a", 0, write(tmp_path / "c0.ply", many)), ("a", 1, write(tmp_path / "c1.ply", rows[:7]))]
    df = cap.read_captures(spark, files, range_bytes=256, columns=["state", "splat_id", "x"])
    assert 8 < df.rdd.getNumPartitions() <= cap.TASKS * spark.sparkContext.defaultParallelism + 2
    got = df.orderBy("state", "splat_id").toPandas()
    np.testing.assert_array_equal(got["splat_id"], [*range(4000), *range(7)])
    np.testing.assert_array_equal(got["x"], np.r_[many[:, 0], rows[:7, 0]].astype(float))


@pytest.mark.parametrize("broken, message", [
    (dict(head="plain"), "not a ply"), (dict(fmt="ascii"), "binary_little_endian"), (dict(kind="double"), "only float32"),
    (dict(element="face"), "'vertex'"), (dict(short=4), "body is"), (dict(names=NAMES[1:]), "missing property 'x'")])
def test_each_broken_file_is_named(spark, tmp_path, rows, broken, message):
    names = broken.get("names", NAMES)
    path = write(tmp_path / "bad.ply", rows[:, : len(names)], **broken)
    with pytest.raises(cap.CaptureError, match=message):
        cap.read_header(path)
    with pytest.raises(Exception, match="bad.ply"):
        cap.read_captures(spark, [("a", 0, path)]).count()


def test_lists_and_prunes_files(spark, tmp_path, rows):
    for name, n in (("a", 0), ("a", 1), ("b", 0)):
        (tmp_path / name / "raw").mkdir(parents=True, exist_ok=True)
        write(tmp_path / name / "raw" / f"c{n}.ply", rows[: 10 + n])
    (tmp_path / "b" / "raw" / "c1.ply").write_bytes(b"broken")
    (tmp_path / "b" / "c2.ply").write_bytes(b"elsewhere")
    files = cap.list_captures(spark, tmp_path.as_uri())
    assert {(r.set_id, r.state) for r in files.collect()} == {("a", 0), ("a", 1), ("b", 0), ("b", 1)}
    wanted = ["set_id", "state", "splat_id", "rot", "opacity"]
    good = cap.read_captures(spark, files.filter("state < 1"), columns=wanted)         # the broken file is never opened
    assert good.columns == wanted and good.count() == 20 and good.rdd.getNumPartitions() == 2
    assert cap.read_captures(spark, files.filter("set_id = 'a' and state in (1, 5)")).count() == 11
    every = cap.read_captures(spark, files.filter("set_id = 'a'"))
    assert (every.filter("state = 0").count(), every.count()) == (10, 21)              # a filter does not stay with the reader
    assert cap.read_captures(spark, files.filter("false")).count() == 0
    with pytest.raises(Exception, match="c1.ply: not a ply"):
        cap.read_captures(spark, files).count()
    empty = cap.read_captures(spark, [("a", 0, write(tmp_path / "none.ply", rows[:0]))])
    assert empty.count() == 0 and len(empty.columns) == 12


def test_header_longer_than_a_read(tmp_path, rows):
    names = NAMES + [f"extra_{i}" for i in range(900)]
    path = write(tmp_path / "long.ply", np.zeros((3, len(names)), "f4"), names)
    head = cap.read_header(path)
    assert (head.rows, len(head.names)) == (3, len(names)) and head.offset > 4096
    (tmp_path / "cut.ply").write_bytes(b"ply\nformat ascii 1.0\n")
    with pytest.raises(cap.CaptureError, match="no end_header"):
        cap.read_header(str(tmp_path / "cut.ply"))
    with pytest.raises(cap.CaptureError, match="no such file"):
        cap.read_header(str(tmp_path / "missing.ply"))


def test_slim_drops_faint_and_broken_rows(spark, tmp_path, rows):
    rows = rows.copy()
    rows[:, NAMES.index("opacity")] = 1.0
    rows[0, 0], rows[1, NAMES.index("scale_1")], rows[2, NAMES.index("opacity")] = np.nan, np.inf, -4.0
    got = cap.slim(cap.read_captures(spark, [("a", 0, write(tmp_path / "c0.ply", rows))]))
    assert got.count() == 497
    assert got.agg(F.max(F.size("f_rest"))).first()[0] == 0
    assert cap.coefficient_counts(cap.read_captures(spark, [("a", 0, str(tmp_path / "c0.ply"))]), 1).first().coefficients == 3


def turn(axis, a):
    k = np.zeros((3, 3))
    k[(axis + 1) % 3, (axis + 2) % 3], k[(axis + 2) % 3, (axis + 1) % 3] = -1, 1
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


def to_matrix(q):
    w, x, y, z = q / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
                     [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


@pytest.mark.parametrize("angle", [0.4, 2.9])
def test_similarity_moves_positions_scales_turns_and_colour(spark, tmp_path, rows, angle):
    rows = rows[:40]
    R = turn(0, angle) @ turn(1, 2 * angle) @ turn(2, -angle)
    M = np.eye(4)
    M[:3, :3], M[:3, 3] = 2.5 * R, [1, -2, 3]
    df = cap.read_captures(spark, [("a", 0, write(tmp_path / "c0.ply", rows))])
    t = spark.createDataFrame([("a", 0, M.tolist())], "set_id string, state int, m array<array<double>>")
    got = sp.transform(df, t).orderBy("splat_id").toPandas()
    np.testing.assert_allclose(got[["x", "y", "z"]], rows[:, :3].astype(float) @ M[:3, :3].T + M[:3, 3], atol=1e-9)
    np.testing.assert_allclose(np.stack(got["scale"]), rows[:, -7:-4] + np.log(2.5), atol=1e-5)
    for q0, q1 in zip(rows[:, -4:], got["rot"]):
        np.testing.assert_allclose(to_matrix(np.asarray(q1, float)), R @ to_matrix(q0.astype(float)), atol=1e-5)
    for before, after in zip(rows[:, 6:15], got["f_rest"]):
        for ch in range(3):
            c, d = before[3 * ch: 3 * ch + 3], after[3 * ch: 3 * ch + 3]
            np.testing.assert_allclose([-d[2], -d[0], d[1]], R @ [-c[2], -c[0], c[1]], atol=1e-5)
    with pytest.raises(ValueError):
        sp.transform(df, spark.createDataFrame([("a", 0, np.diag([1.0, 1, -1, 1]).tolist())], t.schema))


def test_hash_ignores_row_order(spark):
    df = spark.range(50).select(F.lit("a").alias("set_id"), F.lit(0).alias("state"), F.col("id").alias("x"))
    assert cap.content_hash(df).first().hash == cap.content_hash(df.orderBy(F.desc("x"))).first().hash
