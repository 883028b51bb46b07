"""Archives written and read back against a plain reader of whole files."""

import glob
import hashlib
import random

import pytest

from roomdiff.llm import warc
from tests.llm.helpers import rows

SCHEMA = "page_id bigint, url string, html string, kind string, at bigint, file string"
NESTED = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Type: text/plain\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")


def plain_records(folder):
    out = []
    for path in sorted(glob.glob(f"{folder}/part-*")):
        raw, at = open(path, "rb").read(), 0
        while at < len(raw):
            assert raw[at:at + 8] in (b"WARC/1.0", b"WARC/1.1")
            end = raw.index(b"\r\n\r\n", at)
            head = dict(x.split(b": ", 1) for x in raw[at:end].split(b"\r\n")[1:])
            n = int(head[b"Content-Length"])
            block = raw[end + 4:end + 4 + n]
            assert len(block) == n and raw[end + 4 + n:end + 8 + n] == b"\r\n\r\n"
            out.append((path.rsplit("/", 1)[1], at, head[b"WARC-Type"].decode(), block.split(b"\r\n\r\n", 1)[1]))
            at = end + 8 + n
    return out


@pytest.fixture()
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def hostile():
    rng = random.Random(5)
    bits = ["\r\n\r\n", "\r\n", "WARC/1.", "1\r\n", "0\r\n", NESTED, "\r\n\r\n" + NESTED, "Content-Length: 4\r\n", "é☃🙂", "text ", "\r\n\r\nWARC/1.1\r\nContent-Length: 20\r\n\r\n"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(40)]


def test_round_trip(spark, tmp_path, small_ranges):
    texts = [None, "", "short", "short", "x" * 999, "x" * 999, NESTED, NESTED * 9, "\r\n\r\n" + NESTED, "WARC/1.1\r\n", "\r\n", "\r\n\r\n", *hostile(), "y" * 5000, "z" * 1000, "z" * 1000, "z" * 1000, NESTED * 9]
    data = [(k, None if k % 7 == 0 else f"http://a.b/{k}\r\nWARC/1.1", t, "clash", 1, "clash") for k, t in enumerate(texts)]
    data += [(None, None, "z" * 1000, "", 1, ""), (None, "u", None, "", 1, ""), (3, "again", "short", "", 1, "")]
    pages = spark.createDataFrame(data, SCHEMA).repartition(3)
    folder = str(tmp_path / "a")
    warc.write(pages, folder, records=9)
    want = plain_records(folder)
    got = sorted((r.file.rsplit("/", 1)[1], r.at, r.kind, bytes(r.payload)) for r in warc.read(spark, folder).collect())
    assert got == sorted(want) and len(got) == len(data)
    assert warc.problems(spark, folder).count() == 0
    back = warc.resolved(warc.read(spark, folder, keep=False)).collect()
    assert all(r.intact is (None if r.kind == "revisit" else True) for r in back) and all(r.payload is None for r in back)
    first = {}
    for i, _, t, *_ in data:
        raw = (t or "").encode()
        if len(raw) >= 1000 and i is not None:
            first[raw] = max(first.get(raw, i), i)
    expected = sorted((str(i), len(raw := (t or "").encode()), hashlib.sha1(raw).hexdigest(), *(("revisit", str(first[raw])) if raw in first and first[raw] != i else ("response", "None"))) for i, _, t, *_ in data)
    assert sorted((str(r.id), r.payload_bytes, r.digest, r.kind, str(r.refers)) for r in back) == expected
    assert {r.refers_found for r in back} == {None, True}
    joined = str(tmp_path / "b")                        # repeated payloads met by a join
    warc.write(pages, joined, most_bytes=0)
    key = lambda r: (str(r.id), r.payload_bytes, r.digest, r.kind, str(r.refers))
    assert sorted(map(key, warc.resolved(warc.read(spark, joined, keep=False)).collect())) == sorted(map(key, back))


def test_ranges_tile_long_files(spark, tmp_path):
    rng = random.Random(1)
    body = "".join(rng.choice(["\r\n\r\nWARC/1.", "\r\n\r\nWARC", "\r\n", "abcdefgh" * 50, "é"]) for _ in range(6000))
    raw = (NESTED.encode() + b"WARC/1.0\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body.encode()), body.encode())) * 3
    (tmp_path / "long.warc").write_bytes(raw)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("65536", "100003"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted((r.at, r.payload_bytes, r.digest) for r in warc.read(spark, str(tmp_path), keep=False).collect())
            one, two = len(NESTED), len(raw) // 3
            assert got == sorted(x for k in range(3) for x in [(k * two, 3, hashlib.sha1(b"abc").hexdigest()), (k * two + one, len(body.encode()), hashlib.sha1(body.encode()).hexdigest())])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_damage(spark, tmp_path):
    good = NESTED.encode()
    (tmp_path / "whole.warc").write_bytes(good * 3)
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "noise.warc").write_bytes(b"nothing here\r\n\r\n" + good)
    (tmp_path / "gap.warc").write_bytes(good * 2 + b"junk" + good)
    (tmp_path / "cut.warc").write_bytes(good * 2 + good[:-6])
    (tmp_path / "bare.warc").write_bytes(good + good[:-4])
    (tmp_path / "wrong.warc").write_bytes(good.replace(b"Content-Length", b"WARC-Payload-Digest: sha1:" + b"0" * 40 + b"\r\nContent-Length"))
    name = lambda r: r.file.rsplit("/", 1)[1].split(".")[0]
    got = sorted((name(r), r.at, r.intact) for r in warc.read(spark, str(tmp_path)).collect())
    n = len(good)
    assert got == sorted([("whole", 0, True), ("whole", n, True), ("whole", 2 * n, True), ("gap", 0, True), ("gap", n, True), ("cut", 0, True), ("cut", n, True), ("cut", 2 * n, False),
                          ("bare", 0, True), ("bare", n, True), ("wrong", 0, False)])
    assert sorted((name(r), r.at) for r in warc.problems(spark, str(tmp_path)).collect()) == [("cut", 3 * n), ("gap", 2 * n), ("noise", 0)]


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "none")
    warc.write(spark.createDataFrame([], SCHEMA), folder)
    assert rows(warc.resolved(warc.read(spark, folder)), "id") == []
