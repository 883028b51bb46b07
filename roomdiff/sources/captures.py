"""Gaussian-splat capture files as a Spark data source, and the slim table made from them.

    files = captures.list_captures(spark, "hdfs://…/sets").filter("state >= 1")
    captures.read_captures(spark, files, columns=["set_id", "state", "x", "y", "z"])

A file is a text header — magic, format, one ``vertex`` element, float properties — and rows of little-endian float32. The driver only knows
names and sizes, as Spark's own file listing gives them; a partition is a range of bytes, and its task reads the header and then the rows that
start inside the range. Paths may be local or addresses of any file system that Arrow opens. Files are chosen by filtering their list, before
anything is opened; only the columns asked for are built. (Spark keeps what a reader's ``pushFilters`` chose for later uses of the same DataFrame,
also without the filter, so filters are not pushed into the reader.)
"""

from __future__ import annotations

import glob
import io
import json
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from roomdiff.functions import scalar as s

# Fixed names of the capture format.
REQUIRED = ["x", "y", "z", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
COLOUR = ["f_dc_0", "f_dc_1", "f_dc_2"]
FLOAT_NAMES = ("float", "float32")
SCHEMA = ("set_id string, state int, splat_id bigint, x double, y double, z double, opacity_logit float, opacity double, "
          "scale array<float>, rot array<float>, f_dc array<float>, f_rest array<float>")
RANGE_BYTES = 64 << 20
BATCH_ROWS = 1 << 16
TASKS = 4                       # tasks for each core that the ranges of a read are dealt to, while these stay under ``RANGE_BYTES``
HEADER_BYTES = 1 << 20          # a header ends within these


class CaptureError(ValueError):
    """A capture file that cannot be read; the message names the file and the rule it breaks."""


@dataclass
class Header:
    names: list[str]
    rows: int
    offset: int


def _file_system(path: str):
    """(file system, path in it) of a local path or an address."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", path) else (fs.LocalFileSystem(), path)


def open_capture(path: str) -> pa.NativeFile:
    system, where = _file_system(path)
    return system.open_input_file(where)


def file_size(path: str) -> int:
    system, where = _file_system(path)
    info = system.get_file_info(where)
    if not info.is_file:
        raise CaptureError(f"{path}: no such file")
    return info.size


def _head(path: str) -> bytes:
    """The first bytes of a file, to the end of its header if that is within ``HEADER_BYTES``."""
    with open_capture(path) as fh:
        size, n = fh.size(), 4096
        while True:
            head = fh.read_at(min(n, size), 0)
            if n >= min(size, HEADER_BYTES) or re.search(rb"\nend_header[^\n]*\n", head):
                return head
            n *= 4


def read_header(path: str, size: int | None = None) -> Header:
    """The header of one capture, with every rule about it checked, the body's size included."""
    names, rows, layout = [], None, None
    size = file_size(path) if size is None else size
    with io.BytesIO(_head(path)) as fh:
        if fh.readline().strip() != b"ply":
            raise CaptureError(f"{path}: not a ply file")
        while True:
            line = fh.readline()
            if not line:
                raise CaptureError(f"{path}: header has no end_header")
            head, *rest = line.decode("ascii", "replace").split() or [""]
            if head == "end_header":
                break
            if head == "format":
                layout = rest[0]
            elif head == "element":
                if rest[0] != "vertex":
                    raise CaptureError(f"{path}: only a single 'vertex' element is supported, found '{rest[0]}'")
                rows = int(rest[1])
            elif head == "property":
                if rest[0] not in FLOAT_NAMES:
                    raise CaptureError(f"{path}: property '{rest[-1]}' is {rest[0]}; only float32 is supported")
                names.append(rest[1])
        offset = fh.tell()
    if layout != "binary_little_endian":
        raise CaptureError(f"{path}: format must be binary_little_endian, got {layout}")
    if rows is None:
        raise CaptureError(f"{path}: header has no 'element vertex'")
    if not names:
        raise CaptureError(f"{path}: header has no properties")
    body, want = size - offset, rows * len(names) * 4
    if body != want:
        raise CaptureError(f"{path}: body is {body} bytes, the header promises {want}")
    for name in REQUIRED:
        if name not in names:
            raise CaptureError(f"{path}: missing property '{name}'")
    if sum(n.startswith("f_rest_") for n in names) % 3:
        raise CaptureError(f"{path}: the count of f_rest_* is not a multiple of 3")
    return Header(names, rows, offset)


@dataclass
class ByteRange(InputPartition):
    path: str
    set_id: str
    state: int
    size: int
    first: int
    last: int


class CaptureReader(DataSourceReader):
    def __init__(self, options, names: list[str]):
        self.files = json.loads(options["files"])
        # A partition is a whole number of ranges: one, or as many as keep the partitions to ``tasks`` and one more for each file.
        range_bytes, tasks = int(options.get("rangeBytes", RANGE_BYTES)), int(options.get("tasks", 0))
        share = min(RANGE_BYTES, sum(f["size"] for f in self.files) // tasks) if tasks else 0
        self.range_bytes = range_bytes * max(1, -(-share // range_bytes))
        self.names = names

    def partitions(self):
        """Ranges of bytes; an empty or cut file still has one, so that its header is looked at."""
        return [ByteRange(f["path"], f["set_id"], f["state"], f["size"], a, min(a + self.range_bytes, f["size"]))
                for f in self.files for a in range(0, max(1, f["size"]), self.range_bytes)]

    def read(self, part: ByteRange | None):
        if part is None:            # what Spark passes when there are no files
            return
        head = read_header(part.path, part.size)
        stride, col = 4 * len(head.names), {n: i for i, n in enumerate(head.names)}
        first, end = (min(head.rows, max(0, -((head.offset - at) // stride))) for at in (part.first, part.last))      # rows that start in the range
        rest = sorted((n for n in head.names if n.startswith("f_rest_")), key=lambda n: int(n.rsplit("_", 1)[1]))
        with open_capture(part.path) as fh:
            for a in range(first, end, BATCH_ROWS):
                n = min(BATCH_ROWS, end - a)
                block = np.frombuffer(fh.read_at(n * stride, head.offset + a * stride), "<f4").reshape(n, len(head.names))

                def lists(wanted):
                    have = [col[c] for c in wanted if c in col]
                    flat = pa.array(np.ascontiguousarray(block[:, have]).ravel(), pa.float32())
                    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(have)), flat)

                def solid():
                    with np.errstate(over="ignore"):
                        return 1.0 / (1.0 + np.exp(-block[:, col["opacity"]].astype(np.float64)))

                make = {"set_id": lambda: pa.array([part.set_id] * n), "state": lambda: pa.array(np.full(n, part.state, np.int32)),
                        "splat_id": lambda: pa.array(np.arange(a, a + n, dtype=np.int64)), "opacity_logit": lambda: pa.array(np.ascontiguousarray(block[:, col["opacity"]])),
                        "opacity": lambda: pa.array(solid()), "scale": lambda: lists(REQUIRED[4:7]), "rot": lambda: lists(REQUIRED[7:]), "f_dc": lambda: lists(COLOUR),
                        "f_rest": lambda: lists(rest), **{c: lambda c=c: pa.array(block[:, col[c]].astype(np.float64)) for c in "xyz"}}
                yield pa.RecordBatch.from_arrays([make[c]() for c in self.names], names=self.names)


class SplatCapture(DataSource):
    @classmethod
    def name(cls):
        return "splat_capture"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CaptureReader(self.options, schema.names)


def read_captures(spark: SparkSession, files: list[tuple[str, int, str]] | DataFrame, range_bytes: int = RANGE_BYTES, columns: list[str] | None = None) -> DataFrame:
    """``files`` are (set_id, state, path), as a list or as the table that ``list_captures`` gives; ``columns`` the ones wanted. A file that breaks
    a rule fails the read with its name and the rule. A task reads one range of ``range_bytes`` or, where a read has many, several that follow each other."""
    spark.dataSource.register(SplatCapture)
    if isinstance(files, DataFrame):
        found = [(r.set_id, r.state, r.path, r.length) for r in files.select("set_id", "state", "path", "length").collect()]       # names and sizes, a row for a file
    else:
        found = [(a, b, c, file_size(c)) for a, b, c in files]
    listed = json.dumps([dict(zip(("set_id", "state", "path", "size"), f)) for f in found])
    types = dict(f.split() for f in SCHEMA.split(", "))
    schema = ", ".join(f"{c} {types[c]}" for c in columns or types)
    return spark.read.format("splat_capture").schema(schema).option("files", listed).option("rangeBytes", str(range_bytes)).option("tasks", str(TASKS * spark.sparkContext.defaultParallelism)).load()


LAYOUT = r"([^/]+)/raw/c([0-9]+)[.]ply$"


def list_captures(spark: SparkSession, folder: str) -> DataFrame:
    """(set_id, state, path, length) of the captures laid out as ``<folder>/<set>/raw/c<state>.ply``, on any file system Spark lists."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "c*.ply").load(folder)
    part = lambda n: F.regexp_extract("path", LAYOUT, n)
    return files.filter(F.col("path").rlike(LAYOUT)).select(part(1).alias("set_id"), part(2).cast("int").alias("state"), "path", "length")


def find_captures(folder: str) -> list[tuple[str, int, str]]:
    """Captures laid out as ``<folder>/<set>/raw/c<state>.ply`` in a local folder."""
    found = []
    for path in sorted(glob.glob(f"{folder}/*/raw/c*.ply")):
        state = os.path.basename(path)[1:-4]
        if state.isdigit():
            found.append((path.split("/")[-3], int(state), path))
    return found


def slim(splats: DataFrame, min_opacity: float = 0.05) -> DataFrame:
    """The columns that survive ingest: view-dependent colour dropped, rows with any value not finite dropped, faint rows dropped."""
    whole = F.lit(True)
    for c in ("x", "y", "z", "opacity_logit"):
        whole = whole & s.is_finite(F.col(c))
    for c in ("scale", "rot", "f_dc"):
        whole = whole & F.forall(c, lambda e: s.is_finite(e))
    kept = splats.filter(whole & (F.col("opacity_logit").cast("double") >= s.logit(min_opacity)))
    return kept.withColumn("f_rest", F.array().cast("array<float>"))


def coefficient_counts(splats: DataFrame, degree: int = 0) -> DataFrame:
    """(set_id, state, coefficients, problem): view-dependent coefficients per channel, and why the asked degree cannot be written."""
    per = splats.groupBy("set_id", "state").agg(F.max(F.size("f_rest")).alias("n"))
    problem = (F.when(F.col("n") % 3 != 0, "f_rest count is not a multiple of 3").when(F.lit(degree >= 2), "only degrees 0 and 1 are supported")
               .when(F.lit(degree == 1) & (F.col("n") < 9), "no band 1 coefficients"))
    return per.select("set_id", "state", F.floor(F.col("n") / 3).cast("int").alias("coefficients"), problem.alias("problem"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A splat, label or occupancy table partitioned by set and state, so one state is read without the others."""
    df.write.mode(mode).partitionBy("set_id", "state").parquet(path)


def content_hash(df: DataFrame) -> DataFrame:
    """(set_id, state, hash): seven hex digits over a capture's rows, whatever the order of rows and columns."""
    cols = sorted(c for c in df.columns if c not in ("set_id", "state"))
    digest = df.groupBy("set_id", "state").agg(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n"))
    return digest.select("set_id", "state", s.short_sha1(F.concat_ws("-", F.col("sum").cast("string"), F.col("n").cast("string"))).alias("hash"))


def file_hash(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash) of written files: the first seven hex digits of their sha1."""
    return spark.read.format("binaryFile").load(path).select("path", s.short_sha1(F.col("content")).alias("hash"))
