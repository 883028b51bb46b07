"""WARC archives written by Spark and read back in byte ranges.

**Writing.** Spark's text sink writes a row and a separator; with two line feeds as the separator each row is one record of a plain ``.warc``
file, so archives go wherever Spark can write. Equal payloads are stored once: others become ``revisit`` records without a payload.

**Reading.** Spark's text source cuts files into byte ranges and hands out what lies between two occurrences of the boundary, an empty line and
the version. Each such piece is only a candidate: a payload may hold whole records. A task emits for each candidate its place and where the
record that it claims to be would end. The candidates of a file are then chained by pointer jumping from its first byte: a record counts
only if it is the first of its file or begins where a record that counts ends. What a payload holds is never reached.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomdiff.functions.stage import written
from roomdiff.llm.text import byte_slices

VERSION = b"WARC/1."                        # a record begins with this and a digit
BLANK = b"\r\n\r\n"
LEAST_REVISIT = 1000                        # bytes of a payload that is stored once
RECORDS = 8192                              # of a file; bounds the rounds of pointer jumping, not what can be read
MOST_BYTES = 8 << 20                        # of the table of repeated payloads that is sent to all tasks; a larger one is joined
BIN = 1 << 20                               # bytes of a file in which pieces and records that span several are met
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _payload(payload_col: str):
    return F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z",
          least: int = LEAST_REVISIT, records: int = RECORDS, most_bytes: int = MOST_BYTES) -> None:
    """One record for each row, in files of ``folder``. Of rows with equal payloads of ``least`` bytes or more, that with the largest id is a
    response and the others revisit it; all other rows are responses.

    A null payload counts as empty, a null url as none. Rows that repeat the largest id of their payload are all responses; a row without an id
    revisits like any other and has a record without a page. Line ends in a url are encoded. An empty table gives no record."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), _payload(payload_col).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # Only the digests of large payloads travel, combined before the shuffle; payloads are not moved unless the repeated ones are very many.
    repeated = written(rows.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
                       .filter("n > 1").select("digest", "size", "first"), "repeated")
    small = repeated.count() * 128 <= most_bytes
    rows = rows.join(F.broadcast(repeated) if small else repeated.hint("merge"), ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">"))
    line = lambda key, value: F.coalesce(F.concat(F.lit(f"{key}: "), value, F.lit("\r\n")), F.lit(""))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    length = F.octet_length(F.lit(HTTP)) + F.when(revisit, 0).otherwise(F.col("size"))
    head = F.concat(F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", name(F.col("id"))),
                    line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
                    line("WARC-Refers-To", F.when(revisit, name(F.col("first")))), line("WARC-Profile", F.when(revisit, PROFILE)),
                    line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")), F.lit("\r\n"), F.lit(HTTP))
    record = F.concat(head.cast("binary"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))).cast("string")
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).text(folder)


def fields(head: bytes) -> dict[str, str]:
    """Named fields of a header, names in lower case; a line that begins with a blank goes on with the one before."""
    out: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon:
            out.setdefault(key.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
    return out


def claimed(piece: bytes) -> tuple[int, int, dict[str, str]] | None:
    """(bytes of the header, of the block, fields) of a piece that begins behind the version's point; None if it cannot be a record."""
    if piece[:3] not in (b"0\r\n", b"1\r\n"):
        return None
    end = piece.find(BLANK)
    head = piece if end < 0 else piece[:end]            # without an empty line the block itself begins with a boundary
    got = fields(head)
    length = got.get("content-length", "")
    return (len(head) + len(BLANK), int(length), got) if re.fullmatch(r"[0-9]{1,18}", length) else None


def body(block: bytes, got: dict[str, str]) -> bytes:
    """The payload in a block: what follows the header of an HTTP message, else all of it."""
    if not got.get("content-type", "").lower().startswith("application/http"):
        return block
    end = block.find(BLANK)
    return block[end + len(BLANK):] if end >= 0 else b""


def identifier(value: str | None) -> str | None:
    """What stands in a record's name; for pages their id."""
    if value is None:
        return None
    found = re.fullmatch(r"<(?:urn:page:)?(.*)>", value)
    return unquote_plus(found[1]) if found else value


_META = "kind string, id string, uri string, refers string, declared string"
_FOUND = f"file string, block bigint, at bigint, size bigint, head bigint, length bigint, {_META}, payload_bytes bigint, digest string, payload binary"
_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("head", pa.int64()), ("length", pa.int64()),
                     *((k, pa.string()) for k in ("kind", "id", "uri", "refers", "declared")), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())])


def described(got: dict[str, str]) -> list[str | None]:
    return [got.get("warc-type"), identifier(got.get("warc-record-id")), got.get("warc-target-uri"), identifier(got.get("warc-refers-to")), got.get("warc-payload-digest")]


def measured(block: bytes, got: dict[str, str], keep: bool) -> list:
    payload = body(block, got)
    return [len(payload), hashlib.sha1(payload).hexdigest(), payload if keep else None]


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what lies between boundaries, ranges in order inside a task; ``block`` is where Spark's byte range begins."""
    rows = spark.read.option("lineSep", (BLANK + VERSION).decode()).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def placed(batches):
    """(rows as (file, block, place of the value in what the range yields, value)) of each batch."""
    now, at = None, 0
    for part in byte_slices(batches):
        out = []
        for file, block, value in zip(*(part.column(k).to_pylist() for k in range(3))):
            if (file, block) != now:
                now, at = (file, block), 0
            out.append((file, block, at, value))
            at += len(value) + len(BLANK) + len(VERSION)
        yield out


def candidates(spark: SparkSession, path: str, keep: bool) -> DataFrame:
    """Each piece with what it claims: ``at`` is the value's place in its range, ``head`` is null where no record can begin. What lies whole
    inside a piece is measured at once."""
    def run(batches):
        for rows in placed(batches):
            out = []
            for file, block, at, value in rows:
                first = block == 0 and at == 0
                piece = value[len(VERSION):] if first else value
                got = claimed(piece) if not first or value.startswith(VERSION) else None
                if got is None:
                    out.append([file, block, at, len(value), *[None] * 10])
                else:
                    head, length, named = got
                    whole = head + length <= len(piece)
                    out.append([file, block, at, len(value), head, length, *described(named), *(measured(piece[head:head + length], named, keep) if whole else [None] * 3)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SCHEMA.types)], schema=_SCHEMA)
    return pieces(spark, path).mapInArrow(run, _FOUND)


def reached(nodes: DataFrame) -> DataFrame:
    """(file, at) of the ``nodes`` (file, at, to) on the chain from place 0 of each file, by pointer jumping: in round k all pointers are
    2**k records long, and what is that far behind a reached node is reached."""
    ends = nodes.select("file", F.col("at").alias("to"))
    jump = written(nodes.select("file", "at", "to").join(ends, ["file", "to"], "left_semi"), "jump")
    found = nodes.filter("at = 0").select("file", "at")
    while not jump.isEmpty():
        found = found.union(written(found.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")), "reached"))
        far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("end"))
        jump = written(jump.join(far, ["file", "to"]).select("file", "at", F.col("end").alias("to")), "jump")
    return found


def located(spark: SparkSession, path: str, keep: bool) -> tuple[DataFrame, DataFrame]:
    """(candidates with absolute places, files with their bytes and the bases of their ranges). Ranges tile a file, so that a range begins after
    all that the ranges before it yield."""
    gap = len(BLANK) + len(VERSION)
    found = written(candidates(spark, path, keep), "candidates")
    ranges = found.groupBy("file", "block").agg(F.sum(F.col("size") + gap).alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = written(ranges.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
                     .withColumn("file_bytes", F.sum("total").over(Window.partitionBy("file")) - gap), "ranges")
    start = F.col("base") + F.col("at")
    # The first value of a file holds its own version; before all others it belongs to the boundary.
    out = found.join(ranges.select("file", "block", "base", "file_bytes"), ["file", "block"])
    out = out.withColumn("from", start).withColumn("at", F.greatest(start - len(VERSION), F.lit(0))).drop("base")
    return out.withColumn("to", F.col("at") + len(VERSION) + F.col("head") + F.col("length") + len(BLANK)), ranges


def spanning(spark: SparkSession, path: str, parts: DataFrame, ranges: DataFrame, keep: bool) -> DataFrame:
    """(file, at, payload_bytes, digest, payload) of the records ``parts`` (file, at, to, length) whose blocks hold boundaries: their pieces are
    met by file and bin, put in order and measured. A group is one record."""
    def run(batches):
        for rows in placed(batches):
            file, block, at, value = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(file), pa.array(block, pa.int64()), pa.array(at, pa.int64()), pa.array(value, pa.binary())], names=["file", "block", "in_range", "value"])

    cut = pieces(spark, path).join(parts.select("file").distinct(), "file", "left_semi").mapInArrow(run, "file string, block bigint, in_range bigint, value binary")
    cut = cut.join(ranges.select("file", "block", "base"), ["file", "block"]).withColumn("from", F.col("base") + F.col("in_range"))
    cut = cut.withColumn("begin", F.greatest(F.col("from") - len(VERSION), F.lit(0))).withColumn("bin", F.expr(f"begin div {BIN}"))
    wanted = parts.select("file", "at", "to", F.explode(F.expr(f"sequence(at div {BIN}, to div {BIN})")).alias("bin"))
    met = cut.join(wanted, ["file", "bin"]).filter("begin >= at and begin < to").select("file", "at", "from", "value")
    got = met.groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("from", "value"))).alias("pieces"))

    def measure(batches):
        for part in batches:
            out = []
            for k in range(part.num_rows):
                file, at, held = (part.column(c)[k].as_py() for c in range(3))
                raw = (BLANK + VERSION).join(p["value"] for p in held)
                raw = raw[len(VERSION):] if at == 0 else raw
                head, length, named = claimed(raw)
                out.append([file, at, *(measured(raw[head:head + length], named, keep) if head + length <= len(raw) else [None] * 3)])
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["file", "at", "payload_bytes", "digest", "payload"])

    return got.select("file", "at", "pieces").mapInArrow(measure, "file string, at bigint, payload_bytes bigint, digest string, payload binary")


def read(spark: SparkSession, path: str, keep: bool = True) -> DataFrame:
    """(file, at, kind, id, uri, refers, declared, payload_bytes, digest, payload, intact) for each record that is reached from the start of its
    file. ``payload`` is null unless ``keep``. ``intact`` says that the block is whole and the declared digest, if there is one in hexadecimal
    digits, agrees; for a revisit, which has no payload of its own, it is null. A record that its file ends within has null bytes and digest and
    is not intact. Records behind a place where no record begins are not reached; ``problems`` lists such places. An empty file has none."""
    found, ranges = located(spark, path, keep)
    found = written(found, "located")
    on_chain = found.join(reached(found.filter("head is not null").select("file", "at", "to")), ["file", "at"], "left_semi").filter("head is not null")
    parts = written(on_chain.filter("payload_bytes is null and to <= file_bytes + 4").select("file", "at", "to"), "parts")
    if not parts.isEmpty():
        whole = spanning(spark, path, parts, ranges, keep)
        names = ["payload_bytes", "digest", "payload"]
        on_chain = on_chain.join(whole.select("file", "at", *(F.col(c).alias(f"whole_{c}") for c in names)), ["file", "at"], "left")
        on_chain = on_chain.select(*[F.coalesce(c, f"whole_{c}").alias(c) if c in names else c for c in found.columns])
    stated = F.lower(F.regexp_extract("declared", "^sha1:([0-9A-Fa-f]{40})$", 1))
    intact = F.when(F.col("kind") == "revisit", None).otherwise(F.col("digest").isNotNull() & (F.coalesce(stated, F.lit("")).isin("") | (stated == F.col("digest"))))
    return on_chain.select("file", "at", "kind", "id", "uri", "refers", "declared", "payload_bytes", "digest", "payload", intact.alias("intact"))


def problems(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, file_bytes): places where a file's chain of records ends before the file does."""
    found, ranges = located(spark, path, False)
    found = written(found, "located")
    files = ranges.select("file", "file_bytes").distinct().filter("file_bytes > 0")
    nodes = found.filter("head is not null").select("file", "at", "to")
    ends = reached(nodes).join(nodes, ["file", "at"]).groupBy("file").agg(F.max("to").alias("last"))
    return files.join(ends, "file", "left").filter("last is null or not last between file_bytes and file_bytes + 4").select("file", F.coalesce("last", F.lit(0)).alias("at"), "file_bytes")


def resolved(records: DataFrame) -> DataFrame:
    """``records`` of ``read`` with the bytes and digest of a revisit taken from the response it refers to; ``refers_found`` says that there is one."""
    named = records.filter("kind = 'response'").select(F.col("id").alias("key"), F.col("payload_bytes").alias("there_bytes"), F.col("digest").alias("there_digest"))
    back = F.col("kind") == "revisit"
    # Only revisits look for a response; the others get a key of their own, so that they do not meet in one task as nulls would.
    key = F.when(back & F.col("refers").isNotNull(), F.col("refers")).otherwise(F.concat(F.lit("\0"), "file", F.lit("\0"), F.col("at").cast("string")))
    out = records.withColumn("key", key).join(named.dropDuplicates(["key"]), "key", "left")
    there = {"payload_bytes": "there_bytes", "digest": "there_digest"}
    return out.select(*[F.when(back, F.col(there[c])).otherwise(F.col(c)).alias(c) if c in there else c for c in records.columns],
                      F.when(back, F.col("there_bytes").isNotNull()).alias("refers_found"))
