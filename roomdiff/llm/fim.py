"""Fill-in-middle: documents cut into prefix, middle and suffix at whole units and put together anew, and back again.

Cuts are drawn over lines or over characters. Texts are UTF-8 bytes throughout: lines end at byte places, characters are counted as code
points, and a sparse exception index turns one into the other. It holds an entry for a character of several bytes only, so that a text of
ASCII alone has none and its cuts are plain arithmetic.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomdiff.llm.text import as_bytes, byte_slices

SEED = 7
SENTINELS = ("<P>", "<S>", "<M>")           # before the prefix, the suffix and the middle
RATE, SPM_RATE = 100, 50                    # percent of documents cut, and of these in suffix-prefix-middle order


class Exceptions:
    """Places of the characters of more than one byte: ``byte`` and ``point`` of each, and ``excess``, the bytes above one up to and
    without it."""

    def __init__(self, raw: bytes):
        if raw.isascii():
            self.byte = self.point = np.empty(0, np.int64)
            self.excess = np.zeros(1, np.int64)
            return
        at = np.frombuffer(raw, np.uint8)
        self.byte = np.flatnonzero(at >= 0xC0)
        lead = at[self.byte]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))])
        self.point = self.byte - self.excess[:-1]

    def points(self, cut: int) -> int:
        """Code points before byte ``cut``, which is the first byte of a character or the end."""
        return cut - int(self.excess[np.searchsorted(self.byte, cut)])

    def bytes(self, cut: int) -> int:
        """Bytes before code point ``cut``."""
        return cut + int(self.excess[np.searchsorted(self.point, cut)])


@dataclass(frozen=True)
class Cuts:
    n: int                  # units
    form: str               # plain, psm or spm
    first: int = 0          # bytes of the prefix, and of prefix and middle
    second: int = 0
    prefix: int | None = None
    middle: int | None = None


def draws(key: str, seed: int) -> list[int]:
    """Four numbers of 32 bits from the hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12)]


def line_ends(raw: bytes) -> np.ndarray:
    """The byte after each line; the last line may lack its line feed."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return ends if not raw or raw.endswith(b"\n") else np.append(ends, len(raw))


def cut(raw: bytes, key: str, seed: int, units: str, marks: list[bytes], rate: int, spm_rate: int) -> Cuts:
    index = Exceptions(raw)
    ends = line_ends(raw) if units == "lines" else None
    n = index.points(len(raw)) if ends is None else len(ends)
    a, b, c, d = draws(key, seed)
    if not raw or any(m in raw for m in marks) or c % 100 >= rate:
        return Cuts(n, "plain")
    low, high = sorted((a % (n + 1), b % (n + 1)))
    first, second = (index.bytes(k) if ends is None else int(ends[k - 1]) if k else 0 for k in (low, high))
    prefix = index.points(first)
    return Cuts(n, "spm" if d % 100 < spm_rate else "psm", first, second, prefix, index.points(second) - prefix)


def joined(raw: bytes, c: Cuts, marks: list[bytes]) -> bytes:
    if c.form == "plain":
        return raw
    p, s, m = marks
    prefix, middle, suffix = raw[:c.first], raw[c.first:c.second], raw[c.second:]
    return b"".join([p, prefix, s, suffix, m, middle] if c.form == "psm" else [s, suffix, p, prefix, m, middle])


def rebuilt(output: bytes, form: str, marks: list[bytes]) -> bytes:
    """The text of an output. A marker's first character is in no other place of a marker, so its first occurrence is the real one."""
    if form == "plain":
        return output
    p, s, m = marks
    one, two = (p, s) if form == "psm" else (s, p)
    at = output.index(two, len(one))
    end = output.index(m, at + len(two))
    parts = output[len(one):at], output[at + len(two):end]
    prefix, suffix = parts if form == "psm" else parts[::-1]
    return prefix + output[end + len(m):] + suffix


def markers(sentinels: tuple[str, str, str]) -> list[bytes]:
    if len(set(sentinels)) < 3 or any(not s or any(s[0] in t[1:] for t in sentinels) for s in sentinels):
        raise ValueError("three different markers are needed, and what one begins with may not come again in any")
    return [s.encode() for s in sentinels]


def transform(docs: DataFrame, units: str = "lines", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for every row. ``n`` counts the ``units``: lines with their line feed, or
    characters (code points). The cuts, whether a document is cut (``rate`` percent) and the order of its parts (``spm_rate`` percent with
    the suffix first) are drawn from a hash of seed and id alone, so any task that is run again gives the same.

    A null text counts as empty; an empty text, and one that holds a marker, stays plain, with null lengths. Rows that repeat an id are cut
    by the same draws, each over its own units; a null id draws as an empty one. An empty table gives no rows; other columns are not read."""
    if units not in ("lines", "chars"):
        raise ValueError("units are lines or chars")
    marks, kind = markers(sentinels), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in byte_slices(batches):
            raws = [x or b"" for x in as_bytes(part.column(2))]
            cuts = [cut(raw, key or "", seed, units, marks, rate, spm_rate) for raw, key in zip(raws, part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([c.n for c in cuts], pa.int64()), pa.array([c.form for c in cuts]), pa.array([c.prefix for c in cuts], pa.int64()),
                 pa.array([c.middle for c in cuts], pa.int64()), pa.array([joined(r, c, marks) for r, c in zip(raws, cuts)], pa.binary()).cast(pa.string())],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string").withColumnRenamed("id", id_col)


def restore(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """``made`` with the text that its output and form give in place of the output. A null output gives a null text."""
    marks, names = markers(sentinels), made.columns
    form, at = names.index(form_col), names.index(output_col)

    def run(batches):
        for part in byte_slices(batches):
            texts = [None if o is None else rebuilt(o, f, marks) for o, f in zip(as_bytes(part.column(at)), part.column(form).to_pylist())]
            yield part.set_column(at, part.schema.field(at), pa.array(texts, pa.binary()).cast(pa.string()))

    return made.mapInArrow(run, made.schema)
