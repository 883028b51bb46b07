"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over the word windows of training texts.

Words are runs of digits, letters a-z (A-Z lowered) and anything past ASCII. A window is ``n`` consecutive words of a test item; a shorter
item, if it has words at all, is one window. Every hash hit is verified word by word, then spans or whole documents can be removed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomdiff.llm.text import Memo, as_bytes, by_place, hash64, own, per_text, rewrite, slices, unused, window_hashes

N = 10
MOST_BYTES = 16 << 20           # of the test windows as they are sent to tasks: beyond it they are not broadcast but met by a join
PER_WINDOW = 24                 # bytes of a window beside the words of its item: hash, place, length, place of its items and at least one of them
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_SPACED = bytes(0x20 if (c in SEPARATORS and not 0x41 <= c < 0x5B) else _TABLE[c] for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    """Words with an empty one for each further separator, so that places in the text can be told."""
    return raw.translate(_SPACED).split(b" ") if raw else []


def clean_words(raw: bytes | None) -> list[bytes]:
    return raw.translate(_SPACED).split() if raw else []


@dataclass
class Length:
    """The different test windows of one length, by their hashes: where their words stand, and their items by number."""

    hashes: np.ndarray          # sorted, each once
    at: np.ndarray              # first byte of the words in the item's text
    size: np.ndarray            # bytes of the words
    first: np.ndarray           # where the window's items begin, one more than windows
    items: np.ndarray


@dataclass
class Windows:
    """Test windows by length, as arrays over the words of all items; ``odd`` has windows whose hash is that of other words."""

    words: bytes = b""
    names: pa.Array | None = None
    lengths: dict = field(default_factory=dict)
    odd: dict = field(default_factory=dict)         # words of a window -> numbers of its items

    @classmethod
    def of(cls, rows, n: int = N) -> Windows:
        """From (item id, text bytes); items without words are in no window. The windows of a null id count as hits and as no item."""
        hashed, found, texts, names, start = Memo(hash64), {}, [], [], 0
        for number, (item, raw) in enumerate(rows):
            names.append(item)
            words = clean_words(raw)
            k = min(n, len(words))
            if k:
                text = b" ".join(words)
                lasts = np.cumsum([len(w) + 1 for w in words], dtype=np.int64)         # one past the blank after each word
                firsts = np.concatenate([[0], lasts[:-1]])[:len(words) - k + 1]
                hashes = window_hashes(np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words)), k)
                number = -1 if item is None else number
                found.setdefault(k, []).append((hashes, (start + firsts).astype(np.uint32), (lasts[k - 1:] - 1 - firsts).astype(np.uint32), np.full(len(hashes), number, np.int32)))
                texts.append(text)
                start += len(text) + 1
        out = cls(b" ".join(texts), pa.array(names))
        for k, parts in sorted(found.items()):
            hashes, at, size, items = (np.concatenate(p) for p in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            hashes, at, size, items = hashes[order], at[order], size[order], items[order]
            new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
            same = np.ones(len(hashes), bool)
            for j in np.flatnonzero(~new):
                head, own = heads[group[j]], out.said(at[j], size[j])
                if own != out.said(at[head], size[head]):
                    same[j] = False
                    out.odd.setdefault(own, set()).update({int(items[j])} - {-1})
            pairs = np.unique(np.stack([group, items], axis=1)[same & (items >= 0)], axis=0)
            first = np.searchsorted(pairs[:, 0], np.arange(len(heads) + 1)).astype(np.uint32)
            out.lengths[k] = Length(hashes[heads], at[heads], size[heads], first, pairs[:, 1].astype(np.int32))
        return out

    def said(self, at, size) -> bytes:
        return self.words[int(at):int(at) + int(size)]

    def items_of(self, own: Length, place: int, words: bytes):
        """Ids of the items that have the window ``words``, which has the hash at ``place``; None if there is no such window."""
        if self.said(own.at[place], own.size[place]) == words:
            numbers = own.items[own.first[place]:own.first[place + 1]].tolist()
        elif (numbers := self.odd.get(words)) is None:
            return None
        return {self.names[i].as_py() for i in numbers}


def scanner(windows: Windows):
    """Gives a function from UTF-8 text to (words, hit mask, item ids)."""
    hashed = Memo(hash64)

    def scan(raw):
        words = clean_words(raw)
        hit, items = np.zeros(len(words), bool), set()
        if not words or not windows.lengths:
            return words, hit, items
        ids = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
        for k, known in windows.lengths.items():
            if len(words) < k:
                continue
            got = window_hashes(ids, k)
            place = np.minimum(np.searchsorted(known.hashes, got), len(known.hashes) - 1)
            for at in np.flatnonzero(known.hashes[place] == got):
                own = windows.items_of(known, place[at], b" ".join(words[at:at + k]))
                if own is not None:
                    hit[at:at + k] = True
                    items |= own
        return words, hit, items
    return scan


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in items)).encode()).hexdigest()


def _result(found):
    n_words = [len(w) for w, _, _ in found]
    n_hit = [int(h.sum()) for _, h, _ in found]
    return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(i) for _, _, i in found], pa.int64()),
            pa.array([digest(i) for _, _, i in found]), pa.array([h > 0 for h in n_hit]),
            pa.array([[str(x) for x in sorted(i, key=str)] for _, _, i in found], pa.list_(pa.string()))]


SCHEMA = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>"


def size_of(benchmark: DataFrame, n: int = N, item_col: str = "item_id", text_col: str = "text") -> int:
    """Bytes at most of all windows as they are sent: words, ids, and ``PER_WINDOW`` for each window. Counted in tasks, nothing is gathered."""
    def run(batches):
        for part in slices(batches):
            total = 0
            for name, raw in zip(as_bytes(part.column(0)), as_bytes(part.column(1))):
                words = clean_words(raw)
                k = min(n, len(words))
                total += len(name or b"") + 9 + sum(map(len, words)) + len(words) + PER_WINDOW * (len(words) - k + 1 if k else 0)
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["size"])
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "size bigint").agg(F.sum("size")).first()[0] or 0


def gather(benchmark: DataFrame, n: int = N, item_col: str = "item_id", text_col: str = "text") -> Windows:
    """The windows of a benchmark whose size has been checked."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).filter("t is not null").toArrow()
    return Windows.of(zip(rows.column("i").to_pylist(), rows.column("t").cast(pa.binary()).to_pylist()), n)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, items) for every row of ``docs``.

    A null or empty text has no words. Repeated rows get a result each. A null or empty benchmark finds nothing. Items of equal text are
    all named. The windows are sent to every task if they have at most ``most_bytes`` in all; else they are met by a shuffled join.
    """
    if size_of(benchmark, n, item_col, item_text_col) <= most_bytes:
        windows = gather(benchmark, n, item_col, item_text_col)

        def make():
            find = scanner(windows)
            return lambda texts: _result([find(t) for t in texts])
        return per_text(docs, make, SCHEMA, id_col, text_col)
    return _scan_by_join(docs, benchmark, n, id_col, text_col, item_col, item_text_col)


def _positions(df: DataFrame, n: int, lengths: list[int] | None) -> DataFrame:
    """(id, at, k, h, w) of every window of (id, text); with ``lengths`` all of these lengths, else each text's own windows."""
    def run(batches):
        hashed = Memo(hash64)
        for part in slices(batches, 64):
            for i, raw in enumerate(as_bytes(part.column(1))):
                words = clean_words(raw)
                ids = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
                for k in lengths or ([min(n, len(words))] if words else []):
                    got = window_hashes(ids, k)
                    for lo in range(0, len(got), 4096):
                        m = min(4096, len(got) - lo)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([part.column(0)[i].as_py()] * m, part.schema.field(0).type), pa.array(np.arange(lo, lo + m)), pa.array([k] * m, pa.int32()), pa.array(got[lo:lo + m].view(np.int64)),
                             pa.array([b" ".join(words[at:at + k]).decode() for at in range(lo, lo + m)])],
                            names=["id", "at", "k", "h", "w"])
    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, at bigint, k int, h bigint, w string")


def hits_by_join(texts: DataFrame, benchmark: DataFrame, n: int, item_col: str, item_text_col: str) -> DataFrame:
    """(__hid, __hhash, __hits, __found) of the hit texts among (id, text): windows meet by hash and words; gathered for each text, so bounded by it."""
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).cast("string").alias("text"))
    known = _positions(items, n, None).select("k", "h", "w", F.col("id").alias("item")).distinct()
    lengths = sorted(r.k for r in known.select("k").distinct().collect())       # at most n
    seen = texts.select(F.struct("id", F.xxhash64("text").alias("text_hash")).alias("id"), "text").dropDuplicates(["id"])
    return (_positions(seen, n, lengths or [n]).join(known, ["k", "h", "w"])
            .groupBy("id").agg(F.collect_set(F.struct("at", "k")).alias("hits"), F.collect_set(F.col("item").cast("string")).alias("found"))
            .select(F.col("id.id").alias("__hid"), F.col("id.text_hash").alias("__hhash"), F.col("hits").alias("__hits"), F.col("found").alias("__found")))


def _mask(n_words: int, hits) -> np.ndarray:
    mask = np.zeros(n_words, bool)
    for x in hits or []:
        mask[x["at"]:x["at"] + x["k"]] = True
    return mask


def _scan_by_join(docs, benchmark, n, id_col, text_col, item_col, item_text_col):
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    hits = hits_by_join(texts, benchmark, n, item_col, item_text_col)
    full = texts.join(hits, F.col("id").eqNullSafe(F.col("__hid")) & (F.xxhash64("text") == F.col("__hhash")), "left").select("id", "text", "__hits", "__found")

    def finish(batches):
        for part in slices(batches):
            words = [clean_words(raw) for raw in as_bytes(part.column(1))]
            out = [(w, _mask(len(w), hits), set(found or [])) for w, hits, found in zip(words, part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), *_result(out)], names=["id", *(c.split()[0] for c in SCHEMA.split(", "))])

    kind = docs.schema[id_col].dataType.simpleString()
    return full.mapInArrow(finish, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def cut(raw: bytes, hit: np.ndarray) -> bytes:
    """``raw`` without the bytes from the first to the last word of each run of hit words; what stands around a cut stays."""
    spans, at = [], 0
    for w in words_of(raw):
        if w:
            spans.append((at, at + len(w)))
        at += len(w) + 1
    out, last = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for first, end in zip(edges[::2], edges[1::2]):
        out.append(raw[last:spans[first][0]])
        last = spans[end - 1][1]
    return b"".join([*out, raw[last:]])


def _cleared(texts, masks, documents: bool):
    """(texts, mask of the rows that stay)."""
    stay, new = np.ones(len(texts), bool), []
    for i, (raw, hit) in enumerate(zip(texts, masks)):
        if hit.any():
            stay[i] = not documents and not hit.all()
            raw = cut(raw, hit)
        new.append(raw if raw is None else raw.decode())
    return new, stay


def remove(docs: DataFrame, benchmark: DataFrame, documents: bool = False, n: int = N, most_bytes: int = MOST_BYTES, id_col: str = "doc_id",
           text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without what the test windows hit: the spans, or with ``documents`` the whole rows.

    When spans are removed, a row goes only if it had words and none are left. Rows without hits, null texts among them, stay as they are.
    Above ``most_bytes`` of test windows they are met by a join, as in ``scan``.
    """
    if size_of(benchmark, n, item_col, item_text_col) <= most_bytes:
        windows = gather(benchmark, n, item_col, item_text_col)

        def make():
            find = scanner(windows)
            return lambda texts: _cleared(texts, [find(raw)[1] for raw in texts], documents)
        return rewrite(docs, make, text_col)
    text = own(docs, text_col).cast("string")
    hits = hits_by_join(docs.select(own(docs, id_col).alias("id"), text.alias("text")), benchmark, n, item_col, item_text_col)
    joined = docs.join(hits, own(docs, id_col).eqNullSafe(hits["__hid"]) & (F.xxhash64(text) == hits["__hhash"]), "left")
    packed = joined.select(*[own(docs, c) for c in docs.columns], hits["__hits"].alias(unused(docs, "hits")))
    names = docs.columns
    at, width = names.index(text_col), len(names)

    def run(batches):
        for part in slices(batches):
            raw = as_bytes(part.column(at))
            masks = [_mask(len(clean_words(t)), h) for t, h in zip(raw, part.column(width).to_pylist())]
            texts, stay = _cleared(raw, masks, documents)
            columns = [part.column(k) if k != at else pa.array(texts, pa.string()).cast(part.column(k).type) for k in range(width)]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(width)]).filter(pa.array(stay))

    return by_place(packed, run, docs)
