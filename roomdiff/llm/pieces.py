"""SentencePiece encoding and decoding with the tokenizers library.

The model file is read as a protobuf; its normaliser, the metaspace marker, the scores (as unigram scores, or as the order of merges
for a BPE model) and the byte fallback are rebuilt. Where no piece crosses from text into a marker, a text falls apart at the markers
without changing the result: each task then encodes the distinct chunks of a batch once, on several threads, and every distinct chunk is
checked against the sentencepiece library and decoded again.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomdiff.llm.text import long_array, per_text

MARK = "▁"
THREADS = 2                 # of the backend in one worker, unless RAYON_NUM_THREADS says otherwise
# Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def default_model() -> str:
    """Path of the model file: ``TOKENIZER_MODEL`` if it is set, else the public one that is installed."""
    if os.environ.get("TOKENIZER_MODEL"):
        return os.environ["TOKENIZER_MODEL"]
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value, shift = 0, 0
    while True:
        byte = raw[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def fields(raw: bytes):
    """(number, value) of each field of a protobuf message: integers, or bytes."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(raw, at)
        elif wire == 2:
            size, at = _varint(raw, at)
            value, at = raw[at:at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = raw[at:at + size], at + size
        else:
            raise ValueError(f"wire type {wire} in a model file")
        yield number, value


@dataclass
class Model:
    """What a model file says. Field numbers are those of the public format."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix: bool = False                # markers stand after words
    unk: int = 0
    charsmap: bytes = b""
    prefix: bool = True                 # a marker is put before the text
    squeeze: bool = True                # runs of spaces become one, outer ones go
    escape: bool = True                 # spaces become markers

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        out = cls()
        for number, value in fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                out.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in fields(value):
                    if n == 3:
                        out.kind = v
                    elif n == 24:
                        out.suffix = bool(v)
                    elif n == 35:
                        out.byte_fallback = bool(v)
                    elif n == 40:
                        out.unk = v
            elif number == 3:
                for n, v in fields(value):
                    if n == 2:
                        out.charsmap = v
                    elif n == 3:
                        out.prefix = bool(v)
                    elif n == 4:
                        out.squeeze = bool(v)
                    elif n == 5:
                        out.escape = bool(v)
        if out.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model kind {out.kind} is neither unigram nor BPE")
        if out.suffix or not out.escape:
            raise ValueError("models with markers after words, or with bare spaces, are not supported")
        return out

    @property
    def splits(self) -> bool:
        """No piece holds a marker behind other characters, so texts fall apart before markers that follow something else."""
        return not any(MARK in p.lstrip(MARK) for p, _, _ in self.pieces) and not any(k == USER for _, _, k in self.pieces)

    def merges(self) -> list[tuple[str, str]]:
        """For BPE: both halves of every piece that can be merged, best score first."""
        known = {p: i for i, (p, _, k) in enumerate(self.pieces) if k in (NORMAL, USER, UNUSED)}
        found = []
        for i, (piece, score, kind) in enumerate(self.pieces):
            if kind == NORMAL:
                for k in range(1, len(piece)):
                    if piece[:k] in known and piece[k:] in known:
                        found.append((-score, i, known[piece[:k]], known[piece[k:]], piece[:k], piece[k:]))
        return [f[4:] for f in sorted(found)]

    def backend(self):
        """The tokenizers.Tokenizer of this model."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers
        if self.kind == BPE:
            core = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(self.pieces)}, merges=self.merges(), unk_token=self.pieces[self.unk][0],
                              fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            # Control pieces never match text; here they are given names that no text holds.
            core = models.Unigram([(p if k != CONTROL else f"\0{i}", s) for i, (p, s, k) in enumerate(self.pieces)], self.unk, self.byte_fallback)
        out = Tokenizer(core)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.prefix:
            steps.append(normalizers.Prepend(MARK))
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.prefix else [])])
        return out


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


KNOWN = 400_000             # chunks whose ids a worker remembers
JOINED = 128                # chunks that go through the backend as one text


class Coder:
    """Encodes and decodes texts. Ids of distinct chunks are remembered, up to a bound."""

    def __init__(self, raw: bytes, check: bool = True, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.model = m = Model.parse(raw)
        self.tokens = m.backend()
        marker = next((i for i, (p, _, _) in enumerate(m.pieces) if p == MARK), None)
        self.splits = m.splits and m.prefix and not m.squeeze and not m.charsmap and marker is not None
        self.opens = np.array([p.startswith(MARK) for p, _, _ in m.pieces])
        self.known: dict[str, bytes] = {}           # ids of a chunk, as int32
        self.unlike: set[str] = set()               # chunks on which the two libraries differ
        self.lossy: set[str] = set()                # chunks that decode to something else
        self.last = np.array([marker], np.int32).tobytes() if self.splits else b""
        self.reference = None
        if check:
            import sentencepiece
            self.reference = sentencepiece.SentencePieceProcessor(model_proto=raw)

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that are encoded apart, each with a marker before it; joined by spaces they are the text. Of a run of spaces the
        first parts two texts and the others belong to what follows. An empty part, at the end only, is the marker alone."""
        if not text or not self.splits:
            return [text] if text else []
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out, gap = [], 0
        for k, part in enumerate(parts):
            if part or k == len(parts) - 1:
                out.append(" " * gap + part)
                gap = 0
            else:
                gap += 1
        return out

    def learn(self, chunks) -> None:
        """Encodes the chunks that are not known, checks them against the reference and decodes them."""
        if len(self.known) > KNOWN:
            for seen in (self.known, self.unlike, self.lossy):
                seen.clear()
        self.known[""] = self.last
        new = [c for c in dict.fromkeys(chunks) if c not in self.known]
        plain = [c for c in new if c[0] != " "] if self.splits else []
        groups = [plain[at:at + JOINED] for at in range(0, len(plain), JOINED)]
        again = [c for c in new if c[0] == " "] if self.splits else new
        for group, ids, same, back in self._through([" ".join(g) for g in groups], groups):
            ids = np.array(ids, np.int32)
            starts = np.flatnonzero(self.opens[ids])
            if same and back and len(starts) == len(group):
                self.known.update(zip(group, (x.tobytes() for x in np.split(ids, starts[1:]))))
            else:
                again += group
        for chunk, ids, same, back in self._through(again, again):
            self.known[chunk] = np.array(ids, np.int32).tobytes()
            if not same:
                self.unlike.add(chunk)
            if not back:
                self.lossy.add(chunk)

    def _through(self, texts: list[str], names):
        """(name, ids, agrees with the reference, decodes to itself) of each text."""
        for at in range(0, len(texts), 4096):
            part = texts[at:at + 4096]
            ids = [e.ids for e in self.tokens.encode_batch_fast(part, add_special_tokens=False)]
            same = [True] * len(part) if self.reference is None else map(list.__eq__, ids, self.reference.encode(part, num_threads=1))
            back = map(str.__eq__, part, self.tokens.decode_batch(ids, skip_special_tokens=False))
            yield from zip(names[at:at + 4096], ids, same, back)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool, bool]]:
        """(ids, agrees with sentencepiece, decodes to the text) of each text."""
        split = [self.chunks(t) if t else [] for t in texts]
        self.learn({c for part in split for c in part})
        out = []
        for text, part in zip(texts, split):
            ids = np.frombuffer(b"".join(map(self.known.__getitem__, part)), np.int32)
            out.append((ids, self.unlike.isdisjoint(part), self.lossy.isdisjoint(part) and not (text and MARK in text)))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of id lists. Control pieces say nothing."""
        silent = {i for i, (_, _, k) in enumerate(self.model.pieces) if k == CONTROL}
        return self.tokens.decode_batch([[i for i in row if i not in silent] for row in ids], skip_special_tokens=False)


@lru_cache(1)
def coder_of(raw: bytes, check: bool) -> Coder:
    """One coder for all tasks of a worker, so that what it has learned serves the next task."""
    return Coder(raw, check)


SCHEMA = "ids array<int>, n_tokens bigint, parity boolean, round_trip boolean"


def encode(docs: DataFrame, model: str | None = None, check: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, parity, round_trip) for every row, of whole texts.

    ``parity``: every chunk has the ids that the sentencepiece library gives (true unchecked without ``check``). ``round_trip``: decoding gives
    the text again, which a text with the marker character itself, or one that the model normalises, does not. Null and empty texts have no
    tokens. Repeated rows get a result each; a null id stays null. A unigram model reads a text that spells a byte piece, such as <0x41>, as
    that piece, and a model that squeezes spaces keeps a marker character at the end; ``parity`` is then false.
    """
    raw = read_model(model or default_model())

    def make():
        coder = coder_of(raw, check)

        def work(texts):
            found = coder.encode([t if t is None else t.decode() for t in texts])
            return [long_array([f[0] for f in found], np.int32), pa.array([len(f[0]) for f in found], pa.int64()), pa.array([f[1] for f in found]), pa.array([f[2] for f in found])]
        return work
    return per_text(docs, make, SCHEMA, id_col, text_col)


def decode(tokens: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for every row of ids; a null list gives a null text. An id outside the vocabulary ends the job."""
    raw = read_model(model or default_model())
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = coder_of(raw, False)
        size = len(coder.model.pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = part.column(1).to_pylist()
                for row in rows:
                    if row and not all(i is not None and 0 <= i < size for i in row):
                        raise ValueError("an id is outside the vocabulary")
                texts = coder.decode([r or [] for r in rows])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if r is None else t for r, t in zip(rows, texts)], pa.string())], names=["id", "text"])
    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
