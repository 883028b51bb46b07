"""Cumulative-link (proportional odds) regression on hashed text features.

P(grade <= k | x) = sigmoid(theta_k - w.x): one weight vector shared by all thresholds, and ordered thresholds theta_0 < theta_1 < ... .
Features are sparse and linear in the distinct words of a text, so scoring is one remembered number for each distinct word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomdiff.llm.text import Memo, as_bytes, hash32, slices

DIMENSIONS = 1 << 18
PREFIXES = (4, 5, 6)        # code points of a word's start that are features of their own
TRIM = b".,;:!?\"'()[]{}"


def word_features(word: bytes, dims: int = DIMENSIONS) -> np.ndarray:
    """Hashed features of one word: itself without case and outer punctuation, its starts, and its shape."""
    core = word.strip(TRIM)
    low = core.decode("utf-8", "replace").lower()
    names = [b"w" + low.encode()] + [b"p" + low[:n].encode() for n in PREFIXES if len(low) > n]
    upper = core.isupper() and len(core) > 1
    tail = word[len(word.rstrip(b"!?#*$%&|<>")):][:3]
    if upper or tail:
        names.append(b"s" + (b"U" if upper else b"-") + tail)
    if not core:
        names.append(b"x" + word[:4])
    return np.array([hash32(x) % dims for x in names], np.int64)


def text_features(raw: bytes, words: list[bytes], distinct: set[bytes], dims: int = DIMENSIONS) -> np.ndarray:
    """Hashed features of the whole text: its length, repetition, capitals, symbols and word length, in coarse steps."""
    n = max(len(words), 1)
    size = max(len(raw), 1)
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    symbols = size - len(raw.translate(None, b"#*$%&|<>!=_~^"))
    steps = {"n": int(np.log2(n)), "r": min(int(20 * len(distinct) / n), 20), "u": min(int(20 * upper / n), 20),
             "s": min(int(200 * symbols / size), 40), "l": min(size // n, 30), "b": min(raw.count(b"\n") * 20 // n, 20)}
    return np.array([hash32(f"t{k}{v}".encode()) % dims for k, v in steps.items()], np.int64)


@dataclass
class Ordinal:
    """A fitted model; ``weights`` are float32 of fixed length, so its size is bounded by ``dims``."""

    weights: np.ndarray
    thetas: np.ndarray

    def scorer(self):
        """Gives a function from UTF-8 texts to an array (rows, grades) of probabilities."""
        dims = len(self.weights)
        known = Memo(lambda w: float(self.weights[word_features(w, dims)].sum()))

        def score(texts):
            z = np.zeros(len(texts))
            for i, raw in enumerate(texts):
                words = raw.split() if raw else []
                distinct = set(words)
                z[i] = sum(map(known.__getitem__, distinct)) + self.weights[text_features(raw or b"", words, distinct, dims)].sum()
            return self.probabilities(z)
        return score

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        at_most = np.concatenate([np.zeros((len(z), 1)), sigmoid(self.thetas[None, :] - z[:, None]), np.ones((len(z), 1))], axis=1)
        return np.diff(at_most, axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def telling(features: list[np.ndarray], grades: np.ndarray, n_grades: int, dims: int, least: int, z: float) -> np.ndarray:
    """Features in ``least`` texts or more whose texts lie above some threshold ``z`` standard errors more or less often than all texts do."""
    n = max(len(grades), 1)
    having = np.zeros((n_grades, dims), np.int32)       # texts of a grade that have a feature
    for own, grade in zip(features, grades):
        having[grade, own] += 1
    seen = having.sum(axis=0)
    strongest = np.zeros(dims)
    for k in range(n_grades - 1):
        share = (grades > k).sum() / n
        spread = np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
        strongest = np.maximum(strongest, np.abs(having[k + 1:].sum(axis=0) - seen * share) / spread)
    return np.flatnonzero((seen >= least) & (strongest >= z))


def fit(features: list[np.ndarray], grades: np.ndarray, n_grades: int, dims: int = DIMENSIONS, l2: float = 2e-4,
        least: int = 4, z: float = 4.5, steps: int = 100, rate: float = 0.1) -> Ordinal:
    """Maximum likelihood by Adam with an L2 penalty. ``features``: the distinct features of each text. Only ``telling`` ones get weights, or
    the noise of rare words would add up in long texts. A grade nobody has keeps a threshold."""
    n = len(grades)
    used = telling(features, grades, n_grades, dims, least, z)
    place = np.full(dims, -1, np.int32)
    place[used] = np.arange(len(used))
    chosen = [p[p >= 0] for p in (place[own] for own in features)]
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(p) for p in chosen])
    cols = np.concatenate(chosen) if chosen else np.empty(0, np.int32)
    del chosen
    share = (np.bincount(grades, minlength=n_grades) + 0.5) / (n + 0.5 * n_grades)
    cut = np.log(np.cumsum(share)[:-1] / (1 - np.cumsum(share)[:-1]))
    x = np.concatenate([np.zeros(len(used)), cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    d = len(used)
    at = np.arange(n)
    for t in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([x[d:d + 1], np.exp(x[d + 1:])]))
        z = np.bincount(rows, weights=x[:d][cols], minlength=n) if len(rows) else np.zeros(n)
        cdf = np.concatenate([np.zeros((n, 1)), sigmoid(theta[None, :] - z[:, None]), np.ones((n, 1))], axis=1)
        high, low = cdf[at, grades + 1], cdf[at, grades]
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high), low * (1 - low)
        dz = (dh - dl) / p / n
        g_theta = np.zeros(n_grades + 1)
        np.add.at(g_theta, grades + 1, -dh / p / n)
        np.add.at(g_theta, grades, dl / p / n)
        g_theta = g_theta[1:n_grades]
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(cols, weights=dz[rows], minlength=d) + l2 * x[:d], tail[:1], tail[1:] * np.exp(x[d + 1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    weights = np.zeros(dims, np.float32)
    weights[used] = x[:d]
    return Ordinal(weights, np.cumsum(np.concatenate([x[d:d + 1], np.exp(x[d + 1:])])))


def graded_sample(docs: DataFrame, grades: DataFrame, id_col: str, text_col: str, grade_col: str, most: int) -> DataFrame:
    """At most ``most`` graded texts, by a hash of the id: (text, grade). Rows without id, grade or text are not used for fitting; an
    id with several grades has the highest. The ids picked are bounded by ``most`` before they meet the texts."""
    picked = (grades.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).filter("id is not null and grade is not null")
              .groupBy("id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(most))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    return texts.join(F.broadcast(picked), "id").select("id", "text", "grade")


def featured(sample: DataFrame, dims: int = DIMENSIONS) -> tuple[list[np.ndarray], np.ndarray]:
    """(distinct features of each text, grades) of a bounded sample (id, text, grade); hashed on the executors, whole texts."""
    def run(batches):
        known = Memo(lambda w: word_features(w, dims))
        for part in slices(batches):
            out = []
            for raw in as_bytes(part.column(1)):
                words = raw.split()
                distinct = set(words)
                out.append(np.unique(np.concatenate([*map(known.__getitem__, distinct), text_features(raw, words, distinct, dims)])).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(out, pa.binary())], names=["id", "grade", "features"])

    id_type = sample.schema["id"].dataType.simpleString()
    table = sample.select("id", "text", "grade").mapInArrow(run, f"id {id_type}, grade int, features binary").toArrow()
    features = [np.frombuffer(x.as_buffer(), np.int32) for x in table.column("features")]       # views, not copies
    order = sorted(range(len(features)), key=lambda i: (table.column("id")[i].as_py(), len(features[i])))
    return [features[i] for i in order], np.array([table.column("grade")[i].as_py() for i in order], np.int64)
