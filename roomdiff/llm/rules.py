"""Quality rules by line sequence labelling.

A linear-chain conditional random field marks each line that has a word as content or boilerplate; Viterbi decoding takes the best
sequence for a whole text. The share of words on content lines decides retention, beside two plain rules on word counts and repetition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roomdiff.llm.ordinal import graded_sample
from roomdiff.llm.text import Memo, as_bytes, hash64, per_text, rewrite, slices, window_hashes

SAMPLE = 2048               # labelled texts a model is fitted on, at most
CONTENT = 0.5               # least share of words on content lines
FEWEST_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

# Steps of the line features; each value falls into one step, and each step has its own weight for either label.
STEPS = {
    "words": [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233],
    "repeat": [0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9],
    "upper": [0.05, 0.2, 0.5, 0.9],
    "symbol": [0.002, 0.01, 0.03, 0.08, 0.15],
    "bang": [0.05, 0.2, 0.5, 0.9],
    "digit": [0.02, 0.1, 0.3],
    "length": [2, 3, 4, 5, 6, 8, 11],
    "marks": [0.02, 0.05, 0.1, 0.2, 0.4],
}
FLAGS = ("bias", "ends", "again", "capital")
OFFSETS = dict(zip(STEPS, np.cumsum([len(FLAGS), *(len(v) + 1 for v in STEPS.values())])))
WIDTH = len(FLAGS) + sum(len(v) + 1 for v in STEPS.values())
HOT = len(FLAGS) + len(STEPS)           # entries of a line: one for each flag (or -1) and each step feature


def line_features(line: bytes, words: list[bytes], seen: set) -> list[int]:
    """Places of a line's features that are set; -1 for a flag that is not."""
    n = len(words)
    size = sum(map(len, words))
    key = b" ".join(words)
    values = (n, 1 - len(set(words)) / n, sum(1 for w in words if w.isupper() and len(w) > 2) / n, (len(line) - len(line.translate(None, SYMBOLS))) / size,
              line.count(b"!") / n, (len(line) - len(line.translate(None, b"0123456789"))) / size, size / n, (line.count(b".") + line.count(b",")) / n)
    flags = [0, 1 if words[-1][-1:] in (b".", b"!", b"?", b":") else -1, 2 if key in seen else -1, 3 if words[0][:1].isupper() else -1]
    seen.add(key)
    return flags + [OFFSETS[name] + _step(v, STEPS[name]) for name, v in zip(STEPS, values)]


def _step(value, steps) -> int:
    k = 0
    for s in steps:
        if value < s:
            break
        k += 1
    return k


def read(raw: bytes | None, hashed):
    """(features of lines with a word, words of each such line, counts) of a text; counts: words, code points in words, symbols, repeated
    lines, repeated words."""
    if not raw:
        return np.empty((0, HOT), np.int32), np.empty(0, np.int64), (0, 0, 0, 0, 0)
    features, sizes, flat, lines, again = [], [], [], set(), 0
    seen: set = set()
    for line in raw.split(b"\n"):
        words = line.split()
        if words:
            again += line in lines
            lines.add(line)
            features.append(line_features(line, words, seen))
            sizes.append(len(words))
            flat += words
    if not flat:
        return np.empty((0, HOT), np.int32), np.empty(0, np.int64), (0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0)
    chars = len(raw.translate(None, SPACES).decode())
    return np.array(features, np.int32), np.array(sizes, np.int64), (len(flat), chars, len(raw) - len(raw.translate(None, SYMBOLS)), again, repeated(flat, hashed))


def repeated(words: list[bytes], hashed) -> int:
    """Words inside windows of ``WINDOW`` words that stand twice or more in the text, the first time included."""
    if len(words) <= WINDOW:
        return 0
    got = window_hashes(np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words)), WINDOW)
    _, place, counts = np.unique(got, return_inverse=True, return_counts=True)
    many = counts[place] > 1
    if not many.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(many)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


@dataclass
class Chain:
    """Weights of a two-label chain: 1 content, 0 boilerplate."""

    emit: np.ndarray        # (WIDTH, 2)
    move: np.ndarray        # (2, 2) from, to
    start: np.ndarray       # (2,)

    def scores(self, features: np.ndarray) -> np.ndarray:
        """(lines, 2)."""
        padded = np.vstack([self.emit, np.zeros((1, 2))])       # -1 finds the row of zeros
        return padded[features].sum(axis=1)


def viterbi(chain: Chain, scores: list[np.ndarray]) -> list[np.ndarray]:
    """Best labels of each sequence of line scores. Of equal ways content is taken. Sequences of like length go through together."""
    out: list = [np.empty(0, np.int8)] * len(scores)
    for group in _alike([len(s) for s in scores]):
        size = np.array([len(scores[i]) for i in group])
        steps = int(size.max())
        pad = np.zeros((len(group), steps, 2))
        for row, i in enumerate(group):
            pad[row, :size[row]] = scores[i]
        best = pad[:, 0] + chain.start
        back = np.zeros((len(group), steps, 2), np.int8)
        for t in range(1, steps):
            way = best[:, :, None] + chain.move[None]
            back[:, t] = way[:, 1] >= way[:, 0]
            live = (t < size)[:, None]
            best = np.where(live, np.maximum(way[:, 0], way[:, 1]) + pad[:, t], best)
        label = (best[:, 1] >= best[:, 0]).astype(np.int8)
        labels = np.zeros((len(group), steps), np.int8)
        at = np.arange(len(group))
        for t in range(steps - 1, -1, -1):
            labels[:, t] = label
            if t:
                label = np.where(t < size, back[at, t, label], label)
        for row, i in enumerate(group):
            out[i] = labels[row, :size[row]]
    return out


def _alike(sizes: list[int], cells: int = 200_000):
    """Groups of places whose padded sequences have at most ``cells`` lines or are alone; empty ones are in none."""
    order = sorted((i for i, n in enumerate(sizes) if n), key=lambda i: sizes[i])
    group: list[int] = []
    for i in order:
        if group and (sizes[i] * (len(group) + 1) > cells or sizes[i] > 2 * sizes[group[0]] + 8):
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def _softmax2(x):
    """log(exp(a) + exp(b)) over the last axis of two."""
    return np.maximum(x[..., 0], x[..., 1]) + np.log1p(np.exp(-np.abs(x[..., 0] - x[..., 1])))


def fit(features: list[np.ndarray], labels: list[np.ndarray], steps: int = 60, rate: float = 0.1, l2: float = 1e-3) -> Chain:
    """Maximum conditional likelihood by Adam; the gradient comes from forward and backward sums."""
    groups = list(_alike([len(f) for f in features]))
    total = max(sum(len(features[i]) for g in groups for i in g), 1)
    packs = []
    for g in groups:
        size = np.array([len(features[i]) for i in g])
        feats = np.full((len(g), size.max(), HOT), -1, np.int32)
        labs = np.zeros((len(g), size.max()), np.int64)
        for row, i in enumerate(g):
            feats[row, :size[row]] = features[i]
            labs[row, :size[row]] = labels[i]
        packs.append((size, feats, labs))
    x = np.zeros(WIDTH * 2 + 6)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        chain = _chain(x)
        grad = l2 * x
        for size, feats, labs in packs:
            grad += _gradient(chain, size, feats, labs) / total
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        x -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return _chain(x)


def _chain(x: np.ndarray) -> Chain:
    return Chain(x[:WIDTH * 2].reshape(WIDTH, 2), x[WIDTH * 2:WIDTH * 2 + 4].reshape(2, 2), x[-2:])


def _gradient(chain: Chain, size, feats, labs) -> np.ndarray:
    """Of the negative log likelihood of padded sequences, in the order of ``_chain``."""
    n, steps, _ = feats.shape
    live = np.arange(steps)[None, :] < size[:, None]
    score = chain.scores(feats.reshape(n * steps, HOT)).reshape(n, steps, 2)
    forward = np.zeros((n, steps, 2))
    forward[:, 0] = score[:, 0] + chain.start
    for t in range(1, steps):
        forward[:, t] = score[:, t] + _softmax2((forward[:, t - 1, :, None] + chain.move[None]).swapaxes(1, 2))
    backward = np.zeros((n, steps, 2))
    for t in range(steps - 2, -1, -1):
        ahead = _softmax2(chain.move[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :])
        backward[:, t] = np.where((t + 1 < size)[:, None], ahead, 0)
    log_z = _softmax2(forward[np.arange(n), size - 1])
    p = np.exp(forward + backward - log_z[:, None, None]) * live[:, :, None]
    diff = p.copy()
    row, col = np.nonzero(live)
    diff[row, col, labs[row, col]] -= 1
    g_emit = np.zeros((WIDTH + 1, 2))
    for k in range(2):
        g_emit[:, k] = np.bincount(np.where(feats < 0, WIDTH, feats)[live].ravel(), weights=np.repeat(diff[live][:, k], HOT), minlength=WIDTH + 1)
    g_move = np.zeros((2, 2))
    if steps > 1:
        inner = live[:, 1:]
        pair = np.exp(forward[:, :-1, :, None] + chain.move + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - log_z[:, None, None, None])
        g_move = pair[inner].sum(axis=0)
        np.add.at(g_move, (labs[:, :-1][inner], labs[:, 1:][inner]), -1)
    return np.concatenate([g_emit[:WIDTH].ravel(), g_move.ravel(), diff[:, 0].sum(axis=0)])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Chain:
    """Fits on at most ``sample`` labelled texts: their lines are content where the label is 1 and boilerplate where it is 0, but a line
    that repeats an earlier one is boilerplate everywhere. Without labels every line scores alike and counts as content."""
    rows = graded_sample(docs, labels, id_col, text_col, label_col, sample)

    def run(batches):
        for part in slices(batches):
            found = [read(raw, Memo(hash64))[0] for raw in as_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([f.tobytes() for f in found], pa.binary())], names=["id", "grade", "features"])

    kind = rows.schema["id"].dataType.simpleString()
    table = rows.mapInArrow(run, f"id {kind}, grade int, features binary").toArrow().sort_by([("id", "ascending"), ("features", "ascending")])
    features = [np.frombuffer(x, np.int32).reshape(-1, HOT) for x in table.column("features").to_pylist()]
    grades = table.column("grade").to_pylist()
    truth = [np.where(f[:, 2] >= 0, 0, int(g > 0)).astype(np.int64) for f, g in zip(features, grades)]
    return fit(features, truth)


def _judge(chain: Chain, content: float):
    hashed = Memo(hash64)

    def work(texts):
        found = [read(raw, hashed) for raw in texts]
        sizes = [len(f) for f, _, _ in found]
        flat = chain.scores(np.concatenate([f for f, _, _ in found])) if sum(sizes) else np.empty((0, 2))
        labels = viterbi(chain, np.split(flat, np.cumsum(sizes)[:-1]) if sizes else [])
        share = np.array([float((n * lab).sum() / n.sum()) if len(n) else 0.0 for (_, n, _), lab in zip(found, labels)])
        counts = np.array([c for _, _, c in found], np.int64).reshape(-1, 5)
        failed = (counts[:, 0] < FEWEST_WORDS) | (100 * counts[:, 4] > REPEAT_PERCENT * counts[:, 0])
        return counts, failed, share, ~failed & (share >= content), labels
    return work


SCHEMA = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, "
          "content_share double, n_content_lines bigint")


def judge(docs: DataFrame, chain: Chain, content: float = CONTENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, kept, content_share, n_content_lines) for every row.

    base_failed: fewer than ``FEWEST_WORDS`` words, or more than ``REPEAT_PERCENT`` % of them in repeated windows. kept: not that, and at
    least ``content`` of the words on content lines. Null, empty and blank texts have no words and fail. Repeated rows get a result each.
    """
    def make():
        work = _judge(chain, content)

        def columns(texts):
            counts, failed, share, kept, labels = work(texts)
            return [*(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(kept), pa.array(share), pa.array([int(x.sum()) for x in labels], pa.int64())]
        return columns
    return per_text(docs, make, SCHEMA, id_col, text_col)


def keep(docs: DataFrame, chain: Chain, content: float = CONTENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns."""
    def make():
        work = _judge(chain, content)
        return lambda texts: (None, work(texts)[3])
    return rewrite(docs, make, text_col)
