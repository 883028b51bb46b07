"""Hard negatives: for an anchor and one of its positives, the rows of other labels that score a little below the positive.

Every search is a threshold join of a block of anchors with all rows, over integer vectors, in the way of L2AP:

- A task indexes a block of rows by dimension, from the one with most weight to that with least. The last dimensions of a row are left out of
  the index as long as their norm times the largest norm that an anchor has there stays below the lowest threshold: a row that shares no more
  than these with an anchor cannot reach it. Rows are sorted by where they are cut, so that the postings of a dimension are a run.
- Partial scores are accumulated posting by posting. Where the partial score plus the product of what is left of both norms stays below
  an anchor's threshold the row is dropped. What remains is scored in full, in integers.
- The threshold of an anchor starts high, at the best score that a bounded sample of rows has for it. While the window of an anchor does not
  fill, it is lowered: to a score that the sample has often enough, then to the window's own floor. Windows that are full are closed. The sample
  sets where a search begins, never what it finds.

Anchors go to the tasks in blocks of bounded size, one after another; rows never move. What a task sends is at most a window's rows for each window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomdiff.functions.stage import empty, written

POSITIVES, NEGATIVES = 5, 5
LOWEST, HIGHEST = 80, 100                   # percent of the positive's score
SAMPLE = 2048                               # rows whose scores set the first thresholds
BLOCK = 4096                                # rows indexed at once
CHUNK_BYTES = 4 << 20                       # of anchors that tasks get at once
QUERIES = 32                                # anchors accumulated at once
STEP = 16                                   # dimensions between two looks at the bounds
FLOOR = -(1 << 62)


def integers(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vector) of the rows that take part, components as floor(scale * x)."""
    x = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.filter(sound).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
                                     F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("vector"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows; shorter ones end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


@dataclass
class Search:
    """What the tasks get: anchors, and windows (sorted by anchor) of scores in which each looks for rows."""
    ids: np.ndarray             # of anchors
    labels: np.ndarray
    vectors: np.ndarray         # anchors x dimensions
    order: np.ndarray           # dimensions from most to least weight
    of: np.ndarray              # of each window: the anchor, the bounds
    low: np.ndarray
    high: np.ndarray
    name: np.ndarray            # of each window, as the caller counts
    same: bool                  # rows of the anchor's label, without the anchor, or of others
    need: int


def tails(vectors: np.ndarray) -> np.ndarray:
    """Norms of what is left from each dimension on, and 0 behind the last."""
    square = np.cumsum((vectors * vectors)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.hstack([square, np.zeros((len(vectors), 1))])) * (1 + 1e-9)


def above(queries: np.ndarray, floor: np.ndarray, rows: np.ndarray, lowest: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs whose inner product may be ``floor`` of the query or more; all that are can be among them. ``lowest`` is the least floor."""
    width = queries.shape[1]
    left, mine = tails(rows), tails(queries)
    most = mine.max(axis=0)
    # A row is indexed up to the first dimension from which on it cannot reach the lowest threshold.
    cut = (left * most >= lowest).sum(axis=1) if lowest > 0 else np.full(len(rows), width)
    cut = np.minimum(cut, width)
    by_cut = np.argsort(-cut, kind="stable")
    cut, left, postings = cut[by_cut], left[by_cut], np.ascontiguousarray(rows[by_cut].T)
    ends = np.searchsorted(-cut, -np.arange(width), side="left")            # rows in the postings of each dimension
    found_q, found_r = [], []
    for at in range(0, len(queries), QUERIES):
        q, t, rest = queries[at:at + QUERIES], floor[at:at + QUERIES, None], mine[at:at + QUERIES]
        index, alive, live_cut, live_left, held = postings, by_cut, cut, left, ends
        score = np.zeros((len(q), len(alive)))
        for start in range(0, width, STEP):
            for j in range(start, min(start + STEP, width)):
                n = held[j]
                if n == 0:
                    break
                score[:, :n] += q[:, j, None] * index[j, :n]
            stop = np.minimum(live_cut, min(start + STEP, width))           # dimensions that a row's score holds
            open_ = score + rest[:, stop] * live_left[np.arange(len(stop)), stop] >= t
            stay = open_.any(axis=0)
            if stay.sum() < 0.7 * len(stay):
                index, alive, score, live_cut, live_left, open_ = index[:, stay], alive[stay], score[:, stay], live_cut[stay], live_left[stay], open_[:, stay]
                held = np.searchsorted(-live_cut, -np.arange(width), side="left")
            if not len(alive):
                break
        if len(alive):
            who, row = np.nonzero(open_)
            found_q.append(who + at)
            found_r.append(alive[row])
    none = np.empty(0, np.int64)
    return (np.concatenate(found_q), np.concatenate(found_r)) if found_q else (none, none)


def best(window: np.ndarray, score: np.ndarray, ids: np.ndarray, need: int) -> np.ndarray:
    """Places of the ``need`` first of each window: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, window))
    w = window[order]
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.empty(0, np.int64)
    rank = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
    return order[rank < need]


class Task:
    """The windows of one search over the rows of one task."""

    def __init__(self, search: Search):
        self.s = search
        self.vectors = search.vectors[:, search.order].astype(np.float64)
        self.first = np.searchsorted(search.of, np.arange(len(search.ids)))
        self.last = np.searchsorted(search.of, np.arange(len(search.ids)), side="right")
        self.low = search.low.copy()                    # rises where the task itself has filled a window
        self.window, self.score, self.row = (np.empty(0, np.int64) for _ in range(3))

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        s = self.s
        asked = np.flatnonzero(self.last > self.first)
        if not len(asked) or not len(ids):
            return
        floor = np.minimum.reduceat(self.low, self.first[asked])
        ordered = vectors[:, s.order].astype(np.float64)
        q, r = above(self.vectors[asked], floor.astype(np.float64), ordered, float(floor.min()))
        for at in range(0, len(q), 1 << 17):
            self.take(asked[q[at:at + (1 << 17)]], r[at:at + (1 << 17)], ids, labels, vectors)
        self.trim()

    def take(self, q: np.ndarray, r: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        s = self.s
        fits = (labels[r] == s.labels[q]) & (ids[r] != s.ids[q]) if s.same else labels[r] != s.labels[q]
        q, r = q[fits], r[fits]
        score = np.einsum("ij,ij->i", s.vectors[q], vectors[r])
        each = self.last[q] - self.first[q]
        pair = np.repeat(np.arange(len(q)), each)
        window = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each) + self.first[q][pair]
        inside = (score[pair] >= self.low[window]) & (score[pair] <= s.high[window])
        pair, window = pair[inside], window[inside]
        self.window, self.score, self.row = (np.concatenate(x) for x in ((self.window, window), (self.score, score[pair]), (self.row, ids[r[pair]])))
        if len(self.window) > 1 << 20:
            self.trim()

    def trim(self) -> None:
        keep = best(self.window, self.score, self.row, self.s.need)
        self.window, self.score, self.row = self.window[keep], self.score[keep], self.row[keep]
        n = np.bincount(self.window, minlength=len(self.low))
        lowest = np.full(len(self.low), np.iinfo(np.int64).max)
        np.minimum.at(lowest, self.window, self.score)
        full = n >= self.s.need
        self.low[full] = np.maximum(self.low[full], lowest[full])

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.s.name[self.window]), pa.array(self.row), pa.array(self.score)], names=["window", "row", "score"])


def scan(rows: DataFrame, search: Search) -> DataFrame:
    """(window, row, score, n): the first ``need`` rows of each window over all rows, and how many it has."""
    shared, width = rows.sparkSession.sparkContext.broadcast(search), search.vectors.shape[1]

    def run(batches):
        task = Task(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                task.add(part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2), width))
        yield task.found()

    near = rows.mapInArrow(run, "window bigint, row bigint, score bigint")
    order = Window.partitionBy("window").orderBy(F.desc("score"), "row")
    first = near.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {search.need}")
    return first.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("window")))


def first_levels(search: Search, sample: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Thresholds to try for each window: the best score that the sample has in it, the last of ``need``, its floor."""
    ids, labels, vectors = sample
    best_, enough = search.low.copy(), search.low.copy()
    now, score = -1, np.empty(0, np.int64)
    for w, (q, low, high) in enumerate(zip(search.of.tolist(), search.low.tolist(), search.high.tolist())):
        if q != now:
            fits = (labels == search.labels[q]) & (ids != search.ids[q]) if search.same else labels != search.labels[q]
            now, score = q, np.sort(vectors[fits] @ search.vectors[q])
        first, last = np.searchsorted(score, low), np.searchsorted(score, high, side="right")
        if last > first:
            best_[w] = score[last - 1]
        if last - first >= search.need:
            enough[w] = score[last - search.need]
    return [best_, enough, search.low]


def filled(rows: DataFrame, search: Search, sample) -> DataFrame:
    """(window, rank, row, score) of every window, thresholds lowered until each is full or at its floor."""
    parts, floor, left = [], search.low, np.arange(len(search.of))
    for level in first_levels(search, sample):
        # A window whose level is its floor already is complete after this round.
        now = Search(search.ids, search.labels, search.vectors, search.order, search.of[left], level[left], search.high[left], search.name[left], search.same, search.need)
        got = written(scan(rows, now), "windows")
        full = {r[0] for r in got.filter(f"rank = 1 and n >= {search.need}").select("window").collect()}
        done = np.array([search.name[w] in full or level[w] == floor[w] for w in left.tolist()], bool)
        closed = set(search.name[left[done]].tolist())
        parts.append(got if len(closed) == len(left) else got.filter(F.col("n") >= search.need) if closed == full else got.join(
            rows.sparkSession.createDataFrame([(int(w),) for w in closed], "window bigint"), "window", "left_semi"))
        left = left[~done]
        if not len(left):
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("window", "rank", "row", "score")


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST, scale: int = 256,
         sample: int = SAMPLE, chunk_bytes: int = CHUNK_BYTES, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row of ``anchors`` and each of its first ``positives``
    other rows of the same label, the first ``negatives`` rows of other labels with lowest * positive_score <= 100 * negative_score <=
    highest * positive_score. Scores are inner products of floor(scale * x); higher ones come first, ties by smaller id.

    Rows without id, label or vector, or with a component that is null or not finite, take no part. Components missing at a vector's end count as
    0. No row with an anchor's id is its positive; otherwise rows that repeat an id are rows of their own, and equal anchors count once. A label
    with fewer rows has fewer positives, an anchor alone in its label none. Scores are exact while they fit 53 bits. An empty table gives no rows.
    """
    spark = rows.sparkSession
    held = written(integers(rows, id_col, vector_col, label_col, scale), "vectors")
    asked = integers(anchors, id_col, vector_col, label_col, scale).dropDuplicates(["id", "label", "vector"])
    width = held.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(width, asked.agg(F.max(F.size("vector"))).first()[0] or 0)
    outcome = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not width:
        return empty(spark, outcome)
    seen = held.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().combine_chunks()
    pick = tuple(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in seen.columns)
    pick = pick[0].to_numpy(), pick[1].to_numpy(), matrix(pick[2], width)
    order = np.argsort(-(pick[2].astype(np.float64) ** 2).sum(axis=0), kind="stable")
    # Anchors in blocks of about equal size by a hash of the id; of those a block has, the driver holds one at a time.
    each = max(1, chunk_bytes // (8 * width))
    total = asked.count()
    chunks = -(-total // each) if total else 0
    asked = written(asked.withColumn("chunk", F.pmod(F.xxhash64("id", "label", "vector"), F.lit(max(1, chunks)))), "anchors")
    parts = []
    for k in range(chunks):
        block = asked.filter(F.col("chunk") == k).drop("chunk").toArrow()
        if block.num_rows:
            part = mined(held, block.combine_chunks(), width, order, pick, positives, negatives, lowest, highest)
            if part is not None:
                parts.append(written(part, "negatives"))
    if not parts:
        return empty(spark, outcome)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def mined(rows: DataFrame, block: pa.Table, width: int, order: np.ndarray, sample, positives: int, negatives: int, lowest: int, highest: int) -> DataFrame | None:
    """The result of one block of anchors."""
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in block.columns]
    ids, labels, vectors = columns[0].to_numpy(), columns[1].to_numpy(), matrix(columns[2], width)
    n = len(ids)
    every = np.arange(n)
    friends = Search(ids, labels, vectors, order, every, np.full(n, FLOOR), np.full(n, -FLOOR), every, True, positives)
    near = filled(rows, friends, sample).orderBy("window", "rank").toArrow()           # at most `positives` rows for an anchor of the block
    of, row, score = (near.column(c).to_numpy() for c in ("window", "row", "score"))
    # 100 * negative >= lowest * positive, <= highest * positive, in whole numbers.
    low, high = -((-lowest * score) // 100), highest * score // 100
    real = np.flatnonzero(low <= high)
    if not len(real):
        return None
    name = np.arange(len(of))
    foes = Search(ids, labels, vectors, order, of[real], low[real], high[real], name[real], False, negatives)
    got = filled(rows, foes, sample)
    pairs = pa.table({"window": name, "anchor_id": ids[of], "positive_id": row, "positive_score": score})
    named = rows.sparkSession.createDataFrame(pairs)
    return got.join(named, "window").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
