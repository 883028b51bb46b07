"""Toxicity: cumulative-link ordinal regression of severity grades on sparse text features.

One weight vector serves all ordered thresholds; the output is the expected severity and the probability of any toxicity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roomdiff.llm.ordinal import DIMENSIONS, Ordinal, featured, fit, graded_sample
from roomdiff.llm.text import per_text, rewrite

SAMPLE = 8192       # labelled texts a model is fitted on, at most
MARKED = 8.0        # times as frequent in toxic texts as in others: a feature that marks toxicity
SEVERE = 12         # marked features (a word has up to four) from which a toxic text is graded 2


def severity(features: list[np.ndarray], toxic: np.ndarray, dims: int = DIMENSIONS) -> np.ndarray:
    """Grades from labels that only say toxic or not: 0 not toxic, 1 toxic, 2 toxic with ``SEVERE`` or more distinct marked features.
    A feature is marked if it is in at least 5 toxic texts and its share among toxic texts is ``MARKED`` times its share among the others."""
    counts = np.zeros((2, dims), np.int32)
    for own, label in zip(features, toxic):
        counts[int(label > 0), own] += 1
    n_bad, n_good = max(int((toxic > 0).sum()), 1), max(int((toxic == 0).sum()), 1)
    marked = (counts[1] >= 5) & (counts[1] / n_bad >= MARKED * (counts[0] + 0.5) / n_good)
    hits = np.array([marked[own].sum() for own in features], np.int64)
    return np.where(toxic > 0, 1 + (hits >= SEVERE), 0).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
          graded: bool = False, n_grades: int = 3) -> Ordinal:
    """Fits on at most ``sample`` labelled texts. ``graded``: labels are severities 0 to ``n_grades`` - 1 already; else see ``severity``."""
    features, given = featured(graded_sample(docs, labels, id_col, text_col, label_col, sample))
    grades = np.clip(given, 0, n_grades - 1) if graded else severity(features, given)
    return fit(features, grades, n_grades)


def _judge(model: Ordinal, least: float):
    score = model.scorer()

    def work(texts):
        p = score(texts)
        return p @ np.arange(p.shape[1]), 1 - p[:, 0], 1 - p[:, 0] >= least
    return work


def rate(docs: DataFrame, model: Ordinal, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, p_toxic, toxic) for every row: the expected grade, P(grade >= 1), and whether that is ``least`` or more.

    Repeated rows are rated alike, one result each; null and empty texts have the features of an empty one; a null id stays null.
    """
    def make():
        judge = _judge(model, least)
        return lambda texts: [pa.array(x) for x in judge(texts)]
    return per_text(docs, make, "severity double, p_toxic double, toxic boolean", id_col, text_col)


def clean(docs: DataFrame, model: Ordinal, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    def make():
        judge = _judge(model, least)
        return lambda texts: (None, ~judge(texts)[2])
    return rewrite(docs, make, text_col)
