"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Hashed-text weights are shared by ordered thresholds; the model gives the expected grade and a tail probability for selection.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roomdiff.llm.ordinal import Ordinal, featured, fit, graded_sample
from roomdiff.llm.text import per_text

SAMPLE = 8192       # graded texts a model is fitted on, at most


def train(docs: DataFrame, ratings: DataFrame, grade_col: str = "grade", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
          n_grades: int = 3) -> Ordinal:
    """Fits on at most ``sample`` texts rated 0 to ``n_grades`` - 1. Without any rating the model knows nothing: every grade gets an equal share."""
    features, grades = featured(graded_sample(docs, ratings, id_col, text_col, grade_col, sample))
    return fit(features, np.clip(grades, 0, n_grades - 1), n_grades)


def rate(docs: DataFrame, model: Ordinal, select_from: int = 1, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_grade, p_tail, grade, kept) for every row.

    ``p_tail`` is P(grade >= select_from), ``grade`` the likeliest grade (the lower of equals), ``kept`` is p_tail >= least. Repeated rows
    are rated alike, one result each; a null or empty text has the features of an empty one. A null id stays null.
    """
    def make():
        score = model.scorer()

        def work(texts):
            p = score(texts)
            tail = p[:, select_from:].sum(axis=1)
            return [pa.array(p @ np.arange(p.shape[1])), pa.array(tail), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(tail >= least)]
        return work
    return per_text(docs, make, "expected_grade double, p_tail double, grade int, kept boolean", id_col, text_col)
