import numpy as np
from pyspark.sql import functions as F

from roomdiff.llm import ordinal, quality, toxicity
from roomdiff.llm.queries import ratings
from tests.llm.helpers import EDGES, documents

SF = "/root/testdata/sf0.1"


def test_fit_finds_weights_and_ordered_thresholds():
    rng = np.random.default_rng(1)
    n, d = 4000, 12
    x = rng.random((n, d)) < 0.3
    w = np.array([3.0, 2, 1, 0, 0, 0, 0, 0, 0, -1, -2, -3])
    noise = rng.logistic(size=n)
    grades = np.digitize(x @ w + noise, [-1.0, 0.5, 2.0])
    model = ordinal.fit([np.flatnonzero(row) for row in x], grades, 4, dims=16, l2=1e-6, z=0, steps=400)
    assert np.all(np.diff(model.thetas) > 0)
    assert np.abs(model.thetas - [-1.0, 0.5, 2.0]).max() < 0.35
    assert np.abs(model.weights[:d] - w).max() < 0.5
    p = model.probabilities(x @ model.weights[:d])
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()


def test_without_ratings_every_grade_is_as_likely(spark):
    docs = documents(spark, EDGES)
    none = spark.createDataFrame([], "doc_id bigint, grade int")
    out = quality.rate(docs, quality.train(docs, none)).collect()
    assert len(out) == len(EDGES) and all(abs(r.expected_grade - 1) < 0.05 for r in out)


def test_edges_give_one_row_each(spark):
    docs = documents(spark, EDGES + [(10 + k, "bad evil text" if k % 2 else "good kind text", "a") for k in range(60)])
    labels = spark.createDataFrame([(10 + k, k % 2, "z") for k in range(60)] + [(None, 1, "z"), (10, None, "z"), (11, 1, "z"), (999, 1, "z")], "doc_id bigint, toxic int, text string")
    model = toxicity.train(docs, labels)
    out = toxicity.rate(docs, model).collect()
    assert len(out) == len(EDGES) + 60 and all(0 <= r.p_toxic <= 1 for r in out)
    by_id = {r.doc_id: r for r in out}
    assert all(by_id[10 + k].toxic == bool(k % 2) for k in range(60))
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in out)
    assert toxicity.rate(docs.limit(0), model).count() == 0


def split(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(4)) == 0
    return docs, labels.filter(~held), labels.filter(held)


def test_held_out_toxicity(spark):
    docs, fit_on, held = split(spark)
    out = toxicity.rate(docs, toxicity.train(docs, fit_on)).join(held.select("doc_id", F.col("toxic").alias("truth")), "doc_id").toPandas()
    assert out.toxic[out.truth == 1].mean() > 0.9
    assert out.toxic[out.truth == 0].mean() < 0.01


def test_held_out_quality(spark):
    docs, fit_on, held = split(spark)
    out = quality.rate(docs, quality.train(docs, ratings(fit_on))).join(held, "doc_id").toPandas()
    assert out.kept[(out.quality == 1) & (out.toxic == 0)].mean() > 0.98
    assert out.kept[(out.quality == 1) & (out.toxic == 1)].mean() > 0.6         # the middle grade
    assert out.kept[out.quality == 0].mean() < 0.2


def test_held_out_quality_does_not_hang_on_toxicity(spark):
    docs, fit_on, held = split(spark)
    out = quality.rate(docs, quality.train(docs, ratings(fit_on))).join(held, "doc_id").toPandas()
    by = {k: (len(x), round(x.kept.mean(), 4)) for k, x in out.groupby(["quality", "toxic"])}
    assert out.kept[out.quality == 1].mean() > 0.98, by
    assert out.kept[(out.quality == 1) & (out.toxic == 1)].mean() > 0.98, by
    assert out.kept[out.quality == 0].mean() < 0.05, by


def test_ratings_are_of_quality_only(spark):
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 0), (4, 1, 1), (5, None, 1)], "doc_id bigint, quality int, toxic int")
    assert {r.doc_id: r.grade for r in ratings(labels).collect()} == {1: 0, 2: 0, 3: 2, 4: 2, 5: None}
