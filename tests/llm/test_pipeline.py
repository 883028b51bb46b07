"""Every stage of the pipeline against a plain version, each on the rows that its predecessor kept."""

import pytest

import corpus_pipeline
from roomdiff.functions.stage import written
from roomdiff.llm import lines, pieces, toxicity
from tests.llm import test_decontaminate, test_lines, test_minhash
from tests.llm.helpers import prose

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10 ** 6 + k, t, "en", f"src{k % 20}", len(t)) for k, t in enumerate([prose(5, 80) + f" end {k}" for k in range(30)] + ["menu line of the site\n" + prose(200 + k, 40) for k in range(25)])]
    docs = written(docs.union(spark.createDataFrame(extra + [(10 ** 6 + 99, None, None, None, None)], docs.schema)), "in")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return out


def plain(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def test_columns_stay(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "decontamination", "sentencepiece"]


def test_toxic_documents_go(spark, stages):
    before, after = stages[0], stages[1]
    rated = toxicity.rate(before, toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet")))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in rated.filter("not toxic").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {i for i, _, _ in plain(before)} - {i for i, _, _ in plain(after)}
    assert not [i for i in gone if labels.get(i) == 0]
    assert len([i for i in gone if labels.get(i) == 1]) > 0.7 * sum(labels.values())
    assert max(gone) < 10 ** 6


def test_lines_go(stages):
    want = [(i, t) for i, _, _, t in test_lines.brute(plain(stages[1]), lines.SITES)]
    got = sorted(((i, t) for i, t, _ in plain(stages[2])), key=str)
    assert got == sorted(want, key=str)
    assert sum("menu line of the site" in (t or "") for _, t in got) == 1


def test_one_of_each_group(stages):
    comps = test_minhash.brute(plain(stages[2]), 5, 80)
    assert sorted(i for i, _, _ in plain(stages[3])) == sorted({i for i, _, c in comps if i == c})


def test_benchmark_words_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = dict((i, t) for i, t, _ in plain(stages[3])), dict((i, t) for i, t, _ in plain(stages[4]))
    index: dict = {}
    import re
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", test_decontaminate.lowered(t or ""))
    for _, t in items:
        w = split(t)
        k = min(10, len(w))
        index.update({tuple(w[a:a + k]): k for a in range(len(w) - k + 1 if k else 0)})
    sizes = sorted(set(index.values()))
    for i, t in before.items():
        w = split(t)
        hit = {b + j for k in sizes for b in range(len(w) - k + 1) if tuple(w[b:b + k]) in index for j in range(k)}
        left = [x for j, x in enumerate(w) if j not in hit]
        assert (i in after) == (not w or bool(left)), i
        if i in after:
            assert after[i] == t if not hit else split(after[i]) == left


def test_tokens_of_all_that_is_left(stages):
    coder = pieces.Coder(pieces.read_model(pieces.default_model()), check=False)
    texts = {i: t for i, t, _ in plain(stages[4])}
    out = stages[5].collect()
    assert sorted(r.doc_id for r in out) == sorted(texts) and all(r.parity and r.round_trip for r in out)
    assert coder.decode([r.ids for r in out]) == [texts[r.doc_id] or "" for r in out]


def test_run_applies_all_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "ids", "n_tokens", "parity", "round_trip"] and out.count() > 0
