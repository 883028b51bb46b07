import itertools
import re

import numpy as np
from pyspark.sql import functions as F

from roomdiff.llm import rules as r
from tests.llm.helpers import EDGES, documents, prose, rows


def chain(seed):
    rng = np.random.default_rng(seed)
    return r.Chain(rng.normal(size=(r.WIDTH, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))


def value(c, score, labels):
    return c.start[labels[0]] + score[range(len(labels)), labels].sum() + sum(c.move[a, b] for a, b in zip(labels, labels[1:]))


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(3)
    c = chain(3)
    scores = [rng.normal(size=(n, 2)) for n in (1, 2, 0, 7, 3, 9, 1)]
    for score, got in zip(scores, r.viterbi(c, scores)):
        if len(score):
            best = max(itertools.product((0, 1), repeat=len(score)), key=lambda ls: value(c, score, np.array(ls)))
            assert got.tolist() == list(best)
        else:
            assert len(got) == 0


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(4)
    feats = [np.stack([rng.permutation(r.WIDTH)[:r.HOT] for _ in range(n)]).astype(np.int32) for n in (1, 3, 4)]
    labs = [rng.integers(0, 2, len(f)) for f in feats]
    x = rng.normal(size=r.WIDTH * 2 + 6) * 0.3

    def loss(x):
        c, out = r._chain(x), 0.0
        for f, lab in zip(feats, labs):
            score = c.scores(f)
            every = [value(c, score, np.array(ls)) for ls in itertools.product((0, 1), repeat=len(f))]
            out += np.log(np.exp(every).sum()) - value(c, score, lab)
        return out

    size = np.array([len(f) for f in feats])
    pad = np.full((3, 4, r.HOT), -1, np.int32)
    lab = np.zeros((3, 4), np.int64)
    for k, f in enumerate(feats):
        pad[k, :len(f)], lab[k, :len(f)] = f, labs[k]
    got = r._gradient(r._chain(x), size, pad, lab)
    for k in [*range(0, len(x), 7), *range(len(x) - 6, len(x))]:
        step = np.zeros_like(x)
        step[k] = 1e-5
        assert abs((loss(x + step) - loss(x - step)) / 2e-5 - got[k]) < 1e-5


def plain(text):
    """The contract's counts, one word at a time."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts: dict = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside)


TEXTS = [(20, prose(1, 60) + "\n" + prose(2, 40), "a"), (21, (prose(3, 7) + " ") * 9, "a"), (22, "A b\nA b\n\n\nA b \nc # | é x", "b"), (23, "one two three four five", "b"),
         (24, "a b c d e f a b c d e", "b"), (25, "###\n***", None)]


def test_counts_and_edges(spark):
    docs = documents(spark, EDGES + TEXTS)
    labels = spark.createDataFrame([(20, 1), (21, 0), (25, 0), (None, 1), (22, None)], "doc_id bigint, quality int")
    c = r.train(docs, labels)
    got = rows(r.judge(docs, c))
    texts = {i: t for i, t, _ in EDGES + TEXTS}
    assert len(got) == len(EDGES + TEXTS)
    for row in got:
        want = plain(texts[row["doc_id"]])
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert row["base_failed"] == failed and not (failed and row["kept"])
        assert row["kept"] == (not failed and row["content_share"] >= 0.5)
    kept = r.keep(docs, c)
    assert kept.columns == docs.columns and kept.count() == sum(x["kept"] for x in got)
    assert r.judge(docs.limit(0), c).count() == 0


def test_without_labels_everything_is_content(spark):
    docs = documents(spark, TEXTS)
    c = r.train(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert all(x["content_share"] == 1.0 for x in rows(r.judge(docs, c)))


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(4)) == 0
    out = r.judge(docs, r.train(docs, labels.filter(~held))).join(labels.filter(held), "doc_id").toPandas()
    good, poor = out[out.quality == 1], out[out.quality == 0]
    assert (good.kept | good.base_failed).mean() > 0.98
    assert poor.kept.mean() < 0.15
