import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from roomdiff.llm import decontaminate as d
from tests.llm.helpers import EDGES, documents, lowered, prose, rows, sha


def test_words(text="Hé-llo W0rld_x ÀB\x85c\xa0d"):
    assert [w.decode() for w in d.clean_words(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute(text, items, n=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    hit, named, any_hit = set(), set(), False
    for item, t in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        k = min(n, len(own))
        for a in range(len(own) - k + 1 if k else 0):
            for b in range(len(words) - k + 1):
                if words[b:b + k] == own[a:a + k]:
                    hit |= set(range(b, b + k))
                    any_hit = True
                    named |= {item} - {None}
    return len(words), len(hit), len(named), sha(",".join(sorted(map(str, named)))), any_hit


ITEMS = [(1, prose(1, 40)), (2, prose(2, 12)), (3, "Short one, here"), (4, None), (5, ""), (6, "..."), (None, prose(6, 15)), (12, prose(1, 40)), (7, "same")]


@pytest.fixture
def docs(spark):
    texts = [(20, prose(90, 30) + " " + prose(1, 40)[:90] + " tail", "a"), (21, "A short one; HERE it is", "b"), (22, prose(6, 15), "b"), (23, prose(1, 40) + ". " + prose(1, 40), "a"), (24, prose(77, 300), "c")]
    return documents(spark, EDGES + texts), EDGES + texts


@pytest.mark.parametrize("most", [d.MOST_BYTES, 0])
def test_scan_is_brute_force(spark, docs, most):
    df, plain = docs
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows(d.scan(df, items, most_bytes=most))]
    want = sorted(((i, *brute(t, ITEMS)) for i, t, _ in plain), key=lambda r: (r[0] is not None, r[0] or 0, str(r)))
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("most", [d.MOST_BYTES, 0])
def test_removal(spark, docs, most):
    df, plain = docs
    items = spark.createDataFrame([(1, prose(1, 40)), (3, "Short one, here")], "item_id bigint, text string")
    out = d.remove(df, items, most_bytes=most)
    assert out.columns == df.columns
    left = {r.doc_id: r.text for r in out.collect()}
    assert 23 not in left and left[21] == "A  it is" and left[24] == prose(77, 300) and left[1] is None and left[2] == ""
    assert left[20].startswith(prose(90, 30)) and left[20].endswith(" tail")
    assert d.scan(out, items).filter("contaminated").count() == 0
    whole = d.remove(df, items, documents=True, most_bytes=most)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == {i for i, _, _ in plain} - {20, 21, 23}


def test_empty_benchmark_and_empty_documents(spark, docs):
    df, plain = docs
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.scan(df, none).filter("not contaminated").count() == len(plain)
    assert d.scan(df.limit(0), spark.createDataFrame(ITEMS, "item_id bigint, text string")).count() == 0


@given(st.lists(st.sampled_from(["a", "b", "C", "é", ".", " ", "\n"]), max_size=30), st.data())
def test_cut_takes_out_just_the_hit_words(parts, data):
    import numpy as np
    raw = "".join(parts).encode()
    n = len(d.clean_words(raw))
    hit = np.array(data.draw(st.lists(st.booleans(), min_size=n, max_size=n)), bool)
    kept = [w for w, h in zip(d.clean_words(raw), hit) if not h]
    assert b"".join(d.clean_words(d.cut(raw, hit))) == b"".join(kept)


def test_windows_stay_small_when_sent(spark):
    import pickle
    import tracemalloc

    items = [(k, prose(1000 + k, 400, 5000).encode()) for k in range(400)]
    size = d.size_of(spark.createDataFrame([(i, t.decode()) for i, t in items], "item_id bigint, text string"))
    tracemalloc.start()
    windows = d.Windows.of(items)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(pickle.dumps(windows)) <= size <= 8 * sum(len(t) for _, t in items)
    assert held < 2 * size and peak < 6 * size
    assert d.MOST_BYTES <= 20 << 20


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(d, "hash64", lambda w: 1)
    items = [(1, b"a b c"), (2, b"x y z"), (3, b"x y z"), (None, b"q r s"), (4, b"a b c")]
    find = d.scanner(d.Windows.of(items, 2))
    for text, want in ((b"a b", {1, 4}), (b"y z", {2, 3}), (b"r s", set()), (b"b x", None), (b"c a b y", {1, 4})):
        _, hit, found = find(text)
        assert (hit.any(), found) == (want is not None, want or set()), text
