"""Fill-in-middle against plain slicing of code points."""

import hashlib
import random
import re

import pytest

from roomdiff.llm import fim
from tests.llm.helpers import EDGES, documents, rows, sha

ALPHABET = ["a", "b", " ", "\n", "\r", "é", "☃", "🙂", "\u0085", " ", "<", "S", ">", "\x00"]


def plain(text, key, units="lines", seed=7, rate=100, spm=50):
    text = text or ""
    parts = re.findall(r"[^\n]*\n|[^\n]+", text) if units == "lines" else list(text)
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    a, b, c, d = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(parts)
    if not text or any(m in text for m in fim.SENTINELS) or c % 100 >= rate:
        return n, "plain", None, None, text
    i, j = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = ("".join(x) for x in (parts[:i], parts[i:j], parts[j:]))
    if d % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(n):
    rng = random.Random(3)
    return ["".join(rng.choices(ALPHABET, weights=[8, 8, 6, 4, 1, 2, 2, 2, 1, 1, 1, 1, 1, 1], k=rng.randrange(60))) for _ in range(n)]


def test_index():
    for text in texts(200):
        raw, index = text.encode(), fim.Exceptions(text.encode())
        for k in range(len(text) + 1):
            at = len(text[:k].encode())
            assert index.bytes(k) == at and index.points(at) == k
    assert len(fim.Exceptions(b"plain " * 100).byte) == 0


@pytest.mark.parametrize("units,rate,spm", [("lines", 100, 50), ("chars", 100, 50), ("lines", 50, 100), ("chars", 70, 0)])
def test_against_slicing(spark, units, rate, spm):
    data = [*EDGES, *[(100 + k, t, "s") for k, t in enumerate(texts(150))], (400, "a<P>b\nc", "s"), (401, "x\n\ny<", "s"), (402, "\n", "s"), (403, "<\n<S\n>", "s")]
    made = fim.transform(documents(spark, data), units, rate=rate, spm_rate=spm).cache()
    key = lambda r: (r[0] is not None, r[0] or 0, str(r))
    want = sorted([(i, *plain(t, "" if i is None else i, units, 7, rate, spm)) for i, t, _ in data], key=key)
    got = sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()], key=key)
    assert got == want
    back = sorted([(r.doc_id, r.output) for r in fim.restore(made).collect()], key=key)
    assert back == sorted([(i, t or "") for i, t, _ in data], key=key)
    if rate == 100:
        assert {r[2] for r in got} == {"plain", "spm", "psm"} - ({"psm"} if spm == 100 else {"spm"} if spm == 0 else set())


def test_very_long_text(spark):
    text = "é" * 400_000 + "\n" + "line of ascii\n" * 300_000 + "🙂" * 100_000
    got = fim.transform(documents(spark, [(1, text, "a"), (2, "short\n", "a")]))
    assert {r.doc_id: sha(r.output) for r in got.collect()} == {1: sha(plain(text, 1)[-1]), 2: sha(plain("short\n", 2)[-1])}


def test_markers_and_empty(spark):
    empty = documents(spark, [(1, "a", "s")]).filter("doc_id < 0")
    assert rows(fim.transform(empty)) == [] and rows(fim.restore(fim.transform(empty))) == []
    for bad in [("<P>", "<P>", "<M>"), ("", "b", "c"), ("<P<", "<S>", "<M>")]:
        with pytest.raises(ValueError):
            fim.transform(empty, sentinels=bad)
    with pytest.raises(ValueError):
        fim.transform(empty, units="words")
    marks = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    made = fim.transform(documents(spark, [(i, t, "s") for i, t in enumerate(texts(40))]), "chars", seed=11, sentinels=marks)
    assert [r["output"] for r in rows(fim.restore(made, marks))] == texts(40)
