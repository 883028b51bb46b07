import random

import numpy as np
import pytest

from roomdiff.llm import minhash as m
from tests.llm.helpers import EDGES, documents, rows, words


def brute(plain, n, percent):
    """{row: (n_shingles, component_id, kept)} by comparing all pairs; rows with an id only."""
    def shingles(text):
        w = words(text)
        return frozenset(tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t, _ in plain]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = list({(i, s) for i, s in sets if i is not None and s})
    for a, (i, s) in enumerate(distinct):
        for j, t in distinct[:a]:
            k = len(s & t)
            if 100 * k >= percent * (len(s) + len(t) - k):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def near(rng, text, share):
    w = text.split(" ")
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10 ** 6)}"
    return " ".join(w)


def corpus():
    rng = random.Random(7)
    out, i = [], 100
    for size in (2, 3, 8, 120):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 160)))
        for k in range(size):
            out.append((i, near(rng, base, rng.choice([0, 0.01, 0.03, 0.06, 0.1])), "a"))
            i += 1
    for k in range(150):        # chains: each near the one before, ends far apart
        out.append((i, " ".join(f"c{x}" for x in range(k * 2, k * 2 + 60)), "b"))
        i += 1
    for k in range(200):
        out.append((i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 60))), "c"))
        i += 1
    out += [(i, "one", "a"), (i + 1, "ONE", "a"), (i + 2, "one two", "a"), (i + 3, "One  two", "a"), (3000, "a b c d e f g h", "a"), (3000, "p q r s t u v", "a"), (3001, "p q r s t u v", "a"), (2999, "a b c d e f g h", "a")]
    return out


def check(spark, plain, n):
    out = m.components(documents(spark, plain), n=n).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute(plain, n, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)


def test_two_word_shingles(spark):
    check(spark, EDGES + corpus(), 2)


def test_five_word_shingles(spark):
    check(spark, EDGES + corpus(), 5)


def changed(rng, base, low, high):
    w = list(base)
    for k in rng.sample(range(len(w)), rng.randint(low, high)):
        w[k] = f"n{rng.randrange(10 ** 6)}"
    return " ".join(w)


def family(seed, n, low, high, length=80):
    """Copies of one text, each with a few words changed: most pairs are near the threshold, many below."""
    rng = random.Random(seed)
    base = [f"b{seed}_{k}" for k in range(length)]
    return [(k, changed(rng, base, low, high), "a") for k in range(n)]


@pytest.mark.parametrize("low,high", [(3, 6), (2, 5), (4, 7)])
def test_groups_just_under_the_threshold(spark, low, high):
    check(spark, family(low, 300, low, high), 2)


def test_families_in_one_group(spark):
    """Two families that are alike but not enough, with links only inside and a few texts between them."""
    rng = random.Random(9)
    one = [f"a{k}" for k in range(80)]
    two = [f"z{k}" if k % 9 == 0 else w for k, w in enumerate(one)]
    plain = [(k, changed(rng, one if k % 2 else two, 3, 6), "a") for k in range(240)]
    check(spark, plain, 2)
    check(spark, plain + [(900 + k, changed(rng, one[:40 + k] + two[40 + k:], 0, 2), "a") for k in range(3)], 2)


def test_a_node_of_very_many_pairs_is_shared_out(spark):
    sets = spark.createDataFrame([(0, list(range(10)))] + [(k, list(range(10 if k % 2 else 7))) for k in range(1, 2600)], "id bigint, hashes array<bigint>")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 2600)], "u bigint, w bigint")
    assert m.confirm(pairs, sets, 80).count() == 1300


def test_joined_rows_do_not_grow_with_the_square(spark, monkeypatch):
    """Pairs to confirm for groups of 150 and 600."""
    made = []
    plain_confirm = m.confirm
    monkeypatch.setattr(m, "confirm", lambda pairs, sets, percent: (made.append(pairs.count()), plain_confirm(pairs, sets, percent))[1])
    for n in (150, 600):
        m.components(documents(spark, family(3, n, 3, 6)), n=2).count()
    first, second = made[1], made[3]
    assert second < 9 * first


def test_links_at_and_just_below_the_threshold(spark):
    base = [f"x{k}" for k in range(38)]         # 37 pairs
    plain = []
    for k in range(1, 12):
        plain.append((k, " ".join(base + [f"y{j}" for j in range(k)]), "a"))
    plain.append((0, " ".join(base), "a"))
    check(spark, plain, 2)
    exact = [(1, " ".join(f"a{k}" for k in range(41)), "a"), (2, " ".join(f"a{k}" for k in range(33)), "a")]       # 32 of 40: 80 %
    check(spark, exact, 2)
    check(spark, [exact[0], (2, " ".join(f"a{k}" for k in range(32)), "a")], 2)


def test_one_of_each_group_stays(spark):
    plain = EDGES + corpus() + [(4000, "z " * 9, "a"), (4000, "z " * 9, "a"), (None, "z " * 9, "a")]
    df = documents(spark, plain)
    out = m.one_of_each(df, n=2)
    assert out.columns == df.columns
    left = [r.doc_id for r in out.collect()]
    comps = {i: c for i, _, c in brute(plain, 2, 80) if i is not None}
    assert sorted(i for i in left if i is not None) == sorted({i for i, c in comps.items() if i == c})
    assert left.count(None) == sum(i is None for i, _, _ in plain)


def test_empty_table_and_no_links(spark):
    df = documents(spark, EDGES)
    assert m.components(df.limit(0)).count() == 0
    assert m.components(documents(spark, [(1, None, "a"), (2, "", "a")])).filter("kept").count() == 2


def test_estimate_is_unbiased():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(40):
        a = rng.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64)
        b = np.concatenate([a[:240], rng.integers(0, 1 << 63, 60, dtype=np.int64).astype(np.uint64)])
        differ = sum(bin(((int(x) ^ int(y)) | ((int(x) ^ int(y)) >> 1)) & 0x5555555555555555).count("1") for x, y in zip(m.packed(m.minima(a)).view(np.uint64), m.packed(m.minima(b)).view(np.uint64)))
        match = 1 - differ / 250
        errors.append((match - 0.25) / 0.75 - 240 / 360)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_differences_are_counted_without_a_join(spark):
    """What members of a group differ in, from the rarest to the commonest; the counting makes one row for each, no join."""
    sets = {1: [1, 2, 3, 10], 2: [1, 2, 3, 10, 11], 3: [1, 2, 3, 11, 12], 4: [1, 2, 13], 5: [1, 2, 3]}
    state = spark.createDataFrame([("g", n, n, n, len(s), 0, s) for n, s in sets.items()], "g string, node bigint, r bigint, comp bigint, size int, fixed int, items array<bigint>")
    got = m.centred(state)
    assert {r.node: (r.fixed, r["items"]) for r in got.collect()} == {1: (0, [10]), 2: (0, [10, 11]), 3: (1, [11]), 4: (2, []), 5: (0, [])}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and " e#" in line.replace("(", " ") for line in plan.splitlines())
