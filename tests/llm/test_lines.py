from roomdiff.llm import lines as li
from tests.llm.helpers import EDGES, documents


def brute(plain, sites):
    places: dict = {}
    first: dict = {}
    for i, t, s in plain:
        for line in (t or "").split("\n"):
            key = line.strip(" \t\x0b\x0c\r")
            if key and i is not None and s is not None:
                places.setdefault(key, set()).add(s)
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t, s in plain:
        each = [(x, x.strip(" \t\x0b\x0c\r")) for x in (t or "").split("\n")] if t is not None else []
        gone = [bool(k) and i is not None and len(places.get(k, ())) >= sites and first[k] != i for _, k in each]
        out.append((i, sum(bool(k) for _, k in each), sum(gone), None if t is None else "\n".join(x for (x, _), g in zip(each, gone) if not g)))
    return sorted(out, key=str)


def corpus(sites):
    out = [(100 + k, f"menu\nown {k}\n  shared by all \n\nmenu\nfooter {k % 3}", f"s{k}") for k in range(40)]
    for n in range(sites - 4, sites + 5):        # lines around the threshold
        out += [(1000 * n + k, f"near {n}\nown {n} {k}", f"s{k}") for k in range(n)]
    return out + [(9, "menu", "a"), (99999, "menu", None), (99998, None, "a"), (None, "menu\nown 1", "z"), (100, "menu\nown 1", "s77"), (100, "menu\nown 1", "s77")]


def found(df, sites):
    out = li.cleaned(df, sites)
    assert out.columns == df.columns + ["__lines", "__gone"]
    return sorted(((r.doc_id, r["__lines"], r["__gone"], r.text) for r in out.collect()), key=str)


def test_brute_force_around_the_threshold(spark):
    for sites in (8, 20):
        plain = EDGES + corpus(sites)
        assert found(documents(spark, plain), sites) == brute(plain, sites)


def test_copies_on_many_sites_leave_one_whole(spark):
    plain = [(k, "first line\nsecond line", f"s{k}") for k in range(30)]
    got = {i: t for i, _, _, t in found(documents(spark, plain), 10)}
    assert got[0] == "first line\nsecond line" and set(got.values()) == {"first line\nsecond line", ""}


def test_many_sites_are_estimated_and_still_found(spark):
    plain = [(k, f"everywhere\nown {k}", f"site {k}") for k in range(3000)]
    got = found(documents(spark, plain), 10)
    assert sum(g for _, _, g, _ in got) == 2999


def test_empty(spark):
    assert li.cleaned(documents(spark, EDGES).limit(0)).count() == 0
