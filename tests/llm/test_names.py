"""Columns of any name beside those that the stages read."""

import pytest
from pyspark.sql import functions as F

from roomdiff.llm import decontaminate, lines, minhash

NAMES = ["doc_id", "text", "source", "__id", "__hash", "__at", "__gone", "__lines", "__hid", "__hhash", "__hits", "id", "gone", "at", "row", "rank", "a.b", "count", "text_hash", "hits"]


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(f"w{k}" for k in range(40))
    data = [(k, f"menu\n{base if k < 4 else f'text {k}'}", f"s{k}") for k in range(30)] + [(7, "again", "s7"), (None, "menu", "s1"), (50, None, None)]
    rows = [(i, t, s, *[f"{n}-{k}" for n in NAMES[3:]]) for k, (i, t, s) in enumerate(data)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES[3:])).repartition(3)


def rest(df):
    assert df.columns[:len(NAMES)] == NAMES
    return sorted(tuple(r)[3:len(NAMES)] for r in df.collect())


def test_lines(docs):
    assert rest(lines.cleaned(docs)) == rest(docs) == rest(lines.cleaned(docs, counts=False))
    assert lines.cleaned(docs).columns[-2:] == ["__lines_", "__gone_"]
    assert lines.cleaned(docs, counts=False).filter("text like '%menu%'").count() == 2


def test_one_of_each(docs):
    left = minhash.one_of_each(docs)
    assert left.columns == NAMES and left.filter("doc_id < 4").count() == 1 and left.filter("doc_id = 7").count() == 1
    assert set(rest(left)) < set(rest(docs)) and left.count() == docs.count() - 4


@pytest.mark.parametrize("most", [1 << 24, 0])
def test_decontamination(spark, docs, most):
    tests = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(12)))], "item_id bigint, text string")
    left = decontaminate.remove(docs, tests, most_bytes=most)
    assert rest(left) == rest(docs) and left.filter(F.col("text").contains("w5 ")).count() == 0 and left.filter(F.col("text").contains("w20")).count() == 4
