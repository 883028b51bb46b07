"""Line dedup by distinct-site spread.

Each line's sites go into a HyperLogLog sketch; sketches of a line hash merge by aggregation, on the map side first. A line whose
estimate lies near the threshold gets an exact count of its sites in a second pass over just those lines. Lines on ``sites`` or more
sites are boilerplate: they stay in the document with the smallest id that has them and go from all others, so copies of a whole
document on many sites leave one that is whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomdiff.functions.stage import written
from roomdiff.llm.text import own, unused

SITES = 10
LG_K = 12           # sketches of 4096 registers: a standard error of 1.6 %
NEAR = 0.25         # estimates within this share of the threshold are counted exactly: over 15 standard errors


def keys(line: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2")]


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, site, at, h1, h2) of (id, text, site): every line that is not blank, without the white space around it. ``at`` counts all lines."""
    each = docs.select("id", "site", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line", trimmed(F.col("line"))).filter("line <> ''")
    return each.select("id", "site", "at", *keys(F.col("line")))


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\x0c\r"))


def spread(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(h1, h2, first, n_sites) of the lines on ``sites`` or more sites; ``first`` is the smallest id. n_sites is exact near the threshold and
    an estimate above it. A null site is no site."""
    known = lines.filter("site is not null and id is not null")
    sketched = written(known.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("guess"), F.min("id").alias("first"))
                       .filter(F.col("guess") >= sites * (1 - NEAR)), "spread")
    near = sketched.filter(F.col("guess") <= sites * (1 + NEAR))
    exact = known.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_sites"))
    sure = sketched.filter(F.col("guess") > sites * (1 + NEAR)).withColumnRenamed("guess", "n_sites")
    return near.join(exact, ["h1", "h2"]).filter(F.col("n_sites") >= sites).select("h1", "h2", "first", "n_sites").unionByName(sure.select("h1", "h2", "first", "n_sites"))


def removals(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(id, text_hash, gone): for each text of (id, text, site) that loses lines, which; bounded by the text."""
    common = written(spread(lines_of(docs), sites), "common")
    texts = docs.withColumn("id", F.struct("id", F.xxhash64("text").alias("text_hash")))
    hit = lines_of(texts).join(common, ["h1", "h2"]).filter("id.id <> first")
    return hit.groupBy("id").agg(F.array_sort(F.collect_set("at")).alias("gone")).select("id.id", "id.text_hash", "gone")


def without(text: Column, gone: Column) -> Column:
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(gone, s["i"]))
    return F.when(gone.isNull(), text).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))


def cleaned(docs: DataFrame, sites: int = SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", counts: bool = True) -> DataFrame:
    """``docs``, all rows and columns, with boilerplate lines out of ``text_col``, and with ``counts`` two more: ``__lines`` (lines that are not
    blank) and ``__gone`` (how many of them went), with longer names where ``docs`` has these.

    Null texts stay null; empty ones have no lines. Blank lines always stay. Rows without an id lose nothing and do not count as
    sites, nor do null sites. Rows that repeat an id are one document, each cleaned by itself. A text may end up empty; its row stays.
    Further columns may have any names.
    """
    plain = docs.select(own(docs, id_col).alias("id"), own(docs, text_col).cast("string").alias("text"), own(docs, site_col).cast("string").alias("site"))
    gone = removals(plain, sites).select("id", "text_hash", F.col("gone").alias("at"))
    # All columns travel as one, so that no name of theirs can meet one of ours.
    rows = docs.select(F.struct(*[own(docs, c).alias(c) for c in docs.columns]).alias("row"), own(docs, id_col).alias("id"), F.xxhash64(own(docs, text_col).cast("string")).alias("text_hash"))
    text = F.col("row").getField(text_col).cast("string")
    n_lines = F.size(F.filter(F.split(text, "\n"), lambda x: trimmed(x) != ""))
    more = [F.when(text.isNull(), 0).otherwise(n_lines).cast("bigint").alias(unused(docs, "__lines")), F.coalesce(F.size("at"), F.lit(0)).cast("bigint").alias(unused(docs, "__gone"))]
    each = [(without(text, F.col("at")) if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return rows.join(gone, ["id", "text_hash"], "left").select(*each, *(more if counts else []))
