"""Order statistics and histograms that stay distributed when one set holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomdiff.functions.stage import written

ACCURACY = 10_000


def percentiles(df: DataFrame, keys: list[str], asked: dict[str, list[float]], accuracy: int = ACCURACY) -> DataFrame:
    """Exact percentiles, linearly interpolated between ranks: (keys, col, p, value) for each p in 0..1 of each column.

    A mergeable sketch brackets every percentile first; the second pass counts what lies below a bracket and keeps only the
    distinct values inside it, a few ten-thousandths of the rows, for ranking. No task sees a whole group.
    """
    long = df.select(*keys, F.explode(F.create_map(*[x for c in asked for x in (F.lit(c), F.col(c).cast("double"))])).alias("col", "value")).filter("value is not null")
    wanted = sorted({p for ps in asked.values() for p in ps})
    slack = 2.0 / accuracy
    ends = [min(1.0, max(0.0, p + d)) for p in wanted for d in (-slack, slack)]
    sketch = long.groupBy(*keys, "col").agg(F.count("*").alias("total"), F.percentile_approx("value", ends, accuracy).alias("ends"),
                                            F.min("value").alias("least"), F.max("value").alias("most"))
    lists = F.create_map(*[x for c, ps in asked.items() for x in (F.lit(c), F.array(*[F.lit(float(p)) for p in ps]))])
    place = F.array_position(F.array(*[F.lit(p) for p in wanted]), F.col("p")).cast("int")
    # The sketch is off by at most total / accuracy ranks and two ranks are needed, so a bracket of twice that on both sides holds them
    # once it spans two ranks; smaller groups, and the ends of the range, are ranked from or to the true extremes.
    few = F.col("total") <= 2 * accuracy
    low = F.when(few | (F.col("p") <= slack), F.col("least")).otherwise(F.element_at("ends", place * 2 - 1))
    high = F.when(few | (F.col("p") >= 1 - slack), F.col("most")).otherwise(F.element_at("ends", place * 2))
    brackets = sketch.select("*", F.explode(F.element_at(lists, F.col("col"))).alias("p"))
    brackets = written(brackets.select(*keys, "col", "p", "total", low.alias("low"), high.alias("high")), "brackets")
    value = F.when(F.col("value") >= F.col("low"), F.col("value"))
    counts = (long.join(brackets, [*keys, "col"]).filter(F.col("value") <= F.col("high"))
              .groupBy(*keys, "col", "p", "total", value.alias("value")).agg(F.count("*").alias("n")))
    upto = F.sum("n").over(Window.partitionBy(*keys, "col", "p").orderBy(F.asc_nulls_first("value")))
    at = F.col("p") * (F.col("total") - 1)
    ranked = counts.withColumn("upto", upto).groupBy(*keys, "col", "p", "total").agg(
        F.min(F.when(F.col("upto") > F.floor(at), F.col("value"))).alias("v0"), F.min(F.when(F.col("upto") > F.ceil(at), F.col("value"))).alias("v1"))
    return ranked.select(*keys, "col", "p", (F.col("v0") + (F.col("v1") - F.col("v0")) * (at - F.floor(at))).alias("value"))


def wide(long: DataFrame, keys: list[str], names: dict[tuple[str, float], str]) -> DataFrame:
    """One row per key with the named percentiles as columns."""
    pick = lambda c, p: F.max(F.when((F.col("col") == c) & (F.col("p") == F.lit(float(p))), F.col("value")))
    return long.groupBy(*keys).agg(*[pick(c, p).alias(name) for (c, p), name in names.items()])


def crop(df: DataFrame, keys: list[str], cols: list[str], lo: float, hi: float, expand: float) -> DataFrame:
    """Rows strictly inside the lo..hi percentile range of every column, widened by ``expand`` of it on both sides."""
    spans = wide(percentiles(df, keys, {c: [lo, hi] for c in cols}), keys, {(c, p): f"_{c}{n}" for c in cols for n, p in enumerate((lo, hi))})
    rows = df.join(written(spans, "spans"), keys)
    for c in cols:
        a, b = F.col(f"_{c}0"), F.col(f"_{c}1")
        pad = (b - a) * expand
        rows = rows.filter((F.col(c) > a - pad) & (F.col(c) < b + pad))
    return rows.select(*df.columns)


def top_bin(counts: DataFrame, keys: list[str], n: str, tie: list[Column]) -> DataFrame:
    """The row with the highest count per key; ``tie`` orders equal counts, first wins."""
    w = Window.partitionBy(*keys).orderBy(F.desc(n), *tie)
    return counts.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
