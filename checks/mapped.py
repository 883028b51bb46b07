"""The given tables read as scenes, splats, drafts and actions. The SQL is plain enough for Spark and for the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomdiff.functions import geometry as g
from roomdiff.functions.stage import written
from roomdiff.operators import scene

N_STATES = 5
STANDARD = 2

# A thing is a user's events of one type in one four-hour slot of the day; a state is six days. Every third thing moves.
THING = """(user_id * 5 + CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END) * 6
  + CAST(floor(hour(ts) / 4) AS BIGINT)"""
WORN = f"""
seen AS (SELECT DISTINCT CAST(user_id % 25 AS STRING) AS set_id, {THING} AS thing, CAST(floor((day(ts) - 1) / 6) AS INTEGER) AS state FROM events),
worn AS (SELECT set_id, thing, state, CASE WHEN thing % 3 = 2 THEN thing * 8 + state ELSE thing * 8 END AS id,
  ((thing * 37) % 400 + CASE WHEN thing % 3 = 2 THEN (thing % 5) * 10 * state ELSE 0 END) / 100.0 AS x, ((thing * 53) % 600) / 100.0 AS z FROM seen)"""

SPLATS = """splats AS (SELECT CAST(l_suppkey % 4 AS STRING) AS set_id, CAST(floor((year(l_shipdate) - 1995) / 2) AS INTEGER) AS state,
  ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS splat_id,
  CAST(l_partkey % 24 + 0.125 * l_linenumber AS DOUBLE) AS x, CAST(floor(l_partkey / 24) + 0.5 AS DOUBLE) AS y,
  CAST((l_quantity - 1) / 10 AS DOUBLE) AS z, CAST(l_discount * 10 AS DOUBLE) AS opacity FROM lineitem)"""

# A draft per user: each of their events puts one object down. Three users in four have saved it, some moved on since.
PUT = f"""put AS (SELECT CAST(user_id % 25 AS STRING) AS set_id, user_id AS draft, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id END AS id,
  CAST(user_id % 5 AS INTEGER) AS base, event_id AS nth, ({THING}) * 8 + CASE WHEN ({THING}) % 3 = 2 THEN CAST(floor((day(ts) - 1) / 6) AS INTEGER) ELSE 0 END AS object,
  CAST(value / 10 AS DOUBLE) AS x, CAST((event_id % 60) / 10.0 AS DOUBLE) AS z FROM events)"""

_memo: dict = {}


def _once(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _memo:
        _memo[key] = written(make(), name)
    return _memo[key]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql(spark: SparkSession, sf: str, ctes: str, body: str, source: str = "events") -> DataFrame:
    table(spark, sf, source).createOrReplaceTempView(source)
    return spark.sql(f"WITH {ctes} {body}")


# ---- scenes --------------------------------------------------------------------------------------------------------

def objects(spark: SparkSession, sf: str) -> DataFrame:
    def make():
        rows = sql(spark, sf, WORN, "SELECT * FROM worn").groupBy("set_id", "thing", "id", "x", "z").agg(F.sort_array(F.collect_list("state")).alias("present"))
        w = Window.partitionBy("set_id", "thing").orderBy("id")
        at = lambda c, d: F.col(c) + d
        return rows.select(
            "set_id", "id", F.concat(F.lit("Thing "), F.col("thing").cast("string")).alias("name"), F.array_min("present").alias("added_in"), "present",
            F.lag("id").over(w).alias("moved_from"), F.lead("id").over(w).alias("moved_to"),
            g.box([at("x", -0.2), F.lit(0.0), at("z", -0.2)], [at("x", 0.2), F.lit(1.0), at("z", 0.2)]).alias("bbox"),
            F.when(F.col("thing") % 2 == 0, F.concat(F.lit("note "), F.col("thing").cast("string"))).alias("doc"), F.lit("ops").alias("by"))
    return _once(spark, sf, "objects", make)


def roots(spark, sf):
    return _once(spark, sf, "roots", lambda: scene.roots(objects(spark, sf)))


def chain(spark, sf):
    return _once(spark, sf, "chain", lambda: scene.chains(objects(spark, sf), roots(spark, sf)))


def positions(spark, sf):
    return _once(spark, sf, "positions", lambda: scene.positions(objects(spark, sf), chain(spark, sf)))


def names(spark, sf):
    return scene.thing_names(objects(spark, sf))


def states(spark, sf) -> DataFrame:
    """Every state of every set, dated by its first event; the first state of each set is undated, the last is today's."""
    def make():
        rows = sql(spark, sf, "s AS (SELECT CAST(user_id % 25 AS STRING) AS set_id, CAST(floor((day(ts) - 1) / 6) AS INTEGER) AS state, min(CAST(ts AS DATE)) AS d, count(*) AS n FROM events GROUP BY 1, 2)",
                   "SELECT set_id, state, CASE WHEN state = 0 THEN 'soon' ELSE CAST(d AS STRING) END AS captured, n FROM s")
        return rows.withColumn("stats", F.create_map(F.lit("output"), F.col("n").cast("string"))).withColumn("doc", F.when(F.col("state") % 2 == 0, "entry").otherwise("")).withColumn("by", F.lit("ops"))
    return _once(spark, sf, "states", make)


def heads(spark, sf) -> DataFrame:
    return states(spark, sf).select("set_id", F.col("state").alias("head"), F.lit(STANDARD).alias("standard"))


def sizes(spark, sf) -> DataFrame:
    return states(spark, sf).groupBy("set_id").agg((F.max("state") + 1).cast("int").alias("n_states"))


def pairs(spark, sf) -> DataFrame:
    return scene.default_pair(heads(spark, sf)).select("set_id", "a", "b").distinct()


# ---- drafts and actions --------------------------------------------------------------------------------------------

def drafts(spark, sf) -> DataFrame:
    def make():
        rows = sql(spark, sf, PUT, "SELECT * FROM put").groupBy("set_id", "draft", "id", "base").agg(
            F.sort_array(F.collect_list(F.struct("nth", "object", "x", "z"))).alias("p"))
        return rows.select("set_id", "draft", "id", "base", F.transform("p", lambda p: F.struct(p["object"].alias("id"), p["x"].alias("x"), p["z"].alias("z"))).alias("placements"),
                           F.array().cast("array<struct<n:int,text:string>>").alias("attempts"))
    return _once(spark, sf, "drafts", make)


def branches(spark, sf) -> DataFrame:
    shift = F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.0)
    return drafts(spark, sf).filter("id is not null").select(
        "set_id", "id", F.concat(F.lit("Draft "), F.col("id").cast("string")).alias("name"), (F.col("base") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("base"),
        F.transform("placements", lambda p: F.struct(p["id"].alias("id"), (p["x"] + shift).alias("x"), p["z"].alias("z"))).alias("placements"),
        F.array().cast("array<string>").alias("attempts"), F.lit(0).cast("bigint").alias("saved_at"))


def stores(spark, sf) -> DataFrame:
    return drafts(spark, sf).groupBy("set_id").agg(F.max(F.coalesce("id", F.lit(0))).alias("seq"))


def micros(c="ts"):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def actions(spark, sf) -> DataFrame:
    """The event log, with time run 100 000 times faster so that a user's events come about half a second apart."""
    rows = table(spark, sf, "events")
    return rows.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("id"), F.timestamp_micros(F.expr("0L") + F.floor(micros() / 100000)).alias("ts"),
                       F.col("event_type").alias("verb"), F.col("props").alias("detail"), "value")


def gestures(spark, sf) -> DataFrame:
    """An event as a camera gesture: clicks shift the view, views and signups zoom, the rest swing round the target."""
    a = actions(spark, sf)
    x, kind = F.col("value") / 10.0 + 1.0, F.col("verb")
    d = F.when(kind == "click", F.col("value") / 50.0).otherwise(0.0)
    grow = F.when(kind.isin("view", "signup"), 1.0 + F.col("value") / 100.0).otherwise(1.0)
    swing = kind.isin("error", "purchase")
    held = (F.col("id") % 10) * 60
    return a.select("session", F.col("ts").alias("t0"), F.timestamp_micros(F.unix_micros("ts") + held * 1000).alias("t1"), "id",
                    F.array(x, F.lit(1.6), F.lit(2.0)).alias("pos0"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("target0"),
                    F.array(F.when(swing, F.lit(2.0)).otherwise(x * grow + d), F.lit(1.6) * grow, F.when(swing, -x).otherwise(F.lit(2.0) * grow)).alias("pos1"),
                    F.array(d, F.lit(0.0), F.lit(0.0)).alias("target1"))


# ---- splats --------------------------------------------------------------------------------------------------------

def splats(spark, sf) -> DataFrame:
    return _once(spark, sf, "splats", lambda: sql(spark, sf, SPLATS, "SELECT * FROM splats", "lineitem"))


def splat_grids(spark, sf) -> DataFrame:
    return _once(spark, sf, "grids", lambda: splats(spark, sf).groupBy("set_id").agg(F.max("y").alias("y")).select(
        "set_id", F.lit(1.0).alias("voxel"), F.array(*[F.lit(0.0)] * 3).alias("origin"), F.array(F.lit(25), F.ceil("y").cast("int"), F.lit(5)).alias("shape"),
        g.identity().alias("canon"), F.lit(1.0).alias("calibration_m"), F.lit(1.0).alias("span"), F.lit(100.0).alias("ceiling_vox"),
        F.array(F.lit(0.0), F.lit(0.0)).alias("room_lo"), F.array(F.lit(25.0), F.col("y")).alias("room_hi")))


def splat_sizes(spark, sf) -> DataFrame:
    return _once(spark, sf, "sizes", lambda: splats(spark, sf).groupBy("set_id").agg((F.max("state") + 1).cast("int").alias("n_states")))
