"""Published manifests: one JSON document per set, checked rule by rule and spread into tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomdiff.functions import geometry as g
from roomdiff.functions import scalar as s
from roomdiff.functions import variant as vr

PAIR = r"^\d+-\d+$"


@dataclass
class Scenes:
    states: DataFrame
    objects: DataFrame
    sets: DataFrame
    diff_entries: DataFrame
    sites: DataFrame
    violations: DataFrame


def read_documents(spark: SparkSession, path: str, level: int = 2) -> DataFrame:
    """(set_id, json) of whole files; the set is the directory ``level - 1`` above the file."""
    rows = spark.read.text(path, wholetext=True).select(F.split(F.input_file_name(), "/").alias("p"), F.col("value").alias("json"))
    return rows.select(F.element_at("p", -level).alias("set_id"), "json")


def _filled(v, path):
    return s.blank_to_null(vr.text(v, path))


def _at(name, index, field=""):
    return F.concat(F.lit(f"{name}["), index.cast("string"), F.lit(f"]{field}"))


def parse(raw: DataFrame) -> Scenes:
    """``raw(set_id, json)`` -> tables and ``violations(set_id, path, message)``. Lenient fields take their defaults; a set with a violation
    should not be used."""
    v = F.col("v")
    docs = raw.select("set_id", F.try_parse_json("json").alias("v"))
    top = docs.select("set_id", "v", vr.items(v, "$.commits").alias("commits"), vr.items(v, "$.objects").alias("found"), vr.numbers(v, "$.shape", 3).alias("shape"),
                      vr.items(v, "$.world_from_ref").alias("rows"), vr.number(v, "$.voxel").alias("voxel"), vr.numbers(v, "$.origin", 3).alias("origin"),
                      vr.numbers(v, "$.room[0]", 3).alias("room_lo"), vr.numbers(v, "$.room[1]", 3).alias("room_hi"))
    n_states = F.coalesce(F.size("commits"), F.lit(0))
    row_ok = lambda r: F.coalesce(F.size(F.slice(vr.numbers(r), 1, 4)) == 4, F.lit(False))
    room, view = vr.part(v, "$.room"), vr.part(v, "$.view")
    violations = vr.broken_rules(top, [
        vr.rule(~vr.is_kind(v, "OBJECT"), "", "is not an object"),
        vr.rule(n_states < 1, "commits", "must be a non-empty array"),
        vr.rule(F.col("found").isNull(), "objects", "must be an array"),
        vr.rule(F.col("shape").isNull() | F.exists("shape", lambda e: (e < 1) | (e != F.floor(e))), "shape", "must be positive integers"),
        vr.rule(F.col("rows").isNull() | (F.size("rows") < 3), "world_from_ref", "must be a 3×4 or 4×4 matrix"),
        vr.rule(~F.forall(F.slice("rows", 1, 3), row_ok), "world_from_ref", "rows must have 4 entries"),
        vr.rule(F.col("voxel").isNull() | (F.col("voxel") <= 0), "voxel", "must be positive"),
        vr.rule(F.col("origin").isNull(), "origin", "must have 3 entries"),
        vr.rule(~vr.is_null(room) & (F.col("room_lo").isNull() | F.col("room_hi").isNull() | (F.size(vr.items(v, "$.room")) != 2)), "room", "must be [lo, hi]"),
        vr.rule(~vr.is_null(view) & (vr.numbers(v, "$.view.pos", 3).isNull() | vr.numbers(v, "$.view.target", 3).isNull()), "view", "must be {pos, target}")])

    c, i = F.col("c"), F.col("i")
    commits = top.select("set_id", F.posexplode("commits").alias("i", "c"))
    violations = violations.unionByName(vr.broken_rules(commits, [
        vr.rule(~vr.is_kind(c, "OBJECT"), _at("commits", i), "must be an object"),
        vr.rule(vr.is_kind(c, "OBJECT") & ~vr.number(c, "$.index").eqNullSafe(i.cast("double")), _at("commits", i, ".index"), F.concat(F.lit("must equal "), i.cast("string"))),
        *[vr.rule(vr.is_kind(c, "OBJECT") & _filled(c, f"$.{f}").isNull(), _at("commits", i, f".{f}"), "must be a non-empty string") for f in ("id", "hash", "file", "labels")],
        vr.rule(F.contains(vr.text(c, "$.file"), F.lit("..")) | F.contains(vr.text(c, "$.labels"), F.lit("..")), _at("commits", i), "paths must stay inside the set")]))
    figure = lambda key: F.coalesce(vr.text(c, f"$.stats.{key}"), F.when(vr.is_number(vr.part(c, f"$.stats.{key}")), F.try_variant_get(c, f"$.stats.{key}", "string")), F.lit("—"))
    stats = F.when(vr.is_kind(vr.part(c, "$.stats"), "OBJECT"), F.create_map(*[x for k in ("stoppages", "changeover", "output") for x in (F.lit(k), figure(k))]))
    states = commits.select("set_id", i.cast("int").alias("state"), vr.text(c, "$.id").alias("id"), vr.text(c, "$.hash").alias("hash"),
                            F.coalesce(vr.text(c, "$.message"), F.lit("")).alias("message"), F.coalesce(vr.text(c, "$.captured"), F.lit("")).alias("captured"),
                            vr.text(c, "$.file").alias("file"), vr.text(c, "$.labels").alias("labels"), F.coalesce(vr.number(c, "$.splats", "bigint"), F.lit(0)).alias("splats"),
                            _filled(c, "$.doc").alias("doc"), _filled(c, "$.by").alias("by"), stats.alias("stats"))

    o = F.col("o")
    found = top.select("set_id", n_states.alias("n_states"), F.size("found").alias("n_objects"), F.posexplode("found").alias("i", "o"))
    link = lambda f: vr.rule(~vr.is_null(vr.part(o, f"$.{f}")) & ~F.coalesce(vr.number(o, f"$.{f}").between(0, F.col("n_objects") - 1), F.lit(False)),
                             _at("objects", i, f".{f}"), "references a missing object")
    lo, hi = vr.numbers(o, "$.bbox[0]", 3), vr.numbers(o, "$.bbox[1]", 3)
    present = vr.numbers(o, "$.present")
    violations = violations.unionByName(vr.broken_rules(found, [
        vr.rule(~vr.is_kind(o, "OBJECT"), _at("objects", i), "must be an object"),
        vr.rule(~vr.number(o, "$.id").eqNullSafe(i.cast("double")), _at("objects", i, ".id"), F.concat(F.lit("must equal "), i.cast("string"))),
        vr.rule(present.isNull(), _at("objects", i, ".present"), "must be a number array"),
        vr.rule(F.exists(present, lambda e: (e < 0) | (e >= F.col("n_states"))), _at("objects", i, ".present"), "references a missing commit"),
        vr.rule(vr.number(o, "$.added_in").isNull(), _at("objects", i, ".added_in"), "must be a finite number"),
        vr.rule(~vr.is_kind(vr.part(o, "$.removed_in"), "VOID") & vr.number(o, "$.removed_in").isNull(), _at("objects", i, ".removed_in"), "must be a finite number"),
        link("moved_from"), link("moved_to"),
        vr.rule(lo.isNull() | hi.isNull() | (F.size(vr.items(o, "$.bbox")) != 2), _at("objects", i, ".bbox"), "must be [lo, hi]")]))
    objects = found.select(
        "set_id", i.cast("bigint").alias("id"), vr.number(o, "$.source_id", "bigint").alias("source_id"),
        F.coalesce(_filled(o, "$.name"), F.concat(F.lit("object "), i.cast("string"))).alias("name"), vr.text(o, "$.kind").alias("kind"), vr.text(o, "$.sub").alias("sub"),
        _filled(o, "$.doc").alias("doc"), _filled(o, "$.by").alias("by"), vr.number(o, "$.added_in", "int").alias("added_in"), vr.number(o, "$.removed_in", "int").alias("removed_in"),
        present.cast("array<int>").alias("present"), F.coalesce(vr.number(o, "$.voxels", "bigint"), F.lit(0)).alias("voxels"),
        F.coalesce(vr.number(o, "$.volume_vox_m3"), F.lit(0.0)).alias("volume_vox_m3"), vr.number(o, "$.moved_from", "bigint").alias("moved_from"),
        vr.number(o, "$.moved_to", "bigint").alias("moved_to"), F.struct(lo.alias("lo"), hi.alias("hi")).alias("bbox"))

    standard = vr.number(v, "$.standard")
    matrix = F.concat(F.transform(F.slice("rows", 1, 3), lambda r: F.slice(vr.numbers(r), 1, 4)), F.array(F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])))
    sets = top.select(
        "set_id", n_states.alias("n_states"), "voxel", "origin", F.col("shape").cast("array<int>").alias("shape"), matrix.alias("world_from_ref"),
        F.when(F.col("room_lo").isNotNull() & F.col("room_hi").isNotNull(), F.struct(F.col("room_lo").alias("lo"), F.col("room_hi").alias("hi"))).alias("room"),
        F.coalesce(vr.number(v, "$.calibration_m"), F.lit(1.0)).alias("calibration_m"), vr.text(v, "$.door").alias("door"),
        F.when((standard == F.floor(standard)) & (standard >= 0) & (standard < n_states), standard.cast("int")).alias("standard"),
        F.when(~vr.is_null(view), F.struct(vr.numbers(v, "$.view.pos", 3).alias("pos"), vr.numbers(v, "$.view.target", 3).alias("target"))).alias("view"))

    key, e = F.col("key"), F.col("e")
    pairs = top.select("set_id", n_states.alias("n_states"), F.explode(vr.fields(v, "$.diffs")).alias("key", "e"))
    a, b = (F.try_element_at(F.split("key", "-"), F.lit(n)).try_cast("int") for n in (1, 2))
    fits = F.coalesce(key.rlike(PAIR) & (a < b) & (b < F.col("n_states")), F.lit(False))
    where = F.concat(F.lit("diffs."), key)
    violations = violations.unionByName(vr.broken_rules(pairs, [
        vr.rule(~fits, where, "must be keyed a-b within the commits"), vr.rule(~vr.is_kind(e, "OBJECT"), where, "must be an object")]))
    diff_entries = pairs.filter(fits).select("set_id", a.alias("a"), b.alias("b"), _filled(e, "$.doc").alias("doc"), _filled(e, "$.by").alias("by"))

    listed = top.select("set_id", F.posexplode(vr.items(v, "$.sites")).alias("i", "e"))
    name = _filled(e, "$.set")
    violations = violations.unionByName(vr.broken_rules(listed, [
        vr.rule(~vr.is_kind(e, "OBJECT"), _at("sites", i), "must be an object"),
        *[vr.rule(_filled(e, f"$.{f}").isNull(), _at("sites", i, f".{f}"), "must be a non-empty string") for f in ("id", "name")],
        vr.rule(F.contains(name, F.lit("..")) | F.contains(name, F.lit("/")), _at("sites", i, ".set"), "must name a set, not a path")]))
    sites = listed.select("set_id", i.alias("at"), vr.text(e, "$.id").alias("id"), vr.text(e, "$.name").alias("name"), F.coalesce(vr.number(e, "$.count", "int"), F.lit(0)).alias("count"), name.alias("set"))
    return Scenes(states, objects, sets, diff_entries, sites, violations)


def link_warnings(objects: DataFrame) -> DataFrame:
    """Links only one end knows of. The rules allow them, but such an object can be missing from every chain."""
    ahead = objects.select("set_id", F.col("id").alias("a"), F.col("moved_to").alias("b")).filter("b is not null")
    back = objects.select("set_id", F.col("moved_from").alias("a"), F.col("id").alias("b")).filter("a is not null")
    both = ahead.withColumn("f", F.lit(1)).join(back.withColumn("t", F.lit(1)), ["set_id", "a", "b"], "full_outer").filter("f is null or t is null")
    return both.select("set_id", F.concat(F.lit("objects["), F.col("a").cast("string"), F.lit("]")).alias("path"),
                       F.concat(F.lit("is linked one way with object "), F.col("b").cast("string")).alias("message"))


def room_boxes(sets: DataFrame) -> DataFrame:
    """(set_id, room): the room in world metres, or the voxel grid's extent where none was published."""
    far = F.transform(F.arrays_zip("origin", "shape"), lambda p: p["origin"] + p["shape"] * F.col("voxel"))
    grid = g.box_under(F.col("world_from_ref"), F.struct(F.col("origin").alias("lo"), far.alias("hi")), digits=None)
    return sets.select("set_id", F.coalesce("room", grid).alias("room"))
