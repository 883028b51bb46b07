"""Set configurations: one JSON document per set with its captures, tuning and curation, checked and spread into tables."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomdiff.functions import variant as vr
from roomdiff.operators.tracker import DiffParams
from roomdiff.sources.manifests import PAIR, _at


@dataclass(frozen=True)
class RegisterParams:
    up: str = "auto"                    # auto: the floor is the denser end; keep / flip: as found / turned over
    min_inlier_frac: float = 0.4
    min_candidate_margin: float = 0.05


@dataclass(frozen=True)
class BakeParams:
    prune_opacity: float = 0.05
    sh: int = 0


TUNING = {"registration": RegisterParams, "diff": DiffParams, "bake": BakeParams}
DOORS = ("-z", "+z", "-x", "+x")
NAME_FIELDS = ("name", "kind", "sub", "doc", "by")


@dataclass
class Configs:
    sets: DataFrame          # set_id, calibration_m, standard, door, n_states
    states: DataFrame        # set_id, state, file, message, captured, doc, by, stats
    params: dict[str, DataFrame]
    names: DataFrame         # set_id, id, name, kind, sub, doc, by
    exclude: DataFrame       # set_id, id
    removed: DataFrame       # set_id, id, state
    diff_entries: DataFrame
    sites: DataFrame
    hand_boxes: DataFrame    # set_id, id, lo, hi
    violations: DataFrame


def _cast(v: Column, path: str, kind: str) -> Column:
    got = vr.part(v, path)
    if kind == "str":
        return F.try_variant_get(v, path, "string")
    words = vr.text(v, path)
    if kind == "int":
        return F.coalesce(vr.number(v, path).cast("int"), F.when(words.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(words).try_cast("int")), F.when(vr.is_kind(got, "BOOLEAN"), F.try_variant_get(v, path, "int")))
    return F.coalesce(vr.number(v, path), F.trim(words).try_cast("double"), F.when(vr.is_kind(got, "BOOLEAN"), F.try_variant_get(v, path, "double")))


def _text_or_null(v: Column, path: str) -> Column:
    return F.when(~vr.is_null(vr.part(v, path)), F.try_variant_get(v, path, "string"))


def parse(raw: DataFrame, known_files: DataFrame | None = None) -> Configs:
    """``raw(set_id, json)``; ``known_files(set_id, file)`` lists the captures that exist, when that is to be checked."""
    v = F.col("v")
    docs = raw.select("set_id", F.try_parse_json("json").alias("v"))
    commits = vr.items(v, "$.commits")
    n_states = F.coalesce(F.size(commits), F.lit(0))
    metres = _cast(v, "$.calibration_m", "float")
    up = F.coalesce(_cast(v, "$.registration.up", "str"), F.lit("auto"))
    standard, door = vr.part(v, "$.standard"), vr.part(v, "$.door")
    whole = lambda e: vr.is_number(e) & (vr.number(e) == F.floor(vr.number(e))) & (vr.number(e) >= 0)
    exclude, removed = vr.part(v, "$.exclude"), vr.part(v, "$.removed")
    rules = [
        vr.rule(v.isNull() | ~vr.is_kind(v, "OBJECT"), "", "invalid JSON"),
        *[vr.rule(v.isNotNull() & vr.part(v, f"$.{k}").isNull(), k, "missing required key") for k in ("calibration_m", "commits")],
        vr.rule(vr.part(v, "$.calibration_m").isNotNull() & metres.isNull(), "calibration_m", "must be a number"),
        vr.rule(metres <= 0, "calibration_m", "must be positive"),
        vr.rule(vr.part(v, "$.commits").isNotNull() & (n_states < 1), "commits", "must be a non-empty list"),
        vr.rule(~up.isin("auto", "flip", "keep"), "registration.up", "must be 'auto', 'flip' or 'keep'"),
        vr.rule(~vr.is_null(door) & ~F.coalesce(vr.text(v, "$.door").isin(*DOORS), F.lit(False)), "door", "must be one of -z, +z, -x, +x"),
        vr.rule(~vr.is_null(standard) & ~F.coalesce(whole(standard) & (vr.number(standard) < n_states), F.lit(False)), "standard", "must be a commit index"),
        vr.rule(~vr.is_null(exclude) & ~F.coalesce(F.forall(vr.items(v, "$.exclude"), whole), F.lit(False)), "exclude", "must be a list of object ids"),
        vr.rule(~vr.is_null(removed) & ~F.coalesce(F.forall(F.map_entries(vr.fields(v, "$.removed")), lambda e: e["key"].rlike(r"^\d+$") & whole(e["value"])), F.lit(False)),
                "removed", "must map object ids to commit indices"),
    ]
    params = {}
    for section, cls in TUNING.items():
        fields = dataclasses.fields(cls)
        block = vr.part(v, f"$.{section}")
        unknown = F.array_sort(F.array_except(F.map_keys(vr.fields(v, f"$.{section}")), F.array(*[F.lit(f.name) for f in fields])))
        rules += [vr.rule(~vr.is_null(block) & ~vr.is_kind(block, "OBJECT"), section, "must be an object"),
                  vr.rule(F.size(unknown) > 0, section, F.concat(F.lit("unknown key(s): "), F.array_join(unknown, ", ")))]
        cols = []
        for f in fields:
            got, kind = _cast(v, f"$.{section}.{f.name}", f.type), f.type
            rules.append(vr.rule(vr.part(v, f"$.{section}.{f.name}").isNotNull() & got.isNull(), f"{section}.{f.name}", f"must be {kind}"))
            cols.append(F.coalesce(got, F.lit(f.default)).alias(f.name))
        params[section] = docs.select("set_id", *cols)
    violations = vr.broken_rules(docs, rules)

    c, i = F.col("c"), F.col("i")
    listed = docs.select("set_id", F.posexplode(commits).alias("i", "c"))
    stats = vr.part(c, "$.stats")
    named = F.forall(F.map_values(vr.fields(c, "$.stats")), lambda e: vr.is_kind(e, "STRING"))
    violations = violations.unionByName(vr.broken_rules(listed, [
        *[vr.rule(vr.part(c, f"$.{k}").isNull(), _at("commits", i), f"is missing '{k}'") for k in ("file", "message", "captured")],
        vr.rule(~vr.is_null(stats) & ~F.coalesce(named, F.lit(False)), _at("commits", i, ".stats"), "must map names to strings")]))
    states = listed.select("set_id", i.cast("int").alias("state"), *[F.try_variant_get(c, f"$.{k}", "string").alias(k) for k in ("file", "message", "captured")],
                           _text_or_null(c, "$.doc").alias("doc"), _text_or_null(c, "$.by").alias("by"), F.try_variant_get(c, "$.stats", "map<string,string>").alias("stats"))
    if known_files is not None:
        lost = states.join(known_files.select("set_id", "file"), ["set_id", "file"], "left_anti")
        violations = violations.unionByName(lost.select("set_id", _at("commits", F.col("state")).alias("path"), F.concat(F.lit("capture not found: "), F.col("file")).alias("message")))

    key, e = F.col("key"), F.col("e")
    objects = docs.select("set_id", F.explode(vr.fields(v, "$.objects")).alias("key", "e"))
    where = F.concat(F.lit("objects["), key, F.lit("]"))
    is_text, is_obj = vr.is_kind(e, "STRING"), vr.is_kind(e, "OBJECT")
    violations = violations.unionByName(vr.broken_rules(objects, [
        vr.rule(~key.rlike(r"^\d+$"), where, "keys must be object ids"),
        vr.rule(~is_text & ~(is_obj & vr.part(e, "$.name").isNotNull()), where, "must be a name or an object with a name"),
        vr.rule(is_obj & ~vr.is_null(vr.part(e, "$.kind")) & ~F.coalesce(vr.text(e, "$.kind").isin("plant", "thing"), F.lit(False)), where, "kind must be 'plant' or 'thing'")]))
    ids = objects.filter(key.rlike(r"^\d+$"))
    names = ids.select("set_id", key.cast("bigint").alias("id"), F.coalesce(vr.text(e), F.try_variant_get(e, "$.name", "string")).alias("name"),
                       *[F.when(is_obj, _text_or_null(e, f"$.{f}")).alias(f) for f in NAME_FIELDS[1:]])
    lo, hi = vr.numbers(e, "$.box[0]", 3), vr.numbers(e, "$.box[1]", 3)
    boxed = ids.filter(vr.part(e, "$.box").isNotNull())
    violations = violations.unionByName(vr.broken_rules(boxed, [
        vr.rule(lo.isNull() | hi.isNull() | (F.size(vr.items(e, "$.box")) != 2), F.concat(where, F.lit(".box")), "must be [[x, y, z], [x, y, z]]"),
        vr.rule(F.exists(F.zip_with(lo, hi, lambda a, b: b <= a), lambda flat: flat), F.concat(where, F.lit(".box")), "must have lo < hi on every axis")]))
    hand_boxes = boxed.select("set_id", key.cast("bigint").alias("id"), lo.alias("lo"), hi.alias("hi")).filter("lo is not null and hi is not null")

    pairs = docs.select("set_id", n_states.alias("n_states"), F.explode(vr.fields(v, "$.diffs")).alias("key", "e"))
    a, b = (F.try_element_at(F.split("key", "-"), F.lit(n)).try_cast("int") for n in (1, 2))
    fits = F.coalesce(key.rlike(PAIR) & (a < b) & (b < F.col("n_states")), F.lit(False))
    violations = violations.unionByName(vr.broken_rules(pairs, [
        vr.rule(~fits, F.concat(F.lit("diffs."), key), "keys must be 'a-b' with a < b within the commits"), vr.rule(~is_obj, F.concat(F.lit("diffs."), key), "must be an object with doc and by")]))
    entries = pairs.filter(fits).select("set_id", a.alias("a"), b.alias("b"), _text_or_null(e, "$.doc").alias("doc"), _text_or_null(e, "$.by").alias("by"))
    sites = docs.select("set_id", F.posexplode(vr.items(v, "$.sites")).alias("at", "e"))
    violations = violations.unionByName(vr.broken_rules(sites, [
        vr.rule(vr.part(e, "$.id").isNull() | vr.part(e, "$.name").isNull(), _at("sites", F.col("at")), "must have id and name")]))
    sites = sites.select("set_id", "at", *[F.try_variant_get(e, f"$.{f}", "string").alias(f) for f in ("id", "name", "set")], vr.number(e, "$.count", "int").alias("count"))
    sets = docs.select("set_id", metres.alias("calibration_m"), vr.number(v, "$.standard", "int").alias("standard"), vr.text(v, "$.door").alias("door"), n_states.alias("n_states"))
    out = docs.select("set_id", F.explode(vr.items(v, "$.exclude")).alias("e")).select("set_id", vr.number(e, "$", "bigint").alias("id")).distinct()
    gone = docs.select("set_id", F.explode(vr.fields(v, "$.removed")).alias("key", "e")).select("set_id", key.try_cast("bigint").alias("id"), vr.number(e, "$", "int").alias("state"))
    return Configs(sets, states, params, names, out, gone, entries, sites, hand_boxes, violations)


def hand_box_gaps(hand_boxes: DataFrame) -> DataFrame:
    """Violations of sets whose hand-drawn objects are not numbered 0 … n−1."""
    per = hand_boxes.groupBy("set_id").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    return per.filter("top <> n - 1").select("set_id", F.lit("objects").alias("path"), F.concat(F.lit("must be numbered 0…"), (F.col("n") - 1).cast("string")).alias("message"))


def refuse(violations: DataFrame, show: int = 20) -> None:
    """Fails with the first few violations when there are any."""
    rows = violations.limit(show).collect()
    if rows:
        raise ValueError("; ".join(f"{r.set_id}: {r.path} {r.message}" for r in rows))


def as_tuning(section: DataFrame) -> DataFrame:
    """A section of ``params`` as (set_id, params MAP<STRING, DOUBLE>), the form in which jobs take values per set; text values are left out."""
    numbers = [f.name for f in section.schema if f.name != "set_id" and f.dataType.typeName() != "string"]
    return section.select("set_id", F.create_map(*[x for n in numbers for x in (F.lit(n), F.col(n).cast("double"))]).alias("params"))
