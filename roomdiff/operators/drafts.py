"""Layout drafts and the branches they are saved as.

``branches(set_id, id, name, base, placements, attempts, saved_at)`` is the saved table, ``stores(set_id, seq)`` the highest
number ever used per set, ``drafts`` the open ones with ``draft`` (a key), ``id`` (null until saved), ``base``, ``placements``
and ``attempts``. A placement is STRUCT<id, x, z>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomdiff.functions import scalar as s
from roomdiff.functions import variant as vr
from roomdiff.operators import scene

PLACEMENTS = "array<struct<id:bigint,x:double,z:double>>"
MAX_COPIES = 4      # of one object in a draft

def parse_stores(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``raw(set_id, json)`` -> (stores, branches). Junk gives an empty store; a bad placement or attempt is dropped on its own; a
    base that is no number becomes null; seq covers the ids it holds."""
    doc = raw.select("set_id", F.try_parse_json("json").alias("v"))
    fine = F.when(vr.kind(F.col("v")) == "OBJECT", F.col("v"))
    top = doc.select("set_id", fine.alias("v")).select("set_id", vr.number(F.col("v"), "$.seq").alias("seq"), vr.items(F.col("v"), "$.drafts").alias("list"))
    top = top.select("set_id", "seq", F.when(F.col("seq").isNotNull(), F.col("list")).alias("list"))
    d = F.col("d")
    rows = top.filter("list is not null").select("set_id", "seq", F.posexplode("list").alias("at", "d"))
    rows = rows.filter(vr.kind(d) == "OBJECT").select(
        "set_id", "seq", "at", vr.number(d, "$.id", "bigint").alias("id"), vr.text(d, "$.name").alias("name"),
        vr.number(d, "$.base", "int").alias("base"), vr.items(d, "$.placements").alias("put"), vr.items(d, "$.attempts").alias("tries"),
        F.coalesce(vr.number(d, "$.savedAt", "bigint"), F.lit(0)).cast("bigint").alias("saved_at"))
    rows = rows.filter("id is not null and name is not null and put is not null and tries is not null")
    place = lambda p: F.struct(vr.number(p, "$.id", "bigint").alias("id"), vr.number(p, "$.x").alias("x"), vr.number(p, "$.z").alias("z"))
    objects_only = F.filter("put", lambda p: vr.kind(p) == "OBJECT")
    whole = F.filter(F.transform(objects_only, place), lambda p: p["id"].isNotNull() & p["x"].isNotNull() & p["z"].isNotNull())
    texts = F.transform(F.filter("tries", lambda a: vr.kind(a) == "STRING"), lambda a: F.try_variant_get(a, "$", "string"))
    branches = rows.select("set_id", "id", "name", "base", whole.cast(PLACEMENTS).alias("placements"), texts.alias("attempts"), "saved_at", "at")
    highest = branches.groupBy("set_id").agg(F.max("id").alias("top"))
    stores = (top.join(highest, "set_id", "left")
              .select("set_id", F.when(F.col("list").isNull(), 0.0).otherwise(F.greatest("seq", F.coalesce("top", "seq"))).cast("bigint").alias("seq")))
    return stores, branches.drop("at")


def fit(branches: DataFrame, objects: DataFrame, sizes: DataFrame) -> DataFrame:
    """Branches saved against another build of the set: unknown ids dropped, a base past the last state becomes null."""
    put = branches.select("set_id", "id", F.posexplode("placements").alias("at", "p")).withColumn("object", F.col("p.id"))
    kept = put.join(objects.select("set_id", F.col("id").alias("object")), ["set_id", "object"], "left_semi")
    lists = kept.groupBy("set_id", "id").agg(F.sort_array(F.collect_list(F.struct("at", "p"))).alias("kept"))
    rows = branches.join(sizes.select("set_id", "n_states"), "set_id").join(lists, ["set_id", "id"], "left")
    fitted = F.coalesce(F.col("kept.p"), F.array().cast(PLACEMENTS))
    base = F.when(F.col("base") < F.col("n_states"), F.col("base"))
    changed = (F.size(fitted) != F.size("placements")) | ~base.eqNullSafe(F.col("base"))
    return rows.select("set_id", "id", "name", base.alias("base"), fitted.alias("placements"), "attempts", "saved_at", changed.alias("changed"))


def seeds(objects: DataFrame, bases: DataFrame) -> DataFrame:
    """``bases(set_id, base)`` -> placements of everything the base state holds, in id order; none for a null base."""
    at = scene.presence(objects).select("set_id", F.col("state").alias("base"), F.struct("id", "x", "z").alias("p"))
    wanted = bases.select("set_id", "base").distinct()
    got = wanted.join(at, ["set_id", "base"]).groupBy("set_id", "base").agg(F.sort_array(F.collect_list("p")).alias("seed"))
    return wanted.join(got, ["set_id", "base"], "left").withColumn("seed", F.coalesce("seed", F.array().cast(PLACEMENTS)).cast(PLACEMENTS))


def same_layout(a: Column, b: Column) -> Column:
    """The same things in the same places, in the same order."""
    return a.eqNullSafe(b)


def review(drafts: DataFrame, branches: DataFrame, stores: DataFrame, objects: DataFrame) -> DataFrame:
    """Per open draft: its name, whether it differs from its branch (from its seed when it has none), whether it can be saved."""
    saved = branches.select("set_id", "id", F.col("name").alias("b_name"), F.col("base").alias("b_base"),
                            F.col("placements").alias("b_put"), F.size("attempts").alias("b_tries"), F.lit(True).alias("has"))
    rows = (drafts.join(saved, ["set_id", "id"], "left").join(seeds(objects, drafts), ["set_id", "base"], "left")
            .join(stores, "set_id", "left"))
    has = F.col("has").eqNullSafe(True)
    ref_put = F.when(has, F.col("b_put")).otherwise(F.coalesce("seed", F.array().cast(PLACEMENTS)))
    ref_tries = F.when(has, F.col("b_tries")).otherwise(0)
    base_moved = has & ~F.col("base").eqNullSafe(F.col("b_base"))
    dirty = base_moved | (F.size("attempts") != ref_tries) | ~same_layout(F.col("placements").cast(PLACEMENTS), ref_put)
    name = F.when(has, F.col("b_name")).otherwise(F.concat(F.lit("Draft "), (F.coalesce("seq", F.lit(0)) + 1).cast("string")))
    return rows.select("set_id", "draft", "id", "base", name.alias("name"), dirty.alias("dirty"), (F.col("id").isNull() | dirty).alias("can_save"),
                       has.alias("saved"))


def proposal(drafts: DataFrame) -> DataFrame:
    """A draft as a branch keeps it: placement keys dropped, attempts as their text."""
    put = F.transform("placements", lambda p: F.struct(p["id"].cast("bigint").alias("id"), p["x"].alias("x"), p["z"].alias("z")))
    return drafts.select("set_id", "draft", "id", "base", put.alias("placements"), F.transform("attempts", lambda a: a["text"]).alias("attempts"))


def placed_by_object(drafts: DataFrame) -> DataFrame:
    put = drafts.select("set_id", "draft", F.explode("placements").alias("p")).select("set_id", "draft", F.col("p.id").alias("id"))
    return put.groupBy("set_id", "draft", "id").agg(F.count("*").alias("n"))


def placed_by_thing(drafts: DataFrame, objects: DataFrame, chain: DataFrame) -> DataFrame:
    """How many of each thing are down, whichever of its ids they carry; things with none are left out."""
    by_thing = placed_by_object(drafts).join(chain, ["set_id", "id"]).groupBy("set_id", "draft", "root").agg(F.sum("n").alias("n"))
    return by_thing.join(scene.thing_names(objects), ["set_id", "root"]).select("set_id", "draft", "root", "name", "n")


def save(branches: DataFrame, stores: DataFrame, drafts: DataFrame, reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(branches, stores) after saving every savable draft of ``drafts(…, at)``: one with a branch replaces it and keeps its name,
    one without takes the next numbers of its set in draft order."""
    ready = proposal(drafts).join(drafts.select("set_id", "draft", "at"), ["set_id", "draft"]).join(
        reviewed.filter("can_save").select("set_id", "draft", "name", "saved"), ["set_id", "draft"])
    w = Window.partitionBy("set_id").orderBy("draft")
    fresh = (ready.filter(~F.col("saved")).join(stores, "set_id", "left")
             .withColumn("id", (F.coalesce("seq", F.lit(0)) + F.row_number().over(w)).cast("bigint"))
             .withColumn("name", F.concat(F.lit("Draft "), F.col("id").cast("string"))))
    cols = ["set_id", "id", "name", "base", "placements", "attempts", F.col("at").alias("saved_at")]
    kept = ready.filter("saved").groupBy("set_id", "id").agg(F.max_by(F.struct("name", "base", "placements", "attempts", "at"), "at").alias("r")).select(
        "set_id", "id", "r.*")
    new = fresh.select(*cols).unionByName(kept.select(*cols))
    merged = branches.join(new.select("set_id", "id"), ["set_id", "id"], "left_anti").select(
        "set_id", "id", "name", "base", "placements", "attempts", "saved_at").unionByName(new)
    top = merged.groupBy("set_id").agg(F.max("id").alias("top"))
    after = stores.join(top, "set_id", "full_outer").select("set_id", F.greatest(F.coalesce("seq", F.lit(0)), F.coalesce("top", F.lit(0))).cast("bigint").alias("seq"))
    return merged, after


def open_branch(branches: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(set_id, draft, id)``: the branch as an open draft, placements keyed by position."""
    put = F.transform("placements", lambda p, i: F.struct((i + 1).cast("bigint").alias("key"), p["id"].alias("id"), p["x"].alias("x"), p["z"].alias("z")))
    tries = F.transform("attempts", lambda t, i: F.struct((i + 1).alias("n"), t.alias("text")))
    return asked.join(branches, ["set_id", "id"]).select("set_id", "draft", "id", "base", put.alias("placements"), tries.alias("attempts"))


def delete(branches: DataFrame, gone: DataFrame) -> DataFrame:
    """Branches without ``gone(set_id, id)``; the stores keep their seq, so a name is never reused."""
    return branches.join(gone.select("set_id", "id"), ["set_id", "id"], "left_anti")


def measure(drafts: DataFrame) -> DataFrame:
    """Appends "n placed" to the attempts of every draft with something down."""
    n = F.size("placements")
    note = F.struct((F.size("attempts") + 1).cast("int").alias("n"), F.concat(n.cast("string"), F.lit(" placed")).alias("text"))
    more = F.array_append(F.col("attempts").cast("array<struct<n:int,text:string>>"), note)
    return drafts.withColumn("attempts", F.when(n > 0, more).otherwise(F.col("attempts").cast("array<struct<n:int,text:string>>")))


def with_next_pick(events: DataFrame, chunk: int = 1 << 14) -> DataFrame:
    """``events`` with the seq of the next pick of their draft. Looked for from the end inside chunks of seq, then among the first picks of later
    chunks, so that a draft is spread over tasks and a row costs one step."""
    rows = events.withColumn("chunk", F.floor(F.col("seq") / chunk))
    pick, after = F.min(F.when(F.col("verb") == "pick", F.col("seq"))), (Window.unboundedPreceding, -1)
    here = rows.withColumn("here", pick.over(Window.partitionBy("set_id", "draft", "chunk").orderBy(F.desc("seq")).rowsBetween(*after)))
    firsts = rows.groupBy("set_id", "draft", "chunk").agg(pick.alias("pick"))
    later = firsts.withColumn("later", F.min("pick").over(Window.partitionBy("set_id", "draft").orderBy(F.desc("chunk")).rowsBetween(*after))).drop("pick")
    return here.join(later, ["set_id", "draft", "chunk"]).withColumn("next_pick", F.coalesce("here", "later")).drop("chunk", "here", "later")


def replay(events: DataFrame) -> DataFrame:
    """``events(set_id, draft, seq, verb, key, id, x, z)`` with verb place, pick or drop -> the placements left down.

    ``key`` tells copies apart. place puts a key down (again), pick takes it up, drop leaves it off the floor: the last event of a
    key decides. A key still in hand that was never put down is let go when the draft's next one is picked. A copy first placed when ``MAX_COPIES`` others of its object are already down is refused, with everything
    that later happens to it.
    """
    life = with_next_pick(events).groupBy("set_id", "draft", "id", "key").agg(
        F.max_by(F.struct("verb", "x", "z", "seq"), "seq").alias("last"), F.min("seq").alias("first"), F.min_by("next_pick", "seq").alias("next_pick"),
        F.min(F.when(F.col("verb") == "place", F.col("seq"))).alias("placed"), F.min(F.when(F.col("verb") == "drop", F.col("seq"))).alias("dropped"))
    let_go = F.when((F.col("next_pick") < F.col("placed")) | F.col("placed").isNull(), F.col("next_pick"))
    life = life.withColumn("dropped", F.least("dropped", let_go)).drop("next_pick", "placed")
    # A key takes a slot from its first placing until it is dropped; slots are counted in event order per object.
    ticks = life.select("set_id", "draft", "id", "key", F.inline(F.array(
        F.struct(F.col("first").alias("seq"), F.lit(1).alias("kind")), F.struct(F.col("dropped").alias("seq"), F.lit(0).alias("kind"))))).filter("seq is not null")
    folded = ticks.groupBy("set_id", "draft", "id").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "key"))).alias("t"))
    empty = F.array().cast("array<bigint>")
    step = lambda held, t: F.when(t["kind"] == 0, F.struct(F.array_remove(held["down"], t["key"]).alias("down"), held["ok"].alias("ok"))).when(
        F.size(held["down"]) < MAX_COPIES,
        F.struct(F.array_append(held["down"], t["key"]).alias("down"), F.array_append(held["ok"], t["key"]).alias("ok"))).otherwise(held)
    ok = folded.select("set_id", "draft", "id", F.explode(F.aggregate("t", F.struct(empty.alias("down"), empty.alias("ok")), step)["ok"]).alias("key"))
    return (life.join(ok, ["set_id", "draft", "id", "key"]).filter(F.col("last.verb") == "place")
            .select("set_id", "draft", "key", "id", "last.x", "last.z", F.col("last.seq").alias("seq")))


def summary(drafts: DataFrame, reviewed: DataFrame, branches: DataFrame) -> DataFrame:
    """"3 placed · unsaved changes", "… · saved 14:32" or "… · not saved yet"."""
    when = branches.select("set_id", "id", s.clock_text(F.col("saved_at")).alias("clock"))
    rows = reviewed.join(drafts.select("set_id", "draft", F.size("placements").alias("n")), ["set_id", "draft"]).join(when, ["set_id", "id"], "left")
    tail = F.when(~F.col("saved"), "not saved yet").when(F.col("dirty"), "unsaved changes").otherwise(F.concat(F.lit("saved "), F.col("clock")))
    return rows.select("set_id", "draft", "name", F.concat_ws(" · ", F.concat(F.col("n").cast("string"), F.lit(" placed")), tail).alias("status"))
