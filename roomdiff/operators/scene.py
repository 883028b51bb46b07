"""What is in a room and how each thing stands.

Tables in: ``objects`` (one row per detection) and small request tables naming states. A *thing* is a chain of object ids
linked by moves. ``positions`` — one row per thing and state it stands in — is what every question reads.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomdiff.functions import geometry as g
from roomdiff.functions import scalar as s
from roomdiff.functions.stage import shuffled, written

MOVE_MIN_M = 0.05    # closer than this, a thing did not move


# ---- chains --------------------------------------------------------------------------------------------------------

def _valid_links(objects: DataFrame, field: str) -> DataFrame:
    """(set_id, id, to) for each link whose other end exists."""
    ends = objects.select("set_id", F.col("id").alias("to"))
    return (objects.filter(F.col(field).isNotNull())
            .select("set_id", "id", F.col(field).cast("long").alias("to"))
            .join(shuffled(ends), ["set_id", "to"], "left_semi").select("set_id", "id", "to"))


def _follow_to_end(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointer doubling: (rows that reached an end, rows still walking after as many steps as there are links)."""
    cur = written(links.withColumn("moving", F.lit(True)), "links")
    rounds = math.ceil(math.log2(max(cur.count(), 1) + 1)) + 1
    for _ in range(rounds):
        ahead = cur.select("set_id", F.col("id").alias("to"), F.col("to").alias("next"))
        cur = written(cur.join(shuffled(ahead), ["set_id", "to"], "left")
                      .select("set_id", "id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moving")),
                      "links")
        if cur.filter("moving").isEmpty():
            break
    return cur.filter(~F.col("moving")).select("set_id", "id", "to"), cur.filter("moving").select("set_id", "id", "to")


def roots(objects: DataFrame) -> DataFrame:
    """(set_id, id, root): moved_from followed back to the start. A dangling link stops the walk; on a cycle every member is
    its own root, and a walk that enters one stops where it enters."""
    back = written(_valid_links(objects, "moved_from"), "links")
    ended, walking = _follow_to_end(back)
    cyclic = walking.select("set_id", F.col("to").alias("id")).distinct()
    if not walking.isEmpty():
        ended, _ = _follow_to_end(back.join(shuffled(written(cyclic, "cycle")), ["set_id", "id"], "left_anti"))
    return (objects.select("set_id", "id")
            .join(shuffled(ended.withColumnRenamed("to", "root")), ["set_id", "id"], "left")
            .select("set_id", "id", F.coalesce("root", "id").alias("root")))


def chains(objects: DataFrame, root_of: DataFrame | None = None) -> DataFrame:
    """(set_id, root, pos, id): every id a thing wears, oldest first. Each round doubles how far every chain is known, so a chain
    of n ids takes log2(n) joins; the rows written are the chains themselves."""
    root_of = roots(objects) if root_of is None else root_of
    heads = root_of.filter(F.col("id") == F.col("root")).select("set_id", "root")
    jump = written(_valid_links(objects, "moved_to"), "jump")
    known = written(heads.select("set_id", "root", F.lit(0).cast("long").alias("pos"), F.col("root").alias("id")), "chain")
    step = 1
    n_known = known.count()
    while True:
        longer = (known.join(shuffled(jump), ["set_id", "id"])
                  .select("set_id", "root", (F.col("pos") + step).alias("pos"), F.col("to").alias("id")))
        grown = known.unionByName(longer).groupBy("set_id", "root", "id").agg(F.min("pos").alias("pos"))   # a revisit ends a chain
        known = written(grown.select("set_id", "root", "pos", "id"), "chain")
        n_now = known.count()
        if n_now == n_known:
            return known
        n_known = n_now
        ahead = jump.select("set_id", F.col("id").alias("to"), F.col("to").alias("next"))
        jump = written(jump.join(shuffled(ahead), ["set_id", "to"]).select("set_id", "id", F.col("next").alias("to")), "jump")
        step *= 2


def things(objects: DataFrame, chain: DataFrame) -> DataFrame:
    """One row per thing: its root, the root's name, its ids oldest first."""
    ids = chain.groupBy("set_id", "root").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("walk"))
    names = objects.select("set_id", F.col("id").alias("root"), "name")
    return ids.join(names, ["set_id", "root"]).select("set_id", "root", "name", F.col("walk.id").alias("ids"))


def thing_of(root_of: DataFrame, chain: DataFrame) -> DataFrame:
    """(set_id, id, root, pos, member): the chain of the thing each object belongs to."""
    return root_of.join(chain.withColumnRenamed("id", "member"), ["set_id", "root"]).select("set_id", "id", "root", "pos", "member")


# ---- where things stand --------------------------------------------------------------------------------------------

def objects_at(objects: DataFrame, states: DataFrame) -> DataFrame:
    """Objects present in each requested (set_id, state)."""
    seen = objects.select("*", F.explode(F.array_distinct("present")).alias("state"))
    return seen.join(states.select("set_id", "state"), ["set_id", "state"], "left_semi")


def presence(objects: DataFrame) -> DataFrame:
    """(set_id, id, state, x, z): each object's place on the floor in each state it is present in."""
    return objects.select("set_id", "id", F.explode(F.array_distinct(F.col("present").cast("array<int>"))).alias("state"),
                          g.middle(F.col("bbox"), 0).alias("x"), g.middle(F.col("bbox"), 2).alias("z"))


def positions(objects: DataFrame, chain: DataFrame) -> DataFrame:
    """(set_id, root, state, id, x, z): the first id of each chain that is present in a state, and its place."""
    seen = presence(objects).join(shuffled(chain), ["set_id", "id"])
    first = F.min_by(F.struct("id", "x", "z"), "pos").alias("at")
    return seen.groupBy("set_id", "root", "state").agg(first).select("set_id", "root", "state", "at.id", "at.x", "at.z")


def id_at(asked: DataFrame, root_of: DataFrame, places: DataFrame) -> DataFrame:
    """``asked(set_id, id, state)`` with ``worn``: the id its thing wears in that state, or null."""
    worn = places.select("set_id", "root", "state", F.col("id").alias("worn"))
    return asked.join(root_of, ["set_id", "id"]).join(worn, ["set_id", "root", "state"], "left").select("set_id", "id", "state", "worn")


def carry(asked: DataFrame, objects: DataFrame, root_of: DataFrame, chain: DataFrame) -> DataFrame:
    """``asked(set_id, selected, shown array<int>)`` with ``kept``: the first id in the chain present in any shown state."""
    worn = chain.join(objects.select("set_id", "id", "present"), ["set_id", "id"])
    rows = (asked.join(root_of.withColumnRenamed("id", "selected"), ["set_id", "selected"])
            .join(worn, ["set_id", "root"], "left"))
    hit = F.arrays_overlap(F.col("present"), F.col("shown"))
    return rows.groupBy("set_id", "selected", "shown").agg(F.min_by(F.when(hit, F.col("id")), F.when(hit, F.col("pos"))).alias("kept"))


# ---- diff and drift ------------------------------------------------------------------------------------------------

def diff(places: DataFrame, pairs: DataFrame, names: DataFrame) -> DataFrame:
    """``pairs(set_id, a, b)`` answered per thing: (set_id, a, b, root, name, kind, id, from_id, metres, from_x, from_z).

    kind is same, moved, added or removed; ``id`` is the id worn in b (in a when removed). Both states are gathered by one
    grouping per thing, so no state is joined to another.
    """
    wanted = pairs.select("set_id", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("state"))
    rows = places.join(wanted, ["set_id", "state"])
    spot = F.struct("id", "x", "z")
    both = rows.groupBy("set_id", "a", "b", "root").agg(
        F.max(F.when(F.col("state") == F.col("a"), spot)).alias("p"), F.max(F.when(F.col("state") == F.col("b"), spot)).alias("q"))
    gap = g.floor_distance(F.col("p.x"), F.col("p.z"), F.col("q.x"), F.col("q.z"))
    kind = (F.when(F.col("p").isNull(), "added").when(F.col("q").isNull(), "removed")
            .when(gap > MOVE_MIN_M, "moved").otherwise("same"))
    out = both.select("set_id", "a", "b", "root", kind.alias("kind"), F.coalesce("q.id", "p.id").alias("id"),
                      F.col("p.id").alias("from_id"), gap.alias("gap"), F.col("p.x").alias("from_x"), F.col("p.z").alias("from_z"))
    moved = F.col("kind") == "moved"
    return (out.join(shuffled(names), ["set_id", "root"])
            .select("set_id", "a", "b", "root", "name", "kind", "id",
                    F.when(moved, F.col("from_id")).alias("from_id"), F.when(moved, F.col("gap")).alias("metres"),
                    F.when(F.col("kind") != "added", F.col("from_x")).alias("from_x"),
                    F.when(F.col("kind") != "added", F.col("from_z")).alias("from_z")))


def thing_names(objects: DataFrame) -> DataFrame:
    return objects.select("set_id", F.col("id").alias("root"), "name")


DRIFT_WORDS = {"same": "keep", "moved": "move", "added": "remove", "removed": "add"}      # fixed wording
DRIFT_ORDER = {"keep": 0, "move": 1, "remove": 2, "add": 3}                               # fixed order


def drift(places: DataFrame, heads: DataFrame, names: DataFrame) -> DataFrame:
    """``heads(set_id, standard, head)``: what each thing must do for the head to match its standard, in report order
    (``rank``, then root). A head that is its own standard gives no line."""
    pairs = heads.filter(F.col("standard") != F.col("head")).select("set_id", F.col("standard").alias("a"), F.col("head").alias("b"))
    d = diff(places, pairs.distinct(), names)
    word = F.element_at(F.create_map(*[F.lit(v) for kv in DRIFT_WORDS.items() for v in kv]), F.col("kind"))
    rank = F.element_at(F.create_map(*[F.lit(v) for kv in DRIFT_ORDER.items() for v in kv]), F.col("k"))
    back = F.col("k").isin("move", "add")
    lines = d.withColumn("k", word)
    return lines.select(
        "set_id", F.col("a").alias("standard"), F.col("b").alias("head"), "root", "name", "k", rank.alias("rank"),
        F.when(F.col("k") != "add", F.col("id")).alias("id"),
        F.when(F.col("k") == "add", F.col("id")).when(F.col("k") == "move", F.col("from_id")).alias("std_id"),
        "metres", F.when(back, F.col("from_x")).alias("from_x"), F.when(back, F.col("from_z")).alias("from_z"))


def drift_rollup(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Per head: is_standard, how many are off, missing and extra, and the mean metres of the moves (null when none)."""
    counts = lines.groupBy("set_id", "standard", "head").agg(
        F.count_if(F.col("k") == "move").alias("off"), F.count_if(F.col("k") == "add").alias("missing"),
        F.count_if(F.col("k") == "remove").alias("extra"), F.avg(F.when(F.col("k") == "move", F.col("metres"))).alias("mean_m"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (heads.select("set_id", "standard", "head").join(counts, ["set_id", "standard", "head"], "left")
            .select("set_id", "standard", "head", (F.col("standard") == F.col("head")).alias("is_standard"),
                    zero("off"), zero("missing"), zero("extra"), "mean_m"))


def status(heads: DataFrame, rollup: DataFrame) -> DataFrame:
    """``heads(set_id, head, standard)`` in words; extras alone do not put a state off its standard."""
    known = rollup.select("set_id", "standard", "head", (F.col("off") + F.col("missing")).alias("wrong"))
    rows = heads.join(known, ["set_id", "standard", "head"], "left")
    std, head = F.col("standard"), F.col("head")
    cls = (F.when(std.isNull(), "none").when(head == std, "std").when(head < std, "before")
           .when(F.col("wrong") > 0, "off").otherwise("on"))
    text = {"none": "—", "std": "Standard", "before": "Before standard", "off": "Off standard", "on": "On standard"}
    words = F.create_map(*[F.lit(v) for kv in text.items() for v in kv])
    return rows.withColumn("cls", cls).select("set_id", "head", "standard", F.element_at(words, F.col("cls")).alias("text"), "cls")


def standing(asked: DataFrame, root_of: DataFrame, places: DataFrame) -> DataFrame:
    """``asked(set_id, id, head, standard)``: none, extra, missing, off (with metres) or match."""
    at = lambda state, tag: places.select("set_id", "root", F.col("state").alias(state), F.col("x").alias(f"{tag}x"), F.col("z").alias(f"{tag}z"))
    rows = (asked.join(root_of, ["set_id", "id"])
            .join(at("standard", "s"), ["set_id", "root", "standard"], "left")
            .join(at("head", "h"), ["set_id", "root", "head"], "left"))
    gap = g.floor_distance(F.col("sx"), F.col("sz"), F.col("hx"), F.col("hz"))
    k = (F.when(F.col("standard").isNull(), "none").when(F.col("sx").isNull(), "extra").when(F.col("hx").isNull(), "missing")
         .when(gap > MOVE_MIN_M, "off").otherwise("match"))
    t = (F.when(k == "none", "").when(k == "extra", "Not in the standard").when(k == "missing", "Missing from this state")
         .when(k == "off", F.concat(s.metres(gap), F.lit(" from the standard"))).otherwise("Where the standard has it"))
    return rows.select("set_id", "id", "head", "standard", "root", k.alias("k"), F.when(k == "off", gap).alias("metres"), t.alias("t"))


# ---- through time --------------------------------------------------------------------------------------------------

def months(objects: DataFrame, chain: DataFrame, places: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per thing and state of its set: not in room, arrived, in room or moved. ``sizes(set_id, n_states)``."""
    first = (chain.join(objects.select("set_id", "id", "added_in"), ["set_id", "id"])
             .groupBy("set_id", "root").agg(F.min("added_in").alias("first")))
    grid = (first.join(sizes.filter("n_states > 0"), "set_id")
            .select("set_id", "root", "first", F.explode(F.sequence(F.lit(0), F.col("n_states").cast("int") - 1)).alias("state")))
    w = Window.partitionBy("set_id", "root").orderBy("state")
    rows = (grid.join(places, ["set_id", "root", "state"], "left")
            .withColumn("px", F.lag("x").over(w)).withColumn("pz", F.lag("z").over(w)))
    gap = g.floor_distance(F.col("px"), F.col("pz"), F.col("x"), F.col("z"))
    here, before = F.col("id").isNotNull(), F.col("px").isNotNull()
    mark = (F.when(~here, "not in room").when(before & (gap > MOVE_MIN_M), "moved")
            .when(~before & (F.col("state") == F.col("first")), "arrived").otherwise("in room"))
    return rows.select("set_id", "root", "state", "id", mark.alias("mark"), F.when(here & before & (gap > MOVE_MIN_M), gap).alias("metres"))


def default_pair(heads: DataFrame) -> DataFrame:
    """``heads(set_id, head, standard)`` -> the pair a diff opens on: the standard against a later state, else the state before."""
    head, std = F.col("head"), F.col("standard")
    a = F.when(std.isNotNull() & (head > std), std).when(head == 0, F.lit(0)).otherwise(head - 1)
    return heads.select("set_id", "head", "standard", a.cast("int").alias("a"), F.when(head == 0, F.lit(1)).otherwise(head).cast("int").alias("b"))


def latest_standard(marks: DataFrame) -> DataFrame:
    """``marks(set_id, state, at)``, appended to whenever a state is made the standard: the latest row of each set wins."""
    return marks.groupBy("set_id").agg(F.max_by("state", F.struct("at", "state")).alias("standard"))


def make_standard(marks: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows to append for ``asked(set_id, state, at)``: those that name another state than the current standard."""
    now = latest_standard(marks)
    return (asked.join(now, "set_id", "left").filter(~F.col("state").eqNullSafe(F.col("standard"))).select("set_id", "state", "at"))


# ---- reports -------------------------------------------------------------------------------------------------------

DIFF_SIGNS = {"same": "=", "moved": "Δ", "removed": "−", "added": "+"}                        # fixed signs
DIFF_TITLES = {"same": "UNCHANGED", "moved": "MOVED", "removed": "REMOVED", "added": "ADDED"}  # fixed titles, in report order
DRIFT_SIGNS = {"keep": "=", "move": "Δ", "remove": "−", "add": "+"}


def _lookup(words: dict[str, str], key: str):
    return F.element_at(F.create_map(*[F.lit(v) for kv in words.items() for v in kv]), F.col(key))


def diff_groups(d: DataFrame) -> DataFrame:
    """UNCHANGED, MOVED, REMOVED, ADDED with their counts, one row per group and pair (zero counts included)."""
    counts = d.groupBy("set_id", "a", "b").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in DIFF_TITLES])
    pairs = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(DIFF_SIGNS[k]).alias("sign"), F.lit(t).alias("title"), F.col(k).alias("n"))
                      for i, (k, t) in enumerate(DIFF_TITLES.items())])
    return counts.select("set_id", "a", "b", F.inline(pairs))


def diff_report(d: DataFrame, entries: DataFrame) -> DataFrame:
    """One line per thing with its sign and distance, and the written entry of the pair ("No entry." when none)."""
    value = F.when(F.col("kind") == "moved", s.metres(F.col("metres"))).otherwise("")
    lines = d.select("set_id", "a", "b", "root", "name", "id", _lookup(DIFF_SIGNS, "kind").alias("sign"), _lookup(DIFF_TITLES, "kind").alias("title"),
                     value.alias("value"))
    return (lines.join(entries.select("set_id", "a", "b", "doc", "by"), ["set_id", "a", "b"], "left")
            .withColumn("doc", F.coalesce(s.blank_to_null(F.col("doc")), F.lit("No entry."))))


def drift_report(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """What each head must do, line by line; one line "On standard" for a head with nothing in it."""
    value = (F.when(F.col("k") == "keep", "keep").when(F.col("k") == "move", F.concat(F.lit("must move "), s.metres(F.col("metres"))))
             .when(F.col("k") == "remove", "must remove").otherwise("must add"))
    rows = lines.select("set_id", "standard", "head", "rank", "root", _lookup(DRIFT_SIGNS, "k").alias("sign"), "name", value.alias("value"))
    none = (heads.filter(F.col("standard") != F.col("head")).select("set_id", "standard", "head").distinct()
            .join(lines.select("set_id", "standard", "head").distinct(), ["set_id", "standard", "head"], "left_anti")
            .select("set_id", "standard", "head", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("root"),
                    F.lit("").alias("sign"), F.lit("On standard").alias("name"), F.lit("").alias("value")))
    return rows.unionByName(none)


def object_card(objects: DataFrame) -> DataFrame:
    """Dimensions on the three axes as text, and the entry or its absence."""
    b = F.col("bbox")
    dims = F.concat_ws(" × ", *[s.fixed(g.size_along(b, axis), 1) for axis in (0, 2, 1)])
    return objects.select("set_id", "id", "name", F.concat(dims, F.lit(" m")).alias("dims"),
                          F.coalesce(s.blank_to_null(F.col("doc")), F.lit("No entry.")).alias("doc"), "by")


def state_details(states: DataFrame, objects: DataFrame, statuses: DataFrame) -> DataFrame:
    """Per state: date, sequence, status, the three figures, what it holds, its entry."""
    held = (presence(objects).groupBy("set_id", "state").agg(F.count("*").alias("n_objects")))
    n = F.count("*").over(Window.partitionBy("set_id"))
    st = statuses.select("set_id", F.col("head").alias("state"), F.upper("text").alias("status"))
    figure = lambda key: s.stat_text(F.col("stats"), key).alias(key)
    return (states.withColumn("n_states", n).join(held, ["set_id", "state"], "left").join(st, ["set_id", "state"], "left")
            .select("set_id", "state", F.upper(s.date_text(F.col("captured"))).alias("date"),
                    F.concat_ws(" / ", (F.col("state") + 1).cast("string"), F.col("n_states").cast("string")).alias("sequence"),
                    "status", figure("output"), figure("stoppages"), F.upper(s.stat_text(F.col("stats"), "changeover")).alias("changeover"),
                    F.coalesce("n_objects", F.lit(0)).cast("long").alias("n_objects"), F.coalesce(s.blank_to_null(F.col("doc")), F.lit("No entry.")).alias("doc")))


def timeline_tags(states: DataFrame, standards: DataFrame) -> DataFrame:
    """STANDARD, OFF STANDARD (any state after it) or i / n, by position alone."""
    n = F.count("*").over(Window.partitionBy("set_id"))
    rows = states.select("set_id", "state", n.alias("n")).join(standards.select("set_id", "standard"), "set_id", "left")
    tag = (F.when(F.col("state") == F.col("standard"), "STANDARD").when(F.col("state") > F.col("standard"), "OFF STANDARD")
           .otherwise(F.concat_ws(" / ", (F.col("state") + 1).cast("string"), F.col("n").cast("string"))))
    return rows.select("set_id", "state", tag.alias("tag"))


def last_actions(actions: DataFrame, keep: int) -> DataFrame:
    """The last ``keep`` actions of each session, newest first (Spark cuts each session to ``keep`` rows per task before
    it shuffles)."""
    w = Window.partitionBy("session").orderBy(F.desc("id"))
    return actions.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep)


# ---- plan view -----------------------------------------------------------------------------------------------------

_MARK = ["id", "label", "tone", "dashed", "faint", "pickable", "shift_x", "shift_z", "link_x", "link_z", "link_label", "link_tone"]


def _mark(df: DataFrame, keys: list[str], objects: DataFrame, **given) -> DataFrame:
    missing = {"dashed": F.lit(False), "faint": F.lit(False), "pickable": F.lit(True), "shift_x": F.lit(0.0), "shift_z": F.lit(0.0),
               "link_x": F.lit(None).cast("double"), "link_z": F.lit(None).cast("double"),
               "link_label": F.lit(None).cast("string"), "link_tone": F.lit(None).cast("string")}
    cols = {**missing, **given}
    rows = df.select("set_id", *keys, *[cols[c].alias(c) for c in _MARK])
    return rows.join(objects.select("set_id", "id", "bbox"), ["set_id", "id"])


def state_marks(objects: DataFrame, states: DataFrame) -> DataFrame:
    """Footprints of everything in each requested state."""
    return _mark(objects_at(objects, states).select("set_id", "state", "id", "name"), ["state"], objects,
                 id=F.col("id"), label=F.col("name"), tone=F.lit("neutral"))


def diff_marks(d: DataFrame, objects: DataFrame, states: DataFrame) -> DataFrame:
    """Footprints of a diff: what stands in b, what left a (dashed), and for a move a ghost at its old place with a link."""
    keys = ["a", "b"]
    now = F.concat_ws(" ", _lookup(DIFF_SIGNS, "kind"), F.col("name"))
    kind = F.col("kind")
    moved = kind == "moved"
    shown = _mark(d, keys, objects, id=F.col("id"), label=now,
                  tone=F.when(kind == "added", "add").when(kind == "removed", "rem").otherwise("neutral"),
                  dashed=kind == "removed", faint=kind == "same", link_x=F.when(moved, F.col("from_x")), link_z=F.when(moved, F.col("from_z")),
                  link_label=F.when(moved, s.metres(F.col("metres"))), link_tone=F.when(moved, F.lit("neutral")))
    month = states.select("set_id", F.col("state").alias("a"), s.month_text(F.col("captured")).alias("month"))
    ghosts = _mark(d.filter(moved).join(month, ["set_id", "a"]), keys, objects, id=F.col("from_id"), label=F.col("month"), tone=F.lit("ghost"),
                   dashed=F.lit(True), faint=F.lit(True), pickable=F.lit(False))
    return shown.unionByName(ghosts)


def drift_marks(lines: DataFrame, objects: DataFrame) -> DataFrame:
    """Footprints against the standard: what matches, what drifted with a link to its place, and the standard's ghosts."""
    keys = ["standard", "head"]
    k = F.col("k")
    own = lines.filter(k != "add").join(objects.select("set_id", "id", F.col("name").alias("own")), ["set_id", "id"])
    move = k == "move"
    here = _mark(own, keys, objects, id=F.col("id"), label=F.concat_ws(" ", _lookup(DRIFT_SIGNS, "k"), F.col("own")),
                 tone=F.when(k == "keep", "std").otherwise("neutral"), link_x=F.when(move, F.col("from_x")), link_z=F.when(move, F.col("from_z")),
                 link_label=F.when(move, s.metres(F.col("metres"))), link_tone=F.when(move, F.lit("std")))
    std = (lines.filter(k.isin("move", "add")).join(objects.select("set_id", F.col("id").alias("std_id"), F.col("name").alias("own")), ["set_id", "std_id"]))
    there = _mark(std, keys, objects, id=F.col("std_id"), label=F.when(move, F.col("own")).otherwise(F.concat_ws(" ", F.lit("+"), F.col("own"))),
                  tone=F.lit("std"), dashed=F.lit(True), pickable=F.lit(False))
    return here.unionByName(there)


def draft_marks(drafts: DataFrame, objects: DataFrame) -> DataFrame:
    """Footprints of what a draft puts down: copies numbered, each shifted from where it was captured to where it was placed."""
    put = drafts.select("set_id", F.col("id").alias("draft"), F.posexplode("placements").alias("at", "p")).select(
        "set_id", "draft", "at", "p.id", "p.x", "p.z")
    named = number_copies(put, objects)
    return _mark(named, ["draft", "at"], objects, id=F.col("id"), label=F.col("label"), tone=F.lit("neutral"),
                 shift_x=F.col("x") - F.col("cx"), shift_z=F.col("z") - F.col("cz"))


def number_copies(put: DataFrame, objects: DataFrame) -> DataFrame:
    """Labels of placements: the name, numbered when the same object is down more than once."""
    who = objects.select("set_id", "id", "name", g.middle(F.col("bbox"), 0).alias("cx"), g.middle(F.col("bbox"), 2).alias("cz"))
    same = Window.partitionBy("set_id", "draft", "id")
    n, i = F.count("*").over(same), F.row_number().over(same.orderBy("at"))
    return put.join(who, ["set_id", "id"]).withColumn("copies", n).withColumn("copy", i).withColumn(
        "label", F.when(F.col("copies") > 1, F.concat_ws(" ", F.col("name"), F.col("copy").cast("string"))).otherwise(F.col("name")))


MOST_POINTS = 1 << 16        # points of a floor tile that share a task


def _first_inside(points: np.ndarray, boxes: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """For each of ``points`` (x, z) the place of the first of ``boxes`` (x0, x1, z0, z1) it lies in, -1 where there is none. Boxes are taken in
    blocks, and a point that has found one is not looked at again; ``most`` bounds the pairs compared at once."""
    out, todo, at = np.full(len(points), -1), np.arange(len(points)), 0
    while at < len(boxes) and len(todo):
        x0, x1, z0, z1 = boxes[at:at + min(64, max(1, most // len(todo)))].T
        x, z = points[todo, :1], points[todo, 1:]
        inside = (x >= x0) & (x <= x1) & (z >= z0) & (z <= z1)
        hit = inside.any(axis=1)
        out[todo[hit]] = at + inside[hit].argmax(axis=1)
        todo, at = todo[~hit], at + len(x0)
    return out


def smallest_mark_at(points: DataFrame, marks: DataFrame, cell_m: float = 1.0) -> DataFrame:
    """``points(set_id, point, x, z)`` with the smallest pickable footprint each lies in (null when none), the lowest id of equal ones.

    Footprints are cut into floor tiles. A task holds a tile's footprints, smallest first, and up to about ``MOST_POINTS`` of its points: a point is
    done at the first footprint it lies in, and one row for a point leaves the task, so nothing grows with the pairs of points and footprints.
    """
    lo = lambda axis, shift: F.col("bbox")["lo"][axis] + F.col(shift)
    hi = lambda axis, shift: F.col("bbox")["hi"][axis] + F.col(shift)
    flat = marks.filter("pickable").select("set_id", "id", *[c.cast("double").alias(n) for c, n in (
        (lo(0, "shift_x"), "x0"), (hi(0, "shift_x"), "x1"), (lo(2, "shift_z"), "z0"), (hi(2, "shift_z"), "z1"))])
    tile = lambda c: F.floor(c / cell_m)
    tiles = (flat.withColumn("tx", F.explode(F.sequence(tile(F.col("x0")), tile(F.col("x1")))))
             .withColumn("tz", F.explode(F.sequence(tile(F.col("z0")), tile(F.col("z1"))))).withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("z1") - F.col("z0"))))
    spots = points.select("set_id", "point", F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"), tile(F.col("x")).alias("tx"), tile(F.col("z")).alias("tz"))
    spot = ["set_id", "tx", "tz"]
    parts = spots.groupBy(*spot).agg(F.expr(f"count(1) div {MOST_POINTS} + 1").alias("parts")).join(tiles.select(*spot).distinct(), spot, "left_semi")
    parts = written(parts, "parts")
    dealt = spots.join(parts, spot).withColumn("part", F.pmod(F.xxhash64("point", "x", "z"), F.col("parts")))
    copies = tiles.join(parts, spot).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    kinds = {"set_id": points.schema["set_id"].dataType, "point": points.schema["point"].dataType, "area": "double", "id": marks.schema["id"].dataType}
    schema = ", ".join(f"{n} {k if isinstance(k, str) else k.simpleString()}" for n, k in kinds.items())

    def smallest(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, sort_keys=[("area", "ascending"), ("id", "ascending")], null_placement="at_start"))
        columns = lambda t, names: np.stack([t.column(n).to_numpy() for n in names], axis=1)
        at = _first_inside(columns(left, ("x", "z")), columns(right, ("x0", "x1", "z0", "z1")))
        found, mark = left.filter(pa.array(at >= 0)), right.take(pa.array(at[at >= 0]))
        return pa.table({"set_id": found.column("set_id"), "point": found.column("point"), "area": mark.column("area"), "id": mark.column("id")})

    group = [*spot, "part"]
    hits = dealt.select(*group, "point", "x", "z").groupBy(*group).cogroup(copies.select(*group, "id", "x0", "x1", "z0", "z1", "area").groupBy(*group)).applyInArrow(smallest, schema)
    best = F.struct("area", "id")
    none = points.select("set_id", "point", F.lit(None).cast(f"struct<area: double, id: {marks.schema['id'].dataType.simpleString()}>").alias("best"))
    every = none.unionByName(hits.select("set_id", "point", best.alias("best")))
    return every.groupBy("set_id", "point").agg(F.min("best")["id"].alias("id"))
