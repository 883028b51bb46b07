"""Curation and publishing: tracked objects and hand-written entries -> what readers see, one document per set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomdiff.functions import geometry as g
from roomdiff.functions import scalar as s
from roomdiff.functions import voxel as v


def unknown_ids(objects: DataFrame, *curated: DataFrame) -> DataFrame:
    """Violations for curated ids that no object has."""
    named = None
    for c in curated:
        ids = c.select("set_id", "id")
        named = ids if named is None else named.unionByName(ids)
    lost = named.distinct().join(objects.select("set_id", "id"), ["set_id", "id"], "left_anti")
    return lost.select("set_id", F.concat(F.lit("objects["), F.col("id").cast("string"), F.lit("]")).alias("path"), F.lit("does not exist").alias("message"))


def end_early(objects: DataFrame, removed: DataFrame) -> DataFrame:
    """Objects the tracker kept past the state they left in: presence cut there, if any of it lies at or after it."""
    rows = objects.join(removed.select("set_id", "id", F.col("state").alias("_gone")), ["set_id", "id"], "left")
    cut = F.coalesce(F.exists("present", lambda c: c >= F.col("_gone")), F.lit(False))
    return (rows.withColumn("removed_in", F.when(cut, F.col("_gone")).otherwise(F.col("removed_in")))
            .withColumn("present", F.when(cut, F.filter("present", lambda c: c < F.col("_gone"))).otherwise(F.col("present"))).select(*objects.columns))


def sever(objects: DataFrame, names: DataFrame) -> DataFrame:
    """Moves between objects given different names are no moves; both ends of the link go."""
    name = names.select("set_id", "id", "name")
    ends = (objects.filter("moved_from is not null").select("set_id", F.col("id").alias("to"), F.col("moved_from").alias("id"))
            .join(name.withColumnRenamed("name", "was"), ["set_id", "id"]).withColumnRenamed("id", "from")
            .join(name.select("set_id", F.col("id").alias("to"), F.col("name").alias("now")), ["set_id", "to"]).filter("was <> now").select("set_id", "from", "to"))
    out = (objects.join(ends.select("set_id", F.col("to").alias("id"), F.lit(True).alias("_in")), ["set_id", "id"], "left")
           .join(ends.select("set_id", F.col("from").alias("id"), F.col("to").alias("moved_to"), F.lit(True).alias("_out")), ["set_id", "id", "moved_to"], "left"))
    return (out.withColumn("moved_from", F.when(F.col("_in").isNull(), F.col("moved_from")))
            .withColumn("moved_to", F.when(F.col("_out").isNull(), F.col("moved_to"))).select(*objects.columns))


def new_ids(objects: DataFrame, exclude: DataFrame) -> DataFrame:
    """(set_id, id, new_id): the kept objects numbered from 0 in id order."""
    kept = objects.select("set_id", "id").join(exclude.select("set_id", "id"), ["set_id", "id"], "left_anti")
    return kept.withColumn("new_id", (F.row_number().over(Window.partitionBy("set_id").orderBy("id")) - 1).cast("bigint"))


def curate(objects: DataFrame, names: DataFrame, exclude: DataFrame, removed: DataFrame, calibrations: DataFrame) -> DataFrame:
    """``objects`` as tracked (with bbox_canon) -> as published: excluded ones dropped, the rest renumbered, their links with them;
    named; their boxes in world metres. ``calibrations(set_id, calibration_m)``."""
    ids = new_ids(objects, exclude)
    rows = sever(end_early(objects, removed), names).join(ids, ["set_id", "id"]).join(names, ["set_id", "id"], "left").join(calibrations.select("set_id", "calibration_m"), "set_id")
    for link in ("moved_from", "moved_to"):
        rows = rows.join(ids.select("set_id", F.col("id").alias(link), F.col("new_id").alias(f"_{link}")), ["set_id", link], "left")
    return rows.select("set_id", F.col("new_id").alias("id"), F.col("id").alias("source_id"), s.object_name(F.col("name"), F.col("new_id")).alias("name"), "kind", "sub", "doc", "by",
                       "added_in", "removed_in", "present", "voxels", "volume_vox_m3", F.col("_moved_from").alias("moved_from"), F.col("_moved_to").alias("moved_to"),
                       g.box_under(g.world_from_canon(F.col("calibration_m")), F.col("bbox_canon")).alias("bbox"))


def label_problems(labels: DataFrame, objects: DataFrame, grids: DataFrame) -> DataFrame:
    """Violations of label tables: voxels outside the grid, labels of objects that do not exist."""
    shape = grids.select("set_id", F.col("shape").alias("_shape"))
    out = labels.join(shape, "set_id").filter(~v.inside(F.col("vox"), F.col("_shape"))).groupBy("set_id", "state").agg(F.count("*").alias("n"))
    lost = labels.join(objects.select("set_id", F.col("id").alias("object_id")), ["set_id", "object_id"], "left_anti").groupBy("set_id", "state").agg(F.max("object_id").alias("n"))
    row = lambda df, text: df.select("set_id", F.concat(F.lit("labels["), F.col("state").cast("string"), F.lit("]")).alias("path"), F.concat(F.lit(text), F.col("n").cast("string")).alias("message"))
    return row(out, "voxels outside the grid: ").unionByName(row(lost, "no such object: "))


def publish_labels(labels: DataFrame, ids: DataFrame, removed: DataFrame) -> DataFrame:
    """Labels under the published ids; excluded objects', and those curated as gone by then, become static."""
    gone = removed.select("set_id", F.col("id").alias("object_id"), F.col("state").alias("_gone"))
    kept = labels.join(gone, ["set_id", "object_id"], "left").filter("_gone is null or state < _gone")
    return kept.join(ids.withColumnRenamed("id", "object_id"), ["set_id", "object_id"]).select("set_id", "state", "vox", F.col("new_id").alias("object_id"))


def missing_inputs(states: DataFrame, captures: DataFrame, labels_done: DataFrame, objects: DataFrame) -> DataFrame:
    """Violations of what publishing needs first: an aligned capture and a label run for every state, boxes in the room frame."""
    lack = lambda df, text: states.select("set_id", "state").join(df.select("set_id", "state").distinct(), ["set_id", "state"], "left_anti").select(
        "set_id", F.concat(F.lit("commits["), F.col("state").cast("string"), F.lit("]")).alias("path"), F.lit(text).alias("message"))
    old = objects.filter("bbox_canon is null").select("set_id", F.concat(F.lit("objects["), F.col("id").cast("string"), F.lit("]")).alias("path"), F.lit("has no room-aligned box").alias("message"))
    return lack(captures, "is not baked").unionByName(lack(labels_done, "is not compared")).unionByName(old)


def rooms(grids: DataFrame) -> DataFrame:
    """The room of each set in world metres and the matrix from reference to world."""
    return grids.select("set_id", "voxel", "origin", "shape", "calibration_m", g.world_from_ref(F.col("canon"), F.col("calibration_m")).alias("world_from_ref"),
                        g.box_under(g.world_from_canon(F.col("calibration_m")), F.col("room_canon")).alias("room"))


def state_rows(states: DataFrame, counts: DataFrame, hashes: DataFrame) -> DataFrame:
    """States as published: ``states`` of the configuration with splat counts and content hashes."""
    name = F.concat(F.lit("c"), F.col("state").cast("string"))
    return states.join(counts, ["set_id", "state"]).join(hashes, ["set_id", "state"]).select(
        "set_id", "state", name.alias("id"), "hash", "message", "captured", F.concat(F.lit("commits/"), name, F.lit(".spz")).alias("file"), "splats",
        F.concat(F.lit("commits/"), name, F.lit(".labels.bin")).alias("labels"), "doc", "by", "stats")


def manifests(states: DataFrame, objects: DataFrame, room: DataFrame, sets: DataFrame, entries: DataFrame, sites: DataFrame) -> DataFrame:
    """(set_id, json): one document per set, read back by ``sources.manifests.parse``."""
    def gathered(df, key, name, order):
        cols = [c for c in df.columns if c not in ("set_id", key)] if key else [c for c in df.columns if c != "set_id"]
        pairs = F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*cols).alias("_row")))
        rows = df.groupBy("set_id").agg(F.array_sort(pairs, lambda x, y: (x["_order"] - y["_order"]).cast("int")).alias("_rows"))
        return rows.select("set_id", F.transform("_rows", lambda r: r["_row"]).alias(name))

    st = gathered(states.withColumn("index", F.col("state")), "state", "commits", "state")
    box = F.array(F.col("bbox.lo"), F.col("bbox.hi"))
    ob = gathered(objects.withColumn("bbox", box), None, "objects", "id")
    en = entries.groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("-", "a", "b"), F.struct("doc", "by")))).alias("diffs"))
    si = gathered(sites, "at", "sites", "at")
    rows = (st.join(ob, "set_id", "left").join(room.drop("calibration_m"), "set_id").join(sets.select("set_id", "calibration_m", "standard", "door"), "set_id")
            .join(en, "set_id", "left").join(si, "set_id", "left").withColumn("room", F.array("room.lo", "room.hi"))
            .withColumn("objects", F.coalesce("objects", F.array())))
    cols = ["commits", "voxel", "origin", "shape", "room", "world_from_ref", "calibration_m", "door", "standard", "diffs", "sites", "objects"]
    return rows.select("set_id", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def single_objects(hand_boxes: DataFrame, names: DataFrame, occupied: DataFrame, voxel_m: float) -> DataFrame:
    """Objects of a set with one capture: the boxes drawn by hand, present in state 0, sized by the occupied voxels in them."""
    rows = hand_boxes.join(names, ["set_id", "id"], "left").join(occupied, ["set_id", "id"])
    none = lambda t: F.lit(None).cast(t)
    edge = lambda side: F.transform(side, lambda c: F.bround(c, 4))
    return rows.select("set_id", "id", F.col("id").alias("source_id"), s.object_name(F.col("name"), F.col("id")).alias("name"), none("string").alias("kind"), none("string").alias("sub"),
                       "doc", "by", F.lit(0).alias("added_in"), none("int").alias("removed_in"), F.array(F.lit(0)).alias("present"), "voxels",
                       F.bround(F.col("voxels") * F.pow(F.lit(voxel_m), F.lit(3)), 4).alias("volume_vox_m3"), none("bigint").alias("moved_from"), none("bigint").alias("moved_to"),
                       F.struct(edge("lo").alias("lo"), edge("hi").alias("hi")).alias("bbox"))


def single_grid(rooms: DataFrame, voxel_m: float = 0.05) -> DataFrame:
    """The voxel grid over each room box, already in world metres."""
    cells = F.transform(F.arrays_zip(F.col("room.lo").alias("lo"), F.col("room.hi").alias("hi")), lambda e: F.ceil((e["hi"] - e["lo"]) / voxel_m).cast("int"))
    return rooms.select("set_id", F.lit(voxel_m).alias("voxel"), F.col("room.lo").alias("origin"), cells.alias("shape"), "room", g.identity().alias("world_from_ref"))
