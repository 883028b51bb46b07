"""Captures arriving one state at a time: the tracker carried forward by a stream.

Occupancy, labels and object cores only ever gain rows, so each batch writes its own folder of them (labels: its own numbers of the log);
objects and live voxels are small and written whole per batch. A replayed batch starts from the batch before it and overwrites what it wrote, so nothing is
counted twice. Rows of a state already processed go to ``late``; a state whose predecessor is missing waits in ``early``, and so does one
of whose rows only a part has come, as counts for each voxel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomdiff.functions.stage import empty, written
from roomdiff.operators import tracker as tk
from roomdiff.operators import voxels as vx
from roomdiff.operators.labels import LabelLog

OCC = "set_id string, state int, vox bigint"
COUNTS = "set_id string, state int, vox bigint, n bigint"
PROGRESS = "set_id string, last int"
SEEN = "set_id string, state int, rows bigint"
GROWING = {"occ": OCC, "cores": tk.LIVE, "late": OCC}
APPENDS = 1 << 20           # numbers of the label log that a batch has for itself
WHOLE = {"objects": tk.OBJECTS, "live": tk.LIVE, "progress": PROGRESS, "early": COUNTS, "seen": SEEN}


@dataclass
class CaptureTracker:
    """``start(stream)`` with a stream of aligned splats, or ``occupied`` voxels when ``voxels`` is set.

    ``expected(set_id, state, rows)`` says how many rows a capture has, as its header does: a state is taken up once they have all come. Without
    it a state has to come in one batch.
    """

    spark: SparkSession
    folder: str
    grids: DataFrame
    params: tk.DiffParams = tk.DiffParams()
    bits: int = vx.BLOCK_BITS
    voxels: bool = False
    expected: DataFrame | None = None

    def start(self, stream: DataFrame):
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.folder}/checkpoint").outputMode("append")

    def _path(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch={batch}"

    def read(self, name: str, batch: int) -> DataFrame:
        """A table as it stood after ``batch`` (-1: before the first)."""
        if name == "labels":
            return self._labels(batch + 1).read()
        if batch < 0:
            return empty(self.spark, {**GROWING, **WHOLE}[name])
        if name in WHOLE:
            return self.spark.read.schema(WHOLE[name]).parquet(self._path(name, batch))
        return self.spark.read.schema(GROWING[name] + ", batch int").parquet(f"{self.folder}/{name}").filter(F.col("batch") <= batch).drop("batch")

    def _labels(self, batch: int) -> LabelLog:
        return LabelLog(self.spark, f"{self.folder}/labels", batch * APPENDS)

    def batch(self, rows: DataFrame, batch: int) -> None:
        p, before = self.params, batch - 1
        last = self.read("progress", before)
        if self.voxels:
            fresh = rows.select("set_id", "state", "vox", F.lit(p.min_count).cast("bigint").alias("n"))
        else:
            fresh = vx.occupancy(rows, self.grids, p.opacity_solid, 1)
        fresh = fresh.unionByName(self.read("early", before)).groupBy("set_id", "state", "vox").agg(F.sum("n").alias("n"))
        fresh = written(fresh.join(last, "set_id", "left").withColumn("last", F.coalesce("last", F.lit(-1))), "fresh")
        late = fresh.filter(F.col("state") <= F.col("last"))
        waiting = fresh.filter(F.col("state") > F.col("last")).drop("last")
        seen = written(rows.groupBy("set_id", "state").agg(F.count("*").alias("rows")).unionByName(self.read("seen", before))
                       .groupBy("set_id", "state").agg(F.sum("rows").alias("rows")), "seen")
        arrived = seen.select("set_id", "state")
        if self.expected is not None:
            whole = self.expected.select("set_id", "state", F.col("rows").alias("all_rows"))
            arrived = seen.join(whole, ["set_id", "state"]).filter(F.col("rows") >= F.col("all_rows")).select("set_id", "state")
        arrived = written(arrived, "arrived")
        enough = waiting.filter(F.col("n") >= p.min_count).drop("n")
        progress = last
        objects, live = (self.read(n, before) for n in ("objects", "live"))
        labels = self._labels(batch)
        occ, cores = self.read("occ", before), empty(self.spark, tk.LIVE)
        done = empty(self.spark, "set_id string, state int")
        first, top = arrived.agg(F.min("state"), F.max("state")).first()
        for state in range(first or 0, (top if top is not None else -1) + 1):
            here = arrived.filter(F.col("state") == state).join(progress, "set_id", "left").filter(F.coalesce("last", F.lit(-1)) == state - 1)
            here = written(here.select("set_id"), "here")
            if here.isEmpty():
                continue
            now = enough.filter(F.col("state") == state).join(here, "set_id", "left_semi")
            occ = occ.unionByName(written(now, "occ"))          # what stood before is not written again
            if state > 0:
                objects, live, fresh_cores = self._advance(state, objects, live, labels, occ, here)
                cores = cores.unionByName(fresh_cores)
            done = done.unionByName(here.withColumn("state", F.lit(state)))
            progress = written(progress.join(here, "set_id", "left_anti").unionByName(here.withColumn("last", F.lit(state))), "progress")
        done = written(done, "done")
        early = waiting.join(done, ["set_id", "state"], "left_anti")
        self._write("occ", batch, enough.join(done, ["set_id", "state"], "left_semi"))
        self._write("cores", batch, cores)
        self._write("late", batch, late.drop("last", "n"))
        open_states = seen.join(progress, "set_id", "left").filter(F.col("state") > F.coalesce("last", F.lit(-1))).drop("last")
        for name, df in (("objects", objects), ("live", live), ("progress", progress), ("early", early), ("seen", open_states)):
            self._write(name, batch, df)

    def _write(self, name: str, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._path(name, batch))

    def _advance(self, state, objects, live, labels, occ, here):
        p, sizes = self.params, here.withColumn("n_states", F.lit(state + 1))
        two = written(occ.join(here, "set_id", "left_semi").filter(F.col("state") >= state - 1), "two")
        changed = vx.changes(two, sizes, self.grids, p.floor_band_voxels, p.jitter_voxels, self.bits).filter(F.col("step") == state)
        split = written(tk.change_blobs(written(changed, "changed"), self.grids, self.bits), "split")
        blobs = written(tk.kept_blobs(split, tk.candidates(split, two, self.grids, sizes, p, self.bits)), "blobs")
        objects, live, cores = tk.track_step(state, objects, live, labels, blobs, occ, self.grids, here, p, self.bits)
        tk.add_state_labels(state, live, labels, occ, self.grids, here, p, self.bits)
        return objects, live, cores
