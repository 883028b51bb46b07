import datetime as dt

from pyspark.sql import functions as F
from test_tracker import FLOOR, P, cube, tables

from roomdiff.functions import voxel as v
from roomdiff.operators import actions as act
from roomdiff.plans import diff as job
from roomdiff.streaming import captures, sessions


def drain(df, name, **kw):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_tracker_stream_equals_batch_and_sets_late_states_aside(spark, tmp_path):
    box, late = cube(3, 3, 1, 4, 4, 4), cube(12, 12, 1, 3, 3, 4)
    states = [FLOOR | late, FLOOR | late | box, FLOOR | box]
    occ, grids, sizes = tables(spark, {"r": states})
    inbox = str(tmp_path / "in")
    order = [0, 2, 1, 0]                                     # state 2 waits for 1; the second 0 is late
    schema = occ.schema
    tracker = captures.CaptureTracker(spark, str(tmp_path / "state"), grids, P, bits=4, voxels=True)
    for n, s in enumerate(order):
        occ.filter(F.col("state") == s).coalesce(1).write.mode("append").parquet(inbox)
        q = tracker.start(spark.readStream.schema(schema).parquet(inbox)).start()
        q.processAllAvailable()
        q.stop()
    want = job.run_on_voxels(occ, grids, sizes, P, bits=4)
    cols = ["id", "added_in", "removed_in", "present", "voxels", "moved_from", "moved_to"]
    last = len(order) - 1
    assert sorted(map(tuple, tracker.read("objects", last).select(*cols).collect())) == sorted(map(tuple, want.objects.select(*cols).collect()))
    rows = lambda df: {tuple(r) for r in df.select("set_id", "state", "vox", "object_id").collect()}
    assert rows(tracker.read("labels", last)) == rows(want.labels) != set()
    assert tracker.read("late", last).select("state").distinct().collect()[0][0] == 0
    assert tracker.read("early", 1).count() == occ.filter("state = 2").count() and tracker.read("early", last).isEmpty()


def test_zoom_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 12)
    at = [0, 300, 1000, 1900, 2600, 9000, 9700]
    rows = [("u", t0 + dt.timedelta(milliseconds=m), "dolly", 2.0 + n, 3.0 + n) for n, m in enumerate(at)] + [("v", t0, "pan", 1.0, 1.0)]
    rows.append(("u", t0 + dt.timedelta(minutes=5), "dolly", 1.0, 1.5))        # moves the watermark past the rest
    df = spark.createDataFrame(rows, "session string, ts timestamp, verb string, d0 double, d1 double")
    batch = sessions.zoom_sessions(df).filter(F.col("ts") < t0 + dt.timedelta(minutes=1))
    assert [(r.ticks, r.d0, r.d1) for r in batch.orderBy("ts").collect()] == [(3, 2.0, 5.0), (2, 5.0, 7.0), (2, 7.0, 9.0)]
    alone = act.dolly_sessions(df)
    assert {(r.ticks, r.detail) for r in alone.collect()} == {(r.ticks, r.detail) for r in sessions.zoom_sessions(df).collect()}
    path = str(tmp_path / "moves")
    df.coalesce(1).write.parquet(path)
    got = drain(sessions.zoom_sessions(spark.readStream.schema(df.schema).parquet(path)), "zooms")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_another_gesture_ends_a_zoom_on_a_stream_too(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 12)
    story = [(0, "dolly", 5.0, 4.0), (250, "pan", 4.0, 4.0), (500, "dolly", 4.0, 3.0), (900, "dolly", 3.0, 2.5), (3000, "orbit", 2.5, 2.5), (3100, "dolly", 2.5, 3.5), (300_000, "pan", 1.0, 1.0)]
    rows = [("u", t0 + dt.timedelta(milliseconds=m), *r) for m, *r in story]
    df = spark.createDataFrame(rows, "session string, ts timestamp, verb string, d0 double, d1 double")
    want = sorted(map(tuple, act.dolly_sessions(df).collect()))
    assert [(r[3], r[4]) for r in want] == [(5.0, 4.0), (4.0, 2.5), (2.5, 3.5)]
    path = str(tmp_path / "moves")
    for part in ([rows[1], rows[3], rows[4]], [rows[0], rows[2], rows[5]], [rows[6]]):        # out of order over batches
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    got = drain(sessions.zoom_sessions(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)), "mixed_zooms")
    assert sorted(map(tuple, got.collect())) == want


def test_a_capture_in_parts_is_taken_up_when_it_is_whole(spark, tmp_path):
    box = cube(3, 3, 1, 4, 4, 4)
    occ, grids, sizes = tables(spark, {"r": [FLOOR, FLOOR | box]})
    i, j, k = v.unpack(F.col("vox"))
    splats = occ.select("set_id", "state", *[(c + o).cast("double").alias(n) for c, n, o in zip((i, j, k), "xyz", (0.25, 0.25, 0.25))]).withColumn("opacity", F.lit(0.9))
    splats = splats.unionByName(splats.withColumn("x", F.col("x") + 0.5)).withColumn("part", F.pmod(F.xxhash64("x", "y", "z"), F.lit(3)))
    expected = splats.groupBy("set_id", "state").agg(F.count("*").alias("rows")).cache()
    tracker = captures.CaptureTracker(spark, str(tmp_path / "state"), grids, P, bits=4, expected=expected)
    tracker.batch(splats.filter("state = 0"), 0)
    for n in range(3):
        tracker.batch(splats.filter((F.col("state") == 1) & (F.col("part") == n)), n + 1)
    assert tracker.read("progress", 2).first().last == 0 and not tracker.read("early", 2).isEmpty()
    want = job.run_on_voxels(occ, grids, sizes, P, bits=4)
    rows = lambda df: {tuple(r) for r in df.select("set_id", "state", "vox", "object_id").collect()}
    assert rows(tracker.read("labels", 3)) == rows(want.labels) != set()
    assert tracker.read("late", 3).isEmpty() and tracker.read("early", 3).isEmpty() and tracker.read("seen", 3).isEmpty()
    assert tracker.read("occ", 3).count() == occ.count()


def test_standing_alerts_stream_equals_batch(spark, tmp_path):
    story = {1: ["match", "off", "off", "missing"], 2: ["extra", "extra", "extra", "match"]}
    df = spark.createDataFrame([("a", r, n, k) for r, ks in story.items() for n, k in enumerate(ks)], "set_id string, root bigint, state int, k string")
    want = sorted(map(tuple, sessions.standing_alerts(df).collect()))
    assert want == [("a", 1, 1, "match", "off"), ("a", 1, 3, "off", "missing"), ("a", 2, 3, "extra", "match")]
    path = str(tmp_path / "in")
    for half in ("state < 2", "state >= 2"):
        df.filter(half).coalesce(1).write.mode("append").parquet(path)
    stale = spark.createDataFrame([("a", 1, 0, "off")], df.schema)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = sessions.standing_alerts(stream).writeStream.format("memory").queryName("alerts").outputMode("append").start()
    q.processAllAvailable()
    stale.coalesce(1).write.mode("append").parquet(path)
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("alerts").collect())) == want


def test_action_log_replayed_after_a_failure_equals_the_batch(spark, tmp_path):
    """The stream ends in the middle of a batch (rows written, heads not) and starts again; a batch taken a second time changes nothing."""
    start = dt.datetime(2026, 1, 1, 10)
    cast = [(f"s{k % 3}" if k % 7 else None, start + dt.timedelta(minutes=7 * k), ("pan", "orbit")[k % 2], f"d{k}", None if k % 5 else "x") for k in range(60)]
    cast.append(("s0", None, "pan", "no time", None))
    log = sessions.ActionLog(spark, str(tmp_path / "log"))
    df = spark.createDataFrame(cast, log.schema)
    inbox, check, parts = str(tmp_path / "in"), str(tmp_path / "check"), (cast[:20] + cast[60:], cast[20:45], cast[45:60])
    for n, part in enumerate(parts):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(inbox)
        if n == 1:
            whole = log.take

            def broken(batch, m):
                whole(batch.limit(11), m)             # half of the batch is there when it fails
                raise RuntimeError("lost")

            log.take = broken
            q = log.start(spark.readStream.schema(df.schema).parquet(inbox), check)
            try:
                q.awaitTermination()
                raise AssertionError("should have ended")
            except Exception as e:
                assert "lost" in str(e)
            log = sessions.ActionLog(spark, str(tmp_path / "log"))
        log.start(spark.readStream.schema(df.schema).parquet(inbox), check).awaitTermination()
    log.take(spark.createDataFrame(parts[1], df.schema), 1)
    want, ids = [], {}
    for part in parts:
        for s, t, verb, d, snap in sorted(part, key=lambda r: (r[1] is not None, r[1] or start)):
            ids[s] = ids.get(s, 0) + 1
            want.append((s, ids[s], t, verb, d, snap))
    got = [tuple(r) for r in log.read().select("session", "id", "ts", "verb", "detail", "snap").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    once = act.append(spark.createDataFrame([], "session string, id long, ts timestamp, verb string, detail string, snap string"), df.filter("ts is not null"))
    assert {(r.session, r.id, r.detail) for r in once.collect()} == {(s, i, d) for s, i, _, _, d, _ in want if s != "s0"} | {("s0", i - 1, d) for s, i, t, _, d, _ in want if s == "s0" and t}
