import json
import os

from pyspark.sql import functions as F

from lattica.operators import composition
from lattica.sources import listing, sinks
from lattica.streaming import status


def test_listing_of_folders(spark, tmp_path):
    for name in ("b1/x/a.PNG", "b1/b.txt", "b2/c.jpeg"):
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_bytes(b"123")
    found = listing.objects(spark, str(tmp_path / "root"))
    assert sorted((r.bucket, r.key, r.size) for r in found.collect()) == [("b1", "b.txt", 3), ("b1", "x/a.PNG", 3), ("b2", "c.jpeg", 3)]
    images = listing.objects(spark, str(tmp_path / "root"), [".png", ".jpeg"])
    assert sorted(r.key for r in images.collect()) == ["c.jpeg", "x/a.PNG"]
    picked = listing.selected(found, ["b2", "none", "b1"]).orderBy("bucket_pos", "pos").collect()
    assert [(r.bucket_pos, r.pos, r.key) for r in picked] == [(0, 0, "c.jpeg"), (2, 0, "b.txt"), (2, 1, "x/a.PNG")]
    assert {r.bucket for r in listing.buckets(found).collect()} == {"b1", "b2"}


def test_valid_images(spark):
    rows = [("p", bytes.fromhex("89504E470D0A1A0A000000000049454E44AE426082")), ("c", bytes.fromhex("89504E470D0A1A0A00")), ("j", bytes.fromhex("FFD8FFE0")), ("g", b"GIF89a"), ("t", b"text"), ("e", b""), ("n", None)]
    files = spark.createDataFrame(rows, "name string, content binary")
    assert sorted(r.name for r in listing.valid_images(files).collect()) == ["g", "j", "p"]


def test_points_and_rows(spark):
    df = listing.rows_table(spark, [(1, [2.0, None, 4.0]), (2, [])], "k long, ys array<double>")
    assert [(r.k, r.x, r.y) for r in listing.series_points(df, "ys", 1, 0.5).orderBy("idx").collect()] == [(1, 1.0, 2.0), (1, 1.5, None), (1, 2.0, 4.0)]


def test_delimited_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"q'), ("line", "x")], "l string, m string")
    sinks.write_delimited(df, str(tmp_path / "out"), bom=True)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text.startswith('"﻿l","m"') and '"a,b","q""q"' in text
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert sinks.header_line(['a"b', "c"]) == '"a""b","c"'


def test_manifest_repeats_the_last_file(spark):
    frames = spark.createDataFrame([("k", 2, "b.png"), ("k", 1, "a.png")], "key string, pos long, path string")
    lines = [r.line for r in sinks.manifest(frames, ["key"]).orderBy("line_no").collect()]
    assert lines == ["file 'a.png'", "duration 1", "file 'b.png'", "duration 1", "file 'b.png'"]


def test_append_and_batches(spark, tmp_path):
    for _ in range(2):
        sinks.append(spark.range(3), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6
    files = spark.range(60).select(F.when(F.col("id") < 51, "big").otherwise("small").alias("batch"), "id")
    assert {(r.batch, r.accepted) for r in sinks.upload_batches(files).collect()} == {("big", False), ("small", True)}


def test_a_failed_upload_hinders_no_other(spark):
    files = spark.createDataFrame([("a", "x.png", 0), ("a", "y.png", 5), ("a", "z", None), ("b", "u.png", 5), ("b", "v.png", 0), ("b", "w.png", 1), ("b", "t.png", 1)], "batch string, name string, size int")
    faults = {"empty": F.coalesce("size", F.lit(0)) == 0, "no suffix": ~F.col("name").contains(".")}
    got = {r.name: r.error for r in sinks.upload_outcomes(files, "batch", faults, 3).collect()}
    assert got == {"x.png": "empty", "y.png": None, "z": "empty"} | dict.fromkeys(["u.png", "v.png", "w.png", "t.png"], "too many files")


def test_composition_plan(spark):
    bg = spark.createDataFrame([(1, f"{c}.png") for c in "abcde"] + [(1, "z.txt")], "id long, object string")
    fg = spark.createDataFrame([(1, f"{c}.jpg") for c in "xyz"], "id long, object string")
    plan = composition.frames(bg, fg, ["id"], right_to_left=True)
    assert [(r.name, r.bg_key, r.fg_key, r.start) for r in plan.orderBy("pos").collect()] == [("merged_000", "a.png", "z.jpg", 0), ("merged_001", "b.png", "y.jpg", 1000), ("merged_002", "c.png", "x.jpg", 2000)]
    assert [(r.name, r.first_name, r.second_name) for r in composition.composites(plan, ["id"]).collect()] == [("frame_0000", "merged_000", "merged_001")]
    sized = composition.side_by_side(plan.withColumn("w", F.lit(101)).withColumn("h", F.lit(51)), "w", "h").first()
    assert (sized.frame_w, sized.frame_h) == (152, 52)


def test_status_stream(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps({"task_id": t, "seq": s, "status": x}) for t, s, x in [(1, 1, "Processing"), (2, 1, "Processing"), (1, 2, "Completed")]))
    status.run(spark, str(folder), str(tmp_path / "table"), str(tmp_path / "ck"))
    (folder / "2.json").write_text(json.dumps({"task_id": 2, "seq": 2, "status": "failed"}))
    status.run(spark, str(folder), str(tmp_path / "table"), str(tmp_path / "ck"))
    last = status.current(spark, str(tmp_path / "table"))
    assert sorted((r.task_id, r.seq, r.status) for r in last.collect()) == [(1, 2, "completed"), (2, 2, "failed")]


def test_status_batches_rewrite_their_buckets_alone(spark, tmp_path):
    folder, out = tmp_path / "events", str(tmp_path / "table")
    folder.mkdir()
    kinds = ["Processing", "completed", "failed", "processing"]
    every = [(t, s, kinds[(t * 7 + s * 3) % 4]) for t in range(40) for s in range(1, 7)]
    for n, part in enumerate([every[:150], [e for e in every[150:] if e[0] % 2] + every[3:9], [e for e in every[150:] if not e[0] % 2]]):
        (folder / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("task_id", "seq", "status"), e, strict=True))) for e in part))
        os.utime(folder / f"{n}.json", (1_700_000_000 + n,) * 2)
    status.run(spark, str(folder), out, str(tmp_path / "ck"), buckets=8, files_a_batch=1)
    want = {}  # a loop over the events in order; parts hold a task's events in order
    for t, s, x in every:
        at, was = want.get(t, (0, "uncompleted"))
        if (was, x.lower()) in status.STEPS and s > at:
            want[t] = (s, x.lower())
    assert {r.task_id: (r.seq, r.status) for r in status.current(spark, out).collect()} == want
    # the third batch, of a single task, touches its bucket alone and leaves no version but the last two
    (folder / "9.json").write_text(json.dumps({"task_id": 1000, "seq": 1, "status": "processing"}))
    before = status.versions(spark, out)
    status.run(spark, str(folder), out, str(tmp_path / "ck"), buckets=8, files_a_batch=1)
    after = status.versions(spark, out)
    assert sum(before.get(b) != n for b, n in after.items()) == 1 and max(after.values()) == 3
    held = {(int(p.parent.name), int(p.name.split("=")[1])) for p in (tmp_path / "table" / "data").glob("*/bucket=*")}
    assert held == {(n, b) for v in (before, after) for b, n in v.items()}
    assert sorted(p.name for p in (tmp_path / "table" / "versions").iterdir()) == ["2", "3"]


def test_a_batch_that_is_run_again_gives_the_same(spark, tmp_path):
    folder, out = tmp_path / "events", str(tmp_path / "table")
    folder.mkdir()
    for n, x in enumerate(["processing", "failed", "processing"]):
        (folder / f"{n}.json").write_text(json.dumps({"task_id": 5, "seq": n + 1, "status": x}))
        os.utime(folder / f"{n}.json", (1_700_000_000 + n,) * 2)  # batches take files in the order of their times
    status.run(spark, str(folder), out, str(tmp_path / "ck"), files_a_batch=1)
    (tmp_path / "ck" / "commits" / "2").unlink()  # as if the driver was lost before the batch was committed
    (tmp_path / "ck" / "commits" / ".2.crc").unlink(missing_ok=True)
    status.run(spark, str(folder), out, str(tmp_path / "ck"), files_a_batch=1)
    assert [tuple(r) for r in status.current(spark, out).collect()] == [(5, 3, "processing")]
    assert status.current(spark, str(tmp_path / "none")).collect() == []


def test_invalid_steps_are_told(spark):
    df = spark.createDataFrame([(1, 1, "Processing"), (1, 2, "completed"), (1, 3, "processing"), (2, 1, "Completed")], "task_id long, seq long, status string")
    assert [r.valid for r in status.valid_steps(df).orderBy("task_id", "seq").collect()] == [True, True, False, False]


def test_windowed_counts_as_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 00:11:00", "b")], "t string, kind string").select(F.to_timestamp("t").alias("at"), "kind").write.parquet(str(src))
    stream = spark.readStream.schema("at timestamp, kind string").parquet(str(src))
    query = status.windowed_counts(stream, "at", "kind").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.kind, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]


def test_catalogue_in_a_database(spark):
    """Derby comes with Spark; a filter on the read is pushed down to it."""
    url = "jdbc:derby:memory:catalogue;create=true"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string").write.format("jdbc").option("url", url).option("dbtable", "buckets").save()
    got = listing.jdbc(spark, url, "buckets").where("id >= 2").select("name")
    assert sorted(r[0] for r in got.collect()) == ["b", "c"]
    assert "PushedFilters: [*IsNotNull" in got._jdf.queryExecution().toString()


def test_events_that_are_no_step_are_refused(spark):
    kinds = "task_id long, seq long, status string"
    table = spark.createDataFrame([(1, 2, "completed"), (2, 1, "processing"), (5, 1, "processing")], kinds)
    batch = spark.createDataFrame([(1, 3, "processing"), (2, 3, "Processing"), (2, 2, "failed"), (3, 1, "completed"), (4, 1, "Processing"), (4, 2, "completed"), (4, 3, "failed")], kinds)
    got = sorted((r.task_id, r.seq, r.status) for r in status.folded(table, batch).collect())
    assert got == [(1, 2, "completed"), (2, 3, "processing"), (4, 2, "completed"), (5, 1, "processing")]
