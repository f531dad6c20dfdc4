"""The task status workflow as a stream of events.

uncompleted -> processing -> completed or failed; an event that is no step from the
present status is refused. Files of events are read as a stream, and each micro-batch
is folded into the status table by the function given to ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS, VERSIONS = "task_id long, seq long, status string", "bucket int, number int"
BUCKETS = 64
STEPS = {("uncompleted", "processing"), ("processing", "completed"), ("processing", "failed"), ("failed", "processing")}


def events(spark: SparkSession, folder: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of JSON event files."""
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).json(folder)


def valid_steps(history: DataFrame) -> DataFrame:
    """Events with ``valid``: whether each is a step from the one before, statuses compared without case."""
    now, before = F.lower("status"), F.coalesce(F.lower(F.lag("status").over(Window.partitionBy("task_id").orderBy("seq"))), F.lit("uncompleted"))
    step = F.concat_ws(">", before, now)
    return history.withColumn("valid", step.isin(*[f"{a}>{b}" for a, b in sorted(STEPS)]))


def folded(table: DataFrame, batch: DataFrame) -> DataFrame:
    """The status table (task_id, seq, status) after a batch: a task's events are applied in
    order from its status, and one that is no step from there, or not later, is refused."""
    own = batch.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.lower("status").alias("status")))).alias("events"))
    both = table.select("task_id", F.struct("seq", "status").alias("now")).join(own, "task_id", "full_outer")

    def applied(now, event):
        step = F.concat_ws(">", F.coalesce(now["status"], F.lit("uncompleted")), event["status"]).isin(*[f"{a}>{b}" for a, b in sorted(STEPS)])
        return F.when(step & (now["seq"].isNull() | (event["seq"] > now["seq"])), event).otherwise(now)

    start = F.coalesce("now", F.struct(F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("status")))
    after = both.select("task_id", F.aggregate(F.coalesce("events", F.array().cast("array<struct<seq:bigint,status:string>>")), start, applied).alias("now"))
    return after.where("now.status is not null").select("task_id", "now.seq", "now.status")


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _drop(spark: SparkSession, path: str) -> None:
    files, p = _files(spark, path)
    files.delete(p, True)


def versions(spark: SparkSession, out: str, number: int | None = None) -> dict[int, int]:
    """The batch that last wrote each bucket, as of the batch ``number`` (the last one without it)."""
    files, p = _files(spark, f"{out}/versions")
    if not files.exists(p):
        return {}
    known = [int(f.getPath().getName()) for f in files.listStatus(p)]
    at = max(known, default=-1) if number is None else number
    if at not in known:
        return {}
    return {r["bucket"]: r["number"] for r in spark.read.schema(VERSIONS).parquet(f"{out}/versions/{at}").collect()}  # a row for each bucket


def current(spark: SparkSession, out: str, of: dict[int, int] | None = None) -> DataFrame:
    """The status table (task_id, seq, status), or the part of it in the buckets ``of`` these versions."""
    of = versions(spark, out) if of is None else of
    paths = [f"{out}/data/{n}/bucket={b}" for b, n in of.items()]
    return spark.read.schema(EVENTS).parquet(*paths) if paths else spark.createDataFrame([], EVENTS)


def run(spark: SparkSession, folder: str, out: str, checkpoint: str, buckets: int = BUCKETS, files_a_batch: int | None = None) -> None:
    """Folds what is in ``folder`` into the status table below ``out``.

    The table lies in ``buckets`` by task. A batch reads and rewrites only the buckets that its
    tasks lie in, and then puts down which batch wrote each bucket last; readers go by that,
    so they see a batch whole or not at all. A batch that is run again, after a failure, finds
    the versions before it, which go only when the next batch has ended.
    """
    bucket = F.pmod(F.xxhash64("task_id"), F.lit(buckets)).cast("int").alias("bucket")

    def fold(batch: DataFrame, number: int) -> None:
        before = versions(spark, out, number - 1) if number else {}
        touched = [r["bucket"] for r in batch.select(bucket).distinct().collect()]  # ``buckets`` at most
        old = current(spark, out, {b: before[b] for b in touched if b in before})
        folded(old, batch).select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/data/{number}")
        files, p = _files(spark, f"{out}/data/{number}")
        written = {int(f.getPath().getName().split("=")[1]) for f in files.listStatus(p) if "=" in f.getPath().getName()}
        after = before | dict.fromkeys(written, number)
        spark.createDataFrame(sorted(after.items()), VERSIONS).coalesce(1).write.mode("overwrite").parquet(f"{out}/versions/{number}")
        if number > 1:
            earlier = versions(spark, out, number - 2)
            for b, n in earlier.items():
                if n not in (before.get(b), after.get(b)):
                    _drop(spark, f"{out}/data/{n}/bucket={b}")
            _drop(spark, f"{out}/versions/{number - 2}")

    query = events(spark, folder, files_a_batch).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(stream: DataFrame, at: str, kind: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events for each window and kind, late ones up to a watermark (an extension)."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"))
