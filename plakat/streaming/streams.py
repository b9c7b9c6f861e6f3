"""Streaming forms of the batch operators: an extension, with batch equivalence as its test."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """New parquet files of a folder as a stream."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)


def first_seen(stream: DataFrame, keys: list[str], event_time: str, late: str) -> DataFrame:
    """Drop repeats of a signature that arrive within the watermark; state is bounded by it."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, event_time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts a tumbling window; rows later than the watermark are left out."""
    w = F.window(event_time, width)
    return stream.withWatermark(event_time, late).groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(stream: DataFrame, event_time: str, user: str, gap: str, late: str) -> DataFrame:
    """Session windows of each user."""
    w = F.session_window(event_time, gap)
    return stream.withWatermark(event_time, late).groupBy(w, user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


#: Parts of a table that ``upsert_batches`` writes apart, by hash of the key.
PARTS = 64


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, merge: Callable[[DataFrame, DataFrame, str, str], DataFrame], parts: int = PARTS) -> StreamingQuery:
    """Merge each micro-batch into a parquet table by a batch operator that works key by key.

    The table lies in ``parts`` parts by hash of the key; a batch reads and writes only the parts its keys are in, as a version folder of its own. A rerun of a batch
    writes the same version, so a lost executor or a restart doesn't apply it twice. Versions none of whose parts are the latest are removed,
    but for the one before the last, which a reader may still hold.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")
        touched = sorted(r[0] for r in batch.select(part.alias("p")).distinct().collect())  # at most PARTS numbers
        before = latest(spark, path, below=number)
        have = [before[p] for p in touched if p in before]
        stored = spark.read.schema(batch.schema).parquet(*have) if have else batch.limit(0)
        merge(stored, batch, key, order).withColumn("_part", part).write.mode("overwrite").partitionBy("_part").parquet(f"{path}/v={number}")
        retire(spark, path)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def _folder(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of a table written by ``upsert_batches``."""
    root, fs = _folder(spark, path)
    if not fs.exists(root):
        return []
    done = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def latest(spark: SparkSession, path: str, below: int | None = None) -> dict[int, str]:
    """Folder of the latest version of each part, among versions below a number."""
    out: dict[int, str] = {}
    _, fs = _folder(spark, path)
    for v in versions(spark, path):
        if below is None or v < below:
            for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}")):
                name = s.getPath().getName()
                if name.startswith("_part="):
                    out[int(name[6:])] = f"{path}/v={v}/{name}"
    return out


def retire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove the parts that newer versions replace; the last ``keep`` versions stay as they are."""
    done = versions(spark, path)
    _, fs = _folder(spark, path)
    live = set(latest(spark, path).values())
    if len(done) > keep:
        live |= set(latest(spark, path, below=done[-keep] + 1).values())  # what a reader of the version before may hold
    for v in done[:-keep]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}")
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        kept = [n for n in names if n.startswith("_part=") and f"{path}/v={v}/{n}" in live]
        for n in names:
            if n.startswith("_part=") and n not in kept:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, n), True)
        if not kept:
            fs.delete(folder, True)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table: the latest version of each part."""
    return spark.read.parquet(*sorted(latest(spark, path).values()))


def buckets(df: DataFrame, event_time: str, width: str = "1 day") -> DataFrame:
    """Batch counterpart of ``windowed_counts``."""
    return df.groupBy(F.window(event_time, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def live(stream: DataFrame, end: Column, as_of: Column) -> DataFrame:
    """Rows that aren't over."""
    return stream.where(end >= as_of)
