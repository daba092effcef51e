"""The ring store: slices of time in a fixed number of slots, with a catalog kept as a log of updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spool import KEPT, SLICE, sliced

LOG = "hub_id int, slot bigint, slice bigint, start_utc bigint, last_utc bigint, part string"
#: Number of the batch that wrote a part of the log.
_NUMBER = "cast(substring_index(part, '-', -1) as bigint)"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _log(spark: SparkSession, path: str) -> DataFrame:
    """All updates: each part has the first and last time that a batch, or the batches up to one, saw of a slice."""
    store, at = _folder(spark, f"{path}/log")
    return spark.read.schema(LOG).option("basePath", f"{path}/log").parquet(f"{path}/log") if store.exists(at) else spark.createDataFrame([], LOG)


def _slots(log: DataFrame) -> DataFrame:
    """What each slot holds: its newest slice.  Least and greatest times, so an update that is read twice changes nothing."""
    slices = log.groupBy("hub_id", "slot", "slice").agg(F.min("start_utc").alias("start_utc"), F.max("last_utc").alias("last_utc"))
    newest = Window.partitionBy("hub_id", "slot").orderBy(F.desc("slice"))
    return slices.withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r")


def catalog(spark: SparkSession, path: str, slice_ticks: int = SLICE) -> DataFrame:
    """(hub_id, slot, slice, start_utc, stop_utc) of the slots: a hub's newest slice is still written, so it stops where its interval
    does; the others stop at their last hit.  From the log alone, at most ``kept`` rows a hub; hits are not read."""
    slots = _slots(_log(spark, path))
    open_ = F.col("slice") == F.max("slice").over(Window.partitionBy("hub_id"))
    return slots.withColumn("stop_utc", F.when(open_, F.col("start_utc") + (slice_ticks - 1)).otherwise(F.col("last_utc"))).drop("last_utc")


def compact(spark: SparkSession, path: str) -> None:
    """Replace the log's parts by one that has what the slots hold.  A reader or writer in between sees the same slots."""
    log = _log(spark, path)
    parts = [r[0] for r in log.select("part").distinct().collect()]
    top = max((int(p.rsplit("-", 1)[1]) for p in parts), default=None)
    if top is None:
        return
    _slots(log).repartition(1).write.mode("overwrite").parquet(f"{path}/log/part=upto-{top}")
    for part in parts:
        if part != f"upto-{top}":
            store, at = _folder(spark, f"{path}/log/part={part}")
            store.delete(at, True)


def ring_sink(path: str, slice_ticks: int = SLICE, kept: int = KEPT) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: hits into the ring of ``kept`` slots a hub, the catalog in step.

    A slice goes to slot ``slice`` modulo ``kept``; a newer one takes the place of what was there.  Hits of an
    older slice than their slot's are too late and are counted under ``late``.  A batch writes its own folder of
    each slice (dynamic partition overwrite), then its part of the log, then deletes what has lost its slot; one
    that runs again does the same again.  The log counts: until it is written readers see what was before.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = sliced(batch, slice_ticks).withColumn("slot", F.expr(f"pmod(slice, {kept})")).persist()
        try:
            held = _slots(_log(spark, path).where(f"{_NUMBER} < {number}"))
            seen = rows.groupBy("hub_id", "slot", "slice").agg(F.min("utc").alias("start_utc"), F.max("utc").alias("last_utc"), F.count(F.lit(1)).alias("n")).persist()
            both = seen.select("hub_id", "slot", "slice").union(held.select("hub_id", "slot", "slice"))
            newest = both.groupBy("hub_id", "slot").agg(F.max("slice").alias("slice"))
            keys = ["hub_id", "slot", "slice"]
            taken = seen.join(newest, keys).persist()
            into = rows.join(taken.select(*keys), keys).withColumn("batch", F.lit(number))
            into = into.repartition(*keys).sortWithinPartitions(*keys, "utc")
            into.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys, "batch").parquet(f"{path}/data")
            seen.join(newest, keys, "left_anti").select("hub_id", "slice", "n").repartition(1).write.mode("overwrite").parquet(f"{path}/late/part=batch-{number}")
            # what the slots held, and slices of this batch that a newer one of it displaced before they were written, are gone
            gone = held.join(taken.select("hub_id", "slot", F.col("slice").alias("by")), ["hub_id", "slot"]).where("slice < by").select(*keys).collect()
            taken.select("hub_id", "slot", "slice", "start_utc", "last_utc").repartition(1).write.mode("overwrite").parquet(f"{path}/log/part=batch-{number}")
            for hub, slot, old in gone:
                store, at = _folder(spark, f"{path}/data/hub_id={hub}/slot={slot}/slice={old}")
                store.delete(at, True)
        finally:
            for df in (rows, seen, taken):
                df.unpersist()

    return write


def late(spark: SparkSession, path: str) -> DataFrame:
    """(hub_id, slice, n): hits that came after their slot was given to a newer slice."""
    return spark.read.schema("hub_id int, slice bigint, n bigint").parquet(f"{path}/late/part=*")


def read_ring(spark: SparkSession, path: str, first: int, last: int, slice_ticks: int = SLICE) -> DataFrame:
    """Hits of the ring with ``first`` <= utc <= ``last``: the folders of their slices are opened, and what the catalog has in them counts."""
    from ..operators.filters import checked_range

    checked_range(first, last)
    held = catalog(spark, path, slice_ticks).where((F.col("start_utc") <= last) & (F.col("stop_utc") >= first)).select("hub_id", "slot", "slice")
    data = spark.read.parquet(f"{path}/data").where(F.col("slice").between(first // slice_ticks, last // slice_ticks) & F.col("utc").between(first, last))
    return data.withColumn("slot", F.col("slot").cast("long")).withColumn("slice", F.col("slice").cast("long")).join(held, ["hub_id", "slot", "slice"], "left_semi").drop("slot", "slice", "batch")
