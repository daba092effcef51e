"""The time-sliced store: slices, catalog, retention, and the sinks of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import SECOND

#: Ticks of a slice and number of slices that a store keeps.
SLICE, KEPT = 15 * SECOND, 18000


def sliced(hits: DataFrame, slice_ticks: int = SLICE) -> DataFrame:
    return hits.withColumn("slice", F.expr(f"utc div {slice_ticks}"))


def write_spool(hits: DataFrame, path: str, slice_ticks: int = SLICE, mode: str = "append") -> None:
    """Write hits by hub and slice, in time order inside a file, so that statistics on ``utc`` prune row groups."""
    s = sliced(hits, slice_ticks)
    s.repartition("hub_id", "slice").sortWithinPartitions("hub_id", "slice", "utc").write.mode(mode).partitionBy("hub_id", "slice").parquet(path)


def read_range(spark: SparkSession, path: str, first: int, last: int, slice_ticks: int = SLICE) -> DataFrame:
    """Hits of a spool in a range of times; only the folders of its slices are opened."""
    from ..operators.ranges import in_range

    return in_range(spark.read.parquet(path), first, last, slice_ticks)


def catalog(hits: DataFrame, slice_ticks: int = SLICE) -> DataFrame:
    """(hub_id, slice, start_utc, stop_utc): what each slice holds."""
    return sliced(hits, slice_ticks).groupBy("hub_id", "slice").agg(F.min("utc").alias("start_utc"), F.max("utc").alias("stop_utc"))


def open_slices(starts: DataFrame, slice_ticks: int = SLICE) -> DataFrame:
    """Catalog rows of slices that are still written: they stop where their interval does."""
    return starts.withColumn("stop_utc", F.col("start_utc") + (slice_ticks - 1))


def overlapping(cat: DataFrame, first: int, last: int) -> DataFrame:
    return cat.where((F.col("start_utc") <= last) & (F.col("stop_utc") >= first)).orderBy("start_utc", "hub_id")


def retained(cat: DataFrame, kept: int = KEPT) -> DataFrame:
    """Catalog rows that are left when each slice overwrites what had its place modulo ``kept``."""
    newest = Window.partitionBy("hub_id", F.col("slice") % kept).orderBy(F.desc("slice"))
    return cat.withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r")


def write_streams(streams: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    """Write the four streams under folders ``stream=<name>``."""
    for name, rows in streams.items():
        rows.write.mode(mode).parquet(f"{path}/stream={name}")


def tee(rows: DataFrame, *sinks) -> None:
    """Give each sink (a function of a DataFrame) the same rows, computed once."""
    rows = rows.persist()
    try:
        for sink in sinks:
            sink(rows)
    finally:
        rows.unpersist()


def captured(tcal: DataFrame, only: list[int] | None = None, generations: int = 2, per_generation: int = 100) -> DataFrame:
    """Calibrations to capture: all or those of listed modules, of the newest ``generations`` of arrival."""
    rows = tcal if only is None else tcal.where(F.col("mbid").isin(only))
    rows = rows.withColumn("generation", F.expr(f"seq div {per_generation}"))
    top = rows.agg(F.max("generation").alias("top"))
    return rows.crossJoin(F.broadcast(top)).where(F.col("generation") > F.col("top") - generations).drop("top")
