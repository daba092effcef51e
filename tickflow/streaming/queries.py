"""Structured Streaming forms of the operators.  Inputs are streams; functions return streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ticks import event_time
from ..operators.filters import forwarded
from ..operators.ranges import accepts, taken_before
from ..schemas import HOUR, SECOND
from .bins import hub_bins, run_bins
from .calibration import calibrated_hits

__all__ = ["batch_sink", "binned_counts", "calibrated_hits", "continuous_readout", "counts_by_run", "dealt_by_cores", "hub_bins", "rocksdb", "run_bins", "run_to_end", "with_event_time"]
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, as those with stateful processors must.

    A batch ships what it changed, not a snapshot of all.  The session's own settings stay.
    """
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def dealt_by_cores(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside deal their state into two parts a core at most: a part costs files in every batch, however little it holds."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(before), 2 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def with_event_time(hits: DataFrame, year: int, delay: str) -> DataFrame:
    """Hits with ``event_ts`` and a watermark on it; later events than the delay allows are dropped and counted by Spark."""
    return hits.withColumn("event_ts", event_time("utc", year)).withWatermark("event_ts", delay)


def binned_counts(hits: DataFrame, width: str = "10 minutes", key: str = "mbid") -> DataFrame:
    """Counts by tumbling window of ``event_ts`` and channel, put out once the watermark has passed a window."""
    return hits.groupBy(F.window("event_ts", width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def continuous_readout(hits: DataFrame, requests: DataFrame, year: int, delay: str = "1 hour", slice_ticks: int = HOUR) -> DataFrame:
    """Hits of each request as both arrive, once a request: a stream-stream join by time slice.

    ``requests`` has uid and ``elements``, an array of structs.  Elements are cut at slices, so that the join
    is an equi-join and each part is at most as long as a slice: that bound, with the range condition on
    event times, lets Spark drop hits and parts that no later row can meet, however long an element is.  A hit
    is in one slice, so it meets an element once; one that an earlier element of the request takes is left to that.
    """
    h = with_event_time(hits.select("seq", "hub_id", "mbid", "utc"), year, delay).withColumn("slice", F.expr(f"utc div {slice_ticks}"))
    e = requests.select("uid", F.explode("elements").alias("one"), "elements").withColumn("earlier", F.filter("elements", lambda x: x["elem"] < F.col("one.elem")))
    e = e.select("uid", "one.*", "earlier").where("first_utc <= last_utc")
    e = e.withColumn("e_slice", F.explode(F.sequence(F.expr(f"first_utc div {slice_ticks}"), F.expr(f"last_utc div {slice_ticks}"))))
    e = e.withColumn("part_first", F.greatest("first_utc", F.expr(f"e_slice * {slice_ticks}"))).withColumn("part_last", F.least("last_utc", F.expr(f"(e_slice + 1) * {slice_ticks} - 1")))
    e = e.withColumn("first_ts", event_time("part_first", year)).withColumn("last_ts", event_time("part_last", year)).withWatermark("last_ts", delay)
    long = F.expr(f"interval {-(-slice_ticks // SECOND)} seconds")
    within = (F.col("slice") == F.col("e_slice")) & F.col("utc").between(F.col("first_utc"), F.col("last_utc")) & (F.col("event_ts") >= F.col("first_ts")) & (F.col("event_ts") <= F.col("last_ts"))
    met = h.join(e, within & (F.col("last_ts") <= F.col("event_ts") + long), "inner")
    return met.where(accepts() & ((F.size("earlier") == 0) | ~taken_before())).select("uid", "elem", "seq", "hub_id", "mbid", "utc")


def counts_by_run(events: DataFrame) -> DataFrame:
    """Counts of each run and channel, put out when the run ends; its state goes with it.  ``events`` as for ``run_bins``."""
    return run_bins(events, 1 << 62).where("not late").select("run_number", "mbid", "n")


def batch_sink(store: str, thin: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: all hits to the store, those for the trigger to ``thin``.  A batch that runs again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
            forwarded(batch).write.mode("overwrite").parquet(f"{thin}/batch={number}")
        finally:
            batch.unpersist()

    return write


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there and stop; results as Parquet under ``path``."""
    with rocksdb(stream.sparkSession):
        running = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
