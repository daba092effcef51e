"""Filters and predicates on hits, monitoring records and clock samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DAY, EOS, SECOND


def without_eos(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("utc") != EOS)


def forwarded(hits: DataFrame, isolated: bool = False) -> DataFrame:
    """Hits for the trigger: coincident ones, those of trigger mode 4, or all with ``isolated``."""
    return hits if isolated else hits.where("lc_mode <> 0 or trigger_mode = 4")


def long_enough(records: DataFrame, least: int = 38) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) by record length."""
    ok = F.col("rec_len") >= least
    return records.where(ok), records.where(~ok)


def sane_times(hits: DataFrame, max_gap: int = DAY, slice_ticks: int = 15 * SECOND, key: str = "hub_id") -> DataFrame:
    """Drop negative times and all that follows a jump of more than ``max_gap`` in a hub's time order.

    The jump is found on summaries of time slices and on neighbours inside a slice, so no hub is one task.
    """
    positive = hits.where("utc >= 0").withColumn("slice", F.expr(f"utc div {slice_ticks}"))
    inside = Window.partitionBy(key, "slice").orderBy("utc")
    jumps = positive.withColumn("gap", F.col("utc") - F.lag("utc").over(inside)).where(F.col("gap") > max_gap).select(key, "utc")
    ends = positive.groupBy(key, "slice").agg(F.min("utc").alias("utc"), F.max("utc").alias("last"))
    between = ends.withColumn("gap", F.col("utc") - F.lag("last").over(Window.partitionBy(key).orderBy("slice"))).where(F.col("gap") > max_gap)
    first = jumps.union(between.select(key, "utc")).groupBy(key).agg(F.min("utc").alias("first_gap"))
    return positive.drop("slice").join(first, key, "left").where("first_gap is null or utc < first_gap").drop("first_gap")


def registered(hits: DataFrame, doms: DataFrame) -> DataFrame:
    return hits.join(doms.select("mbid"), "mbid", "left_semi")


def unregistered_counts(hits: DataFrame, doms: DataFrame) -> DataFrame:
    return hits.join(doms.select("mbid"), "mbid", "left_anti").groupBy("mbid").agg(F.count(F.lit(1)).alias("dropped"))


def quick_samples(samples: DataFrame, max_exec_ns: int) -> DataFrame:
    """Clock samples that did not take too long."""
    return samples.where(F.col("exec_ns") <= max_exec_ns)


def length_violations(records: DataFrame, raw: str = "raw") -> DataFrame:
    """Records whose stated length is not that of their bytes."""
    return records.where(F.col("rec_len") != F.octet_length(raw))


def order_violations(hits: DataFrame, key: str = "hub_id", block: int = 1 << 20) -> DataFrame:
    """(key, seq, utc, before): records that come before the one that arrived before them.

    Neighbours inside a block of arrival numbers are compared by a window, block ends by a window over blocks.
    """
    blocked = hits.select(key, "seq", "utc", F.expr(f"seq div {block}").alias("block"))
    inside = blocked.withColumn("before", F.lag("utc").over(Window.partitionBy(key, "block").orderBy("seq")))
    edges = blocked.groupBy(key, "block").agg(F.min_by("utc", "seq").alias("utc"), F.min("seq").alias("seq"), F.max_by("utc", "seq").alias("last"))
    edges = edges.withColumn("before", F.lag("last").over(Window.partitionBy(key).orderBy("block")))
    columns = [key, "seq", "utc", "before"]
    return inside.where("utc < before").select(*columns).union(edges.where("utc < before").select(*columns))


def monitor_texts(moni: DataFrame) -> DataFrame:
    """Overflow and start-of-run messages among the monitoring records."""
    return moni.select("seq", "mbid", F.contains("text", F.lit("LBM OVERFLOW")).alias("overflow"), F.startswith("text", F.lit("Starting run")).alias("run_start")).where("overflow or run_start")


def in_runs(rows: DataFrame, runs: DataFrame, utc: str = "utc", slice_ticks: int = 10 * DAY) -> DataFrame:
    """Rows inside an active run, with its number: a range join on time slices."""
    spans = runs.withColumn("__slice", F.explode(F.sequence(F.expr(f"start_utc div {slice_ticks}"), F.expr(f"stop_utc div {slice_ticks}"))))
    return (
        rows.withColumn("__slice", F.expr(f"{utc} div {slice_ticks}"))
        .join(spans, "__slice")
        .where(F.col(utc).between(F.col("start_utc"), F.col("stop_utc")))
        .drop("__slice", "start_utc", "stop_utc")
    )


def checked_range(first: int, last: int) -> None:
    if last < first:
        raise ValueError(f"invalid range: {first} to {last}")


def invalid_elements(elements: DataFrame) -> DataFrame:
    return elements.where("last_utc < first_utc")


def very_good_gps(gps: DataFrame) -> DataFrame:
    return gps.where("quality = 32")


def emitted_tcals(tcal: DataFrame, runs: DataFrame) -> DataFrame:
    """Calibration records that are put out: those inside a run; calibration itself reads all."""
    return in_runs(tcal, runs)
