"""Run monitoring: counters, histograms, rates, statistics and their messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SECOND
from ..functions.ticks import month_token
from .lookups import zero_filled

#: Ten minutes in ticks.
BIN = 600 * SECOND


def binned_counter(events: DataFrame, doms: DataFrame, width: int = BIN, key: str = "mbid", utc: str = "utc") -> DataFrame:
    """Counts of every configured channel in every bin with events: (key, first_utc, last_utc, n), 0 where unseen.

    Bins are aligned to multiples of the width; the first bin begins at the first event, the last ends at the last one.
    """
    bin_ = F.expr(f"({utc} div {width}) * {width}")
    counts = events.groupBy(key, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(utc).alias("lo"), F.max(utc).alias("hi"))
    whole = counts.agg(F.min("lo").alias("begin"), F.max("hi").alias("end"))
    filled = zero_filled(counts.select(key, "bin", "n"), doms, key, "n", counts.select("bin").distinct())
    return filled.crossJoin(F.broadcast(whole)).select(
        key, F.greatest("bin", "begin").alias("first_utc"), F.least(F.col("bin") + (width - 1), F.col("end")).alias("last_utc"), "n"
    )


def run_counter(events: DataFrame, key: str, zero_fill_from: DataFrame | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Number of events by key (and ``extra`` columns); every key of ``zero_fill_from`` appears."""
    counts = events.groupBy(key, *extra).agg(F.count(F.lit(1)).alias("n"))
    return counts if zero_fill_from is None else zero_filled(counts, zero_fill_from, key, "n")


def cable_histogram(isochrons: DataFrame, centres: DataFrame, bins: int = 100, width: float = 0.2e-9) -> DataFrame:
    """(mbid, bin, n): cable lengths around each channel's centre; bin -1 below, ``bins`` above; channels with under 8 samples are left out."""
    enough = isochrons.groupBy("mbid").agg(F.count(F.lit(1)).alias("samples")).where("samples >= 8")
    low = F.col("centre") - bins / 2 * width
    at = F.floor(F.round((F.col("cable") - low) / F.lit(width), 6)).cast("int")  # a millionth of a bin below an edge is on it
    placed = isochrons.join(enough, "mbid", "left_semi").join(centres, "mbid").withColumn("bin", F.when(at < 0, -1).when(at >= bins, bins).otherwise(at))
    return placed.groupBy("mbid", "bin").agg(F.count(F.lit(1)).alias("n"))


def histogram_centres(averages: DataFrame, first: int = 7) -> DataFrame:
    """Centre of each channel: its outlier-rejecting average (key, seq, average) after its first ``first`` samples."""
    number = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    return averages.withColumn("__n", number).where(F.col("__n") <= first).groupBy("key").agg(F.max_by("average", "seq").alias("centre")).withColumnRenamed("key", "mbid")


def channel_counters(hits: DataFrame, moni: DataFrame, tcals: DataFrame) -> DataFrame:
    """Counters of each channel: hits and their first and last time, monitoring records, overflows, calibrations by outcome."""
    h = hits.groupBy("mbid").agg(F.count(F.lit(1)).alias("hits"), F.sum((F.col("lc_mode") > 0).cast("long")).alias("lc_hits"), F.min("utc").alias("first_utc"), F.max("utc").alias("last_utc"))
    m = moni.groupBy("mbid").agg(F.count(F.lit(1)).alias("moni"), F.count_if(F.contains("text", F.lit("LBM OVERFLOW"))).alias("lbm_overflow"))
    t = tcals.groupBy("mbid").agg(F.count_if("ok").alias("valid_tcal"), F.count_if(~F.col("ok")).alias("error_tcal"), F.max("dor_tx").alias("last_dor"), F.max("dom_tx").alias("last_dom"))
    out = h.join(m, "mbid", "full").join(t, "mbid", "full")
    zero = ["hits", "lc_hits", "moni", "lbm_overflow", "valid_tcal", "error_tcal"]
    return out.select("mbid", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero], "first_utc", "last_utc", "last_dor", "last_dom")


def hub_rollup(doms: DataFrame, counters: DataFrame, seconds: float) -> DataFrame:
    """Channels, active channels, summed rates and overflows of each hub."""
    return doms.join(counters, "mbid", "left").groupBy("hub_id").agg(
        F.count(F.lit(1)).alias("channels"), F.count_if(F.coalesce("hits", F.lit(0)) > 0).alias("active"), (F.coalesce(F.sum("hits"), F.lit(0)) / F.lit(seconds)).alias("hit_rate"),
        (F.coalesce(F.sum("lc_hits"), F.lit(0)) / F.lit(seconds)).alias("lc_rate"), F.coalesce(F.sum("lbm_overflow"), F.lit(0)).alias("lbm_overflow"),
    )


def size_statistics(rows: DataFrame, key: str | None = None, size: str = "size") -> DataFrame:
    """Count, number of empty ones, and least, greatest, mean and sample variance of the others."""
    some = F.when(F.col(size) > 0, F.col(size))
    return rows.groupBy(*([key] if key else [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(size) == 0).alias("n_zero"), F.min(some).alias("least"), F.max(some).alias("most"), F.avg(some).alias("mean"), F.var_samp(some).alias("variance")
    )


def cycle_statistics(cycles: DataFrame, n: int = 10) -> DataFrame:
    """Messages and bytes of each cycle (id, cycle, size), the step from the cycle before, the mean bytes of the last ``n``; the last ``n`` are kept."""
    per = cycles.groupBy("id", "cycle").agg(F.count(F.lit(1)).alias("messages"), F.sum("size").alias("bytes"))
    order = Window.partitionBy("id").orderBy("cycle")
    per = per.withColumn("gap", F.col("cycle") - F.lag("cycle").over(order)).withColumn("sma", F.avg("bytes").over(order.rowsBetween(-(n - 1), 0)))
    return per.withColumn("__r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cycle")))).where(F.col("__r") <= n).drop("__r")


def message_intervals(hits: DataFrame, message: Column) -> DataFrame:
    """Hits, spans of both clocks and nanoseconds a hit of each message of a channel."""
    grouped = hits.withColumn("msg", message).groupBy("mbid", "msg")
    return grouped.agg(F.count(F.lit(1)).alias("n"), (F.max_by("domclk", "seq") - F.min_by("domclk", "seq")).alias("clk_span"), (F.max_by("utc", "seq") - F.min_by("utc", "seq")).alias("utc_span")).withColumn("ns_per_hit", F.col("utc_span") / 10 / F.col("n"))


def edge_times(hits: DataFrame, doms: DataFrame) -> DataFrame:
    """One row: the earliest last and the latest first time over all modules; 0 if one of them has none."""
    per = hits.groupBy("mbid").agg(F.min_by("utc", "seq").alias("first"), F.max_by("utc", "seq").alias("last"))
    every = doms.select("mbid").join(per, "mbid", "left")
    none = F.count_if(F.col("first").isNull()) > 0
    return every.agg(F.when(none, 0).otherwise(F.min("last")).alias("earliest_last"), F.when(none, 0).otherwise(F.max("first")).alias("latest_first"))


def scaler_timeline(bins: DataFrame, width: int) -> DataFrame:
    """Sum of scalers of each hub by bins of ``width`` ticks; ``bins`` has hub_id, utc and scaler."""
    return bins.groupBy("hub_id", F.expr(f"(utc div {width}) * {width}").alias("bin")).agg(F.sum("scaler").alias("scalers"), F.count(F.lit(1)).alias("n"))


def replay_totals(hits: DataFrame, gap: int = SECOND, key: str = "hub_id", block: int = 1 << 20) -> DataFrame:
    """Records, summed gaps of over ``gap`` and summed steps back of each stream, neighbours by blocks of arrival.

    The sums are decimal(38,0): some thousand steps of days are more ticks than a bigint holds.
    """
    blocked = hits.select(key, "seq", "utc", F.expr(f"seq div {block}").alias("block"))
    step = F.col("utc") - F.lag("utc").over(Window.partitionBy(key, "block").orderBy("seq"))
    inside = blocked.select(key, "utc", step.alias("step"))
    edges = blocked.groupBy(key, "block").agg(F.min_by("utc", "seq").alias("first"), F.max_by("utc", "seq").alias("last"))
    between = edges.select(key, F.lit(None).cast("long").alias("utc"), (F.col("first") - F.lag("last").over(Window.partitionBy(key).orderBy("block"))).alias("step"))
    total = lambda steps: F.coalesce(F.sum(steps.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")
    return inside.union(between).groupBy(key).agg(
        F.count("utc").alias("payloads"), total(F.when(F.col("step") > gap, F.col("step"))).alias("gap_time"), total(F.when(F.col("step") < 0, -F.col("step"))).alias("behind")
    )


def rollover_report(clocks: DataFrame, now: Column, warn_days: int = 65, critical_days: int = 78, prefix: str = "dom-clock-alert") -> DataFrame:
    """Channels whose clock (domclk) has run for over ``warn_days``, with the level of the whole report.

    A warning is sent once a month: its ``throttle_token`` is ``prefix`` with month and year of ``now``.  A
    critical report always goes, so it has none.
    """
    day = 24 * 3600 * 40_000_000
    late = clocks.where(F.col("domclk") > warn_days * day).withColumn("critical", F.col("domclk") > critical_days * day)
    level = late.agg(F.when(F.bool_or("critical"), "critical").otherwise("warning").alias("level"))
    token = F.when(F.col("level") == "warning", F.concat(F.lit(prefix + "-"), month_token(now)))
    return late.crossJoin(F.broadcast(level)).withColumn("throttle_token", token)


def email_alert(rows: DataFrame, condition: str, description: str, receiver: str, body: Column, variables: Column, token: Column | None = None) -> DataFrame:
    """An alert for each row: ``alert`` is the JSON of condition, desc, the mail (receiver, subject, body and
    throttleToken, which is left out where null) and vars, a map."""
    mail = F.struct(F.lit(receiver).alias("receiver"), F.lit(description).alias("subject"), body.alias("body"), (F.lit(None).cast("string") if token is None else token).alias("throttleToken"))
    whole = F.struct(F.lit(condition).alias("condition"), F.lit(description).alias("desc"), mail.alias("dbnotify"), variables.alias("vars"))
    return rows.withColumn("alert", F.to_json(whole))


def message(rows: DataFrame, name: str, priority: str, *values: str) -> DataFrame:
    """Monitoring messages: name, priority and the values as JSON."""
    return rows.select(F.lit(name).alias("name"), F.lit(priority).alias("priority"), F.to_json(F.struct(*values)).alias("body"))


def count_message(counts: DataFrame, doms: DataFrame, name: str, *by: str) -> DataFrame:
    """One message for each group: a JSON map from module location to count."""
    located = counts.join(doms.select("mbid", F.format_string("%02d-%02d", "string", "position").alias("at")), "mbid").groupBy(*by, "at").agg(F.sum("n").alias("n"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("at", "n"))))
    return located.groupBy(*by).agg(entries.alias("counts")).select(*by, F.lit(name).alias("name"), F.to_json("counts").alias("body"))
