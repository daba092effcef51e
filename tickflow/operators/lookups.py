"""Joins with dimensions: modules, leap seconds, GPS readings, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Component classes by the thousands of a source id.
COMPONENTS = {1: "legacy-trigger", 3: "surface-handler", 4: "in-ice-trigger", 5: "surface-trigger", 6: "global-trigger", 7: "event-builder", 12: "hub"}


def reconciled(doms: DataFrame, active: DataFrame) -> DataFrame:
    """(mbid, state): configured modules that are usable, and those that were dropped."""
    ids = active.select("mbid").distinct()
    usable = doms.join(ids, "mbid", "left_semi").select("mbid", F.lit("usable").alias("state"))
    return usable.union(doms.join(ids, "mbid", "left_anti").select("mbid", F.lit("dropped").alias("state")))


def zero_filled(counts: DataFrame, keys: DataFrame, key: str, value: str, bins: DataFrame | None = None) -> DataFrame:
    """A count for every key (and bin): 0 where nothing was counted.  ``keys`` is a dimension of channels."""
    every = keys.select(key) if bins is None else keys.select(key).crossJoin(bins)
    on = every.columns
    return every.join(counts, on, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def with_channel(rows: DataFrame, doms: DataFrame) -> DataFrame:
    return rows.join(doms.select("mbid", "channel_id", "name", "string", "position"), "mbid")


def leap_seconds(days: DataFrame, table: DataFrame, day: str = "day") -> DataFrame:
    """``days`` with ``leap``, the offset in force: that of the latest row of the table (from_day, offset) on or before it.

    The table becomes intervals and is joined by range; it has a row for each leap second ever.
    """
    spans = table.withColumn("to_day", F.coalesce(F.lead("from_day").over(Window.orderBy("from_day")), F.lit(2**31 - 1)))
    return days.join(F.broadcast(spans), (F.col(day) >= F.col("from_day")) & (F.col(day) < F.col("to_day")), "left").withColumn("leap", F.coalesce("offset", F.lit(0))).drop("from_day", "to_day", "offset")


def component(source_id: str) -> Column:
    """Component class of a source id; null for negative or unknown ones."""
    names = F.create_map(*[F.lit(x) for pair in COMPONENTS.items() for x in pair])
    return F.when(F.col(source_id) >= 0, F.try_element_at(names, F.expr(f"cast({source_id} div 1000 as int)")))


def with_gps(tcal: DataFrame, gps: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Calibrations (seq, card, mbid) with ``gps_offset``, that of the card's latest GPS reading; null before the first.

    Both meet in blocks of arrival; a block begins with the last reading of those before it, from a window over
    one row for each block, so no task has a card's whole history.
    """
    readings = gps.where("gps_offset is not null").select("seq", "card", "gps_offset", F.expr(f"seq div {block}").alias("block"))
    asked = tcal.select("seq", "card", "mbid", F.expr(f"seq div {block}").alias("block"))
    both = asked.select("seq", "card", "mbid", "block", F.lit(None).cast("long").alias("offset"), F.lit(1).alias("wanted")).union(
        readings.select("seq", "card", F.lit(None).cast("long"), "block", F.col("gps_offset").cast("long"), F.lit(0))
    )
    lasts = readings.groupBy("card", "block").agg(F.max_by("gps_offset", "seq").alias("offset"))
    blocks = both.select("card", "block").distinct().join(lasts, ["card", "block"], "left")
    before = Window.partitionBy("card").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("card", "block", F.last("offset", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("card", "block").orderBy("seq", "wanted").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("here", F.last("offset", ignorenulls=True).over(inside)).where("wanted = 1")
    return found.join(carried, ["card", "block"]).select("seq", "card", "mbid", F.coalesce("here", "carried").alias("gps_offset"))


def discovered_and_configured(found: DataFrame, doms: DataFrame) -> DataFrame:
    return found.select("mbid").intersect(doms.select("mbid"))


def excluded(doms: DataFrame, without: DataFrame) -> DataFrame:
    return doms.select("mbid").exceptAll(without.select("mbid"))
