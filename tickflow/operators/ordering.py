"""Order of arrival and order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def time_ordered(hits: DataFrame) -> DataFrame:
    """Total order of time over all channels: a range shuffle and a sort in each range."""
    return hits.orderBy("utc", "mbid", "seq")


def backward_steps(hits: DataFrame, key: str = "hub_id", block: int = 1 << 20) -> DataFrame:
    """How often, for each hub, a record arrives before the time of the one ahead of it."""
    from .filters import order_violations

    return order_violations(hits, key, block).groupBy(key).agg(F.count(F.lit(1)).alias("backward"))


def enforced(hits: DataFrame, epsilon: int = 0, max_drops: int | None = None, block: int = 1 << 20) -> DataFrame:
    """Each record of a channel with ``kept``, and for those behind the running maximum ``cause``.

    A record is retrograde when its time is below the greatest time before it; such records never raise
    that maximum, so it is a plain running maximum.  Within ``epsilon`` they are kept.  The cause is
    ``clock`` if the module's own clock went back too, else ``translation``.  With ``max_drops`` the job fails
    when a channel drops more.  Windows are over blocks of arrival and over summaries of blocks, so no task
    has the whole history of a channel.
    """
    blocked = hits.withColumn("__block", F.expr(f"seq div {block}"))
    sums = blocked.groupBy("mbid", "__block").agg(F.max("utc").alias("__top"), F.max_by("domclk", "seq").alias("__clk"))
    ahead = Window.partitionBy("mbid").orderBy("__block")
    sums = sums.select("mbid", "__block", F.max("__top").over(ahead.rowsBetween(Window.unboundedPreceding, -1)).alias("__ahead"), F.lag("__clk").over(ahead).alias("__clk"))
    inside = Window.partitionBy("mbid", "__block").orderBy("seq")
    out = (
        blocked.join(sums, ["mbid", "__block"])
        .withColumn("top", F.greatest(F.max("utc").over(inside.rowsBetween(Window.unboundedPreceding, -1)), "__ahead"))
        .withColumn("last_clk", F.when(F.row_number().over(inside) > 1, F.lag("domclk").over(inside)).otherwise(F.col("__clk")))
        .withColumn("retrograde", F.coalesce(F.col("utc") < F.col("top"), F.lit(False)))
        .withColumn("kept", ~F.col("retrograde") | (F.col("top") - F.col("utc") <= epsilon))
        .withColumn("cause", F.when(F.col("retrograde"), F.when(F.col("domclk") < F.col("last_clk"), "clock").otherwise("translation")))
        .drop("last_clk", "__block", "__ahead", "__clk")
    )
    if max_drops is not None:
        drops = out.groupBy("mbid").agg(F.count_if(~F.col("kept")).alias("__drops"))
        out = out.join(drops, "mbid")
        out = out.withColumn("ok", F.assert_true(F.col("__drops") <= max_drops, F.lit("too many records out of order"))).where("ok is null").drop("ok", "__drops")
    return out


def _prefix_max(rows: DataFrame, key: str, value: str, block: int) -> DataFrame:
    """``rows`` with ``top``, the greatest value that arrived before in the whole of ``key``, by blocks of arrival."""
    blocked = rows.withColumn("__block", F.expr(f"seq div {block}"))
    tops = blocked.groupBy(key, "__block").agg(F.max(value).alias("__top"))
    ahead = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(key, "__block", F.max("__top").over(ahead).alias("__ahead"))
    inside = Window.partitionBy(key, "__block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return blocked.join(tops, [key, "__block"]).withColumn("top", F.greatest(F.max(value).over(inside), "__ahead")).drop("__block", "__ahead")


def without_steps_back(hits: DataFrame, key: str = "hub_id", block: int = 1 << 20) -> DataFrame:
    """Records that are not before the last kept one of their stream: those at the running maximum or above."""
    return _prefix_max(hits, key, "utc", block).where("top is null or utc >= top").drop("top")


def prescaled(rows: DataFrame, n: int, key: str = "hub_id", block: int = 1 << 20) -> DataFrame:
    """Every n-th record of a stream in order of arrival; all if n is not positive."""
    if n <= 0:
        return rows
    blocked = rows.withColumn("__block", F.expr(f"seq div {block}"))
    counts = blocked.groupBy(key, "__block").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "__block", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy(key, "__block").orderBy("seq")) + F.col("__before")
    return blocked.join(counts, [key, "__block"]).withColumn("__number", number).where(F.col("__number") % n == 0).drop("__block", "__before", "__number")


def digitizers_merged(hits: DataFrame, block: int = 60 * 40_000_000) -> DataFrame:
    """Rank of each hit in its channel when both digitizers are merged by clock, the second first on ties.

    Hits are ranked inside blocks of ``block`` clock counts (a minute), after the numbers of the blocks before.
    """
    blocked = hits.withColumn("__block", F.expr(f"domclk div {block}"))
    counts = blocked.groupBy("mbid", "__block").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy("mbid").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("mbid", "__block", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    order = Window.partitionBy("mbid", "__block").orderBy("domclk", F.desc("atwd_chip"), "seq")
    return blocked.join(counts, ["mbid", "__block"]).withColumn("rank", F.row_number().over(order) + F.col("__before")).drop("__block", "__before")


def last_n(rows: DataFrame, key: str, n: int, order: str = "seq") -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__r") <= n).drop("__r")


def readout_order(found: DataFrame) -> DataFrame:
    return found.orderBy("uid", "utc", "source_id", "mbid", "seq")


def dom_order(doms: DataFrame) -> DataFrame:
    return doms.orderBy("string", "position", "mbid")


def catalog_order(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("start_utc", "hub_id")


def first_time(hits: DataFrame) -> DataFrame:
    return hits.agg(F.min("utc").alias("first_utc"))
