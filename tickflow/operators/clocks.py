"""Clock triangulation and offset samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _carried(rows: DataFrame, key: list[str], value: str, block: int) -> DataFrame:
    """``rows`` with the last ``value`` of their key that is not null and not of a later arrival, by blocks of arrival."""
    blocked = rows.withColumn("__block", F.expr(f"seq div {block}"))
    edges = blocked.groupBy(*key, "__block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("seq"))).alias("__edge"))
    ahead = Window.partitionBy(*(key or [F.lit(0)])).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*key, "__block", F.last("__edge", ignorenulls=True).over(ahead).alias("__edge"))
    inside = Window.partitionBy(*key, "__block").orderBy("seq", F.col(value).isNull()).rowsBetween(Window.unboundedPreceding, 0)
    now = blocked.withColumn(value, F.last(value, ignorenulls=True).over(inside)).join(edges, [*key, "__block"])
    return now.withColumn(value, F.coalesce(value, "__edge")).drop("__block", "__edge")


def master_offsets(gps: DataFrame, ntp: DataFrame, points: DataFrame, max_ntp_ns: int = 25_000_000, max_tcal_ns: int = 50_000_000, block: int = 65536) -> DataFrame:
    """(card, seq, offset): milliseconds between a card's GPS clock and the time server at each GPS reading.

    ``gps`` has card, seq, gps_ms and dorclk.  At a reading, the latest time server sample that was quick
    enough and, for each module on the card, its latest quick calibration count; the offset is the mean
    over modules.  Readings before the first server sample give none; before the first calibration the
    offset is the one before, at first 0.

    A calibration counts by its nanoseconds less 50 for each count of its clock.  The sum of these over a card's
    modules changes only where a module is calibrated, so it is a running sum of changes: readings are not
    paired with modules.  The mean is taken of whole nanoseconds, and only then made milliseconds.  All that runs
    over a history runs inside ``block`` numbers of arrival and over summaries of blocks.
    """
    quick_ntp = ntp.where(F.col("exec_ns") <= max_ntp_ns).select("seq", "ntp_system_ms", "point_ns")
    both = gps.select("seq", "card", "gps_ms", "dorclk", F.lit(None).cast("struct<ms:bigint,ns:bigint>").alias("ntp")).union(
        quick_ntp.select("seq", F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long"), F.struct(F.col("ntp_system_ms").alias("ms"), F.col("point_ns").alias("ns")))
    )
    readings = _carried(both, [], "ntp", block).where("card is not null and ntp is not null")
    # what each calibration adds to its card's sum and number of modules, and what it takes away of its module's last one
    quick = points.where((F.col("exec_ns") <= max_tcal_ns) & F.col("card").isNotNull() & F.col("cwd").isNotNull())
    quick = quick.select("card", "cwd", "seq", F.expr(f"seq div {block}").alias("block"), F.expr("point_ns - point_dor * 50").alias("at"))
    change = lambda now, before: (F.coalesce(now, F.lit(0)) - F.coalesce(before, F.lit(0)), now.isNotNull().cast("long") - before.isNotNull().cast("long"))
    last = F.lag("at").over(Window.partitionBy("card", "cwd", "block").orderBy("seq"))
    inside = quick.select("card", "seq", *change(F.col("at"), last))
    # a module's first calibration in a block also takes away what the module had at the end of its block before
    ends = quick.groupBy("card", "cwd", "block").agg(F.min("seq").alias("seq"), F.max_by("at", "seq").alias("end"))
    edge = F.lag("end").over(Window.partitionBy("card", "cwd").orderBy("block"))
    across = ends.select("card", "seq", edge.alias("edge")).where("edge is not null").select("card", "seq", *change(F.lit(None).cast("long"), F.col("edge")))
    none = F.lit(None)
    changes = inside.union(across).toDF("card", "seq", "sum", "n")
    rows = changes.select("card", "seq", F.col("sum").cast("decimal(20,0)").alias("sum"), "n", none.cast("long").alias("gps_ms"), none.cast("long").alias("dorclk"), none.cast("struct<ms:bigint,ns:bigint>").alias("ntp")).union(
        readings.select("card", "seq", none.cast("decimal(20,0)"), none.cast("long"), "gps_ms", "dorclk", "ntp")
    ).withColumn("block", F.expr(f"seq div {block}"))
    ahead = Window.partitionBy("card").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("card", "block").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    sums = sums.select("card", "block", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in ("sum", "n")])
    so_far = Window.partitionBy("card", "block").orderBy("seq", F.col("ntp").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.select("*", *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"{c}_inside") for c in ("sum", "n")]).where("ntp is not null").join(sums, ["card", "block"])
    counted = counted.withColumn("total", F.expr("sum_inside + sum_before")).withColumn("modules", F.expr("nullif(n_inside + n_before, 0)"))
    counted = counted.withColumn("whole", F.expr("total div modules")).withColumn("rest", F.expr("cast(total - whole * modules as double) / modules"))
    offset = F.expr("ntp.ms + (cast(whole + dorclk * 50 - ntp.ns as double) + rest) / 1000000D - gps_ms")
    return _carried(counted.select("card", "seq", offset.alias("offset")), ["card"], "offset", block).select("card", "seq", F.coalesce("offset", F.lit(0.0)).alias("offset"))


def offset_range(offsets: DataFrame, key: str | None = "card") -> DataFrame:
    """Least, greatest and current offset, by card or over all."""
    return offsets.groupBy(*([key] if key else [])).agg(F.min("offset").alias("least"), F.max("offset").alias("most"), F.max_by("offset", "seq").alias("current"))
