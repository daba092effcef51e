"""Operators on neighbouring records: averages, rates, streaks, gaps and good times."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SECOND
from .calibrate import folded


#: Rows by arrival, and ticks, of the blocks that long histories are cut into.
ROWS, TICKS = 1 << 20, 600 * SECOND


def numbered(rows: DataFrame, key: list[str], order: str, block: int = ROWS) -> DataFrame:
    """``rows`` with ``__n``, their number in their key by ``order``, a whole number: counted over blocks of it, then inside one."""
    blocked = rows.withColumn("__block", F.expr(f"{order} div {block}"))
    ahead = Window.partitionBy(*(key or [F.lit(0)])).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocked.groupBy(*key, "__block").agg(F.count(F.lit(1)).alias("__size"))
    sizes = sizes.select(*key, "__block", F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*key, "__block").orderBy(order))
    return blocked.join(sizes, [*key, "__block"]).withColumn("__n", inside + F.col("__before")).drop("__block", "__before")


def moving_average(rows: DataFrame, key: str, order: str, value: str, n: int, block: int = ROWS) -> DataFrame:
    """Mean of the last ``n`` values, of fewer at the start.

    Rows are numbered and cut into blocks; a block also gets the last n - 1 rows of the one before (its halo),
    so no task has the history of a key.
    """
    part = F.expr(f"__n div {block}")
    ends = F.expr(f"__n % {block}") >= block - (n - 1)
    spread = numbered(rows, [key], order, block).withColumn("__home", part).withColumn("__part", F.explode(F.when(ends, F.array(part, part + 1)).otherwise(F.array(part))))
    last = Window.partitionBy(key, "__part").orderBy("__n").rowsBetween(-(n - 1), 0)
    return spread.withColumn("sma", F.avg(value).over(last)).where("__part = __home").drop("__n", "__home", "__part")


def event_rate(hits: DataFrame, span: int = 10 * SECOND, key: str = "mbid", block: int = TICKS) -> DataFrame:
    """Events a second of all and of coincident hits in the ``span`` of time up to each hit, its start not included.

    Time is cut into blocks of at least ``span``; hits of the last ``span`` of a block also go to the next one,
    as its halo, so a window never needs more than a block and its halo.
    """
    block = max(block, span)
    part = F.expr(f"(utc - pmod(utc, {block}L)) div {block}")
    ends = F.expr(f"pmod(utc, {block}L)") > block - span
    spread = hits.withColumn("__home", part).withColumn("__part", F.explode(F.when(ends, F.array(part, part + 1)).otherwise(F.array(part))))
    trailing = Window.partitionBy(key, "__part").orderBy("utc").rangeBetween(-span + 1, 0)
    wide = F.lit(span / SECOND)
    rated = spread.withColumn("rate", F.count(F.lit(1)).over(trailing) / wide).withColumn("lc_rate", F.sum((F.col("lc_mode") > 0).cast("long")).over(trailing) / wide)
    return rated.where("__part <=> __home").drop("__home", "__part")


def streaks(samples: DataFrame, over: str, n: int, key: str | None = None, block: int = ROWS) -> DataFrame:
    """Samples at which the condition ``over`` has held ``n`` times in a row or more, with ``streak``.

    Inside a block of arrival a streak counts from the last row that broke it.  A block in which none did goes
    on with what the blocks before end in: sums over block summaries that start again at every block with a
    break.  So neither a key nor a streak is ever one task.
    """
    part = [key] if key else []
    blocked = samples.withColumn("__over", F.expr(f"coalesce({over}, false)")).withColumn("__block", F.expr(f"seq div {block}"))
    inside = Window.partitionBy(*part, "__block").orderBy("seq")
    blocked = blocked.withColumn("__at", F.row_number().over(inside))
    blocked = blocked.withColumn("__since", F.max(F.when(~F.col("__over"), F.col("__at"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = blocked.groupBy(*part, "__block").agg(F.count(F.lit(1)).alias("__size"), F.max(F.when(~F.col("__over"), F.col("__at"))).alias("__break"))
    blocks = Window.partitionBy(*(part or [F.lit(0)])).orderBy("__block")
    ends = ends.withColumn("__tail", F.col("__size") - F.coalesce("__break", F.lit(0))).withColumn("__segment", F.sum(F.when(F.col("__break").isNotNull(), 1).otherwise(0)).over(blocks))
    segment = Window.partitionBy(*part, "__segment").orderBy("__block")
    ends = ends.withColumn("__tails", F.sum("__tail").over(segment)).select(*part, "__block", F.coalesce(F.lag("__tails").over(blocks), F.lit(0)).alias("__carried"))
    held = blocked.where("__over").join(ends, [*part, "__block"])
    held = held.withColumn("streak", F.when(F.col("__since").isNull(), F.col("__at") + F.col("__carried")).otherwise(F.col("__at") - F.col("__since")))
    return held.where(F.col("streak") >= n).drop("__over", "__block", "__at", "__since", "__carried")


def throttled(alerts: DataFrame, interval: int, key: str = "kind", time: str = "ns") -> DataFrame:
    """Alerts that are sent: of each kind the first, then those more than ``interval`` after the last one sent."""

    def step(last, row):
        t = getattr(row, time)
        return (t, (row.seq, getattr(row, key), t)) if last is None or t > last + interval else (last, None)

    return folded(alerts.select("seq", key, time), key, time, lambda: None, step, f"seq bigint, {key} {alerts.schema[key].dataType.simpleString()}, {time} bigint")


def replay_gaps(hits: DataFrame, huge: int = 3 * SECOND, exempt: int = 9, abort_after: int = 20, key: str = "hub_id", block: int = 1 << 20) -> DataFrame:
    """(key, seq, gap, n_huge): gaps of data time over ``huge``, the first ``exempt`` records excepted, up to where a replay aborts.

    Neighbours are compared inside blocks of arrival and at block ends; only the gaps, which are few, are numbered.
    """
    blocked = hits.select(key, "seq", "utc", F.expr(f"seq div {block}").alias("block"))
    sizes = blocked.groupBy(key, "block").agg(F.count(F.lit(1)).alias("n"), F.max_by("utc", "seq").alias("last"))
    ahead = Window.partitionBy(key).orderBy("block")
    sizes = sizes.select(key, "block", F.coalesce(F.sum("n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lag("last").over(ahead).alias("edge"))
    inside = Window.partitionBy(key, "block").orderBy("seq")
    gaps = (
        blocked.withColumn("number", F.row_number().over(inside))
        .withColumn("prev", F.lag("utc").over(inside))
        .join(sizes, [key, "block"])
        .withColumn("gap", F.col("utc") - F.coalesce("prev", "edge"))
        .where((F.col("gap") > huge) & (F.col("number") + F.col("before") > exempt))
    )
    return gaps.withColumn("n_huge", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).where(F.col("n_huge") <= abort_after + 1).select(key, "seq", "gap", "n_huge")


def scaler_gaps(packets: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Supernova packets that do not begin where the one before ended: ``gap_ms`` is negative for overlaps."""
    order = Window.partitionBy("mbid").orderBy("seq")
    expected = F.lag(F.col("domclk") + F.size("scalers").cast("long") * width).over(order)
    return packets.withColumn("expected", expected).where("domclk <> expected").select("mbid", "seq", "expected", "domclk", ((F.col("domclk") - F.col("expected")) * 25 / F.lit(1e6)).alias("gap_ms"))


def first_misalignment(gps: DataFrame, offset: str = "gps_offset") -> DataFrame:
    """First reading of each card whose offset is not that of the card's first reading."""
    base = gps.groupBy("card").agg(F.min_by(offset, "seq").alias("base"))
    return gps.join(base, "card").where(F.col(offset) != F.col("base")).groupBy("card").agg(F.min("seq").alias("seq"), F.min_by(offset, "seq").alias("found"), F.first("base").alias("base"))


def not_ready(reads: DataFrame, expected: int = 11, key: str = "card") -> DataFrame:
    """Read misses beyond ``expected`` in a row: (card, seq, streak).  ``reads`` has ``miss``; a good read ends a streak."""
    return streaks(reads, "miss", expected + 1, key).select(key, "seq", "streak")


def failed_cards(reads: DataFrame, max_misses: int = 3600, max_errors: int = 10, key: str = "card") -> DataFrame:
    """Cards (key, reason) that fail: more than ``max_misses`` misses between good reads, or an error after more
    than ``max_errors`` of them.  Only a good read starts the counts again: errors don't end a streak of misses."""
    misses = streaks(reads.where("not error"), "miss", max_misses + 1, key).select(key).withColumn("reason", F.lit("misses"))
    errors = streaks(reads.where("not miss"), "error", max_errors + 2, key).select(key).withColumn("reason", F.lit("errors"))
    return misses.union(errors).distinct()


def good_times(times: DataFrame, mode: str, minute: int = 60 * SECOND, key: str = "hub_id", value: str = "t") -> DataFrame:
    """Good first or last time of each hub from one time for each of its modules (a bounded number).

    ``first``: the latest first time; if times spread over more than a minute, the end of what comes before
    the first gap of over a minute if that is over half of the modules, else the latest of all.  ``last``
    mirrors that with the last such gap.  0 if a module has no time yet (negative).
    """
    t = f"sort_array(collect_list({value}))"
    rows = times.groupBy(key).agg(F.expr(f"{t} as t"))
    gaps = f"filter(sequence(1, size(t) - 1), i -> t[i] - t[i - 1] > {minute})"
    pick = "try_element_at(g, 1)" if mode == "first" else "try_element_at(g, -1)"
    rows = rows.withColumn("g", F.expr(f"if(size(t) > 1, {gaps}, cast(array() as array<int>))")).withColumn("i", F.expr(f"coalesce({pick}, 0)")).withColumn("h", F.expr("size(t) div 2"))
    wide = f"t[size(t) - 1] - t[0] >= {minute}"
    if mode == "first":
        good = f"case when t[0] < 0 then 0 when not ({wide}) then t[size(t) - 1] when h < i then t[i - 1] else t[size(t) - 1] end"
    else:
        good = f"case when t[0] < 0 then 0 when not ({wide}) then t[0] when h > i then t[i] else t[0] end"
    return rows.select(key, F.expr(f"cast({good} as bigint)").alias("good"))


def latency_samples(hits: DataFrame, every: int = 10 * 40_000_000) -> DataFrame:
    """One hit of each channel for more than ``every`` counts of its clock since the last one picked: (mbid, seq, domclk).

    Channels are sorted inside partitions and read batch by batch; what is picked next is found by a binary
    search in the running maximum of the clock, so steps are as many as picks, not as hits, and all that is
    kept is the last pick.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, last = None, None
        for batch in batches:
            if not len(batch):
                continue
            mbid, clock = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.r_[True, mbid[1:] != mbid[:-1], True]).tolist()
            picked = []
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if mbid[start] != channel:
                    channel, last = mbid[start], None
                # before a pick no clock was higher than it, so the maximum passes a limit where a hit does
                top = np.maximum.accumulate(clock[start:end])
                at = 0 if last is None else int(np.searchsorted(top, last + every, "right"))
                while at < len(top):
                    picked.append(start + at)
                    last = int(clock[start + at])
                    at = int(np.searchsorted(top, last + every, "right"))
            yield batch.take(pa.array(picked, pa.int64()))

    rows = hits.select("mbid", "seq", "domclk").where("mbid is not null and domclk is not null")
    return rows.repartition("mbid").sortWithinPartitions("mbid", "seq").mapInArrow(run, "mbid bigint, seq bigint, domclk bigint")


def acquisition_latency(hits: DataFrame, n: int = 9) -> DataFrame:
    """Sampled hits with ``latency``, system minus translated time (columns system_utc, utc), averaged over the last ``n``."""
    picked = latency_samples(hits).join(hits.select("mbid", "seq", "utc", "system_utc"), ["mbid", "seq"])
    return moving_average(picked.withColumn("latency", F.col("system_utc") - F.col("utc")), "mbid", "seq", "latency", n).select("mbid", "seq", "latency", "sma")
