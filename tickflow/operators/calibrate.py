"""Clock calibration: isochrons, the chain of accepted ones, and the translation of module clocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ticks import dom_ticks
from ..schemas import SECOND

#: Limits of the cable length average: seconds of difference, weight of a sample, samples until it is settled.
WILD, WEIGHT, SETTLED = 10e-9, 0.1, 3


def folded(rows: DataFrame, key: str, order: str, start: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """A scan of each key in order: ``step(state, row)`` gives (state, output row or None).

    Keys are spread by a shuffle and sorted inside partitions; the state goes from batch to batch, so a key
    of any length needs constant memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, at = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if getattr(row, key) != at:
                    state, at = start(), getattr(row, key)
                state, found = step(state, row)
                if found is not None:
                    out.append(found)
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


# --- averages -----------------------------------------------------------------------------------------------


def average_step(state: tuple[float | None, int], sample: float, threshold: float, weight: float, settled: int) -> tuple[tuple[float | None, int], bool]:
    """Outlier-rejecting exponential average: ((average, stable samples), accepted)."""
    average, stable = state
    if average is None:
        return (sample, stable + 1), True
    if abs(average - sample) < threshold:
        return ((average + weight * sample) / (1.0 + weight), stable + 1), True
    if stable < settled:
        return (sample, 1), True
    return state, False


def exponential_average(samples: DataFrame, threshold: float, weight: float, settled: int) -> DataFrame:
    """(key, seq, average, accepted) after each sample (key, seq, x)."""

    def step(state, row):
        state, ok = average_step(state, row.x, threshold, weight, settled)
        return state, (row.key, row.seq, state[0], ok)

    return folded(samples.select("key", "seq", "x"), "key", "seq", lambda: (None, 0), step, "key bigint, seq bigint, average double, accepted boolean")


# --- isochrons ----------------------------------------------------------------------------------------------


def half(x: int) -> int:
    """Division by two that truncates toward zero."""
    return x // 2 if x >= 0 else -(-x // 2)


def isochron(a: tuple[int, ...], b: tuple[int, ...]) -> tuple | None:
    """(lower, upper, dor_mid, dom_mid, epsilon, cable) from the four stamps of two calibrations, in order.

    It holds module clocks after ``lower`` and up to ``upper``.  None if the stamps are not monotonic.
    """
    if not (a[3] >= a[0] and a[2] >= a[1] and b[3] >= b[0] and b[2] >= b[1] and b[0] >= a[3] and b[1] >= a[2]):
        return None
    dor, dom = half((b[0] + b[3]) - (a[0] + a[3])), half((b[1] + b[2]) - (a[1] + a[2]))
    if dom == 0:
        return None
    epsilon = (dor - dom) / dom
    cable = 0.5 * ((b[3] - b[0]) * 1e-10 - (1.0 + epsilon) * ((b[2] - b[1]) * 1e-10))
    return a[2], b[2], half(b[0] + b[3]), half(b[1] + b[2]), epsilon, cable


def adjacent_isochrons(stamps: DataFrame) -> DataFrame:
    """Isochron of each calibration (mbid, seq, t0..t3) and the one before it, whatever came of that."""
    order = Window.partitionBy("mbid").orderBy("seq")
    s = stamps
    for t in ("t0", "t1", "t2", "t3"):
        s = s.withColumn(f"a{t[1]}", F.lag(t).over(order))
    s = s.where("a0 is not null").withColumn(
        "monotonic", F.expr("a3 >= a0 and a2 >= a1 and t3 >= t0 and t2 >= t1 and t0 >= a3 and t1 >= a2")
    )
    return s.withColumn("dordt", F.expr("((t0 + t3) - (a0 + a3)) div 2")).withColumn("domdt", F.expr("((t1 + t2) - (a1 + a2)) div 2")).withColumn(
        "epsilon", F.expr("cast(dordt - domdt as double) / domdt")
    ).selectExpr(
        "mbid", "seq", "monotonic", "a2 as lower", "t2 as upper", "(t0 + t3) div 2 as dor_mid", "(t1 + t2) div 2 as dom_mid", "epsilon",
        "0.5D * ((t3 - t0) * 1e-10D - (1 + epsilon) * ((t2 - t1) * 1e-10D)) as cable",
    )


CHAIN = "mbid bigint, seq bigint, outcome string, lower bigint, upper bigint, dor_mid bigint, dom_mid bigint, epsilon double, cable double, gps_offset bigint"


def chain_step(state, row, threshold: float = WILD, weight: float = WEIGHT, settled: int = SETTLED):
    """One calibration through the chain: state is (phase, last record, stamps of the last accepted end, average).

    The first record only starts the chain.  The second makes the first isochron with the one before it,
    whatever that was, so a bad record costs two pairs; later ones start at the end of the last accepted
    isochron.  Bad waveforms and stamps out of order are errors; a cable length far from the average is wild.
    """
    phase, last, end, average = state
    now = None if row.bad else (int(row.t0), int(row.t1), int(row.t2), int(row.t3))
    blank = (None,) * 6
    if phase == 0:
        return (1, now, None, average), (row.mbid, row.seq, "first", *blank, None)
    begin = last if phase == 1 else end
    made = isochron(begin, now) if begin and now else None
    if made is None:
        return (phase, now, end, average), (row.mbid, row.seq, "error", *blank, None)
    average, ok = average_step(average, made[5], threshold, weight, settled)
    state = (2, now, now if ok else end, average)
    return state, (row.mbid, row.seq, "accepted" if ok else "wild", *made, int(row.gps_offset))


def calibrated(stamps: DataFrame, threshold: float = WILD, weight: float = WEIGHT, settled: int = SETTLED) -> DataFrame:
    """The chain over all calibrations (mbid, seq, t0..t3, bad, gps_offset): one row each, with its outcome."""
    step = lambda state, row: chain_step(state, row, threshold, weight, settled)
    needed = stamps.select("mbid", "seq", "t0", "t1", "t2", "t3", "bad", "gps_offset").where("gps_offset is not null")
    return folded(needed, "mbid", "seq", lambda: (0, None, None, (None, 0)), step, CHAIN)


def translated(hits: DataFrame, isochrons: DataFrame, max_history: int | None = None, block: int = 600 * SECOND) -> DataFrame:
    """Hits (mbid, seq, domclk) with ``utc`` by the isochron that holds their clock.

    Isochrons of a channel are contiguous, so the holder is the one with the least upper end at or after the
    clock; clocks past all of them go by the newest, those before all by the oldest, of the newest
    ``max_history`` if given.  Without isochrons ``utc`` is null.  Both sides meet in one shuffle by channel and
    block of ``block`` ticks of the clock, in two running windows; past the ends of a block its summary has the
    nearest isochrons of other blocks, so no task has the whole history of a channel.
    """
    iso = isochrons
    if max_history:
        iso = iso.withColumn("__r", F.row_number().over(Window.partitionBy("mbid").orderBy(F.desc("upper")))).where(F.col("__r") <= max_history)
    packed = iso.select("mbid", F.col("upper").alias("clk"), F.lit(None).cast("long").alias("seq"), F.struct("dor_mid", "dom_mid", "epsilon", "gps_offset").alias("iso"))
    asked = hits.select("mbid", dom_ticks("domclk").alias("clk"), "seq", F.lit(None).cast(packed.schema["iso"].dataType).alias("iso"))
    both = packed.union(asked).withColumn("block", F.expr(f"clk div {block}"))
    ends = both.groupBy("mbid", "block").agg(F.min_by("iso", F.when(F.col("iso").isNotNull(), F.col("clk"))).alias("first"), F.max_by("iso", F.when(F.col("iso").isNotNull(), F.col("clk"))).alias("last"))
    blocks = Window.partitionBy("mbid").orderBy("block")
    ends = ends.select(
        "mbid", "block", F.first("first", ignorenulls=True).over(blocks.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
        F.last("last", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
    )
    both = both.join(ends, ["mbid", "block"])
    # equal clocks: the isochron's own end belongs to it, so it must be seen from the clock downwards
    down = Window.partitionBy("mbid", "block").orderBy(F.desc("clk"), F.col("iso").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    upward = Window.partitionBy("mbid", "block").orderBy("clk", F.col("iso").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("use", F.coalesce(F.last("iso", ignorenulls=True).over(down), "after", F.last("iso", ignorenulls=True).over(upward), "before")).where("iso is null")
    dt = "clk - use.dom_mid"
    return found.select("mbid", "seq", F.expr(f"use.dor_mid + ({dt}) + cast(use.epsilon * cast({dt} as double) as bigint) + use.gps_offset").alias("utc"))


def held_until_calibrated(hits: DataFrame, isochrons: DataFrame) -> DataFrame:
    """Hits that some isochron reaches (``upper`` at or after the clock), with the first calibration that lets them go."""
    reach = isochrons.groupBy("mbid").agg(F.max("upper").alias("reach"))
    return hits.join(reach, "mbid").where(dom_ticks("domclk") <= F.col("reach")).drop("reach")


def gated(records: DataFrame, limit: int = 5000, text: str = "Starting run") -> DataFrame:
    """Monitoring records (mbid, seq, text) with ``release_seq``, the record whose arrival lets them go, and ``opened_by``.

    A module's gate is shut until a message begins with ``text`` (``message``) or all but two of ``limit``
    records wait (``limit``), whichever comes first; a gate that never opens lets its records go at the end of
    the stream (``end``, release_seq null).  Records behind an open gate go when they come.
    """
    message = records.where(F.col("text").startswith(text)).groupBy("mbid").agg(F.min("seq").alias("by_message"))
    number = F.row_number().over(Window.partitionBy("mbid").orderBy("seq"))
    full = records.select("mbid", "seq", number.alias("n")).where(F.col("n") <= limit - 2).groupBy("mbid").agg(F.max_by("seq", "n").alias("by_limit"), F.max("n").alias("n"))
    full = full.where(F.col("n") == limit - 2).drop("n")
    gates = records.select("mbid").distinct().join(message, "mbid", "left").join(full, "mbid", "left")
    opening = F.least("by_message", "by_limit")
    kind = F.when(opening.isNull(), "end").when(F.col("by_message") == opening, "message").otherwise("limit")
    gates = gates.select("mbid", opening.alias("opening"), kind.alias("opened_by"))
    return records.join(gates, "mbid").withColumn("release_seq", F.when(F.col("opening").isNotNull(), F.greatest("seq", "opening"))).drop("opening")
