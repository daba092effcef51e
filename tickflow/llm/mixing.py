"""Operator 4: mixing sources to target weights with a low-discrepancy schedule.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: 2^32 over the golden ratio, made odd: its multiples modulo 2^32 are the golden-ratio sequence in fixed point.
GOLDEN = 2654435769
#: Cells of the unit interval, as a power of two, by which a point finds its source in an equi-join.
CELL_BITS = 12
#: More sources than this are joined by a shuffle, not broadcast.
BROADCAST_SOURCES = 100_000
#: Slots of the schedule that are ranked together, and documents that are ordered together.
CHUNK, BUCKET = 65536, 1024


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size) to (sid, source, source_size, target).

    Weights repeat over the sources in code point order, null last.  ``share`` times all words is shared by
    weight; a source stops at ``max_epochs`` times its size and the rest is shared again.  With the sources
    in the order of limit over weight, the level before which all are full and after which none is gives
    that end state at once.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "sid")
    every = Window.partitionBy(F.lit(0))
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    return (
        sizes.withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * float(max_epochs))
        .withColumn("words", F.sum("source_size").over(every) * float(share))
        .withColumn("level", (F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("water", F.max(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))).over(every))
        .withColumn("target", F.least(F.col("water") * F.col("weight"), F.col("cap")))
        .select("sid", "source", "source_size", "target")
    )


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    block_words: int = 32,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken.

    A slot of the schedule takes one block of ``block_words`` words.  Slot i has the point frac(i * golden
    ratio), which falls into the interval of one source, as long as the slots that the source wants; its
    rank among the slots of that source names the block it takes from the source's documents, laid end to
    end in the order of a hash of their ids and read around again from the start.  The last block of a
    source takes the remainder, so it may have up to twice as many words.  ``taken`` is the number of words
    that the slots take of a row, repeats counted, never over ``max_epochs`` times its size.

    Null texts have size 0 and are taken 0 times; a null source is a source of its own, after all others.
    Rows that repeat an id are mixed each by itself.  An empty table gives no rows.
    """
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    blocks = F.greatest(F.lit(1), F.expr(f"source_size div {block_words}"))
    wanted = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    targets = written(source_targets(sizes, weights, share, max_epochs).withColumn("blocks", blocks).withColumn("wanted", wanted))
    facts = targets.agg(F.count(F.lit(1)), F.sum("wanted"), F.count_if(F.col("source").isNull())).first()
    sources, slots = facts[0], round(facts[1] or 0)
    small = F.broadcast if sources <= BROADCAST_SOURCES else (lambda df: df)

    taken = _times(targets, slots, max_epochs, small)
    sized = rows.withColumn("key", F.struct("source")).join(
        small(targets.select(F.struct("source").alias("key"), "sid", "source_size", "target", "blocks")), "key"
    )
    placed = _placed(sized, max(1, rows.count() // BUCKET), seed)
    first, last = F.expr(f"least(start div {block_words}, blocks - 1)"), F.expr(f"least((start + size - 1) div {block_words}, blocks - 1)")
    block_end = F.when(F.col("block") == F.col("blocks") - 1, F.col("source_size")).otherwise((F.col("block") + 1) * block_words)
    overlap = F.least(F.col("start") + F.col("size"), block_end) - F.greatest(F.col("start"), F.col("block") * block_words)
    row = ["doc_id", "size", "source_size", "target"]
    some = (
        placed.where("size > 0")
        .withColumn("block", F.explode(F.sequence(first, last)))
        .join(taken, ["sid", "block"], "left")
        .groupBy("sid", "start", *row)
        .agg(F.sum(overlap * F.coalesce("times", F.lit(0))).alias("taken"))
    )
    return some.select(*row, "taken").unionByName(sized.where("size = 0").select(*row, F.lit(0).cast("long").alias("taken")))


def _times(targets: DataFrame, slots: int, max_epochs: float, small) -> DataFrame:
    """(sid, block, times): how often the schedule takes each block."""
    spark, unit = targets.sparkSession, 1 << 32
    upto = F.sum("wanted").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("wanted").over(Window.partitionBy(F.lit(0)))
    spans = (
        targets.withColumn("hi", F.round(F.try_divide(upto, whole) * unit).cast("long"))
        .withColumn("lo", F.lag("hi", 1, 0).over(Window.orderBy("sid")))
        .where("hi > lo")
        .select("sid", "blocks", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", 32 - CELL_BITS), F.shiftright(F.col("hi") - 1, 32 - CELL_BITS))).alias("cell"))
    )
    schedule = (
        spark.range(slots)
        .withColumn("point", (F.col("id").bitwiseAND(F.lit((1 << 31) - 1)) * F.lit(GOLDEN)).bitwiseAND(F.lit(unit - 1)))
        .withColumn("cell", F.shiftright("point", 32 - CELL_BITS))
        .join(small(spans), "cell")
        .where("point >= lo and point < hi")
        .select("sid", "blocks", "id", F.expr(f"id div {CHUNK}").alias("chunk"))
    )
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = schedule.groupBy("sid", "chunk").count().select("sid", "chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("id")) - 1 + F.col("before")
    return (
        schedule.join(offsets, ["sid", "chunk"])
        .withColumn("rank", rank)
        .where(F.col("rank") < F.col("blocks") * F.lit(float(max_epochs)))
        .groupBy("sid", (F.col("rank") % F.col("blocks")).alias("block"))
        .agg(F.count(F.lit(1)).alias("times"))
    )


def _placed(rows: DataFrame, buckets: int, seed: int) -> DataFrame:
    """``rows`` with ``start``, the words before each in its source's order: sums over buckets of the hash, then inside one."""
    rows = rows.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("sum")).select("sid", "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(offsets, ["sid", "bucket"]).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
