"""Operator 2: exact duplicates by two passes of Bloom filtering.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_bits, looked_up, probed, slot, twice_filter, written


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Two rows are equal when their texts are identical; a null text counts as empty.  The largest id of a
    group stays; rows that repeat that very id stay too, and null ids come before all others (a group of
    null ids only is kept).  An empty table gives no rows; other columns of ``docs`` are not read.

    Pass one counts slots of one hash over all rows; pass two counts slots of a second hash over the rows
    that pass one left.  Rows that neither clears are shuffled by digest; all others go straight through.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256")))
    total = rows.count()
    bits = filter_bits(total)
    first, second = slot(F.col("text_sha256"), bits, 1), slot(F.col("text_sha256"), bits, 2)

    once = twice_filter(rows.select(first.alias("slot")))
    left = probed(rows, [(once, first)], "suspect").where("suspect").drop("suspect")
    again = twice_filter(left.select(second.alias("slot")))
    flagged = probed(rows, [(once, first), (again, second)], "suspect")

    suspects = written(flagged.where("suspect").drop("suspect"))
    groups = suspects.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    exact = looked_up(suspects, groups, "text_sha256", "group_size", total)
    alone = flagged.where(~F.col("suspect")).select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return alone.unionByName(exact).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
