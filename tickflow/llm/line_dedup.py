"""Operator 6: repeated lines, found by a once-seen and a twice-seen Bloom filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, bitmaps, filter_bits, looked_up, probed, slot, twice_filter, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _digest(key: Column) -> Column:
    """128 bits of SHA-256 stand for a key: two keys of a corpus never share them in practice."""
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def line_duplicates(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_dropped, kept_text.

    A null or empty text is one empty line.  A key is a line without outer white space, A-Z lower-cased;
    a key of ``min_chars`` code points or more that occurs under two ids loses its lines except under the
    smallest id.  Rows that share an id count as one document.  Rows without an id keep all lines and are
    no document for others.  An empty table gives no rows; other columns of ``docs`` are not read.

    Only keys whose two slots were both seen twice are shuffled for exact confirmation, and only documents
    that may lose a line are shuffled again with their text; all others pass straight through.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keys = F.transform(_lines("text"), _key)
    keys = F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= min_chars))
    lines = written(
        docs.where("doc_id is not null").select("doc_id", F.explode(keys).alias("key")).select("doc_id", _digest(F.col("key")).alias("key"))
    )
    total = lines.count()
    bits = filter_bits(total)
    slots = [slot(F.col("key"), bits, seed) for seed in (1, 2)]
    filters = [(twice_filter(lines.select(s.alias("slot"))), s) for s in slots]
    suspects = written(probed(lines, filters, "suspect").where("suspect").drop("suspect"))

    found = suspects.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
    repeats = found.where("last_id > first_id").drop("last_id")
    dropped = looked_up(suspects, repeats, "key", "n", total).where("doc_id > first_id")
    drops = written(dropped.groupBy("doc_id").agg(F.collect_set("key").alias("drop_keys")))

    touched = bitmaps(drops.select(slot(F.col("doc_id"), bits, 3).alias("slot")).distinct())
    flagged = probed(docs, [(touched, F.coalesce(slot(F.col("doc_id"), bits, 3), F.lit(0)))], "touched")
    kept = F.filter(_lines("text"), lambda x: ~F.coalesce(F.array_contains(F.col("drop_keys"), _digest(_key(x))), F.lit(False)))
    some = (
        flagged.where("touched").join(drops, "doc_id", "left").select("doc_id", "text", kept.alias("kept"))
    )
    return (
        flagged.where(~F.col("touched"))
        .select("doc_id", "text", F.lit(None).cast("array<string>").alias("kept"))
        .unionByName(some)
        .select(
            "doc_id",
            F.size(_lines("text")).cast("long").alias("n_lines"),
            F.coalesce(F.size(_lines("text")) - F.when(F.col("kept").isNotNull(), F.size("kept")), F.lit(0)).cast("long").alias("n_dropped"),
            F.coalesce(F.array_join("kept", "\n"), "text", F.lit("")).alias("kept_text"),
        )
    )
