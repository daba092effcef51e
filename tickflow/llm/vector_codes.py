"""Operator 13: vector codes by parts, with distances read from tables of the values that occur."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Parts of a vector, entries of a part's codebook, rounds, and steps of a unit.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers are held to this size, so that squared distances of up to 4096 components fit 64 bits.
LIMIT = 1 << 24


def usable(vector: Column) -> Column:
    """Is the vector there, with neither null nor non-finite components?"""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf")))), F.lit(False))


def integers(vectors: pa.Array, length: int, width: int) -> np.ndarray:
    """Rows of floor(scale * x), filled with zeros up to ``width`` columns."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    out = np.zeros((len(flat), width), np.int64)
    out[:, :length] = np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT)
    return out


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row's part by its codebook (entries x width), ties to the lower entry.

    Each dimension's values are coded by a dictionary of those that occur; one table has the squared differences
    of every value in it to all entries, and distances are sums of its rows, gathered by code.
    """
    distance = np.zeros((len(values), len(book)), np.int64)
    for d in range(values.shape[1]):
        dictionary, codes = np.unique(values[:, d], return_inverse=True)
        table = (dictionary[:, None] - book[None, :, d]) ** 2
        distance += table[codes]
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(values)), best]


def _cut(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    width = values.shape[1] // PARTS
    for p in range(PARTS):
        yield p, values[:, p * width : (p + 1) * width]


def _sums(vectors: DataFrame, books: np.ndarray, length: int) -> np.ndarray:
    """(parts, entries, width + 1): sums of the parts that each entry is nearest to, and their number.

    A task adds up what it reads, so it ships one row for each component of the codebooks.
    """
    shape = (*books.shape[:2], books.shape[2] + 1)

    def run(batches):
        total = np.zeros(shape, np.int64)
        for batch in batches:
            values = integers(batch.column(0), length, books.shape[2] * PARTS)
            for p, part in _cut(values) if len(values) else ():
                entry, _ = nearest(part, books[p])
                total[p, :, -1] += np.bincount(entry, minlength=shape[1])
                for d in range(part.shape[1]):
                    total[p, :, d] += np.bincount(entry, part[:, d].astype(np.float64), shape[1]).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "total"])

    found = vectors.select("vector").mapInArrow(run, "at bigint, total bigint").groupBy("at").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(int(np.prod(shape)), np.int64)
    for at, total in found:
        out[at] = total
    return out.reshape(shape)


def codebooks(vectors: DataFrame, length: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (parts, entries, width) of (vec_id, vector) rows: parts of the smallest ids, moved to means ``rounds`` times.

    Only codebooks come to the driver, a fixed number of integers.
    """
    width = -(-length // PARTS)
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").toArrow()
    start = integers(first.column(0).combine_chunks(), length, width * PARTS)
    books = np.stack([part for _, part in _cut(start)])
    for _ in range(rounds):
        sums = _sums(vectors, books, length)
        used = sums[:, :, -1] > 0
        books = np.where(used[:, :, None], sums[:, :, :-1] // np.maximum(sums[:, :, -1:], 1), books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(vectors: DataFrame, books: np.ndarray, length: int) -> DataFrame:
    """(vec_id, label, code, error) of each (vec_id, label, vector) row."""

    def run(batches):
        for batch in batches:
            values = integers(batch.column(2), length, books.shape[2] * PARTS)
            codes, error = np.zeros((len(values), PARTS), np.uint8), np.zeros(len(values), np.int64)
            for p, part in _cut(values) if len(values) else ():
                codes[:, p], distance = nearest(part, books[p])
                error += distance
            text = [row.tobytes().hex() for row in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return vectors.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error bigint")


def vector_codes(table: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each usable vector: vec_id, label, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components are dropped, as are those whose length is not
    the commonest one (the longest of several).  A length that the number of parts doesn't divide is filled up
    with zeros.  Components beyond 65536 count as that.  Fewer rows than entries make smaller codebooks, no row
    an empty result.  Ids may be null (they come last) or repeat (then vectors are in order of their
    components); equal labels and null labels are summed together; other columns are not read.

    The table is scanned once for each round and once for the codes.  What tasks ship in a round is one row
    for each component of the codebooks; only labels and codes are shuffled at the end, labels summed before.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    vectors = table.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")))
    commonest = vectors.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = commonest[0] if commonest else 0
    if not length:
        blank = vectors.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return blank.withColumn("label_error", F.col("error")).withColumn("codebooks_sha256", F.lit(digest(np.zeros(0))))
    vectors = vectors.where(F.size("vector") == length)
    books = codebooks(vectors, length, rounds, entries)
    codes = written(encoded(vectors, books, length))
    sums = codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
