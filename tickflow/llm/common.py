"""What the training-data operators share: scratch tables, bit filters, skew-safe lookups."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_dir

#: White space of the text contracts: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
#: Bits in one bitmap row; the bitmap aggregates of Spark SQL work on 4096-byte maps.
BITMAP_BITS = 32768
#: A key is hot when it holds at least one in this many of the rows.
HOT_SHARE = 1000
#: Rows of an Arrow batch, and bytes from which on it takes no further row.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20

_written: list[tuple[SparkSession, str]] = []


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers a thousand at a time or some 8 MB: Spark's defaults can fill a worker's memory.

    A batch also stands twice in buffers of its executor outside the heap.  So do column chunks that Parquet reads from a
    local file system as ranges, and the threads that read them keep theirs; files there are read in turn instead.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")
    if spark.conf.get("spark.checkpoint.dir", "file:").startswith(("file:", "/")):
        spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


def hand_back_memory() -> None:
    """Give free memory of this process back to the system; Python workers live on for the stages that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written once as Parquet in the scratch folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from ``written`` that no later result reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for entry in [e for e in _written if path.endswith(e[1].rsplit("/", 1)[1])]:
            _written.remove(entry)
            _delete(*entry)


def clear_scratch() -> None:
    """Delete the scratch tables of this process; call when no result that reads them is needed any more."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit
            return


atexit.register(clear_scratch)


def filter_bits(rows: int, per_row: int = 16, least: int = 1 << 20, most: int = 1 << 28) -> int:
    """Size of a bit filter in bits, a power of two; ``most`` bounds what is broadcast (2^28 bits are 32 MB).

    Past that bound a filter fills up and passes more rows on to the exact step; results stay the same.
    """
    return min(most, max(least, 1 << max(0, rows * per_row - 1).bit_length()))


def slot(value: Column, bits: int, seed: int) -> Column:
    """The bit of a filter that a value sets; seeds give independent slots."""
    return F.xxhash64(value, F.lit(seed)).bitwiseAND(F.lit(bits - 1))


def bitmaps(slots: DataFrame, name: str = "slot") -> DataFrame:
    """(bucket, bitmap) rows with the bit of every value in column ``name`` set."""
    return slots.groupBy(F.shiftright(name, 15).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col(name).bitwiseAND(F.lit(BITMAP_BITS - 1))).alias("bitmap")
    )


def twice_filter(slots: DataFrame, name: str = "slot") -> DataFrame:
    """Bitmaps of the slots that at least two rows set.

    Counting is the merge of a once-seen and a twice-seen filter in sparse form: rows of one slot are
    combined before the shuffle, and a slot costs its number, not a whole filter for each task.
    """
    return bitmaps(slots.groupBy(name).count().where("count >= 2"), name)


def probed(rows: DataFrame, filters: list[tuple[DataFrame, Column]], flag: str) -> DataFrame:
    """``rows`` with a boolean column: are the slots set in all (bitmaps, slot) filters?  Bitmaps are broadcast."""
    names = rows.columns
    for k, (maps, at) in enumerate(filters):
        maps = maps.select(F.col("bucket").alias(f"__b{k}"), F.col("bitmap").alias(f"__m{k}"))
        byte = f"conv(hex(substring(__m{k}, shiftright(__at & {BITMAP_BITS - 1}, 3) + 1, 1)), 16, 10)"
        bit = F.expr(f"shiftright(cast({byte} as int), cast(__at & 7 as int)) & 1")
        rows = (
            rows.withColumn("__at", at)
            .join(F.broadcast(maps), F.shiftright("__at", 15) == F.col(f"__b{k}"), "left")
            .withColumn(f"__f{k}", F.coalesce(bit == 1, F.lit(False)))
            .drop("__at", f"__b{k}", f"__m{k}")
        )
    hit = F.lit(True)
    for k in range(len(filters)):
        hit = hit & F.col(f"__f{k}")
    return rows.select(*names, hit.alias(flag))


def looked_up(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row for each key) that no hot key can hold up.

    Keys whose ``weight`` (their number of rows) is at least a thousandth of ``total`` are fewer than
    HOT_SHARE + 1, so they are broadcast; the others are joined by a shuffle.
    """
    is_hot = F.col(weight) * HOT_SHARE >= F.lit(max(total, HOT_SHARE))
    hot, cold = table.where(is_hot), table.where(~is_hot)
    by_shuffle = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(by_shuffle)


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in the first column of ``gone``; a null id there takes null ids away.

    Only rows that a bit filter of the ids may know are shuffled; all others go straight through.
    """
    gone = written(gone.select(F.struct(F.col(gone.columns[0]).alias("id")).alias("__gone")).distinct())
    bits = filter_bits(gone.count())
    maps = bitmaps(gone.select(slot(F.col("__gone"), bits, 1).alias("slot")).distinct())
    keyed = docs.withColumn("__key", F.struct(F.col(id_col).alias("id")))
    flagged = probed(keyed, [(maps, slot(F.col("__key"), bits, 1))], "__maybe")
    left = flagged.where("__maybe").join(gone, F.col("__key") == F.col("__gone"), "left_anti")
    return flagged.where("not __maybe").unionByName(left).select(*[F.col(f"`{c}`") for c in docs.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
