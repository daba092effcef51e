"""Raw module messages and configuration files; record files are in ``spool_files``."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- raw module messages ------------------------------------------------------------------------------------

RAW_HIT = "mbid bigint, message bigint, number int, fmt int, atwd_chip int, domclk bigint, size int, word1 int, word3 int"
_RAW = pa.schema([("mbid", pa.int64()), ("message", pa.int64()), ("number", pa.int32()), ("fmt", pa.int32()), ("atwd_chip", pa.int32()), ("domclk", pa.int64()), ("size", pa.int32()), ("word1", pa.int32()), ("word3", pa.int32())])


def hit_places(data: bytes) -> list[tuple[int, int, int, int]]:
    """(format, place, high bits of the clock, size) of the hits in a message.

    A message holds blocks of a length and a format, big-endian.  Engineering blocks (1, 2) are one hit with a
    clock of six bytes; a compressed block (0x90) holds little-endian hits that share the clock's high bits
    and state their size in 11 bits.  Blocks of other formats are skipped.
    """
    out, at = [], 0
    while at + 4 <= len(data):
        size, fmt = struct.unpack_from(">HH", data, at)
        if size < 4:
            raise ValueError(f"block of {size} bytes at {at}")
        if fmt in (1, 2):
            out.append((2, at, 0, size))
        elif fmt == 0x90:
            high, inside, end = data[at + 4] << 8 | data[at + 5], at + 8, min(at + size, len(data)) - 12
            while inside <= end:
                hit = data[inside] | (data[inside + 1] & 7) << 8
                if hit < 12:
                    raise ValueError(f"hit of {hit} bytes at {inside}")
                out.append((3, inside, high, hit))
                inside += hit
        at += size
    return out


def split_messages(messages: DataFrame) -> DataFrame:
    """One row for each hit of raw messages (mbid, message, content): (format, chip, clock, size, word1, word3) and its number.

    Lengths are followed one by one; heads are then decoded for all messages of a batch at once.
    """

    def run(batches):
        for batch in batches:
            contents = batch.column(2).to_pylist()
            found = [hit_places(c or b"") for c in contents]
            counts = np.array([len(f) for f in found], np.int64)
            fmt, place, high, size = np.array([hit for f in found for hit in f], np.int64).reshape(-1, 4).T
            starts = np.cumsum([0, *(len(c or b"") for c in contents)])[:-1]
            which = np.repeat(np.arange(len(contents)), counts)
            raw = np.frombuffer(b"".join(c or b"" for c in contents) + bytes(16), np.uint8)
            heads = raw[(starts[which] + place)[:, None] + np.arange(16)]
            words = np.ascontiguousarray(heads[:, :12]).view("<i4").astype(np.int64)
            packed = fmt == 3
            clock = np.where(packed, high << 32 | words[:, 1] & 0xFFFFFFFF, (heads[:, 10:].astype(np.int64) << np.arange(40, -1, -8)).sum(axis=1))
            chip = np.where(packed, words[:, 0] >> 11 & 1, heads[:, 4] & 1)
            number = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = pa.array(which)
            columns = [batch.column(0).take(at), batch.column(1).take(at), number, fmt, chip, clock, size, pa.array(words[:, 0], mask=~packed), pa.array(words[:, 2], mask=~packed)]
            yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(t) for c, t in zip(columns, _RAW.types, strict=True)], _RAW.names)

    return messages.select("mbid", "message", "content").mapInArrow(run, RAW_HIT)


def packed_messages(hits: DataFrame, per_message: int = 8) -> DataFrame:
    """(mbid, message, content): hits as raw compressed messages of hits that share a clock's high bits, for tests and replays."""
    little = "concat(substr({0}, 7, 2), substr({0}, 5, 2), substr({0}, 3, 2), substr({0}, 1, 2))"
    word1 = little.format("lpad(hex((word1 & ~4095) | 16 | shiftleft(atwd_chip, 11)), 8, '0')")
    word2 = little.format("lpad(hex(domclk & 4294967295L), 8, '0')")
    hit = F.expr(f"unhex(concat({word1}, {word2}, {little.format(chr(39) + '00000007' + chr(39))}, '00000000'))")
    rows = hits.select("mbid", "seq", F.expr("shiftright(domclk, 32)").alias("high"), F.expr(f"seq div {per_message * 1000}").alias("part"), hit.alias("hit"))
    grouped = rows.groupBy("mbid", "high", "part").agg(F.sort_array(F.collect_list(F.struct("seq", "hit"))).alias("hs"))
    body = F.aggregate("hs", F.lit(b""), lambda a, h: F.concat(a, h["hit"]))
    return grouped.select("mbid", F.expr("hs[0].seq").alias("message"), F.concat(F.expr("unhex(lpad(hex(size(hs) * 16 + 8), 4, '0'))"), F.expr("unhex('0090')"), F.expr("unhex(lpad(hex(high), 4, '0'))"), F.expr("unhex('0000')"), body).alias("content"))


# --- configuration ------------------------------------------------------------------------------------------


def read_dom_configs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each ``domConfig`` element of XML files: module id, format, trigger mode and the rest as read."""
    raw = spark.read.format("xml").option("rowTag", "domConfig").load(path)
    return raw.withColumn("mbid", F.conv("_mbid", 16, 10).cast("long")) if "_mbid" in raw.columns else raw
