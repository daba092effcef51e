"""Length-prefixed record files as a splittable source: any byte range of a file is read by itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import RECORD

#: Bytes of a range, bytes read at once, records between two entries of an index, and the longest record that a range may begin in.
RANGE, BUFFER, STRIDE, LONGEST = 64 << 20, 4 << 20, 1024, 1 << 20
#: Records that must follow one another for a place to count as the beginning of one; files are in order of time.
CHAIN = 16
#: The head of a record: length, type, module, padding and time; in streams other than hits the time stands in the module's place.
_HEAD = np.dtype([("rec_len", ">i4"), ("fmt", ">i4"), ("mbid", ">i8"), ("padding", ">i8"), ("utc", ">i8")])
HEAD_SIZE = _HEAD.itemsize
_INDEX = np.dtype([("offset", ">i8"), ("utc", ">i8")])
_RECORD = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("rec_len", pa.int32()), ("fmt", pa.int32()), ("mbid", pa.int64()), ("utc", pa.int64()), ("payload", pa.binary())])


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


class RecordFile:
    """A file of records; ``sync`` finds the first record at or after a byte, by the file's index or a chain of lengths."""

    def __init__(self, path: str, time_at_other: bool = False):
        store, inside = opened(path)
        self.path, self.time_at_other, self.file = path, time_at_other, store.open_input_file(inside)
        self.size = self.file.size()
        index = store.get_file_info(f"{inside}.idx")
        self.index = np.frombuffer(store.open_input_file(index.path).read(), _INDEX) if index.is_file else None

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(min(n, self.size - at), at)

    def length(self, data: bytes, at: int, base: int) -> int:
        """Length of the record at ``at`` of data that begins at byte ``base`` of the file."""
        size = int.from_bytes(data[at : at + 4], "big", signed=True)
        if size < HEAD_SIZE or base + at + size > self.size:
            raise ValueError(f"{self.path}: record of {size} bytes at {base + at} of {self.size}")
        return size

    def sync(self, at: int) -> int:
        if at <= 0 or at >= self.size:
            return min(max(at, 0), self.size)
        if self.index is not None:
            before = self.index["offset"][self.index["offset"] <= at]
            pos = int(before[-1]) if len(before) else 0
            while pos < at:
                data, k = self.read(pos, BUFFER), 0
                while k + 4 <= len(data) and pos + k < at:
                    k += self.length(data, k, pos)
                pos += k
            return pos
        return self._chained(at)

    def _chained(self, at: int) -> int:
        """The first place from which CHAIN records, or all to the file's end, follow one another."""
        data = np.frombuffer(self.read(at, 2 * LONGEST), np.uint8)
        n = len(data) - 3
        if n <= 0:
            return self.size
        sizes = np.zeros(n + 3, np.int64)
        sizes[:n] = data[:n].astype(np.int32) << 24 | data[1 : n + 1].astype(np.int32) << 16 | data[2 : n + 2].astype(np.int32) << 8 | data[3 : n + 3]
        whole = at + len(data) == self.size
        place = np.arange(len(sizes))
        good = (sizes >= HEAD_SIZE) & (sizes <= LONGEST) & (not whole or place + sizes <= len(data))
        # a record that ends at the file's end, or past what was read, is followed by what is good
        follows = np.append(good, True)
        after = np.minimum(place + np.where(good, sizes, 0), len(sizes))
        chain = follows
        for _ in range(CHAIN):
            chain = np.append(good & chain[after], True)
        raw = data.tobytes()
        return next((at + k for k in np.flatnonzero(chain[:-1]).tolist() if self._alike(raw, k)), self.size)

    def _alike(self, data: bytes, at: int) -> bool:
        """Does the record have the format of one of the three after it, and are their times in order?  Else it only leads to records."""
        heads = []
        while len(heads) < 4 and at + HEAD_SIZE <= len(data):
            head = np.frombuffer(data, _HEAD, 1, at)[0]
            heads.append((int(head["fmt"]), int(head["mbid" if self.time_at_other else "utc"])))
            at += int(head["rec_len"])
        (kind, _), *others = heads
        return (not others or kind in (k for k, _ in others)) and all(a[1] <= b[1] for a, b in zip(heads, others, strict=False))

    def records(self, start: int, end: int, with_payload: bool = True) -> Iterator[pa.RecordBatch]:
        """Records that begin in [start, end).  A range begins where the one before ends, which each checks at its end."""
        pos = self.sync(start)
        while pos < min(end, self.size):
            data = self.read(pos, BUFFER)
            if len(data) < (size := self.length(data, 0, pos)):
                data = self.read(pos, size)
            at, offsets = 0, []
            while pos + at < end and at + 4 <= len(data):
                size = self.length(data, at, pos)
                if at + size > len(data):
                    break
                offsets.append(at)
                at += size
            if at + 4 > len(data) and pos + len(data) == self.size and at < len(data):
                raise ValueError(f"{self.path}: {len(data) - at} bytes after the last record")
            yield self._decoded(data, np.array(offsets), pos, with_payload)
            pos += at
        if self.index is None and end < self.size and (next_ := self._chained(end)) != pos:
            raise ValueError(f"{self.path}: records go on at {pos}, but a chain of lengths begins at {next_}; write an index")

    def _decoded(self, data: bytes, offsets: np.ndarray, base: int, with_payload: bool) -> pa.RecordBatch:
        heads = np.frombuffer(data, np.uint8)[offsets[:, None] + np.arange(HEAD_SIZE)].view(_HEAD)[:, 0]
        column = lambda name, kind: pa.array(heads[name].astype(kind))
        mbid, utc = column("mbid", np.int64), column("utc", np.int64)
        if self.time_at_other:
            mbid, utc = pa.nulls(len(heads), pa.int64()), mbid
        payload = pa.array([data[o + HEAD_SIZE : o + n] for o, n in zip(offsets.tolist(), heads["rec_len"].tolist(), strict=True)], pa.binary()) if with_payload else pa.nulls(len(heads), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([self.path] * len(heads)), pa.array(offsets + base), column("rec_len", np.int32), column("fmt", np.int32), mbid, utc, payload], schema=_RECORD)


def indexed(path: str, stride: int = STRIDE) -> int:
    """Write the index of one file: place and time of every ``stride``-th record.  Returns the number of records."""
    file, entries, n = RecordFile(path), [], 0
    for batch in file.records(0, file.size, False):
        at = [k for k in range(len(batch)) if (n + k) % stride == 0]
        entries += [(batch.column(1)[k].as_py(), batch.column(5)[k].as_py()) for k in at]
        n += len(batch)
    store, inside = opened(path)
    with store.open_output_stream(f"{inside}.idx") as out:
        out.write(np.array(entries, _INDEX).tobytes())
    return n


# --- batch --------------------------------------------------------------------------------------------------


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))


class SpoolReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def named(self, inside: str) -> str:
        """A path of the listing with the scheme of the folder's."""
        scheme, found, _ = self.options["path"].partition("://")
        return f"{scheme}://{inside}" if found and scheme != "file" else inside

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of all files.  With an index and a range of times, only those that may hold such times: files are in order of time."""
        store, inside = opened(self.options["path"])
        step = int(self.options.get("range_bytes", RANGE))
        first, last = (int(self.options[k]) if k in self.options else None for k in ("first", "last"))
        found = store.get_file_info(arrow_fs.FileSelector(inside, recursive=True))
        out = []
        for info in sorted((i for i in found if i.is_file and i.size and not i.path.endswith(".idx") and not i.base_name.startswith((".", "_"))), key=lambda i: i.path):
            low, high, path = 0, info.size, self.named(info.path)
            index = RecordFile(path).index if first is not None else None
            if index is not None and len(index):
                behind, beyond = np.flatnonzero(index["utc"] < first), np.flatnonzero(index["utc"] > last)
                low = int(index["offset"][behind[-1]]) if len(behind) else 0
                high = int(index["offset"][beyond[0]]) if len(beyond) else info.size
            out += [ByteRange(path, a, min(a + step, high)) for a in range(low, high, step)]
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        path, start, end = partition.value
        first, last = (int(self.options[k]) if k in self.options else None for k in ("first", "last"))
        for batch in RecordFile(path, self.options.get("time", "hit") == "other").records(start, end, self.options.get("payload", "true") == "true"):
            if first is not None:
                utc = batch.column(5).to_numpy()
                batch = batch.filter(pa.array((utc >= first) & (utc <= last)))
            if len(batch):
                yield batch


class SpoolSource(DataSource):
    """``spark.read.format("spool")``: records of all files below ``path``.

    Options: ``first`` and ``last`` (times), ``payload`` (false leaves it out), ``time`` (``other``: it stands at
    byte 8 and there is no module), ``range_bytes``.  A file is cut into ranges, however large it is; each begins
    with the first record in it, found by the file's index (``name.idx``) or else by a chain of lengths.  A
    range checks that the next one begins where it ends, so a chain that misleads is an error, never other rows.
    """

    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> SpoolReader:
        return SpoolReader(dict(self.options))


def read_spool(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, with_payload: bool = True, range_bytes: int = RANGE, time: str = "hit") -> DataFrame:
    """Records of all files of a spool folder, with ``first`` <= time <= ``last`` if given."""
    spark.dataSource.register(SpoolSource)
    options = {"payload": str(with_payload).lower(), "range_bytes": range_bytes, "time": time} | ({} if first is None else {"first": first, "last": last})
    return spark.read.format("spool").options(**options).load(path)


def write_spool(hits: DataFrame, path: str, slice_ticks: int, name: str = "concat('hub', hub_id, '-', slice, '.dat')", stride: int = STRIDE) -> DataFrame:
    """Write hits as record files, one for each hub and slice of time, in order of time, with their indexes.

    Returns (file, n, bytes) of what was written.  A file is written by one task as its records pass, under a name
    of its own, and then takes its place, so a task that runs again leaves the same files.
    """
    store, inside = opened(path)
    store.create_dir(inside, recursive=True)
    packed = F.expr(
        "concat(unhex(lpad(hex(rec_len), 8, '0')), unhex(lpad(hex(fmt), 8, '0')), unhex(lpad(hex(mbid), 16, '0')), unhex(repeat('0', 16)), "
        "unhex(lpad(hex(utc), 16, '0')), unhex(lpad(hex(word1), 8, '0')), unhex(repeat('00', rec_len - 36)))"
    )
    rows = hits.withColumn("slice", F.expr(f"utc div {slice_ticks}")).select(F.expr(name).alias("file"), "utc", "mbid", "seq", packed.alias("rec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, folder = opened(path)
        at, out, part, entries, n, size = None, None, "", [], 0, 0

        def finish():
            out.close()
            with store.open_output_stream(f"{folder}/{at}.idx") as index:
                index.write(np.array(entries, _INDEX).tobytes())
            store.move(part, f"{folder}/{at}")
            return pa.RecordBatch.from_pydict({"file": [at], "n": [n], "bytes": [size]}, pa.schema([("file", pa.string()), ("n", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for file, utc, rec in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4)), strict=True):
                if file != at:
                    if at is not None:
                        yield finish()
                    at, part, entries, n, size = file, f"{folder}/.{file}-{uuid.uuid4().hex}", [], 0, 0
                    out = store.open_output_stream(part)
                if n % stride == 0:
                    entries.append((size, utc))
                out.write(rec)
                n, size = n + 1, size + len(rec)
        if at is not None:
            yield finish()

    return rows.repartition("file").sortWithinPartitions("file", "utc", "mbid", "seq").mapInArrow(run, "file string, n bigint, bytes bigint")


# --- replay as a stream -------------------------------------------------------------------------------------


def replay_stream(spark: SparkSession, folder: str, pattern: str = "hub*_*.dat", skip: int = 0, files_per_trigger: int = 100, range_bytes: int = RANGE) -> DataFrame:
    """Records of replay files ``hub<id>_<stream>_<n>.dat`` as a stream with column ``stream``, without the first ``skip`` hit files.

    The stream is of files, so what was read is in its checkpoint and a query that starts again goes on there; a
    batch takes ``files_per_trigger`` of them.  A file is cut into ranges that tasks read by themselves.
    """
    binary = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(binary).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).load(folder)
    name = r"hub\d+_([a-z]+)_(\d+)\.dat$"
    files = files.select("path", "length", F.regexp_extract("path", name, 1).alias("stream"), F.regexp_extract("path", name, 2).cast("int").alias("number"))
    kept = files.where((F.col("stream") != "hit") | (F.col("number") >= skip)).where("length > 0")
    ranges = kept.select("path", "stream", "length", F.explode(F.expr(f"sequence(0L, length - 1, {range_bytes}L)")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, stream, size, start in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for found in RecordFile(path, stream != "hit").records(start, min(start + range_bytes, size)):
                    yield pa.RecordBatch.from_arrays([*found.columns, pa.array([stream] * len(found))], [*_RECORD.names, "stream"])

    return ranges.repartition("path", "start").mapInArrow(run, RECORD + ", stream string")
