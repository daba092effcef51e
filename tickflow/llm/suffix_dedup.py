"""Operator 7: repeated passages by merging sorted suffixes."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITMAP_BITS, bitmaps, bounded_batches, discard, filter_bits, looked_up, probed, slot, twice_filter, written

#: Bytes that a passage must have in common with another, of the grams that choose anchors, and of the halves that are counted.
LENGTH, GRAM = 400, 16
HALF = LENGTH // 2
#: Contexts that a task sorts at once, and suspect contexts that occur once for each part that is merged at once:
#: parts follow the number of contexts, so the memory of a merge doesn't.
RUN, PART = 20_000, 5_000
#: Texts and spans of repeats that are broadcast (under 100 bytes each); more are joined by a shuffle.
BROADCAST_SPANS = 500_000


# --- anchors ----------------------------------------------------------------------------------------------


def anchors(data: bytes) -> tuple[list[int], list[int], list[int]]:
    """(places, first, last): the least gram of every LENGTH-byte string of ``data``, the first of equal ones.

    The strings that start from first[k] to last[k] have their anchor at places[k].  The choice depends on
    the string alone, so equal strings have their anchors at the same place in them.
    """
    n = len(data)
    if n < LENGTH:
        return [], [], []
    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), 8).copy().view("<u8").ravel()
    h = (words[: n - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (words[GRAM - 8 :] * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    ranked = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width = LENGTH - GRAM + 1
    padded = np.full(-(-len(ranked) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(ranked)] = ranked
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    starts = n - LENGTH + 1
    least = np.minimum(ahead[:starts], behind[width - 1 : width - 1 + starts]) & np.uint64(0xFFFFFFFF)
    first = np.nonzero(np.r_[True, least[1:] != least[:-1]])[0]
    return least[first].tolist(), first.tolist(), [*(first[1:] - 1).tolist(), starts - 1]


def contexts(data: bytes):
    """(place, left, right, left hash, right hash) for each anchor.

    The two sides hold the strings that have this anchor, and no more.  A hash covers the HALF bytes before
    the anchor, or from it on, and is 0 if no string has them.
    """
    for p, first, last in zip(*anchors(data), strict=True):
        left, right = data[first:p], data[p : last + LENGTH]
        yield (
            p, left, right,
            xxhash.xxh64_intdigest(left[-HALF:], 1) if len(left) >= HALF else 0,
            xxhash.xxh64_intdigest(right[:HALF], 2) if len(right) >= HALF else 0,
        )


# --- sorted runs ------------------------------------------------------------------------------------------


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, ``at`` bytes of which are known."""
    most = min(len(a), len(b))
    while at < most:
        x, y = a[at : at + 64], b[at : at + 64]
        if x != y:
            size = min(len(x), len(y))
            differ = int.from_bytes(x[:size], "big") ^ int.from_bytes(y[:size], "big")
            return at + (size - (differ.bit_length() + 7) // 8)
        at += 64
    return most


HEAD = struct.Struct("<HHHI")


def front_coded(items: list[tuple[bytes, bytes, int]]) -> bytes:
    """Sorted (suffix, other side, count) items; of a suffix only what it doesn't share with the one before."""
    out, before = [], b""
    for suffix, other, count in items:
        shared = common(before, suffix)
        out += (HEAD.pack(shared, len(suffix) - shared, len(other), count), suffix[shared:], other)
        before = suffix
    return b"".join(out)


def decoded(run: bytes):
    """(shared, suffix, other side, count) of a front-coded run, one by one."""
    at, before = 0, b""
    while at < len(run):
        shared, own, other, count = HEAD.unpack_from(run, at)
        at += HEAD.size
        before = before[:shared] + run[at : at + own]
        yield shared, before, run[at + own : at + own + other], count
        at += own + other


def merged(runs: list[bytes]):
    """(shared with the item before, suffix, other side, count) over all runs in suffix order: a loser tree.

    A node remembers how many bytes the loser shares with the winner that beat it.  Of two heads, the one
    that shares more with the last item put out is smaller; only heads that share equally much are compared,
    from the first byte that isn't known to be the same.
    """
    sources = [decoded(r) for r in runs]
    k = len(sources)
    heads: list = [next(s, None) for s in sources]
    shared = [0] * k  # with the last item put out, or with the winner at the node where the run lost
    tree = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs."""
        if heads[a] is None:
            return b, a
        if heads[b] is None:
            return a, b
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a][1], heads[b][1]
        n = common(x, y, shared[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    def up(run: int) -> int:
        node = (run + k) // 2
        while node:
            if tree[node] < 0:
                tree[node] = run
                return -1
            run, tree[node] = play(run, tree[node])
            node //= 2
        return run

    champion = -1
    for run in range(k):
        champion = max(champion, up(run)) if k > 1 else 0
    while champion >= 0 and heads[champion] is not None:
        _, suffix, other, count = heads[champion]
        yield shared[champion], suffix, other, count
        heads[champion] = next(sources[champion], None)
        if heads[champion] is not None:
            shared[champion] = heads[champion][0]
        champion = up(champion) if k > 1 else 0


# --- groups -----------------------------------------------------------------------------------------------


def extents(members: list[tuple[bytes, bytes, int]], shared: list[int]) -> list[tuple[int, int]]:
    """For distinct (suffix, other side, count) members in suffix order: how far each reaches on both sides.

    shared[i] is what members i and i - 1 have in common.  A member reaches over a pair with s bytes of the
    suffix and o bytes of the other side in common if s + o is LENGTH or more: the result is the greatest s
    and the greatest o over such pairs, (0, 0) without one.  A member that occurs twice reaches over itself.
    In the order of either side the bytes in common with a member fall with the distance, so the first
    partner that is found outwards has the greatest number; the search ends where even the most that the
    member has in common on the other side is too little.
    """
    n = len(members)
    by_other = sorted(range(n), key=lambda i: members[i][1])
    rank = [0] * n
    for r, i in enumerate(by_other):
        rank[i] = r
    other_shared = [0] + [common(members[a][1], members[b][1]) for a, b in zip(by_other, by_other[1:], strict=False)]
    edge = [*shared, 0], [*other_shared, 0]
    edge[0][0] = 0
    most = [max(edge[0][i], edge[0][i + 1]) for i in range(n)], [max(edge[1][rank[i]], edge[1][rank[i] + 1]) for i in range(n)]
    out = []
    for i, (suffix, other, count) in enumerate(members):
        if len(suffix) + len(other) < LENGTH:
            out.append((0, 0))
            continue
        if count > 1:
            out.append((len(suffix), len(other)))
            continue
        best = [0, 0]
        for side in (0, 1):
            place, order = (i, None) if side == 0 else (rank[i], by_other)
            least = max(1, LENGTH - most[1 - side][i])
            for step in (-1, 1):
                at, bytes_ = place, LENGTH * 2
                while True:
                    bytes_ = min(bytes_, edge[side][at if step < 0 else at + 1])
                    at += step
                    if not 0 <= at < n or bytes_ < least or bytes_ <= best[side]:
                        break
                    j = at if order is None else order[at]
                    if bytes_ + common(members[i][1 - side], members[j][1 - side]) >= LENGTH:
                        best[side] = bytes_
                        break
        # a partner on one side is a partner on the other, be it with nothing in common there
        out.append((best[0], best[1]))
    return out


def grouped(runs: list[bytes]):
    """Groups of two or more items that share HALF bytes of their suffixes: (distinct members, shared), in order.

    Members are distinct in both sides; those that several runs hold are one, with their counts added.
    """

    def close(group):
        if len(group) > 1 or group[0][3] > 1:
            place: dict[tuple[bytes, bytes], int] = {}
            members: list[list] = []
            shared: list[int] = []
            least = LENGTH
            for common_before, suffix, other, count in group:
                least = min(least, common_before)
                if (suffix, other) in place:
                    members[place[suffix, other]][2] += count
                    continue
                place[suffix, other] = len(members)
                members.append([suffix, other, count])
                shared.append(least)
                least = LENGTH * 2
            yield [tuple(m) for m in members], shared

    group: list = []
    for item in merged(runs):
        if group and item[0] < HALF:
            yield from close(group)
            group = []
        group.append(item)
    if group:
        yield from close(group)


# --- Spark ------------------------------------------------------------------------------------------------


def _digest(left: bytes, right: bytes) -> bytes:
    return xxhash.xxh3_128_digest(left + b"|" + right + len(left).to_bytes(2, "big"))


def _texts(batch: pa.RecordBatch, column: int):
    for k in range(0, len(batch), 256):
        part = batch.slice(k, 256)
        yield part, part.column(column).to_pylist()


def _hashes(texts: DataFrame) -> DataFrame:
    """(h): hashes of both halves at every anchor of every text."""

    def run(batches):
        for batch in batches:
            for _, datas in _texts(batch, 0):
                found = [h for data in datas for *_, l, r in contexts(data) for h in (l, r) if h]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).view(np.int64))], ["h"])

    return texts.select("data").mapInArrow(run, "h bigint")


def _loaded(maps: DataFrame, bits: int) -> np.ndarray:
    """A bit filter as one array of bytes on the driver; ``bits`` bounds its size."""
    out = np.zeros(bits // 8, np.uint8)
    for bucket, bitmap in maps.toLocalIterator():
        out[bucket * BITMAP_BITS // 8 :][: BITMAP_BITS // 8] = np.frombuffer(bitmap, np.uint8)
    return out


def _has(table: np.ndarray, at: int) -> bool:
    return bool(table[at >> 3] >> (at & 7) & 1)


def _suspect(tables: list[np.ndarray], bits: int, h: int) -> int:
    """The slot of a hash that both filters know, -1 for others."""
    low, high = h & (bits - 1), h >> 32 & (bits - 1)
    return low if h and _has(tables[0], low) and _has(tables[1], high) else -1


PLACES = "digest binary, place int, before int, after int, key binary, left_slot int, right_slot int"
_PLACES = pa.schema([("digest", pa.binary()), ("place", pa.int32()), ("before", pa.int32()), ("after", pa.int32()), ("key", pa.binary()), ("left_slot", pa.int32()), ("right_slot", pa.int32())])


def _places(texts: DataFrame, filters, bits: int) -> DataFrame:
    """Suspect anchors of every text: lengths and digest of their contexts, and the slots of their suspect halves (-1 for others)."""

    def run(batches):
        tables = filters.value
        for batch in batches:
            for part, datas in _texts(batch, 1):
                rows = []
                for digest, data in zip(part.column(0).to_pylist(), datas, strict=True):
                    for p, left, right, l, r in contexts(data):
                        slots = _suspect(tables, bits, l), _suspect(tables, bits, r)
                        if max(slots) >= 0:
                            rows.append((digest, p, len(left), len(right), _digest(left, right), *slots))
                columns = list(zip(*rows, strict=True)) or [()] * len(_PLACES)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PLACES.types, strict=True)], _PLACES.names)

    return texts.select("digest", "data").mapInArrow(run, PLACES)


def _runs(texts: DataFrame, filters, bits: int, parts: int) -> DataFrame:
    """(kind, part, run): sorted, front-coded contexts that may have a partner, by part of their first HALF bytes.

    Kind 1 is sorted by the right side, kind 2 by the left side read backwards.  A context goes where its
    half is that of some context which occurs once: only those are still to be resolved, and their partners.
    """

    def run(batches):
        halves = filters.value
        held: list[dict] = [{}, {}]

        def flush():
            rows = []
            for kind, items in enumerate(held, 1):
                by_part: dict[int, list] = {}
                for (suffix, other), count in items.items():
                    by_part.setdefault(xxhash.xxh32_intdigest(suffix[:HALF]) % parts, []).append((suffix, other, count))
                items.clear()
                for part in list(by_part):
                    data = front_coded(sorted(by_part.pop(part)))
                    rows.append((kind, part, len(data).to_bytes(4, "big") + pa.compress(data, codec="zstd", asbytes=True)))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["kind", "part", "run"])

        for batch in batches:
            for _, datas in _texts(batch, 0):
                for data in datas:
                    for _, left, right, l, r in contexts(data):
                        back = left[::-1]
                        if r and _has(halves[1], r & (bits - 1)):
                            held[0][right, back] = held[0].get((right, back), 0) + 1
                        if l and _has(halves[0], l & (bits - 1)):
                            held[1][back, right] = held[1].get((back, right), 0) + 1
                if max(map(len, held)) >= RUN:
                    yield flush()
        yield flush()

    return texts.select("data").mapInArrow(run, "kind int, part int, run binary")


def _reaches(runs: DataFrame) -> DataFrame:
    """(key, before, after): how far around its anchor each context that occurs once is covered, from merged runs."""

    def resolved(runs: list[bytes], kind: int):
        keys, before, after = [], [], []
        unpacked = [pa.decompress(r[4:], int.from_bytes(r[:4], "big"), codec="zstd", asbytes=True) for r in runs]
        for members, shared in grouped(unpacked):
            for (suffix, other, count), (far, near) in zip(members, extents(members, shared), strict=True):
                if far and count == 1:
                    left, right, b, a = (other[::-1], suffix, near, far) if kind == 1 else (suffix[::-1], other, far, near)
                    keys.append(_digest(left, right))
                    before.append(b)
                    after.append(a)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(before, pa.int32()), pa.array(after, pa.int32())], ["key", "before", "after"])

    def run(batches):
        held, at = [], None
        for batch in batches:
            for kind, part, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and (kind, part) != at:
                    yield resolved(held, at[0])
                    held = []
                at = kind, part
                held.append(data)
        if held:
            yield resolved(held, at[0])

    ordered = runs.repartition("kind", "part").sortWithinPartitions("kind", "part")
    return ordered.mapInArrow(run, "key binary, before int, after int")


def cut(data: bytes, spans: list[dict]) -> bytes:
    """``data`` without the spans, which are in order and apart."""
    edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, spans.

    A byte goes if a string of 400 bytes that covers it starts at some other place as well, in any text or
    the same; strings don't cross texts and are judged on the input.  ``spans`` are the maximal removed runs
    as (start, end).  ``text`` is what is left; a character that a run cuts through is U+FFFD there (the
    digest is that of the bytes).  Null texts count as empty; rows may repeat and ids be null, each row being a text of
    its own; texts under 400 bytes are kept.  An empty table gives no rows; other columns are not read.

    Each 400-byte string has an anchor that its bytes alone choose, so equal strings have equal anchors.  Of
    two equal strings, 200 bytes on one side of the anchor lie in both: only anchors with such a half that
    was seen twice (two bit filters, as for lines) are suspect.  Contexts that occur twice are covered whole.
    The others and their possible partners are sorted as suffixes in each task, front-coded, exchanged by
    their first 200 bytes and merged by loser trees; inside a group that shares 200 bytes, neighbours in the
    order of either side give the reach of each context.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.unhex(F.substring(F.sha2("text", 256), 1, 32))
    texts = source.select(digest.alias("digest"), F.col("text").cast("binary").alias("data"))

    hashes = written(_hashes(texts))
    bits = filter_bits(hashes.count(), per_row=8, most=1 << 27)
    low, high = F.col("h").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1))
    twice = spark.sparkContext.broadcast([_loaded(twice_filter(hashes.select(s.alias("slot"))), bits) for s in (low, high)])
    discard(hashes)

    places = written(_places(texts, twice, bits))
    n = F.count(F.lit(1))
    counts = written(places.groupBy("key").agg(n.alias("n"), F.first("left_slot").alias("left_slot"), F.first("right_slot").alias("right_slot")))
    once = counts.where("n = 1")
    alone = spark.sparkContext.broadcast([_loaded(bitmaps(once.where(F.col(c) >= 0).select(F.col(c).cast("long").alias("slot")).distinct()), bits) for c in ("left_slot", "right_slot")])
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), once.count() // PART)
    reaches = written(_reaches(_runs(texts, alone, bits, parts)).groupBy("key").agg(F.max("before").alias("before"), F.max("after").alias("after")))

    total = places.count()
    rows = places.select("digest", "place", "before", "after", "key").distinct()
    many = looked_up(rows, counts.where("n > 1").select("key", "n"), "key", "n", total).drop("n")
    few = rows.drop("before", "after").join(reaches, "key").select(many.columns)
    span = F.struct((F.col("place") - F.col("before")).alias("start"), (F.col("place") + F.col("after")).alias("end"))
    spans = written(many.union(few).groupBy("digest").agg(F.collect_set(span).alias("spans")).withColumn("spans", F.expr(UNION)))
    n_spans = spans.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0))).first()[0]
    keyed = source.withColumn("digest", digest)
    if n_spans <= BROADCAST_SPANS:
        found = keyed.join(F.broadcast(spans), "digest", "left")
        return _kept(found.where("spans is not null")).unionByName(_whole(found.where("spans is null")))
    maps = bitmaps(spans.select(slot(F.col("digest"), bits, 4).alias("slot")).distinct())
    flagged = probed(keyed, [(maps, slot(F.col("digest"), bits, 4))], "touched")
    sizes = flagged.where("touched").groupBy("digest").agg(n.alias("n"))
    weighed = written(spans.join(sizes, "digest"))
    hit = looked_up(flagged.where("touched").drop("touched"), weighed, "digest", "n", source.count())
    missed = flagged.where("touched").join(weighed.select("digest"), "digest", "left_anti")
    return _kept(hit).unionByName(_whole(flagged.where(~F.col("touched")))).unionByName(_whole(missed))


#: Maximal runs of the union of spans, as a SQL expression.
UNION = """aggregate(array_sort(spans), cast(array() as array<struct<start:int,end:int>>), (runs, s) -> if(size(runs) > 0 and s.start <= runs[size(runs) - 1].end,
    concat(slice(runs, 1, size(runs) - 1), array(named_struct('start', runs[size(runs) - 1].start, 'end', greatest(runs[size(runs) - 1].end, s.end)))), concat(runs, array(s))))"""


RESULT = "doc_id {}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string, spans array<struct<start:int,end:int>>"


def _whole(rows: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return rows.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), "text", empty.alias("spans"))


def _kept(rows: DataFrame) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for data, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept = cut(data, spans)
                for column, value in zip(out, (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), spans), strict=True):
                    column.append(value)
            arrays = [pa.array(out[k], pa.int64()) for k in range(3)] + [pa.array(out[3], pa.string()), pa.array(out[4], pa.string()), pa.array(out[5], span)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "spans"])

    return rows.select("doc_id", F.col("text").cast("binary").alias("data"), "spans").mapInArrow(run, RESULT.format(kind))
