"""Operator 3: SimHash near duplicates by anchor points of a covering code."""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, looked_up, written
from .graph import components



class Code(NamedTuple):
    """A perfect binary cyclic code on some bits of a fingerprint: every value is within ``radius`` of one code word."""

    polynomial: int
    length: int
    checks: int
    radius: int
    shift: int  # the lowest of its bits


#: The Golay code on two blocks of 23 bits: 2^24 anchors.
GOLAY = tuple(Code(0b101011100011, 23, 11, 3, shift) for shift in (0, 23))
#: With the Hamming code on 15 more bits, 2^35 anchors: some 150 copies of a print instead of 61, but 2048 times
#: fewer prints at an anchor.  From as many prints as FINE_FROM that is the lesser work; links are the same.
FINE = (*GOLAY, Code(0b10011, 15, 4, 1, 46))
FINE_FROM = 1 << 28
#: Pairs compared at once, and group size from which a group is compared row by row.
PAIRS, LARGE = 1 << 20, 512


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash of a UTF-8 text: a bit is set if over half of the shingle hashes have it set."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(n)), np.uint64, n)
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp) for every row; null texts count as empty and have fingerprint 0."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t or b"", shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def syndromes(values: np.ndarray, code: Code) -> np.ndarray:
    """Remainders modulo the generator polynomial, for arrays of values of the code's length."""
    out = np.zeros(len(values), np.int64)
    for bit in range(code.length):
        rest = 1 << bit
        for k in range(code.length - 1, code.checks - 1, -1):
            if rest >> k & 1:
                rest ^= code.polynomial << (k - code.checks)
        out ^= (values >> bit & 1) * rest
    return out


def near_words(code: Code, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: error patterns that lead to the code words within the radius + slack.

    The second array has what each costs beyond the covering radius; unused places cost more than ``slack``.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in range(1 << code.checks)]
    for weight in range(code.radius + slack + 1):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(code.length), weight)], np.int64)
        for s, e in zip(syndromes(patterns, code).tolist(), patterns.tolist(), strict=True):
            found[s].append((e, max(0, weight - code.radius)))
    most = max(map(len, found))
    errors, costs = np.zeros((len(found), most), np.int64), np.full((len(found), most), slack + 1, np.int64)
    for s, row in enumerate(found):
        errors[s, : len(row)], costs[s, : len(row)] = zip(*row, strict=True)
    return errors, costs


def anchors(fps: np.ndarray, tables: list, far: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices into ``fps`` and the anchors within the radius plus ``far``: anchor * 2, plus 1 beyond the radius plus ``near``.

    An anchor is a code word of each code in ``tables`` (code, errors, costs); the distances beyond the radii add up.
    """
    row, anchor, cost = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64)
    for code, errors, costs in tables:
        value = (fps >> np.uint64(code.shift)).astype(np.int64) & ((1 << code.length) - 1)
        s = syndromes(value, code)[row]
        k, j = np.nonzero(cost[:, None] + costs[s] <= far)
        anchor = anchor[k] << (code.length - code.checks) | (value[row[k]] ^ errors[s[k], j]) >> code.checks
        cost, row = cost[k] + costs[s[k], j], row[k]
    return row, anchor << 1 | (cost > near)


def _forest(n: int, pairs) -> list[tuple[int, int]]:
    """Those of ``pairs`` that join two trees."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kept = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            up[ra] = rb
            kept.append((a, b))
    return kept


def _large_group(fps: np.ndarray, near: int, bits: int) -> list[tuple[int, int]]:
    """Links that span the group, found row by row: a row adds one link for each tree that it touches."""
    label, kept = np.arange(len(fps)), []
    for x in range(near):
        linked = np.nonzero(np.bitwise_count(fps ^ fps[x]) <= bits)[0]
        trees, first = np.unique(label[linked], return_index=True)
        if len(trees) > 1:
            kept += [(x, int(y)) for t, y in zip(trees, linked[first], strict=True) if t != label[x]]
            label[np.isin(label, trees)] = trees[0]
    return kept


def linked(keys: np.ndarray, fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links among rows sorted by key, for each anchor a spanning forest of its rows within ``bits``."""
    anchor = keys >> 1
    starts = np.nonzero(np.r_[True, anchor[1:] != anchor[:-1]])[0]
    ends = np.r_[starts[1:], len(keys)]
    nears = np.add.reduceat((keys & 1) == 0, starts, dtype=np.int64)
    out: list[tuple[int, int]] = []
    many = ends - starts > LARGE
    for a, b, near in zip(starts[many].tolist(), ends[many].tolist(), nears[many].tolist(), strict=True):
        out += [(a + x, a + y) for x, y in _large_group(fps[a:b], near, bits)]
    small = (ends - starts > 1) & ~many & (nears > 0)
    s, e, n = starts[small], ends[small], nears[small]
    cut = np.searchsorted(np.cumsum((e - s) * n), np.arange(1, 2 + int(((e - s) * n).sum()) // PAIRS) * PAIRS)
    for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(s)], strict=True):
        if lo >= hi:
            continue
        size, near, first = (e - s)[lo:hi], n[lo:hi], s[lo:hi]
        left = np.repeat(first, near) + _ramp(near)
        width = np.repeat(size, near)
        x, y = np.repeat(left, width), np.repeat(np.repeat(first, near), width) + _ramp(width)
        hit = np.nonzero((fps[x] < fps[y]) & (np.bitwise_count(fps[x] ^ fps[y]) <= bits))[0]
        x, y = x[hit].tolist(), y[hit].tolist()
        at = {k: i for i, k in enumerate(dict.fromkeys(x + y))}
        back = list(at)
        out += [(back[a], back[b]) for a, b in _forest(len(back), ((at[a], at[b]) for a, b in zip(x, y, strict=True)))]
    return out


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, end to end."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def near_links(prints: DataFrame, bits: int = 3, codes: tuple[Code, ...] = GOLAY, by: str | None = None) -> DataFrame:
    """(a, b): links that join all fingerprints (distinct, column fp) with ``bits`` or fewer differing bits.

    Blocks of bits are covered by perfect codes, so every value is within the sum of their radii of an
    anchor.  Of two prints within ``bits``, a point between them is within half of ``bits``, rounded
    down, of the one and half, rounded up, of the other; both are replicated to the anchor that covers it,
    being within the radius plus their half.  Each pair within ``bits`` therefore meets at an anchor as a
    near and a far row, and only such rows are compared.  An anchor gives links that span its rows, not all
    pairs.  With ``by``, a column of small numbers, only fingerprints of the same number meet, and links have it too.
    """
    near, far = bits // 2, bits - bits // 2

    def replicate(batches):
        tables = [(c, *near_words(c, far)) for c in codes]
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            apart = batch.column(1).to_numpy().astype(np.int64) << 40 if by else np.zeros(len(fps), np.int64)
            for k in range(0, len(fps), 2048):
                part = fps[k : k + 2048]
                row, key = anchors(part, tables, far, near)
                yield pa.RecordBatch.from_arrays([pa.array(key | apart[k : k + 2048][row]), pa.array(part[row].view(np.int64))], ["key", "fp"])

    def compare(batches):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in _and_none(batches):
            if batch is not None:
                keys = np.r_[keys, batch.column(0).to_numpy()]
                fps = np.r_[fps, batch.column(1).to_numpy().view(np.uint64)]
                ready = int(np.searchsorted(keys >> 1, keys[-1] >> 1)) if len(keys) else 0  # the last anchor may go on
            else:
                ready = len(keys)
            if ready:
                found = linked(keys[:ready], fps[:ready], bits)
                at = np.array(found, np.int64).reshape(-1, 2)
                columns = [*fps[at.T].view(np.int64), *([(keys[at[:, 0]] >> 40).astype(np.int32)] if by else [])]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["a", "b", *([by] if by else [])])
                keys, fps = keys[ready:], fps[ready:]

    visits = prints.select("fp", *([by] if by else [])).mapInArrow(replicate, "key bigint, fp bigint")
    met = visits.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return met.mapInArrow(compare, "a bigint, b bigint" + (f", {by} int" if by else "")).distinct()


def _and_none(items):
    yield from items
    yield None


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Texts are lower-cased in A-Z and cut into words at white space; a fingerprint is the SimHash of all runs
    of ``shingle`` words (of the whole sequence if it is shorter; 0 without words or for null).  Rows whose
    fingerprints differ in ``bits`` or fewer are linked; component_id is the smallest id that links reach,
    null where all ids are null.  Ids may repeat.  An empty table gives no rows; other columns are not read.
    """
    rows = written(fingerprints(docs, shingle, id_col, text_col))
    total = rows.count()
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("min_id"), F.count(F.lit(1)).alias("n_rows"))
    prints = written(prints)
    codes = FINE if prints.count() >= FINE_FROM else GOLAY
    root = components(near_links(prints, bits, codes), "a", "b").withColumnRenamed("node", "fp")
    prints = written(prints.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    groups = prints.groupBy("root").agg(F.min("min_id").alias("component_id"), F.count(F.lit(1)).alias("n_prints"))
    named = looked_up(prints.select("fp", "root", "n_rows"), groups, "root", "n_prints", total).select("fp", "n_rows", "component_id")
    out = looked_up(rows, written(named), "fp", "n_rows", total)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
