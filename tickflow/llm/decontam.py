"""Operator 5: benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Items with fewer characters must stand in a text as whole words.
SHORT = 20
#: Characters of benchmark text that one pass over the documents searches for; bounds what is broadcast.
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    """Lower case, each run of white space as one space, trimmed; null is empty."""
    return " ".join((text or "").lower().split())


def budget(length: int, error_rate: float) -> int:
    return int(length * error_rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces (offset, text) of nearly the same length: at least one survives ``errors`` edits."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a substring of ``text``, and that substring's end: Myers' bit vectors."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    plus, minus, score = full, 0, len(pattern)
    best, end = score, 0
    for j, c in enumerate(text, 1):
        same = masks.get(c, 0)
        vertical = same | minus
        horizontal = (((same & plus) + plus) ^ plus) | same
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        score += 1 if up & top else -1 if down & top else 0
        up, down = up << 1, down << 1
        plus, minus = (down | ~(vertical | up)) & full, up & vertical & full
        if score < best:
            best, end = score, j
    return best, end


def stands_alone(text: str, begin: int, end: int) -> bool:
    """Do no letters or digits go on beyond the ends of a place?  Scripts without spaces between words (from U+2E80 on) always end there."""

    def goes_on(a: str, b: str) -> bool:
        return a.isalnum() and b.isalnum() and max(a, b) < "\u2e80"

    return not (begin and goes_on(text[begin - 1], text[begin])) and not (end < len(text) and goes_on(text[end - 1], text[end]))


def searcher(items: list[tuple[object, str]], error_rate: float):
    """A function from a normalised text to its matches (item index, distance, end)."""
    automaton = ahocorasick.Automaton()
    at: dict[str, list[tuple[int, int]]] = {}
    budgets = [budget(len(text), error_rate) for _, text in items]
    for k, (_, text) in enumerate(items):
        for offset, piece in pieces(text, budgets[k]):
            at.setdefault(piece, []).append((k, offset))
    for piece, places in at.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()

    def search(text: str) -> list[tuple[int, int, int]]:
        windows: dict[int, list[list[int]]] = {}
        exact: dict[int, int] = {}
        for last, (length, places) in automaton.iter(text):
            for k, offset in places:
                begin = last - length + 1 - offset
                if len(items[k][1]) < SHORT:
                    if k not in exact and stands_alone(text, begin, last + 1):
                        exact[k] = last + 1
                    continue
                lo, hi = max(0, begin - budgets[k]), begin + len(items[k][1]) + budgets[k]
                spans = windows.setdefault(k, [])
                if spans and lo <= spans[-1][1] and hi >= spans[-1][0]:
                    spans[-1] = [min(lo, spans[-1][0]), max(hi, spans[-1][1])]
                else:
                    spans.append([lo, hi])
        out = [(k, 0, end) for k, end in sorted(exact.items())]
        for k, spans in sorted(windows.items()):
            found = min((d, lo + end) for lo, hi in spans for d, end in [myers(items[k][1], text[lo:hi])])
            if found[0] <= budgets[k]:
                out.append((k, *found))
        return out

    return search


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    error_rate: float = 0.05,
    block_chars: int = BLOCK_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, distance, item_chars, match_end): the items that a row of ``docs`` holds.

    Both texts are lower-cased and white space is folded.  A row holds an item if the least edit distance of
    the item to a substring is at most ``error_rate`` times the item's length, rounded down.  An item is cut
    into one piece more than that budget, so one piece must occur exactly; windows around exact hits are
    verified.  The best match of each row and item is reported, the first of equal ones.

    Null and empty texts hold nothing, null and empty items are held by none.  Items of fewer than SHORT
    characters have no budget; they must stand as whole words, so that a short answer is not found inside other
    words.  Rows that repeat are reported each.  Without documents or items
    there are no rows.  The benchmark is searched for in blocks of about ``block_chars`` characters, each
    collected and broadcast; the documents are never shuffled.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n_blocks = 1 + chars // block_chars
    kinds = [docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, item_chars int, match_end int"
    item_type = items.select("item_id").limit(0).toArrow().schema.field(0).type
    documents = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = []
    for block in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).distinct()
        listed = [(r[0], text) for r in part.collect() if (text := normal(r[1]))]
        if listed:
            found.append(documents.mapInArrow(_matcher(spark.sparkContext.broadcast(sorted(listed, key=str)), error_rate, item_type), schema))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)


def _matcher(listed, error_rate: float, item_type: pa.DataType):
    def run(batches):
        search, items = searcher(listed.value, error_rate), listed.value
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, distance, end in search(normal(text)):
                    for column, value in zip(rows, (doc_id, items[k][0], distance, len(items[k][1]), end), strict=True):
                        column.append(value)
            arrays = [pa.array(rows[0], batch.column(0).type), pa.array(rows[1], item_type), *(pa.array(r, pa.int32()) for r in rows[2:])]
            if rows[0]:
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "distance", "item_chars", "match_end"])

    return run
