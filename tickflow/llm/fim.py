"""Operator 11: fill-in-middle transformation by secondary sort.

Every text is cut into pieces of a bounded number of code points, keyed by document and place in the output.
One shuffle by document with a sort inside partitions puts the pieces of each output in order; they stream
through an incremental digest.  What the stream holds is parsed again for its marks, sorted by place in the
source inside the same partitions, and streams through a second digest: the text rebuilt from the output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
#: Order of the marks in each form, and the place of the part after a mark in the source.
FORMS = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
SOURCE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: Code points of a piece.
UNITS = 8192

_PIECE = pa.schema([("key", pa.binary()), ("doc_id", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("copies", pa.int64()), ("place", pa.int64()), ("piece", pa.string())])


def cuts(text: str, digest: str, plain_percent: int, spm_percent: int) -> tuple[str, int, int]:
    """(form, end of prefix, end of middle) by the first four groups of eight hex digits of a document's digest."""
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(m in text for m in MARKS) or h3 % 100 >= 100 - plain_percent:
        return "plain", 0, 0
    return ("spm" if h4 % 100 < spm_percent else "psm"), low, high


def pieces(text: str, form: str, low: int, high: int, units: int = UNITS) -> Iterator[str]:
    """The output in pieces of at most ``units`` code points; a mark stands before the first piece of its part."""
    spans = {PREFIX: (0, low), MIDDLE: (low, high), SUFFIX: (high, len(text))} if form != "plain" else {"": (0, len(text))}
    for mark in FORMS[form] or ("",):
        start, end = spans[mark]
        yield mark + text[start : min(start + units, end)]
        for at in range(start + units, end, units):
            yield text[at : min(at + units, end)]


class Parser:
    """Takes an output apart as it streams in: ``feed`` gives (place of the part in the source, text)."""

    def __init__(self, form: str):
        self.marks, self.part, self.rest = list(FORMS[form]), 0, ""

    def feed(self, piece: str) -> Iterator[tuple[int, str]]:
        data = self.rest + piece
        while self.marks and (at := data.find(self.marks[0])) >= 0:
            if at:
                yield self.part, data[:at]
            self.part = SOURCE[self.marks[0]]
            data = data[at + len(self.marks.pop(0)) :]
        # the end of a piece may be the beginning of the next mark
        keep = next((k for k in (2, 1) if self.marks and data.endswith(self.marks[0][:k])), 0)
        self.rest = data[len(data) - keep :]
        if len(data) > keep:
            yield self.part, data[: len(data) - keep]

    def end(self) -> Iterator[tuple[int, str]]:
        if self.rest:
            yield self.part, self.rest


def restore(output: str, form: str) -> str:
    """The text of one output."""
    parser = Parser(form)
    parts = [*parser.feed(output), *parser.end()]
    return "".join(text for _, text in sorted(parts, key=lambda p: p[0]))


def output_pieces(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20, units: int = UNITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The outputs of all documents as rows of pieces, each output in order inside one partition.

    Columns: key, doc_id (as string), n, form, prefix_chars, middle_chars, copies, place, piece.  The key is a
    digest of id and text, so null and repeated ids don't meet in one group; rows that agree in both have one
    output and are combined, batch by batch, before the shuffle (``copies``).
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            same: dict[tuple, int] = {}
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                same[row] = same.get(row, 0) + 1
            rows, size = [], 0
            for (doc_id, digest, text), copies in same.items():
                form, low, high = cuts(text, digest, plain_percent, spm_percent)
                key = hashlib.sha256(f"{doc_id is None:d}{digest}{len(text)}:".encode() + text.encode()).digest()[:16]
                lengths = (None, None) if form == "plain" else (low, high - low)
                for place, piece in enumerate(pieces(text, form, low, high, units)):
                    rows.append((key, doc_id, len(text), form, *lengths, copies, place, piece))
                    size += len(piece)
                    if size >= 1 << 22:
                        yield _batch(rows, _PIECE)
                        rows, size = [], 0
            yield _batch(rows, _PIECE)

    number = F.col(id_col).cast("string")
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(number, F.lit(""))), 256)
    named = docs.select(number.alias("doc_id"), digest.alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "key binary, doc_id string, n bigint, form string, prefix_chars bigint, middle_chars bigint, copies bigint, place bigint, piece string"
    return named.mapInArrow(run, schema).repartition("key").sortWithinPartitions("key", "place")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _distinct(batches) -> Iterator[tuple]:
    """Rows of sorted pieces as tuples, those of copies added to the first one."""
    rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True))
    for _, same in groupby(rows, lambda r: (r[0], r[7])):
        first = next(same)
        yield *first[:6], first[6] + sum(r[6] for r in same), *first[7:]


_STEP = pa.schema([("key", pa.binary()), ("part", pa.int32()), ("place", pa.int64()), ("piece", pa.string()), ("doc_id", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("copies", pa.int64()), ("output", pa.string()), ("output_sha256", pa.string())])
_DONE = 3


def fill_in_middle(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20, with_output: bool = False, units: int = UNITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, and ``output``.

    ``output`` (only ``with_output``) is the transformed text, ``restored_sha256`` the digest of the text rebuilt
    from it and its form.  Null texts count as empty and stay plain; a null id counts as no digits when cuts are
    drawn and stays null; repeated ids and rows are kept; other columns are not read.  Pieces stream, so a task
    holds some of them at a time (``with_output`` one whole text), however long a text is.
    """

    def assemble(batches):
        """Digest each output in order; give its parts with their place in the source and a last row with the rest."""
        rows, size = [], 0
        for key, same in groupby(_distinct(batches), lambda r: r[0]):
            digest, parser, texts, k, row = hashlib.sha256(), None, [], 0, None
            for row in same:
                parser = parser or Parser(row[3])
                digest.update(row[8].encode())
                texts += [row[8]] if with_output else []
                for part, text in parser.feed(row[8]):
                    rows.append((key, part, k, text, *[None] * 8))
                    k, size = k + 1, size + len(text)
                if size >= 1 << 22:
                    yield _batch(rows, _STEP)
                    rows, size = [], 0
            rows += [(key, part, k + j, text, *[None] * 8) for j, (part, text) in enumerate(parser.end())]
            rows.append((key, _DONE, 0, None, *row[1:7], "".join(texts) if with_output else None, digest.hexdigest()))
            size += sum(map(len, texts))
            if len(rows) >= 1000:
                yield _batch(rows, _STEP)
                rows, size = [], 0
        yield _batch(rows, _STEP)

    def rebuild(batches):
        digest = hashlib.sha256()
        for batch in batches:
            out = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(_STEP))), strict=True):
                if row[1] != _DONE:
                    digest.update(row[3].encode())
                    continue
                out += [(*row[4:9], *row[10:], digest.hexdigest())] * row[9]
                digest = hashlib.sha256()
            for at in range(0, len(out), 1000):
                yield _batch(out[at : at + 1000], done)

    done = pa.schema([("doc_id", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
    step = "key binary, part int, place bigint, piece string, doc_id string, n bigint, form string, prefix_chars bigint, middle_chars bigint, copies bigint, output string, output_sha256 string"
    ordered = output_pieces(docs, plain_percent, spm_percent, units, id_col, text_col).mapInArrow(assemble, step)
    # the same partitions: pieces of a document are where they are, only their order changes
    rebuilt = ordered.sortWithinPartitions("key", "part", "place").mapInArrow(
        rebuild, "doc_id string, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string, restored_sha256 string"
    )
    rebuilt = rebuilt.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
    return rebuilt if with_output else rebuilt.drop("output")
