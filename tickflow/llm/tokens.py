"""Operator 8: token ids in patched frame-of-reference blocks."""

from __future__ import annotations

import os
import struct
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded_batches, hand_back_memory, written

#: Ids in a block, and ids in a row of the token file (a whole number of blocks).
BLOCK, ROW_IDS = 1024, 1 << 18
#: Head of a block: ids, least id, bits of an id, number of exceptions, bytes of the block.
HEAD = struct.Struct("<IIBHI")
#: The share of ids that the chosen width must hold.
PERCENTILE = 95
#: Pieces that a worker remembers the ids of.
REMEMBERED = 200_000
#: Pieces that are encoded as one text.
JOINED = 128
#: Characters that are encoded at once (one text may have more).
CHARS = 1 << 20
# What the pattern of the tokenizer keeps with an apostrophe before it.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


# --- blocks -----------------------------------------------------------------------------------------------


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Each row's values at ``width`` bits, end to end, lowest bit first: rows of bytes.  Eight values fill ``width`` bytes."""
    rows, n = values.shape
    kind = np.uint32 if width <= 24 else np.uint64
    eights = np.zeros((rows, -(-n // 8) * 8), kind)
    eights[:, :n] = values
    eights = eights.reshape(rows, -1, 8)
    out = np.zeros((*eights.shape[:2], width), np.uint8)
    for k in range(8 if width else 0):
        byte, shift = divmod(k * width, 8)
        shifted = eights[:, :, k] << kind(shift)
        for j in range(-(-(shift + width) // 8)):
            out[:, :, byte + j] |= (shifted >> kind(8 * j)).astype(np.uint8)
    return out.reshape(rows, -1)[:, : -(-n * width // 8)]


def unpack_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    """The ``n`` values of each row of bytes."""
    rows = len(data)
    kind = np.uint32 if width <= 24 else np.uint64
    bytes_ = np.zeros((rows, -(-n // 8) * width), np.uint8)
    bytes_[:, : data.shape[1]] = data
    bytes_ = bytes_.reshape(rows, -(-n // 8), width)
    out = np.zeros((rows, -(-n // 8), 8), np.uint32)
    for k in range(8 if width else 0):
        byte, shift = divmod(k * width, 8)
        value = np.zeros(bytes_.shape[:2], kind)
        for j in range(-(-(shift + width) // 8)):
            value |= bytes_[:, :, byte + j].astype(kind) << kind(8 * j)
        out[:, :, k] = (value >> kind(shift)) & kind((1 << width) - 1)
    return out.reshape(rows, -1)[:, :n]


def _pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of equal size, one for each row: the least id is subtracted, ids are packed at the width that
    PERCENTILE of them need, and the high bits of the others stand in a list of (place, high bits)."""
    count, n = ids.shape
    base = ids.min(axis=1)
    rest = (ids - base[:, None]).astype(np.uint32)
    at = -(-n * PERCENTILE // 100) - 1
    widths = np.array([int(x).bit_length() for x in np.partition(rest, at, axis=1)[:, at]])
    out: list[bytes] = [b""] * count
    for width in set(widths.tolist()):
        rows = np.nonzero(widths == width)[0]
        own = rest[rows]
        packed = pack_bits(own & np.uint32((1 << width) - 1), width)
        high = own >> np.uint32(width) if width < 32 else np.zeros_like(own)
        row, place = np.nonzero(high)
        edges = np.searchsorted(row, np.arange(len(rows) + 1)).tolist()
        place, high = place.astype("<u2"), high[row, place].astype("<u4")
        for k, r in enumerate(rows.tolist()):
            a, b = edges[k], edges[k + 1]
            payload = packed[k].tobytes() + place[a:b].tobytes() + high[a:b].tobytes()
            out[r] = HEAD.pack(n, int(base[r]), width, b - a, HEAD.size + len(payload)) + payload
    return out


def pack_ids(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Blocks end to end, and the index of their starts (unsigned 32-bit, little-endian)."""
    whole = len(ids) // BLOCK * BLOCK
    blocks = _pack_blocks(ids[:whole].reshape(-1, BLOCK)) if whole else []
    if whole < len(ids):
        blocks += _pack_blocks(ids[None, whole:])
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    return b"".join(blocks), starts.astype("<u4").tobytes()


def unpack_ids(data: bytes, index: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (not included) of a row; only the blocks that hold them are read."""
    starts = np.frombuffer(index, "<u4").tolist()
    last = len(starts) * BLOCK if last is None else last
    starts = starts[first // BLOCK : -(-last // BLOCK)]
    heads = [HEAD.unpack_from(data, s) for s in starts]
    alike: dict[tuple[int, int], list[int]] = {}
    for k, (n, _, width, _, _) in enumerate(heads):
        alike.setdefault((n, width), []).append(k)
    stored = np.frombuffer(data, np.uint8)
    parts: list = [None] * len(heads)
    for (n, width), members in alike.items():
        size = -(-n * width // 8)
        bodies = np.array([starts[k] + HEAD.size for k in members])
        ids = unpack_bits(stored[bodies[:, None] + np.arange(size)], n, width)
        for row, k, body in zip(ids, members, bodies.tolist(), strict=True):
            _, base, _, n_over, _ = heads[k]
            over = np.frombuffer(data, "<u2", n_over, body + size)
            row[over] |= np.frombuffer(data, "<u4", n_over, body + size + 2 * n_over) << np.uint32(width)
            row += np.uint32(base)
            parts[k] = row
    skip = first - first // BLOCK * BLOCK
    return np.concatenate(parts)[skip : skip + last - first] if parts else np.zeros(0, np.uint32)


# --- encoding ---------------------------------------------------------------------------------------------


class Encoder:
    """Encodes with the tokenizers library, each distinct piece of text once as long as it is remembered.

    The tokenizer cuts a text into pieces by a fixed pattern and encodes each by itself.  Pieces are found
    here for a whole batch from the classes of its characters.

    With ``special``, tokens that the file adds to its vocabulary are recognised in texts as the library does
    unless told otherwise: texts that hold the string of one go to it whole.  Without, special ones are plain text.
    """

    def __init__(self, path: str, special: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.empty()
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with the space, which the vocabulary spells so
        self.spaced[[k for token, k in vocabulary.items() if token[0] == "\u0120"]] = True
        self.classes = np.zeros(0x110000, np.uint8)  # 0 other, 1 letter, 2 number, 3 white space, 4 the space itself
        for low, high in ((0, 0xD800), (0xE000, 0x110000)):
            points = "".join(map(chr, range(low, high)))
            for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
                for run in regex.finditer(pattern, points):
                    self.classes[low + run.start() : low + run.end()] = kind
        self.classes[32] = 4

    def empty(self) -> None:
        """Forget all pieces."""
        self.places: dict[str, int] = {}
        self.recent: list[str] = []
        self.ids, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each text."""
        plain = [k for k, t in enumerate(texts) if not any(a in t for a in self.added)]
        ids, n = self._plain([texts[k] for k in plain])
        if len(plain) == len(texts):
            return ids, n
        counts = np.zeros(len(texts), np.int64)
        parts: list = [None] * len(texts)
        counts[plain] = n
        for k, part in zip(plain, np.split(ids, np.cumsum(n)[:-1]) if plain else [], strict=True):
            parts[k] = part
        others = [k for k in range(len(texts)) if parts[k] is None]
        for k, e in zip(others, self.tokenizer.encode_batch_fast([texts[k] for k in others], add_special_tokens=False), strict=True):
            parts[k] = np.array(e.ids, np.uint32)
            counts[k] = len(parts[k])
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), counts

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        begins = np.cumsum([0, *map(len, texts)])
        data = whole.encode()
        try:  # one byte a character, for most European texts
            points = np.frombuffer(whole.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        cut = self._cuts(points, self.classes[points], begins[:-1][np.diff(begins) > 0])
        offsets = np.r_[cut, len(points)]
        if len(data) > len(points):
            width = (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)
            offsets = offsets + np.r_[0, np.cumsum(width, dtype=np.int64)][offsets]
        pieces = pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        place = self._places(pieces.dictionary.to_pylist())
        n = self.starts[place + 1] - self.starts[place]
        bounds = np.r_[0, np.cumsum(n)]
        own = self.ids[np.repeat(self.starts[place] - bounds[:-1], n) + np.arange(bounds[-1])]
        ids = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(own)).take(pieces.indices).flatten().to_numpy()
        ends = np.cumsum(n[pieces.indices.to_numpy()])
        return ids, np.diff(np.r_[0, ends][np.searchsorted(cut, begins)])

    @staticmethod
    def _cuts(points: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where pieces begin: runs of letters, numbers or others with one space before; of white space, all but
        a last character that stands before something else is one piece, and that character, if it isn't a
        space that goes with what follows, another.  An apostrophe that begins a piece takes one of the
        ENDINGS that follows it along, and no more."""
        fresh = np.zeros(len(kind), bool)
        fresh[begins] = True
        white = kind >= 3
        plain = np.where(white, np.uint8(3), kind)
        changes = np.r_[True, plain[1:] != plain[:-1]] | fresh
        space_before = np.r_[False, kind[:-1] == 4] & ~fresh
        next_black = np.r_[~white[1:] & ~fresh[1:], False]
        cuts = changes & np.where(white, True, ~space_before) | white & next_black
        marks = np.nonzero((points == ord("'")) & cuts)[0]
        for ending in ENDINGS if len(marks) else ():
            follows = marks[marks + len(ending) < len(points)]
            for k, c in enumerate(ending, 1):
                follows = follows[(points[follows + k] == ord(c)) & ~fresh[follows + k]]
            cuts[follows + 1] = False
            after = follows + len(ending) + 1
            cuts[after[after < len(points)]] = True
        return np.nonzero(cuts)[0]

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Where the ids of each piece stand in ``starts``."""
        if len(self.places) > REMEMBERED:
            self._forget()
        self.recent = pieces
        found = np.fromiter(map(self.places.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.nonzero(found < 0)[0]
        new = [pieces[k] for k in missing.tolist()]
        joined = [p for p in new if p[0] == " " and len(p) > 1 and not p[1].isspace()]
        for k in range(0, len(joined), 64 * JOINED):
            self._remember_joined(joined[k : k + 64 * JOINED])
        alone = [p for p in new if p not in self.places]
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
        self._remember(alone, np.array(list(chain.from_iterable(encoded)), np.uint32), np.array([len(e) for e in encoded], np.int64))
        found[missing] = np.fromiter(map(self.places.__getitem__, new), np.int64, len(new))
        return found

    def _forget(self) -> None:
        """Keep only the pieces of the batch before; frequent ones are among them."""
        old, starts, ids = self.places, self.starts, self.ids
        keep = np.fromiter(map(old.__getitem__, self.recent), np.int64, len(self.recent))
        n = starts[keep + 1] - starts[keep]
        at = np.repeat(starts[keep] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        kept = ids[at]
        self.places, self.starts[0] = {}, 0
        self._remember(self.recent, kept, n)

    def _remember_joined(self, pieces: list[str]) -> None:
        """Pieces that begin with a space keep apart when they stand end to end: a text of many is encoded at once.

        They have no other space, so each begins at a token that begins with one.
        """
        groups = [pieces[k : k + JOINED] for k in range(0, len(pieces), JOINED)]
        ids, counts, known = [], [], []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            own = np.array(e.ids, np.uint32)
            begins = np.nonzero(self.spaced[own])[0]
            if len(begins) == len(group) and begins[0] == 0:
                known += group
                ids.append(own)
                counts.append(np.diff(np.r_[begins, len(own)]))
        if known:
            self._remember(known, np.concatenate(ids), np.concatenate(counts))

    def _remember(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        first = len(self.places)
        begin = int(self.starts[first])
        while first + len(pieces) >= len(self.starts):
            self.starts = np.r_[self.starts, np.zeros_like(self.starts)]
        while begin + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.ids[begin : begin + len(ids)] = ids
        self.starts[first + 1 : first + 1 + len(pieces)] = begin + np.cumsum(counts)
        self.places.update(zip(pieces, range(first, first + len(pieces)), strict=True))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
    if path not in _encoders:
        _encoders[path] = Encoder(path, special=True)
    return _encoders[path]


# --- files ------------------------------------------------------------------------------------------------

ROW = "shard int, row int, n_ids bigint, doc_ids array<bigint>, ends array<bigint>, data binary, index binary"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text", hand_back: bool = False) -> None:
    """Write the token ids of ``docs``, in ascending id order, as a token file under ``path``.

    Ids are the library's with its defaults and without added special tokens: the string of a special token
    in a text is that token.  Each document's ids are followed by ``end_id``.  A shard is a range of ids of the table; its row r holds
    some 2^18 ids as packed blocks, the index of block starts, and for each document that ends in the row its
    id and the place after its last token, counted from the row's start.  Rows are stored as Parquet through
    Spark, so any store that Spark reaches will do, and a lost task writes its shard again.  A page is closed by its
    size after any row: Parquet would look first after a hundred, some 70 MB that a page is packed and unpacked in.

    Null texts count as empty (the end id alone); null ids come first; rows that repeat an id are written each.
    With ``hand_back`` a task forgets at its end what its worker remembers of pieces, which the next one would
    use again: for jobs whose other stages need the memory.
    """
    bounded_batches(docs.sparkSession)
    documents = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ranges = (partitions, "doc_id") if partitions else ("doc_id",)
    ordered = documents.repartitionByRange(*ranges).sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())

    def run(batches):
        encode, row, shard = encoder(tokenizer_path).encode, 0, 0
        held, doc_ids, ends, n = [], [], [], 0

        def flush(size):
            nonlocal held, doc_ids, ends, n, row
            ids = np.concatenate(held)
            out, inside = ids[:size], [e for e in ends if e <= size]
            data, index = pack_ids(out)
            made = {"shard": [shard], "row": [row], "n_ids": [len(out)], "doc_ids": [doc_ids[: len(inside)]], "ends": [inside], "data": [data], "index": [index]}
            held, doc_ids, ends, n, row = [ids[size:]], doc_ids[len(inside) :], [e - size for e in ends[len(inside) :]], n - size, row + 1
            return pa.RecordBatch.from_pydict(made, schema=_ARROW)

        for batch in batches:
            shard = batch.column(2)[0].as_py() if len(batch) else shard
            for part, texts in _portions(batch):
                ids, counts = encode(texts)
                at = np.cumsum(counts + 1)
                ended = np.full(at[-1], end_id, np.uint32)
                inside = np.ones(at[-1], bool)
                inside[at - 1] = False
                ended[inside] = ids
                held.append(ended)
                doc_ids += part.column(0).to_pylist()
                ends += (at + n).tolist()
                n += int(at[-1])
                while n > ROW_IDS:
                    yield flush(ROW_IDS)
        if n:
            yield flush(n)
        if hand_back:
            held.clear()
            encoder(tokenizer_path).empty()
            hand_back_memory()

    ordered.mapInArrow(run, ROW).write.options(**{"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}).parquet(path)


def _portions(batch: pa.RecordBatch):
    """Slices of a batch with some CHARS characters each, and their texts."""
    first, chars, texts = 0, 0, []
    for k, text in enumerate(batch.column(1)):
        texts.append(text.as_py() or "")
        chars += len(texts[-1])
        if chars >= CHARS or k + 1 == len(batch):
            yield batch.slice(first, len(texts)), texts
            first, chars, texts = k + 1, 0, []


_ARROW = pa.schema([("shard", pa.int32()), ("row", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("data", pa.binary()), ("index", pa.binary())])


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents of a token file.

    ``start`` counts the ids of all documents before.  A document may run over several rows of its shard;
    each row gives the pieces of the documents in it with their ids' bytes, and pieces are put together by document.
    """
    bounded_batches(spark)
    rows = spark.read.schema(ROW).parquet(path)
    by_row = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.select("shard", "row", "n_ids", F.size("ends").cast("long").alias("n_docs"))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    by_shard = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(by_shard), F.lit(0)).alias("shard_start"))
    placed = (
        sizes.withColumn("row_start", F.coalesce(F.sum("n_ids").over(by_row), F.lit(0)))
        .withColumn("docs_before", F.coalesce(F.sum("n_docs").over(by_row), F.lit(0)))
        .join(shards, "shard")
        .select("shard", "row", (F.col("row_start") + F.col("shard_start")).alias("row_start"), "docs_before")
    )
    placed = written(placed)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_ids(r["data"], r["index"]).astype("<u4")
                cuts = [0, *r["ends"]]
                if cuts[-1] < len(ids):
                    cuts.append(len(ids))
                spans = list(zip(cuts, cuts[1:], strict=False))
                doc_ids = (r["doc_ids"] + [None])[: len(spans)]
                ordinal = [r["docs_before"] + k for k in range(len(spans))]
                closed = [k < len(r["ends"]) for k in range(len(spans))]
                whole = [c and (k > 0 or r["row"] == 0) for k, c in enumerate(closed)]
                data = [ids[a:b].tobytes() for a, b in spans]
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": [r["shard"]] * len(spans), "ordinal": ordinal, "row": [r["row"]] * len(spans), "doc_id": doc_ids, "closed": closed, "whole": whole,
                        "start": [r["row_start"] + a for a, _ in spans], "n": [b - a for a, b in spans],
                        "crc": [zlib.crc32(d) if w else None for d, w in zip(data, whole, strict=True)], "part": [None if w else d for d, w in zip(data, whole, strict=True)],
                    },
                    schema=_PIECE,
                )

    pieces = written(rows.drop("n_ids").join(placed, ["shard", "row"]).mapInArrow(run, PIECE))
    whole = pieces.where("whole").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    parts = F.array_sort(F.collect_list(F.struct("row", "part")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["part"]))
    cut = pieces.where("not whole").groupBy("shard", "ordinal").agg(F.max("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.crc32(joined).alias("ids_crc32"))
    return whole.unionByName(cut.select("doc_id", "start", "n_tokens", "ids_crc32"))


PIECE = "shard int, ordinal bigint, row int, doc_id bigint, closed boolean, whole boolean, start bigint, n bigint, crc bigint, part binary"
_PIECE = pa.schema([("shard", pa.int32()), ("ordinal", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("closed", pa.bool_()), ("whole", pa.bool_()), ("start", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("part", pa.binary())])
