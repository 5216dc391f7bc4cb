"""Tokenizing whole texts; token files in bit or byte planes; token counts from flat files.

``Encoder`` encodes with the tokenizers library. A byte-level pre-tokenizer with its own pattern never lets a token pass from a character that
is not white space to white space, nor from an ASCII letter or digit to another printable ASCII character, so texts are cut there, some megabytes
at a time as one array of bytes, and each distinct piece is encoded once for each Python worker (two tables of about ``CACHED`` pieces are held).
Texts with added tokens, white space beyond ASCII's or very many characters are cut one by one, at their added tokens first, as the library does.
Texts with control characters on whose class regular expression libraries differ are encoded in one call, and so are all texts of any other
vocabulary: one with a normalizer, another pre-tokenizer or model, or added tokens that take white space along.

Token files (operator 3): ids in ascending doc_id order are cut into blocks of ``BLOCK`` ids; a block's bytes (or bits) are
transposed into planes, and each plane is compressed with zstandard. A row of the file table is one chunk with its entry of the
chunk index: part, number in the part, ids, plane sizes and the documents that it holds. Spark's own
committed Parquet files carry the chunks, so that any store that Spark can write will do and repeated or lost tasks leave nothing behind.

Flat files (operator 2): a stream of ids without any index; every document ends with the separator. Blocks are scanned
on their own and stitched by a prefix scan over the blocks of a file.

Null text counts as empty, and an empty text has its end id only. Documents with a null doc_id come last, repeated rows
are documents of their own (equal doc_ids in order of a hash of the text), and an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import CHUNK_BYTES, SPACE, chunks, columns, kept_by, read, table, utf8

CACHED = 500_000
BLOCK = 1 << 16
FLAT_BLOCK = 1 << 18
_L = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_UNIT = re.compile(rf" ?[{_L}]+(?=[.,;:!?]*(?!\S))|[.,;:!?]+(?!\S)| ?\S+|\s+(?=\s\S)|\s+")
_ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")
_APART = "[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"  # odd ones, and white space beyond ASCII's
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = ~_WORD[0x21:0x7F]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces of texts that lie one after another start, and the end: at a run of white space, at its last byte if a word follows, at a word after
    other white space than a blank, and at a mark after an ASCII letter or digit. Texts have no white space beyond ASCII's, and some byte."""
    space, cut = SPACE[data], np.zeros(len(data) + 1, bool)
    word = ~space
    follows = np.append(word[1:], False)
    follows[offsets[1:] - 1] = False  # the next byte is of another text
    cut[1:-1] = space[1:] & (word[:-1] | follows[1:]) | word[1:] & space[:-1] & (data[:-1] != 0x20) | _MARK[data[1:]] & _WORD[data[:-1]]
    cut[offsets] = True
    return np.flatnonzero(cut)


class Encoder:
    def __init__(self, path: str, specials: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.lengths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for t, i in self.tokenizer.get_vocab().items():
            self.lengths[i] = len(t)  # of a byte-level vocabulary each character stands for a byte
        plan = json.loads(self.tokenizer.to_str())
        own = plan["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        added = [t for t in plan["added_tokens"] if specials or not t["special"]]
        plain = plan["model"]["type"] == "BPE" and not plan["model"].get("dropout") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        self.by_piece = own and plan["normalizer"] is None and plain
        self.added = re.compile("(" + "|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) + ")") if added else None
        self.apart = "|".join([_APART] + [re.escape(t["content"]) for t in added])
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, new: set[str]) -> None:
        """Afterwards ``held`` has these units."""
        plain, others = [], []
        for u in new:
            if (ids := self.older.get(u)) is not None:
                self.held[u] = ids
            else:
                (plain if self.by_piece and u[:1] == " " and not u[1:2].isspace() and len(u) > 1 else others).append(u)
        for u, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self.held[u] = np.array(e.ids, self.dtype).tobytes()
        for at in range(0, len(plain), 1 << 15):  # no token passes from one to the next: one text of them has the same ids, told apart by the bytes that each id stands for
            some = plain[at : at + (1 << 15)]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(u.encode()) for u in some])) + 1
            raw, size = ids.tobytes(), self.dtype.itemsize
            for u, a, b in zip(some, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                self.held[u] = raw[size * a : size * b]

    def parts(self, text: str) -> list[str]:
        """A text cut at its added tokens, these among the parts."""
        return [p for p in self.added.split(text) if p] if self.added and self.added.search(text) else [text]

    def units(self, text: str) -> list[str]:
        if not self.by_piece or _ODD.search(text):
            return [text]
        parts = self.parts(text)
        return _UNIT.findall(text) if len(parts) == 1 else [u for p in parts for u in ([p] if self.added.fullmatch(p) else _UNIT.findall(p))]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The units of a text, some at a time."""
        if not self.by_piece or _ODD.search(text):
            yield [text]
            return
        for p in self.parts(text):
            if self.added and self.added.fullmatch(p):
                yield [p]
                continue
            units = (m.group() for m in _UNIT.finditer(p))
            while part := list(islice(units, 1 << 17)):
                yield part

    def look_up(self, units: list[str]) -> list[bytes]:
        """The ids of each unit. What was met since the last turn but one outlives a turn of the two tables."""
        if len(self.held) > CACHED:
            self.held, self.older = {}, self.held
        found = list(map(self.held.get, units))
        gaps = [k for k, f in enumerate(found) if f is None]
        self.learn({units[k] for k in gaps})
        for k in gaps:
            found[k] = self.held[units[k]]
        return found

    def ids(self, units: list[list[str]]) -> list[bytes]:
        """The ids of each list of units."""
        return [b"".join(self.look_up(u)) for u in units]

    def together(self, col: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, all cut at once; none matches ``apart``."""
        data, offsets = utf8(col)
        if not len(data):
            yield from [np.zeros(0, self.dtype)] * len(col)
            return
        at = cuts(data, offsets)
        pieces = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        found = pa.array(self.look_up(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        starts = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1] // self.dtype.itemsize
        which = pieces.indices.to_numpy()
        n = np.diff(starts)[which]
        ends = np.cumsum(n)
        ids = np.frombuffer(found.buffers()[2], self.dtype)[np.repeat(starts[which] - ends + n, n) + np.arange(ends[-1])]
        firsts = np.append(0, ends)[np.searchsorted(at, offsets)].tolist()
        for a, b in zip(firsts[:-1], firsts[1:], strict=True):
            yield ids[a:b]

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if (pa.compute.sum(pa.compute.binary_length(col)).as_py() or 0) > 2 * CHUNK_BYTES:
            for t in col.to_pylist():
                yield np.frombuffer(b"".join(self.ids([p])[0] for p in self.pieces(t or "")), self.dtype)
            return
        apart = np.ones(len(col), bool)
        if self.by_piece:
            apart = pa.compute.fill_null(pa.compute.match_substring_regex(col, self.apart), False).to_numpy(zero_copy_only=False)
        others = self.together(col.filter(pa.array(~apart)) if apart.any() else col)
        for k, alone in enumerate(apart.tolist()):
            yield np.frombuffer(self.ids([self.units(col[k].as_py() or "")])[0], self.dtype) if alone else next(others)


def encoder(path: str, specials: bool) -> Encoder:
    """One for each Python worker."""
    kept = kept_by("tokens")
    if (path, specials) not in kept:
        kept[path, specials] = Encoder(path, specials)
    return kept[path, specials]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Token files in planes -------------------------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, bits: bool = False) -> tuple[list[int], bytes]:
    """Sizes of the compressed planes of a block of ids (as unsigned 32-bit integers), lowest plane first, and the planes one after another."""
    import zstandard

    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if bits:
        raw = np.packbits((raw[:, None, :] >> np.arange(8, dtype=np.uint8)[None, :, None]) & 1, axis=2).reshape(32, -1)
    z = zstandard.ZstdCompressor(level=3)
    out = [z.compress(np.ascontiguousarray(p).tobytes()) for p in raw]
    return [len(p) for p in out], b"".join(out)


def from_planes(n: int, sizes: list[int], payload: bytes) -> np.ndarray:
    import zstandard

    z, at, planes = zstandard.ZstdDecompressor(), 0, []
    for s in sizes:
        planes.append(np.frombuffer(z.decompress(payload[at : at + s]), np.uint8))
        at += s
    raw = np.stack(planes)
    if len(sizes) == 32:
        full = np.unpackbits(raw, axis=1, count=n).reshape(4, 8, n)
        raw = (full << np.arange(8, dtype=np.uint8)[None, :, None]).sum(axis=1, dtype=np.uint8)
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1)


_X = 1 << 31
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2), modulo that of crc32, highest bit first."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def crc32_of_both(first: int, second: int, n: int) -> int:
    """crc32 of two strings one after another, from theirs and the second's length."""
    power, square = _X, _X >> 8  # x**0 and x**8
    while n:
        if n & 1:
            power = _times(power, square)
        square, n = _times(square, square), n >> 1
    return _times(power, first) ^ second


FILE_SCHEMA = "part int, chunk int, n_ids int, planes array<int>, payload binary, docs array<struct<doc_id:bigint,ord:bigint,start:int,n:int>>"
_FILE_ARROW = pa.schema([
    ("part", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.int32())), ("payload", pa.binary()),
    ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("ord", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))),
])


def token_file(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, block: int = BLOCK, bits: bool = False, specials: bool = True) -> DataFrame:
    """Writes the ids of all documents, in ascending doc_id order, and returns the file's chunks as a table."""
    path = vocabulary or default_vocabulary()
    ordered = (
        columns(docs, "doc_id", "text").withColumn("h_", F.xxhash64("text")).repartitionByRange(F.col("doc_id").asc_nulls_last(), "h_").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "h_").select("doc_id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, chunk, ordinal = encoder(path, specials), TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        inside: list[dict] = []
        n = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            sizes, payload = to_planes(ids, bits)
            return pa.RecordBatch.from_pylist([{"part": part, "chunk": chunk, "n_ids": len(ids), "planes": sizes, "payload": payload, "docs": inside}], schema=_FILE_ARROW)

        end = np.array([end_id], e.dtype)
        for b in chunks(batches):
            for doc, ids in zip(b.column(0).to_pylist(), e.encode(b.column(1)), strict=True):
                ids, at = np.concatenate([ids, end]), 0
                while at < len(ids):
                    take = min(block - n, len(ids) - at)
                    held.append(ids[at : at + take])
                    inside.append({"doc_id": doc, "ord": ordinal, "start": n, "n": take})
                    n, at = n + take, at + take
                    if n == block:
                        yield flush()
                        held, inside, n, chunk = [], [], 0, chunk + 1
                ordinal += 1
        if n:
            yield flush()

    return table(ordered.mapInArrow(write, FILE_SCHEMA), "none", batch_bytes=2 * CHUNK_BYTES)


def read_token_file(file: DataFrame, block: int = BLOCK) -> DataFrame:
    """From the chunks: doc_id, start (ids before it in the whole file), n_tokens and ids_crc32 of each document."""
    pieces_schema = "part int, ord long, doc_id long, chunk int, start int, n long, crc long"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                raw = from_planes(r["n_ids"], r["planes"], r["payload"]).tobytes()
                d = r["docs"]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([r["part"]] * len(d), pa.int32()), "ord": pa.array([x["ord"] for x in d], pa.int64()), "doc_id": pa.array([x["doc_id"] for x in d], pa.int64()), "chunk": pa.array([r["chunk"]] * len(d), pa.int32()), "start": pa.array([x["start"] for x in d], pa.int32()), "n": pa.array([x["n"] for x in d], pa.int64()),
                    "crc": pa.array([zlib.crc32(raw[4 * x["start"] : 4 * (x["start"] + x["n"])]) for x in d], pa.int64()),
                })

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, sizes, crcs = [], [], []
            for parts in b.column(2).to_pylist():
                crc, n = parts[0]["crc"], parts[0]["n"]
                for p in parts[1:]:
                    crc, n = crc32_of_both(crc, p["crc"], 4 * p["n"]), n + p["n"]
                starts.append(parts[0]["chunk"] * block + parts[0]["start"])
                sizes.append(n)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["part", "doc_id", "local", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part of the file
    parts = file.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("p_"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("before"))
    found = (
        file.mapInArrow(pieces, pieces_schema).groupBy("part", "ord").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("chunk", "start", "n", "crc"))).alias("pieces"))
        .select("part", "doc_id", "pieces").mapInArrow(joined, "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    )
    return found.join(parts, F.col("part") == F.col("p_")).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_file(token_file(read(spark, sf_dir, "documents")))


# Token counts from flat files --------------------------------------------------------------------------------------------


def flat_files(docs: DataFrame, vocabulary: str | None = None, block: int = FLAT_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Ids of all documents, each ended by the separator, as flat files cut into blocks (file, block, width, ids); and beside them the names of the documents (file, ord, doc_id)."""
    path = vocabulary or default_vocabulary()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, file = encoder(path, False), TaskContext.get().partitionId()
        end = np.array([separator(e)], e.dtype)
        held: list[np.ndarray] = []
        names: list[int | None] = []
        n = k = 0

        def flush(ids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": file, "block": k, "width": e.dtype.itemsize, "ids": ids.tobytes(), "names": names}], schema=_FLAT_ARROW)

        for b in chunks(batches):
            for doc, ids in zip(b.column(0).to_pylist(), e.encode(b.column(1)), strict=True):
                held += [ids, end]
                names.append(doc)
                n += len(ids) + 1
            if n >= block:
                ids = np.concatenate(held)
                for at in range(0, n - n % block, block):
                    yield flush(ids[at : at + block])
                    k, names = k + 1, []
                held, n = [ids[n - n % block :]], n % block
        if n or names:
            yield flush(np.concatenate(held))

    files = table(columns(docs, "doc_id", "text").mapInArrow(write, "file int, block int, width int, ids binary, names array<bigint>"), batch_bytes=2 * CHUNK_BYTES)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = files.select("file", "block", "names").withColumn("n_", F.coalesce(F.sum(F.size("names")).over(before), F.lit(0)))
    return files.select("file", "block", "width", "ids"), names.select("file", "n_", F.posexplode("names").alias("at", "doc_id")).select("file", (F.col("n_") + F.col("at")).alias("ord"), "doc_id")


_FLAT_ARROW = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("names", pa.list_(pa.int64()))])


def separator(e: Encoder) -> int:
    return e.tokenizer.token_to_id("<|endoftext|>")


def separator_scan(files: DataFrame, end_id: int) -> DataFrame:
    """From blocks of flat files (file, block, width, ids): n_tokens of each document (file, ord), its separator left out. A file that doesn't end with a separator has its last tokens as a document (closed false).

    Each block is searched on its own: tokens before its first separator, gaps between its separators, tokens after its
    last. A prefix scan over the blocks of a file then carries the open tail and the number of documents on."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, block, width, raw in zip(*(b.column(i) for i in range(4)), strict=True):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width.as_py()}")
                at = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array([file.as_py()], pa.int32()), "block": pa.array([block.as_py()], pa.int32()), "n": pa.array([len(ids)], pa.int64()), "ends": pa.array([len(at)], pa.int64()),
                    "head": pa.array([int(at[0]) if len(at) else len(ids)], pa.int64()), "tail": pa.array([len(ids) - 1 - int(at[-1]) if len(at) else None], pa.int64()), "gaps": pa.array([(np.diff(at) - 1)], pa.list_(pa.int64())),
                })

    found = files.select("file", "block", "width", "ids").mapInArrow(scan, "file int, block int, n long, ends long, head long, tail long, gaps array<bigint>")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("position", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = found.withColumns({
        "docs": F.coalesce(F.sum("ends").over(before), F.lit(0)),
        # the place after the last separator before this block
        "open": F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("position") + F.col("n") - F.col("tail"))).over(before), F.lit(0)),
        "last": F.lead("block").over(order).isNull(),
    })
    counts = F.when(F.col("ends") > 0, F.concat(F.array(F.col("position") + F.col("head") - F.col("open")), F.col("gaps"))).otherwise(F.array().cast("array<bigint>"))
    closed = found.select("file", "docs", F.posexplode(counts).alias("at", "n_tokens")).select("file", (F.col("docs") + F.col("at")).alias("ord"), "n_tokens", F.lit(True).alias("closed"))
    left = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("position") + F.col("n") - F.col("open"))
    rest = found.where("last").withColumn("left", left).where("left > 0").select("file", (F.col("docs") + F.col("ends")).alias("ord"), F.col("left").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, names = flat_files(read(spark, sf_dir, "documents"))
    counts = separator_scan(files, separator(encoder(default_vocabulary(), False)))
    return names.join(counts, ["file", "ord"], "left").select("doc_id", "n_tokens")
