"""Benchmark decontamination with an Aho-Corasick automaton.

Words are maximal runs of bytes outside \\x00-\\x2F, \\x3A-\\x60, \\x7B-\\x7F, A-Z in lower case. Each 13 words in a row of an
item (all of an item that has fewer, but not none) are a pattern; one automaton holds all patterns and each text passes
it once. Hits are kept as stretches of words and mapped to offsets in the original text.

The patterns are the only data sent to all tasks. Their bytes are measured first: each automaton holds at most
``block_bytes`` of item text, and a larger benchmark is cut into several automata whose hits are merged per document.
Null texts and null item texts have no words; items without an item_id are one item, named by the empty string; a null doc_id is kept as it is; very long texts are
one row of one task; repeated rows give a row each (with several automata, rows that
agree in doc_id and text give the same values); an empty table or benchmark gives no hits.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import columns, kept_by, read

WINDOW = 13
BLOCK_BYTES = 32 << 20
SHARE = 20  # a document is contaminated from one hit word in so many

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # in texts before A-Z become lower case

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits array<struct<start:int,end:int>>, items array<string>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def patterns(items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[str, tuple[int, list[str]]]:
    """Pattern text -> its number of words, and the items that have it."""
    out: dict[str, tuple[int, list[str]]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            held = out.setdefault((b" " + b" ".join(part) + b" ").decode("latin-1"), (len(part), []))[1]
            if (name := "" if item is None else str(item)) not in held:
                held.append(name)
    return out


def automaton(key: str, held):
    """Built once in each Python worker."""
    built = kept_by("decontaminate")
    if key not in built:
        import ahocorasick

        if len(built) > 3:
            built.clear()
        a = ahocorasick.Automaton()
        for text, value in held.value.items():
            a.add_word(text, (len(text), *value))
        if len(a):
            a.make_automaton()
        built[key] = a
    return built[key]


def scan(a, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged stretches of hit words, and items whose patterns occur."""
    w = words(text)
    if not w or not len(a):
        return len(w), [], set()
    line = (b" " + b" ".join(w) + b" ").decode("latin-1")
    spans, items = [], set()
    at = seen = 0
    for end, (size, n, names) in a.iter(line):
        seen += line.count(" ", at, end)  # spaces before the pattern's last one: words that end there
        at = end
        spans.append((seen - n, seen))
        items.update(names)
    return len(w), merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of words as code points of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def row(doc_id, text, n: int, spans: list[tuple[int, int]], items: set[str]) -> dict:
    hit, names = sum(b - a for a, b in spans), sorted(items)
    return {
        "doc_id": doc_id, "n_words": n, "n_hit": hit, "n_items": len(names), "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(),
        "contaminated": hit > 0 and SHARE * hit >= n, "hits": [{"start": a, "end": b} for a, b in offsets(text or "", spans)] if spans else [], "items": names,
    }


def blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list[dict[str, tuple[int, list[str]]]]:
    """Patterns of the items by blocks of at most ``block_bytes`` of text (one item at least). The benchmark is the stated query set: read by the driver block by block, never whole."""
    items = columns(benchmark, "item_id", "text")
    out, part, size = [], [], 0
    for r in items.toLocalIterator():
        n = len(r["text"] or "") * 4
        if part and size + n > block_bytes:
            out.append(patterns(part, window))
            part, size = [], 0
        part.append((r["item_id"], r["text"]))
        size += n
    return [*out, patterns(part, window)]


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
    ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())),
])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: words, hit words, items, hit stretches as code points of the text."""
    spark, parts = docs.sparkSession, blocks(benchmark, window, block_bytes)
    held = [(uuid.uuid4().hex, spark.sparkContext.broadcast(p)) for p in parts]

    if len(held) == 1:
        one = held[0]

        def scan_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = automaton(*one)
            for b in batches:
                for i in range(0, b.num_rows, 1000):
                    s = b.slice(i, 1000)
                    yield pa.RecordBatch.from_pylist([row(d, t, *scan(a, t)) for d, t in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True)], schema=_ARROW)

        return columns(docs, "doc_id", "text").mapInArrow(scan_all, SCHEMA)

    def scan_block(k: int):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = automaton(*held[k])
            for b in batches:
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    n, spans, items = scan(a, t)
                    if spans:
                        yield pa.RecordBatch.from_pylist([{"b_doc": d, "b_text": hashlib.sha256((t or "").encode()).hexdigest(), "spans": [[x for s in spans for x in s]], "items": [sorted(items)]}], schema=pa.schema([("b_doc", pa.int64()), ("b_text", pa.string()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.list_(pa.string())))]))

        return f

    rows = columns(docs, "doc_id", "text")
    hits = None
    for k in range(len(held)):
        part = rows.mapInArrow(scan_block(k), "b_doc long, b_text string, spans array<array<int>>, items array<array<string>>")
        hits = part if hits is None else hits.unionByName(part)
    hits = hits.groupBy("b_doc", "b_text").agg(F.flatten(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.flatten(F.collect_list("items")))).alias("items"))
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("b_doc")) & (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("b_text")), "left").select("doc_id", "text", "spans", "items")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                s = r["spans"] or []
                out.append(row(r["doc_id"], r["text"], len(words(r["text"])), merge(list(zip(s[::2], s[1::2], strict=True))), set(r["items"] or [])))
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return joined.mapInArrow(finish, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns; rows stay where they are."""
    parts = blocks(benchmark, window, block_bytes)
    held, at = [(uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(p)) for p in parts], docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            found: list[tuple[int, list]] = [(0, [])] * len(texts)
            for h in held:
                a = automaton(*h)
                found = [(x[0], f[1] + x[1]) for f, x in zip(found, (scan(a, t) for t in texts), strict=True)]
            hit = [sum(y - x for x, y in merge(s)) for _, s in found]
            yield b.filter(pa.array([not (h > 0 and SHARE * h >= n) for h, (n, _) in zip(hit, found, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
