"""Removal of repeated substrings: 100 bytes that also start earlier in the corpus, found on Burrows-Wheeler transforms.

1. Every string of ``LENGTH`` bytes holds an anchor: of its ``GRAM``-byte grams the one with the least hash, the leftmost of equals. Equal strings
   have equal anchors in equal places, so strings that share no anchor need never meet. The starts of a document fall
   into runs of one anchor; a run's content is all that its strings cover (at most ``SPAN`` + 99 bytes).
2. Runs whose anchor occurs once in the corpus hold nothing repeated. Runs of equal contents become one class, known by its first run.
3. Contents of the other classes are read from the texts of their first runs and dealt out by anchor. Blocks of whole anchors are
   transformed (suffixes sorted to a depth of 100, their preceding symbols as the transform). Intervals of suffixes are extended
   backward, breadth first: the level is the common prefix, each boundary is set once at its value, and the search stops at 100
   bytes. Boundaries still unset join suffixes that share 100 bytes or more.
4. In each such interval all but the first start (smallest doc_id, then start) are repeated; and so are all starts of a run that isn't
   the first of its class. Per document the repeated starts are united to the bytes that they cover.

An anchor of more than ``hot`` contents (a passage that very many documents hold, each with other text around it) would fill a
block: its strings are dealt out one by one, by the string itself.

Nothing is collected by key beyond the runs of one row. Null text counts as empty; every row is judged and cut by itself: where rows lack a
doc_id or repeat one, all rows are numbered in the order of doc_id (none last), hash of the text, place in the input; texts under 100
bytes are kept whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import chunks, columns, read, rolling, table, utf8

LENGTH, GRAM = 100, 20
SPAN = LENGTH - GRAM + 1
BLOCK = 2 << 20
_LOW = np.uint64((1 << 22) - 1)
HOT = 20_000

# place of a run: its first start, number of starts, and distance of the anchor from the first start
_AT, _N = 15, 7


def runs(data: np.ndarray, offsets: np.ndarray, anchors_only: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """Document (by number), place, anchor and class of the runs of texts that lie one after another, block by block."""
    r = rolling()
    for lo in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
        d = data[lo : lo + BLOCK + LENGTH - 1]
        prefix, n = r.prefix(d), len(d) - GRAM + 1
        h = prefix[GRAM:] - prefix[:-GRAM]
        h *= r.inverse[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        m = h & ~_LOW
        m |= np.arange(n, dtype=np.uint64)
        size = 1
        while size < SPAN:
            step = min(size, SPAN - size)
            m = np.minimum(m[:-step], m[step:])
            size += step
        first, last = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, lo + len(d), "left")
        pos = (m & _LOW).astype(np.int64)
        for k in range(first + 1, last + 1):  # strings that would cross the end of a document
            limit = offsets[k] - lo
            pos[max(0, limit - LENGTH + 1) : max(0, limit)] = -1
        change = np.flatnonzero(np.diff(pos, prepend=-2))
        end = np.append(change[1:], len(pos))
        inside = pos[change] >= 0
        start, end = change[inside], end[inside]
        anchor = pos[start]
        if anchors_only:
            yield (h[anchor],)
            continue
        doc = np.searchsorted(offsets, start + lo, "right") - 1
        place = (start + lo - offsets[doc] << _AT) | (end - start << _N) | (anchor - start)
        yield doc, place, h[anchor], r.of(prefix, start, end + LENGTH - 1)


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> _AT, place >> _N & 255


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(anchor, class, doc_, place) of the runs whose anchor occurs more than once."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            ids = b.column(0).to_numpy()
            with np.errstate(over="ignore"):
                for doc, place, anchor, name in runs(*utf8(b.column(1))):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(name.view(np.int64)), pa.array(ids[doc]), pa.array(place)], ["anchor", "class", "doc_", "place"])

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            with np.errstate(over="ignore"):
                for (anchor,) in runs(*utf8(b.column(1)), anchors_only=True):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], ["anchor"])

    found = docs.mapInArrow(f, "anchor long, class long, doc_ long, place long")
    often = docs.mapInArrow(anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select(F.col("anchor").alias("a_"))
    return table(found.join(often.hint("shuffle_hash"), F.col("anchor") == F.col("a_"), "left_semi"))


def contents(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(anchor, class, doc_, place, content) of classes (anchor, class, doc_, place, hot), read from the texts. A hot class gives a row for each string: class null, content the string."""
    lists = classes.groupBy(F.col("doc_").alias("d_")).agg(F.collect_list(F.struct("anchor", "class", "place", "hot")).alias("wanted"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = rolling()
        for b in batches:
            out: list[tuple] = []
            texts, lists_ = b.column(1), b.column(2)
            ends, fields = lists_.offsets.to_numpy(), [x.to_numpy(zero_copy_only=False) for x in lists_.values.flatten()]
            for k, doc in enumerate(b.column(0).to_pylist()):
                data = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""
                anchor, name, place, hot = (x[ends[k] : ends[k + 1]] for x in fields)
                start, n = _unpack(place)
                stop = start + n + LENGTH - 1
                good = np.flatnonzero(stop <= len(data))
                with np.errstate(over="ignore"):
                    if len(data) <= 2 * BLOCK:
                        same = r.of(r.prefix(np.frombuffer(data, np.uint8)), start[good], stop[good])
                    else:
                        same = np.array([r.of(r.prefix(np.frombuffer(data[x:y], np.uint8)), np.zeros(1, int), np.array([y - x]))[0] for x, y in zip(start[good].tolist(), stop[good].tolist(), strict=True)], np.uint64)
                good = good[same.view(np.int64) == name[good]]
                for i in good.tolist():
                    part = data[start[i] : stop[i]]
                    if hot[i]:
                        out += [(anchor[i], None, doc, int(start[i]) + x << _AT | 1 << _N, part[x : x + LENGTH]) for x in range(int(n[i]))]
                    else:
                        out.append((anchor[i], name[i], doc, place[i], part))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _CONTENT.types, strict=True)], schema=_CONTENT)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _CONTENT.types, strict=True)], schema=_CONTENT)

    rows = docs.join(lists.hint("shuffle_hash"), F.col("doc_") == F.col("d_")).select("doc_", "text", "wanted")
    return rows.mapInArrow(f, "anchor long, class long, doc_ long, place long, content binary")


_CONTENT = pa.schema([("anchor", pa.int64()), ("class", pa.int64()), ("doc_", pa.int64()), ("place", pa.int64()), ("content", pa.binary())])


def sorted_suffixes(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols (of 9 bits) at least, by doubling what is sorted."""
    n, h = len(text), 7
    wide = np.zeros(n + h, np.int64)
    wide[:n] = text
    key = np.zeros(n, np.int64)
    for i in range(h):
        key = (key << 9) | wide[i : i + n]
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    rank = np.empty(n + depth * 2, np.int64)
    rank[n:] = -1
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    open_ = np.flatnonzero(np.repeat(np.diff(np.append(head, n)) > 1, np.diff(np.append(head, n))))  # places of suffixes not alone
    while h < depth and len(open_):
        part = order[open_]
        key = (rank[part] << 32) | (rank[part + h] + 1)
        by = np.argsort(key)
        part, key = part[by], key[by]
        order[open_] = part
        new = np.append(True, key[1:] != key[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(part)))
        rank[part] = np.repeat(open_[heads], sizes)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


def intervals(text: np.ndarray, order: np.ndarray, least: int = LENGTH) -> np.ndarray:
    """Breadth-first backward extension on the transform of ``text`` (symbol 0 parts strings): the number of the interval of suffixes with a common prefix of ``least`` symbols, for each suffix in ``order``."""
    n = len(text)
    bwt = text[order - 1]
    back = np.empty(n, np.int64)  # where the suffix one symbol longer stands
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    counts = np.bincount(text, minlength=257)
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    right = np.cumsum(counts)
    left = (right - counts)[counts > 0]
    right = right[counts > 0]
    edge[right] = True  # level 1: strings of one symbol
    owner_at = np.full(n, -1, np.int32)
    for _ in range(2, least + 1):
        if not len(left):
            break
        one = right - left == 1
        l1 = left[one]
        l1 = back[l1[bwt[l1] != 0]]
        r1 = l1 + 1
        left, right = left[~one], right[~one]
        size = right - left
        if len(left):
            owner = np.repeat(np.arange(len(left), dtype=np.int32), size)
            at = np.arange(size.sum()) + np.repeat(left - np.append(0, np.cumsum(size)[:-1]), size)
            keep = bwt[at] != 0
            to, owner = back[at[keep]], owner[keep]
            if len(to) > n // 16:  # marks in place of a sort
                owner_at[to] = owner
                to = np.flatnonzero(owner_at >= 0)
                owner = owner_at[to]
                owner_at[to] = -1
            else:
                by = np.argsort(to)
                to, owner = to[by], owner[by]
            symbol = text[order[to]]
            new = np.append(True, (np.diff(to) != 1) | (np.diff(owner) != 0) | (np.diff(symbol) != 0))[: len(to)]
            first = np.flatnonzero(new)
            l2, r2 = to[first], (to[np.append(first[1:], len(to)) - 1] + 1 if len(to) else to)
            l1, r1 = np.concatenate([l1, l2]), np.concatenate([r1, r2])
        fresh = ~edge[r1]
        left, right = l1[fresh], r1[fresh]
        edge[right] = True
    return np.cumsum(edge[:n]) - 1


def repeats(parts: list[bytes], docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contents with the document and place of their first runs: those starts (content, offset) whose string also starts earlier."""
    n = _unpack(places)[1]
    sizes = n + LENGTH  # with the separator
    text = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8).astype(np.int16) + 1
    begin = np.append(0, np.cumsum(sizes))
    text[begin[1:] - 1] = 0
    order = sorted_suffixes(text)
    group = intervals(text, order)
    part = np.repeat(np.arange(len(parts)), sizes)[order]
    offset = order - begin[part]
    inside = offset < n[part]
    part, offset, group = part[inside], offset[inside], group[inside]
    if not len(part):
        return part, offset
    doc = np.unique(docs, return_inverse=True)[1]
    key = (doc[part].astype(np.int64) << 40) + _unpack(places)[0][part] + offset
    head = np.flatnonzero(np.append(True, np.diff(group) != 0))
    least = np.repeat(np.minimum.reduceat(key, head), np.diff(np.append(head, len(group))))
    later = key > least
    return part[later], offset[later]


def repeated_starts(rows: DataFrame) -> DataFrame:
    """(doc_, place) of stretches of repeated starts, from contents dealt out by anchor."""

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        docs, places = t["doc_"].to_numpy(), t["place"].to_numpy()
        part, offset = repeats(t["content"].to_pylist(), docs, places)
        if len(part):
            by = np.lexsort([offset, part])
            part, offset = part[by], offset[by]
            head = np.flatnonzero(np.append(True, (np.diff(part) != 0) | (np.diff(offset) != 1)))
            size = np.diff(np.append(head, len(part)))
            yield pa.RecordBatch.from_arrays([pa.array(docs[part[head]]), pa.array((_unpack(places)[0][part[head]] + offset[head] << _AT) | (size << _N))], ["doc_", "place"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in chunks(batches, "content", 1 << 18):
            a = b.column(0).to_numpy()
            if size > BLOCK:  # a block ends where the next anchor begins
                last = held[-1].column(0)[-1].as_py()
                cut = int(np.searchsorted(a != last, True))
                if cut < len(a):
                    yield from solve([*held, b.slice(0, cut)])
                    held, size, b = [], 0, b.slice(cut)
            held.append(b)
            size += b.nbytes
        if held:
            yield from solve(held)

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(f, "doc_ long, place long")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_, text) with a key doc_ of its own for each row, in the order of doc_id: doc_id itself where it is one, else the row's number in a written table."""
    rows = columns(docs, "doc_id", "text")
    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        return rows.select("doc_id", F.col("doc_id").alias("doc_"), "text")
    order = [F.col("doc_id").asc_nulls_last(), F.col("h_").asc(), F.col("t_").asc()]
    sorted_ = rows.select("*", F.xxhash64("text").alias("h_"), F.monotonically_increasing_id().alias("t_")).repartitionByRange(*order).sortWithinPartitions(*order)
    return table(sorted_.select("doc_id", F.monotonically_increasing_id().alias("doc_"), "text"))


def dedup_substrings(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed bytes: start, end)."""
    rows = keyed(docs)
    found = repeated_runs(rows.select("doc_", "text"))
    first = F.min(F.struct("doc_", "place"))
    classes = table(found.groupBy("anchor", "class").agg(first.alias("f")).select("anchor", "class", "f.doc_", "f.place"))
    big = table(classes.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(F.col("anchor").alias("a_")))
    split = big.count() > 0
    marked = classes.join(big.hint("shuffle_hash"), F.col("anchor") == F.col("a_"), "left").withColumn("hot", F.col("a_").isNotNull()).drop("a_") if split else classes.withColumn("hot", F.lit(False))
    parts = contents(rows.select("doc_", "text"), marked)
    items = lambda df, kind: df.select("doc_", (F.col("place") * 4 + kind).alias("item"))
    if split:
        parts = table(parts)
        one = parts.where("class IS NULL").select("content", "doc_", "place")
        least = one.groupBy(F.col("content").alias("c_")).agg(first.alias("f"))
        later = one.join(least.hint("shuffle_hash"), F.col("content") == F.col("c_")).where("f.doc_ <> doc_ OR f.place <> place")
        parts = parts.where("class IS NOT NULL")
    stretches = items(repeated_starts(parts), 2)
    if split:
        stretches = stretches.unionByName(items(later, 2))
    stretches = table(stretches)
    lists = items(found, 0).unionByName(items(classes, 1)).unionByName(stretches).groupBy(F.col("doc_").alias("d_")).agg(F.collect_list("item").alias("items"))
    return rows.join(lists.hint("shuffle_hash"), F.col("doc_") == F.col("d_"), "left").select("doc_id", "text", "items").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kinds of items: 0 a run, 1 a run that is the first of its class, 2 repeated starts. Repeated are runs that aren't first, and 2."""
    for b in batches:
        out = []
        for doc, text, held in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            data, spans = (text.as_buffer().to_pybytes() if text.is_valid else b""), []
            if held.is_valid:
                items = held.values.to_numpy()
                kind, place = items & 3, items >> 2
                place = np.concatenate([np.setdiff1d(place[kind == 0], place[kind == 1]), place[kind == 2]])
                start, n = _unpack(place)
                by = np.argsort(start)
                start, end = start[by], np.maximum.accumulate((start + n + LENGTH - 1)[by])
                head = np.flatnonzero(np.append(True, start[1:] > end[:-1])[: len(start)])
                spans = list(zip(start[head].tolist(), end[np.append(head[1:], len(end)) - 1].tolist() if len(end) else [], strict=True))
            kept, at = [], 0
            for s, e in spans:
                kept.append(data[at:s])
                at = e
            out.append({"doc_id": doc, "n_bytes": len(data), "n_removed": sum(e - s for s, e in spans), "n_spans": len(spans), "kept_sha256": hashlib.sha256(b"".join([*kept, data[at:]])).hexdigest(), "spans": [{"start": s, "end": e} for s, e in spans]})
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, schema=_OUT)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents"))
