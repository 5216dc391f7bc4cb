"""Top documents of a stated set of queries in one scan of the documents for each block of queries.

Each task scores its documents against tiles of queries and keeps the best n of each query, so that what is shuffled is n rows for each query and task, whatever the documents hold.
Words of many queries are columns of a matrix product, the others are met by their lists of queries, so that a pair of a document and a query costs little more than its common words. Blocks hold
at most ``BLOCK`` queries and ``TOKENS`` distinct tokens (one query at least) and are the only data sent to all tasks, one after another.

Queries: query_id, query; null queries have no tokens. Documents: doc_id, tokens, and what the channel asks for. Rows that repeat a query_id are one
query of several texts' tokens only if the caller means it: ids should be unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import strip, tokens
from corvane.operators import nearest

BLOCK, TOKENS = 1 << 16, 500_000
#: Queries of a tile, its columns, pairs scored at a time; a word is a column if one of ``RARE`` queries of the tile has it.
TILE, COLUMNS, PAIRS, RARE = 1 << 13, 128, 1 << 20, 150
#: Documents whose tokens are looked up at a time.
DOCS = 1024


class Asked:
    """A block of queries: ids, distinct tokens, how often each query has each (word, query and count, by word), numbers of tokens, whole queries in lower case."""

    def __init__(self, rows: list):
        self.ids = np.array([r["query_id"] for r in rows], np.int64)
        self.words = sorted({t for r in rows for t in r["t"] or ()})
        place = {w: i for i, w in enumerate(self.words)}
        pairs = np.array([place[t] * len(rows) + k for k, r in enumerate(rows) for t in r["t"] or ()], np.int64)
        pairs, counts = np.unique(pairs, return_counts=True)
        self.word, self.query, self.count = pairs // max(len(rows), 1), pairs % max(len(rows), 1), counts.astype(np.float32)
        self.n = np.bincount(self.query, self.count, len(rows)).astype(np.int64)
        self.phrases = [r["phrase"] or "" for r in rows]
        self.number = np.array([w[0].isdigit() for w in self.words], bool)


class Tile:
    """Queries lo..hi of a block: words that many of them have as columns, the others as lists of queries."""

    def __init__(self, asked: Asked, lo: int, hi: int):
        self.lo, self.hi = lo, hi
        mine = (asked.query >= lo) & (asked.query < hi)
        word, query, count = asked.word[mine], asked.query[mine] - lo, asked.count[mine]
        degree = np.bincount(word, minlength=len(asked.words))
        often = np.argsort(-degree, kind="stable")[:COLUMNS]
        often = often[degree[often] * RARE > hi - lo]
        self.place = np.full(len(asked.words), -1)
        self.place[often] = np.arange(len(often))
        self.columns = np.zeros((len(often), hi - lo), np.float32)
        dense = self.place[word] >= 0
        self.columns[self.place[word[dense]], query[dense]] = count[dense]
        self.query, self.count = query[~dense], count[~dense]
        self.at = np.searchsorted(word[~dense], np.arange(len(asked.words) + 1))

    def sums(self, n: int, doc: np.ndarray, word: np.ndarray, value: np.ndarray) -> np.ndarray:
        """For n documents and the tile's queries the sums of value times count over the common words; each (doc, word) once."""
        place = self.place[word]
        dense = place >= 0
        held = np.zeros((n, len(self.columns)), value.dtype)
        held[doc[dense], place[dense]] = value[dense]
        out = (held @ self.columns.astype(value.dtype, copy=False)).astype(np.float64)
        doc, word, value = doc[~dense], word[~dense], value[~dense]
        many = self.at[word + 1] - self.at[word]
        ends = np.cumsum(many)
        if len(ends) and ends[-1]:
            at = np.repeat(self.at[word] - (ends - many), many) + np.arange(ends[-1])
            width = self.hi - self.lo
            out += np.bincount(np.repeat(doc, many) * width + self.query[at], np.repeat(value, many) * self.count[at], n * width).reshape(n, width)
        return out


def blocks(queries: DataFrame, cut: Callable[[Column], Column] = tokens) -> Iterator[Asked]:
    """The queries by blocks, read one after another: by a hash of their id, so that each block is small whatever their number."""
    plain = queries.select("query_id", cut(F.col("query")).alias("t"), F.lower(strip(F.col("query"))).alias("phrase"))
    parts = -(-queries.count() // (BLOCK // 2))
    for part in range(parts):
        rows, words = [], set()
        for r in plain.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).collect():
            new = set(r["t"] or ())
            if rows and (len(rows) >= BLOCK or len(words | new) > TOKENS):
                yield Asked(rows)
                rows, words = [], set()
            rows.append(r)
            words |= new
        if rows:
            yield Asked(rows)


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)


def _term_counts(lists: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, word, times) of the words that occur, by list."""
    at = pc.index_in(lists.flatten(), value_set=words)
    hit = np.asarray(pc.is_valid(at))
    flat = np.repeat(np.arange(len(lists)), _lengths(lists))[hit] * len(words) + np.asarray(at.drop_null(), dtype=np.int64)
    flat, times = np.unique(flat, return_counts=True)
    return flat // max(len(words), 1), flat % max(len(words), 1), times


#: From a batch of documents the function of (first, last, tile) that scores documents by the tile's queries; -inf: no hit.
Scorer = Callable[[pa.RecordBatch], Callable[[int, int, Tile], np.ndarray]]


def _add(best: nearest.Best, tile: Tile, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
    """Merges a tile's scores; of those equal to a query's last one only what goes before it."""
    i, j = nearest.pairs(score.T, best.least(slice(tile.lo, tile.hi)), best.k)
    score, i = np.round(score[j, i], 9), i + tile.lo
    last, name, key = best.score[i, -1], best.ids[i, -1], best.more[i, -1, 0]
    good = (score > last) | ((score == last) & ((keys[j] > key) | ((keys[j] == key) & (ids[j] < name))))
    best.add(i[good], score[good], ids[j[good]], keys[j[good], None])


def best(queries: DataFrame, docs: DataFrame, n: int, scored: Callable[[Asked], Scorer], cut: Callable[[Column], Column] = tokens, keyed: bool = False) -> DataFrame | None:
    """(query_id, doc_id, score, and key if ``keyed``), the best n of each query and task, from docs (doc_id, key, ...), by score, then the later key, then the smaller id."""
    out, schema = None, "query_id long, doc_id long, score double" + (", key long" if keyed else "")
    for asked in blocks(queries, cut):
        sent = queries.sparkSession.sparkContext.broadcast(asked)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            score, held = scored(asked), nearest.Best(len(asked.ids), n, 1, keyed=True)
            tiles = [Tile(asked, at, min(at + TILE, len(asked.ids))) for at in range(0, len(asked.ids), TILE)]
            for b in (x.slice(at, DOCS) for x in batches for at in range(0, x.num_rows, DOCS)):
                f, ids, keys = score(b), b.column(0).to_numpy(), b.column(1).to_numpy()
                for tile in tiles:
                    some = max(64, PAIRS // (tile.hi - tile.lo))
                    for at in range(0, b.num_rows, some):
                        end = min(at + some, b.num_rows)
                        _add(held, tile, f(at, end, tile), ids[at:end], keys[at:end])
            query, doc, best_score, key = held.found(asked.ids)
            more = [key[:, 0]] if keyed else []
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query, doc, best_score, *more)], schema.replace(" long", "").replace(" double", "").split(", "))

        part = docs.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out


def sparse_scores(asked: Asked) -> Scorer:
    """Rows: doc_id, key, tokens. Zero scores count."""
    words = pa.array(asked.words, pa.string())

    def score(b: pa.RecordBatch) -> Callable[[int, int, Tile], np.ndarray]:
        length = np.maximum(_lengths(b.column(2)), 1)
        doc, word, times = _term_counts(b.column(2), words)
        value = np.minimum(times, 4).astype(np.float32)

        def f(lo: int, hi: int, tile: Tile) -> np.ndarray:
            at = slice(*np.searchsorted(doc, (lo, hi)))
            return tile.sums(hi - lo, doc[at] - lo, word[at], value[at]) / length[lo:hi, None]

        return f

    return score


def bm25_scores(idf: dict[str, float], average: float, k1: float, b: float) -> Callable[[Asked], Scorer]:
    """Rows: doc_id, key, tokens. Documents without a query's token are no hits."""

    def scored(asked: Asked) -> Scorer:
        words = pa.array(asked.words, pa.string())
        weight = np.array([idf.get(w, 0.0) for w in asked.words])

        def score(batch: pa.RecordBatch) -> Callable[[int, int, Tile], np.ndarray]:
            length = _lengths(batch.column(2)).astype(np.float64)
            doc, word, times = _term_counts(batch.column(2), words)
            value = times * (k1 + 1) / (times + k1 * (1 - b + b * length[doc] / max(average, 1e-9))) * weight[word]

            def f(lo: int, hi: int, tile: Tile) -> np.ndarray:
                at = slice(*np.searchsorted(doc, (lo, hi)))
                where = hi - lo, doc[at] - lo, word[at]
                return np.where(tile.sums(*where, np.ones(len(where[1]), np.float32)) > 0, tile.sums(*where, value[at]), -np.inf)

            return f

        return score

    return scored


def _inside(asked: Asked) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """From lists of tokens (list, word), once each, of the queries' tokens that lie inside one: each distinct token of a batch passes one automaton over the queries' tokens once."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, w in enumerate(asked.words):
        automaton.add_word(w, i)
    if asked.words:
        automaton.make_automaton()

    def f(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not asked.words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        coded = lists.flatten().dictionary_encode()
        met = [list({i for _, i in automaton.iter(w)}) for w in coded.dictionary.to_pylist()]
        many = np.array([len(x) for x in met], np.int64)
        flat, start = np.array([i for x in met for i in x], np.int64), np.cumsum(many) - many
        row, code = np.repeat(np.arange(len(lists)), _lengths(lists)), np.asarray(coded.indices, dtype=np.int64)
        row, code = row[many[code] > 0], code[many[code] > 0]
        times = many[code]
        ends = np.cumsum(times)
        at = np.repeat(start[code] - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)
        pairs = np.unique(np.repeat(row, times) * len(asked.words) + flat[at])
        return pairs // len(asked.words), pairs % len(asked.words)

    return f


def exact_scores(asked: Asked) -> Scorer:
    """Rows: doc_id, key, distinct tokens, body. A token of a query occurs in a body just if it lies inside one of the body's tokens."""
    inside = _inside(asked)

    def score(b: pa.RecordBatch) -> Callable[[int, int, Tile], np.ndarray]:
        doc, word = inside(b.column(2))
        one, number, bodies = np.ones(len(doc), np.float32), asked.number[word].astype(np.float32), b.column(3)

        def f(lo: int, hi: int, tile: Tile) -> np.ndarray:
            at, n = slice(*np.searchsorted(doc, (lo, hi))), asked.n[tile.lo : tile.hi]
            where = hi - lo, doc[at] - lo, word[at]
            hits = tile.sums(*where, one[at])
            out = hits / np.maximum(n, 1) + tile.sums(*where, number[at]) * 0.25
            last, body = -1, ""
            for i, k in zip(*np.nonzero((hits == n) & (n > 0)), strict=True):
                if i != last:
                    last, body = i, bodies[lo + int(i)].as_py()
                if asked.phrases[tile.lo + k] in body:
                    out[i, k] += 1.5
            return np.where(hits > 0, out, -np.inf)

        return f

    return score


def share_scores(asked: Asked) -> Scorer:
    """Rows: ord, key, distinct tokens. The share of a query's tokens that lie inside one of the row's tokens, 0.2 more if a number does."""
    inside = _inside(asked)

    def score(b: pa.RecordBatch) -> Callable[[int, int, Tile], np.ndarray]:
        doc, word = inside(b.column(2))
        one, number = np.ones(len(doc), np.float32), asked.number[word].astype(np.float32)

        def f(lo: int, hi: int, tile: Tile) -> np.ndarray:
            at = slice(*np.searchsorted(doc, (lo, hi)))
            where = hi - lo, doc[at] - lo, word[at]
            hits = tile.sums(*where, one[at])
            out = hits / np.maximum(asked.n[tile.lo : tile.hi], 1) + 0.2 * (tile.sums(*where, number[at]) > 0)
            return np.where(hits > 0, out, -np.inf)

        return f

    return score
