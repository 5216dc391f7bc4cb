"""Near-duplicate documents with HyperMinHash sketches.

A document's set holds its distinct shingles of ``shingle`` words, as 64-bit hashes. Documents of equal sets form a class,
whose smallest doc_id stands for it from then on; groups of copies of any size so become one row.

Sketch: shingle hashes fall into ``BUCKETS`` buckets; a register keeps the least hash of its bucket as its count of leading zeros and
``MANTISSA`` bits after the first one. For banding an empty register takes the value of the first full one in a random order of its own
(``PROBES``), so that one shingle that differs spoils no neighbouring registers of small sets. ``ROWS`` registers make a band; classes that
agree in a band share a key. At a similarity of 0.8 independent registers would agree in none of the 42 bands with probability 3e-6; simulated,
3 of 320,000 pairs of 5 to 640 shingles at exactly 0.8 did. Such a link is lost, and one whose estimate errs by more than five standard errors.

The members of a key of at most ``SMALL`` are compared by the estimate (corrected for registers that agree by chance); pairs that may be linked by it, five
standard errors allowed, are confirmed on the full sets. Larger keys are joined in regions around pivots by exact differences to them (``regions``), which never compares all
members with each other, and ends in few rounds however far members are from the pivots.

Empty sets (null or empty texts, texts of white space) are linked with nothing. Documents without a doc_id join the class of their set, and stay
alone (component null, kept) where no member has an id. Rows that repeat a doc_id are judged each by its own text; a component's id is the smallest of
its members. Very long texts are one row of one task: their hashes take eight bytes a word. Columns other than doc_id and text are not read, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import chunks, mix, read, table
from corvane.llm.regions import classes, differences, full_sets, keyed, linked_components, members_of, shingles

BUCKETS, MANTISSA, ROWS, EMPTY = 256, 10, 6, 0xFFFF
BANDS = BUCKETS // ROWS
#: For each register the order in which others stand in for it: itself, then all others in a random order of its own.
PROBES = np.argsort(np.random.default_rng(4242).random((BUCKETS, BUCKETS)) - np.eye(BUCKETS), axis=1)
SHARE = (80, 100)
#: Members of a key that are compared with each other by their sketches.
SMALL = 8


def sketches(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Registers of each set of sorted hashes: leading zeros and mantissa of the least hash of each bucket, or EMPTY."""
    n = len(firsts) - 1
    out = np.full(n * BUCKETS, EMPTY, np.uint16)
    if len(hashes):
        place = np.repeat(np.arange(n, dtype=np.int64), np.diff(firsts)) * BUCKETS + (hashes >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        value = (hashes[first] & np.uint64((1 << 56) - 1)) | np.uint64(2)
        top = np.frexp(value.astype(np.float64))[1]
        mantissa = (value << (65 - top).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
        out[place[first]] = ((56 - np.minimum(top, 56)).astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)
    return out.reshape(n, BUCKETS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch that has a full register."""
    n, full_at = len(registers), registers != EMPTY
    at = np.broadcast_to(np.arange(BUCKETS), (n, BUCKETS)).copy()
    row, col = np.nonzero(~full_at & full_at.any(axis=1, keepdims=True))
    for turn in range(1, BUCKETS):
        if not len(row):
            break
        to = PROBES[col, turn]
        at[row, col] = to
        open_ = ~full_at[row, to]
        row, col = row[open_], col[open_]
    full = np.take_along_axis(registers, at, axis=1)[:, : BANDS * ROWS].reshape(n, ROWS, BANDS).transpose(0, 2, 1).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, BANDS)).copy()
    for i in range(ROWS):
        keys = mix(keys ^ full[:, :, i] + np.uint64(i << 32))
    return keys


def chance(load: np.ndarray) -> np.ndarray:
    """Probability that registers of two unrelated sets with ``load`` shingles a bucket agree."""
    k = np.arange(56)[:, None]
    high, low = 2.0**-k, np.where(k < 55, 2.0 ** -(k + 1), 0)
    return (2.0 ** -(k + 1 + MANTISSA) * load / 2 * (np.exp(-2 * load * low) - np.exp(-2 * load * high))).sum(axis=0)


def estimate(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of sketches, row by row, and the number of buckets that it rests on."""
    used = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(used.sum(axis=1), 1)
    p = chance(np.maximum(sizes / BUCKETS, 1e-9))
    return np.clip(((((a == b) & used).sum(axis=1)) / n - p) / (1 - p), 0, 1), n


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, class (16 bytes: hash of the set; null if empty), sketch."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            hashes, firsts = shingles(b, n)
            registers, names = sketches(hashes, firsts), []
            for i, j in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                names.append(hashlib.blake2b(hashes[i:j].tobytes(), digest_size=16).digest() if j > i else None)
            sketch = [r.tobytes() if k else None for r, k in zip(registers, names, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(firsts), pa.int64()), pa.array(names, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "text_key", "n_shingles", "class", "sketch"])

    return keyed(docs).mapInArrow(f, "doc_id long, text_key long, n_shingles long, class binary, sketch binary")


def _bands(classes: DataFrame) -> DataFrame:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                s = b.slice(at, 2000)
                with np.errstate(over="ignore"):
                    keys = band_keys(np.frombuffer(b"".join(s.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(s.column(0).to_numpy(), BANDS))], ["key", "node"])

    return classes.select("node", "sketch").mapInArrow(f, "key long, node long")


def _sides(pairs: DataFrame, table_: DataFrame, *names: str) -> DataFrame:
    """``pairs`` (u, v) with columns of both nodes, prefixed by u_ and v_."""
    for k in "uv":
        side = table_.select(F.col("node").alias(f"{k}_n"), *[F.col(c).alias(f"{k}_{c}") for c in names])
        pairs = pairs.join(side, F.col(k) == F.col(f"{k}_n")).drop(f"{k}_n")
    return pairs


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """u, v and whether their estimate may reach ``least``."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                s = b.slice(at, 2000)
                x, y = (np.frombuffer(b"".join(s.column(i).to_pylist()), np.uint16).reshape(-1, BUCKETS) for i in (2, 3))
                j, n = estimate(x, y, s.column(4).to_numpy().astype(float))
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(j >= least - 5 * np.sqrt(0.25 / n))], ["u", "v", "near"])

    both = _sides(pairs.select("u", "v"), classes, "sketch", "n_shingles")
    return both.select("u", "v", "u_sketch", "v_sketch", ((F.col("u_n_shingles") + F.col("v_n_shingles")) / 2).alias("n")).mapInArrow(f, "u long, v long, near boolean")


def links(docs: DataFrame, classes_: DataFrame, n: int, share: tuple[int, int]) -> DataFrame:
    """(node, component) of all nodes that are linked with another, from classes (node, doc_id, text_key, n_shingles, sketch)."""
    bands, least = _bands(classes_), share[0] / share[1]
    shared = bands.groupBy("key").agg(F.count("*").alias("n_")).where("n_ > 1").select(F.col("key").alias("k_"), "n_")
    rows = table(bands.join(shared, F.col("key") == F.col("k_")).select("key", "node", "n_"))
    held = rows.select(F.col("node").alias("m_")).distinct()
    sets = table(full_sets(docs, classes_.join(held, F.col("node") == F.col("m_"), "left_semi"), n))
    few = rows.where(F.col("n_") <= SMALL)
    pairs = few.select("key", F.col("node").alias("u")).join(few.select(F.col("key").alias("k_"), F.col("node").alias("v")), (F.col("key") == F.col("k_")) & (F.col("u") < F.col("v"))).select("u", "v").distinct()
    edges = table(differences(table(_estimated(pairs, classes_, least).where("near")), sets, share).where("linked").select("u", "v"))
    found, _ = linked_components(table(rows.where(F.col("n_") > SMALL).select("key", "node")), sets, share, edges=edges)
    return found


def keyed_near_duplicates(docs: DataFrame, shingle: int = 5, share: tuple[int, int] = SHARE) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept, and text_key, the xxhash64 of its text."""
    rows = table(sets_of(docs, shingle))
    nodes = classes(rows, "n_shingles", "sketch")
    out = members_of(rows, nodes, links(docs, nodes, shingle, share))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "text_key")


def near_duplicates(docs: DataFrame, shingle: int = 5, share: tuple[int, int] = SHARE) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept."""
    return keyed_near_duplicates(docs, shingle, share).drop("text_key")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=2)
