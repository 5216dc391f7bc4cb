"""N-gram Jaccard join: the components of documents whose sets of word shingles are at least ``share`` alike, exactly.

A document's set holds its distinct shingles of ``shingle`` words, as 64-bit hashes. Documents of equal sets form a class, whose smallest doc_id stands for it; groups
of copies of any size so become one row.

Keys. Two linked sets of which the smaller has ``m`` elements differ in at most ``k(m) = m (1 - share) / share``. The hashes are cut into
``2 (k + 1)`` ranges (buckets) for each class of sizes; linked sets agree wholly in all buckets but ``k``. A set sends, as keys, the hashes of its
``k + c`` buckets with most elements (an order that goes by content alone); then linked sets send at least ``c`` equal keys: of the buckets in which both agree, the i-th
in that order comes at most k places later in either set. A set near the lower end of its class of sizes sends keys for the class below too. Nodes of which fewer than
``c`` keys are another's too can't be linked and drop out; so do keys of one node.

Regions. What remains is joined in Voronoi regions around pivots with windows by the triangle inequality, recursively and exactly (``regions``).

Empty sets (null or empty texts, texts of white space) are linked with nothing. Documents without a doc_id join the class of their set, and have no component where no member
has an id. Rows that repeat a doc_id are judged each by its own text; a component's id is the smallest of its members. Very long texts are one row of one
task (eight bytes a word). Columns other than doc_id and text are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import chunks, mix, read, table
from corvane.llm.regions import classes, full_sets, keyed, linked_components, members_of, shingles

SHARE, SHINGLE = (90, 100), 3
#: Classes of sizes: the least size of each, growing by this ratio.
RATIO = 1.4


def _edges(most: int = 1 << 40) -> np.ndarray:
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array(out, np.int64)


EDGES = _edges()


def apart(n, share: tuple[int, int]):
    """Elements in which a set of n elements and a larger one may differ."""
    return n * (share[1] - share[0]) // share[0]


def common(n, share: tuple[int, int]):
    """Keys that a set of n elements and a larger one that is linked with it must both send."""
    return apart(n, share) // 2 + 1


def signatures(hashes: np.ndarray, firsts: np.ndarray, share: tuple[int, int]) -> list[np.ndarray]:
    """The keys of each set of sorted hashes; the lowest bit of a key tells its class of sizes from the next."""
    n = np.diff(firsts)
    own = np.searchsorted(EDGES, n, "right") - 1
    least = -(-n * share[0] // share[1])
    doc = np.flatnonzero(n > 0)
    lower = doc[least[doc] < EDGES[own[doc]]]
    entry_doc, entry_class = np.concatenate([doc, lower]), np.concatenate([own[doc], own[lower] - 1])
    buckets = 2 * (apart(EDGES[entry_class + 1] - 1, share) + 1)
    wanted = apart(n[entry_doc], share) + common(n[entry_doc], share)
    sizes = n[entry_doc]
    ends = np.cumsum(sizes)
    entry = np.repeat(np.arange(len(entry_doc)), sizes)
    h = hashes[np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes) + np.repeat(firsts[entry_doc], sizes)]
    bucket = ((h >> np.uint64(11)).astype(np.float64) * (buckets[entry] / 2.0**53)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, (entry[1:] != entry[:-1]) | (bucket[1:] != bucket[:-1]))) if len(h) else np.zeros(0, np.int64)
    of, size = entry[starts], np.diff(np.append(starts, len(h)))
    sums = np.add.reduceat(mix(h.copy()), starts) if len(h) else h
    full = np.bincount(of, minlength=len(entry_doc))
    short = np.flatnonzero(full < np.minimum(wanted, buckets))  # so few buckets have elements that empty ones are sent too
    tag = entry_class.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = mix(sums + tag[of] + bucket[starts].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for e in short.tolist():
        empty = np.setdiff1d(np.arange(buckets[e]), bucket[starts[of == e]])
        keys = np.append(keys, mix(tag[e] + (empty.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)))
        of, size = np.append(of, np.full(len(empty), e)), np.append(size, np.zeros(len(empty), np.int64))
    keys = (keys & ~np.uint64(1)) | (entry_class[of] & 1).astype(np.uint64)
    by = np.lexsort((keys, -size, of))
    of, keys = of[by], keys[by]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    sent = rank < wanted[of]
    of, keys = entry_doc[of[sent]], keys[sent]
    by = np.argsort(of, kind="stable")
    return np.split(keys[by].view(np.int64), np.searchsorted(of[by], np.arange(1, len(n))))


def signed_sets(docs: DataFrame, n: int, share: tuple[int, int]) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, class (16 bytes: hash of the set; null if empty), keys."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            hashes, firsts = shingles(b, n)
            names = [hashlib.blake2b(hashes[i:j].tobytes(), digest_size=16).digest() if j > i else None for i, j in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
            with np.errstate(over="ignore"):
                keys = signatures(hashes, firsts, share)
            ends = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(firsts), pa.int64()), pa.array(names, pa.binary()), lists], ["doc_id", "text_key", "n_shingles", "class", "keys"])

    return keyed(docs).mapInArrow(f, "doc_id long, text_key long, n_shingles long, class binary, keys array<bigint>")


def _members(nodes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(key, node) of the nodes that share as many keys with others as a link takes."""
    rows = nodes.select("node", "n_shingles", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n_")).where("n_ > 1").select(F.col("key").alias("k_"))
    rows = table(rows.join(shared, F.col("key") == F.col("k_"), "left_semi"))
    num, den = share
    needed = F.expr(f"((n_shingles * {num} + {den - 1}) div {den}) * {den - num} div {num} div 2 + 1")  # common() of the smallest set that may be linked
    side = F.col("key").bitwiseAND(F.lit(1))
    enough = rows.groupBy("node", side.alias("side")).agg(F.count("*").alias("n_"), F.first("n_shingles").alias("n_shingles")).where(F.col("n_") >= needed).select(F.col("node").alias("e_node"), F.col("side").alias("e_side"))
    rows = rows.join(enough, (F.col("node") == F.col("e_node")) & (side == F.col("e_side")), "left_semi").select("key", "node")
    again = rows.groupBy("key").agg(F.count("*").alias("n_")).where("n_ > 1").select(F.col("key").alias("k_"))
    return table(rows.join(again, F.col("key") == F.col("k_"), "left_semi"))


def jaccard_join(docs: DataFrame, shingle: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id."""
    rows = table(signed_sets(docs, shingle, share))
    nodes = classes(rows, "n_shingles", "keys")
    members = _members(nodes, share)
    held = members.select(F.col("node").alias("m_")).distinct()
    sets = table(full_sets(docs, nodes.join(held, F.col("node") == F.col("m_"), "left_semi"), shingle))
    found, _ = linked_components(members, sets, share)
    return members_of(rows, nodes, found).drop("text_key")


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))
