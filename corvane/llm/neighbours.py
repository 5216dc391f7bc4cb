"""Approximate nearest neighbours by NN-descent, searched greedily.

Equal vectors are one node of the graph, known by the smallest vec_id, so that copies cost nothing and ties are exact.

First graph: ``TREES`` trees of random hyperplanes, fitted on at most ``SAMPLE`` vectors, deal all nodes to leaves; within a leaf every
node gets its nearest nodes (leaves over ``LEAF`` are halved further in their task). NN-descent: around each node its neighbours and at
most ``K`` of those that name it meet, and each takes those nearer than its farthest neighbour as candidates; the best ``K`` stay. The graph is built on single
precision. Search: each query holds its best ``BEAM`` nodes, and in each of at most ``HOPS`` rounds the neighbours of its ``EXPAND`` nearest nodes not seen before are measured.

Distances are Euclidean, in double precision on the original vectors. Vectors that are null, empty, zero, hold a null or a component that
isn't finite, or have another length than most, take no part, nor do rows without vec_id; rows that repeat a vec_id count once if the vector
is the same. Ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import columns, read, table

TREES, SAMPLE, LEAF, K = 8, 20_000, 192, 24
ROUNDS, NEAREST = 3, 16
BEAM, EXPAND, HOPS = 256, 64, 6
#: Queries whose vectors are sent to all tasks at a time; more are searched block by block.
BLOCK = 20_000


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec): the components' bytes (double precision) of the vectors that take part."""
    good = "vec_id IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(embedding, x -> x <> 0)"
    rows = columns(vectors, "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>")).where(good)
    most = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if most:
        rows = rows.where(F.size("embedding") == most[0]["d"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            flat, n = col.flatten().to_numpy(zero_copy_only=False) + 0.0, len(col)  # -0.0 becomes 0.0
            width = len(flat) // n if n else 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in flat.reshape(n, width)], pa.binary())], ["vec_id", "vec"])

    return rows.mapInArrow(f, "vec_id long, vec binary")


def _matrix(col: pa.Array, kind: type = np.float32) -> np.ndarray:
    raw = col.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1) if raw else np.zeros((0, 1), kind)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def plant(sample: np.ndarray, leaves: int, seed: int) -> list[tuple]:
    """A tree: for each inner node the direction, the threshold, and the numbers of its children (below 0: leaf)."""
    rng, tree, n_leaves = np.random.default_rng(seed), [], 0

    def grow(rows: np.ndarray, share: int) -> int:
        nonlocal n_leaves
        if share <= 1 or len(rows) < 4:
            n_leaves += 1
            return -n_leaves
        a, b = sample[rng.choice(rows, 2, replace=False)]
        way = a - b
        at = sample[rows] @ way
        cut = float(np.median(at))
        left = at < cut
        if not left.any() or left.all():
            n_leaves += 1
            return -n_leaves
        here = len(tree)
        tree.append(None)
        tree[here] = (way, cut, grow(rows[left], share // 2), grow(rows[~left], share - share // 2))
        return here

    root = grow(np.arange(len(sample)), leaves)
    return tree if root == 0 else []


def leaf_of(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))] if tree else []
    while todo:
        k, rows = todo.pop()
        way, cut, low, high = tree[k]
        below = x[rows] @ way < cut
        for child, part in ((low, rows[below]), (high, rows[~below])):
            if child < 0:
                out[part] = -child
            elif len(part):
                todo.append((child, part))
    return out


def _nearest(ids: np.ndarray, x: np.ndarray, k: int, seed: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each vector its k nearest of the others; sets over LEAF are halved at random hyperplanes first."""
    if len(ids) > LEAF:
        rng = np.random.default_rng(seed + len(ids))
        at = x @ (x[rng.integers(len(ids))] - x[rng.integers(len(ids))])
        order = np.argsort(at, kind="stable")
        half = len(ids) // 2
        for part in (order[:half], order[half:]):
            yield from _nearest(ids[part], x[part], k, seed + 1)
        return
    k = min(k, len(ids) - 1)
    if k > 0:
        d = _distances(x, x)
        np.fill_diagonal(d, np.inf)
        best = np.argpartition(d, k - 1, axis=1)[:, :k]
        yield np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(d, best, axis=1).ravel().astype(float)


def _groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Rows of one key at a time, from rows that come sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            part = b.slice(i, j - i)
            if held and held[-1].column(key)[0].as_py() != keys[i]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


_EDGE = "u long, v long, d double"


def _edges(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for f in found:
        held.append(f)
        size += len(f[0])
        if size > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["u", "v", "d"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["u", "v", "d"])


def _best(edges: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("u").orderBy("d", "v")
    return edges.where("u <> v").groupBy("u", "v").agg(F.min("d").alias("d")).withColumn("r_", F.row_number().over(order)).where(F.col("r_") <= k).drop("r_")


def first_graph(nodes: DataFrame, n: int, k: int) -> DataFrame:
    sample = nodes.sample(min(1.0, 1.2 * SAMPLE / max(n, 1)), seed=7).limit(SAMPLE).toArrow() if n > SAMPLE else nodes.toArrow()
    x = _matrix(sample["vec"].combine_chunks()) if len(sample) else np.zeros((0, 1))
    forest = nodes.sparkSession.sparkContext.broadcast([plant(x, max(1, -(-n // (LEAF // 2))), s) for s in range(TREES)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column(1))
            for t, tree in enumerate(forest.value):
                yield pa.RecordBatch.from_arrays([pa.array(leaf_of(tree, m) * TREES + t), *b.columns], ["leaf", "node", "vec"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _edges(e for g in _groups(batches) for e in _nearest(g["node"].to_numpy(), _matrix(g["vec"].combine_chunks()), k))

    return nodes.select("node", "vec").mapInArrow(deal, "leaf long, node long, vec binary").repartition("leaf").sortWithinPartitions("leaf").mapInArrow(meet, _EDGE)


def descend(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Candidates from one round: those that meet around each node."""
    named = Window.partitionBy("v").orderBy(F.xxhash64("u"))
    back = graph.withColumn("r_", F.row_number().over(named)).where(F.col("r_") <= k).select(F.col("v").alias("at"), F.col("u").alias("m"))
    around = graph.select(F.col("u").alias("at"), F.col("v").alias("m")).unionByName(back).unionByName(nodes.select(F.col("node").alias("at"), F.col("node").alias("m"))).distinct()
    far = graph.groupBy(F.col("u").alias("f_")).agg(F.when(F.count("*") >= k, F.max("d")).otherwise(float("inf")).alias("far"))
    rows = around.join(nodes.select("node", "vec").join(far, F.col("node") == F.col("f_"), "left"), F.col("m") == F.col("node")).select("at", "m", "vec", F.coalesce("far", F.lit(float("inf"))).alias("far"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for g in _groups(batches):
                far = dict(zip(g["m"].to_pylist(), g["far"].to_pylist(), strict=True))
                for u, v, d in _nearest(g["m"].to_numpy(), _matrix(g["vec"].combine_chunks()), NEAREST):
                    nearer = d < np.array([far[x] for x in u.tolist()])
                    yield u[nearer], v[nearer], d[nearer]

        yield from _edges(found())

    return rows.repartition("at").sortWithinPartitions("at").mapInArrow(meet, _EDGE)


def build(nodes: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """The graph (u, v, d) over nodes (node, vec): each node's k nearest found."""
    graph = table(_best(first_graph(nodes, nodes.count(), k), k))
    for _ in range(rounds):
        graph = table(_best(graph.unionByName(descend(graph, nodes, k)), k))
    return graph


def _measured(pairs: DataFrame, queries, nodes: DataFrame) -> DataFrame:
    """(q, node, d) for pairs (q, node). ``queries``: sent to all tasks, ids in order and their vectors."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = queries.value
        for b in batches:
            if b.num_rows:
                d = _matrix(b.column(2), np.float64) - x[np.searchsorted(ids, b.column(0).to_numpy())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.sqrt((d * d).sum(1)))], ["q", "node", "d"])

    return pairs.join(nodes.select(F.col("node").alias("n_"), "full"), F.col("node") == F.col("n_")).select("q", "node", "full").mapInArrow(f, "q long, node long, d double")


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """(q, node, d): each query's best nodes. ``queries``: q (a node, where the search begins) and its vector."""
    rows = queries.orderBy("q").toArrow()  # BLOCK at most
    sent = queries.sparkSession.sparkContext.broadcast((rows["q"].to_numpy(), _matrix(rows["full"].combine_chunks(), np.float64)))
    order = Window.partitionBy("q").orderBy("d", "node")
    pool = table(queries.select("q", F.col("q").alias("node"), F.lit(0.0).alias("d"), F.lit(False).alias("seen")))
    for _ in range(HOPS):
        ranked = pool.withColumn("o_", F.when(~F.col("seen"), F.row_number().over(Window.partitionBy("q", "seen").orderBy("d", "node"))))
        ranked = ranked.withColumn("now", F.coalesce(F.col("o_") <= EXPAND, F.lit(False))).drop("o_")
        front = ranked.where("now").select("q", F.col("node").alias("u_"))
        new = front.join(graph.select("u", "v"), F.col("u_") == F.col("u")).select("q", F.col("v").alias("node")).distinct().join(pool.select("q", "node"), ["q", "node"], "left_anti")
        found = _measured(new, sent, nodes).withColumn("seen", F.lit(False))
        known = ranked.select("q", "node", "d", (F.col("seen") | F.col("now")).alias("seen"))
        before, pool = pool, table(known.unionByName(found).withColumn("r_", F.row_number().over(order)).where(F.col("r_") <= BEAM).drop("r_"))
        if not pool.where("NOT seen").limit(1).count():
            break
    return pool.select("q", "node", "d")


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([np.frombuffer(v).astype(np.float32).tobytes() for v in b.column(1).to_pylist()], pa.binary())], ["node", "full", "members", "vec"])


def nearest(vectors: DataFrame, is_query: str, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of all other vectors for rows of which the SQL condition ``is_query`` on vec_id holds."""
    rows = usable(vectors)
    first = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.groupBy("vec", "vec_id").agg(F.count("*").alias("n_")).withColumn("r_", F.row_number().over(first)).where(F.col("r_") <= k + 1)  # of copies, no more can be among a query's nearest
    nodes = table(few.groupBy("vec").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_list("vec_id")).alias("members")).select("node", F.col("vec").alias("full"), "members"), "none")
    nodes = nodes.mapInArrow(_single, "node long, full binary, members array<bigint>, vec binary")
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("v_")).distinct().join(nodes.select("node", "full"), F.col("v_") == F.col("full")).select("query_id", F.col("node").alias("a_"))
    asked = table(asked)
    queries = nodes.join(asked.select("a_").distinct(), F.col("node") == F.col("a_"), "left_semi").select(F.col("node").alias("q"), "full")
    graph, best = build(nodes, max(K, k)), None
    blocks = max(1, -(-queries.count() * 5 // (4 * BLOCK)))
    for i in range(blocks):
        part = search(queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i), nodes, graph)
        best = part if best is None else best.unionByName(part)
    # the members of a query's nodes by rank of the node: at most k + 1 of each are held
    near = best.join(nodes.select(F.col("node").alias("n_"), "members"), F.col("node") == F.col("n_")).select("q", "d", F.explode("members").alias("vec_id"))
    near = near.withColumn("r_", F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))).where(F.col("r_") <= k + 1).drop("r_")
    found = asked.join(near, F.col("a_") == F.col("q")).where("vec_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")
