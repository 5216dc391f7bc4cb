"""Exact joins of sets by Jaccard similarity in regions around pivots, when keys name the pairs that may be linked.

``members`` (key, node) say which nodes may be linked: two linked nodes share a key. Jaccard distance ``d`` is a metric, and links are pairs within ``eps = 1 - share``.

Pivots. In each key some members are pivots (those first by hashes of the node, so that keys of like members take the same ones; ``pivots`` of them from
``WIDE`` members on). The full sets give each member's exact difference to each pivot of its key, ``D(x)``, its distance, and whether they are linked. Pivots
have then met all of their key and are done.

Regions. A member's home is its nearest pivot (a Voronoi region). A member also joins the region of each other pivot that is at most ``2 eps`` farther than
its home: if x is at home in p, and y is within eps of x, then ``d(y, p) <= d(x, p) + eps <= d(x, q) + eps <= d(y, q) + 2 eps`` for y's nearest pivot q. So
each link between members that are no pivots lies in a region in which one of the two is at home.

Inside a region sets are told by their differences to the pivot: ``|x ^ y| = |D(x) ^ D(y)|`` (symmetric differences). A region of at most ``LEAF`` members is joined from them by one task.

Larger regions are dealt into blocks, members at home first, then by the component that the links so far give them, and joined in tiles of two blocks, each by one task. Tiles in which all members
are of one component, or none is at home, are left out, so that the others cost the product of those outside the largest component and all.

Regions of more than ``TILES`` such tiles are cut further by meetings. Two members x, y in different components, of which y is not linked with the pivot p, are
linked just if ``|D(x)| + |D(y)| - 2 |D(x) & D(y)| <= L (|x| + |y|)``, ``L = (1 - share) / (1 + share)``. As ``|D(y)| > L (|y| + |p|)``, x has to share more than
``(|D(x)| + L (|p| - |x|)) / 2`` of its differences. So the rarest ``|D(x)|`` less that number plus one of x hold a difference of y (prefix filter), and
differences that only one member has drop out of them. Members that meet in such a difference form a key of the next round, which is joined in
the same way (recursion), until keys hold few pairs a node (counted first), which are compared directly. Templates whose copies have little in common but the template
go in one round, however far they are from the pivot: their own parts drop out. No pair within a key is left out but by these exact bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import chunks, columns, forget, shingle_hashes, table, utf8, word_hashes
from corvane.llm.components import components

#: Pivots of a key of at least WIDE members; smaller keys have one.
PIVOTS, WIDE = 3, 64
#: Members of a region that one task compares all with each other.
LEAF = 4096
#: Differences of a block (a tile holds two), and tiles of a region above which it is cut by meetings.
ELEMENTS, TILES = 1 << 21, 1 << 12
#: A difference is a column of a matrix product if it makes more than one of ``RARE`` pairs of a tile.
RARE = 300
#: Pairs for each node, and for small inputs in all, below which the pairs of the keys are compared directly.
PAIRS_PER_NODE, PAIRS = 1, 50_000


def shingles(batch: pa.RecordBatch, n: int, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return shingle_hashes(*word_hashes(*utf8(batch.column(batch.schema.get_field_index(text)))), n)


def keyed(docs: DataFrame) -> DataFrame:
    return columns(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("text_key"))


def full_sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """node and the sorted hashes of its set, from nodes (node, doc_id, text_key)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            hashes, firsts = shingles(b, n)
            parts = [hashes[i:j].tobytes() for i, j in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.binary())], ["node", "set"])

    first = nodes.select("node", F.col("doc_id").alias("d_"), F.col("text_key").alias("k_")).hint("shuffle_hash")
    rows = keyed(docs).join(first, (F.col("doc_id") == F.col("d_")) & (F.col("text_key") == F.col("k_")))
    return rows.select("node", "text").mapInArrow(f, "node long, set binary").dropDuplicates(["node"])


def classes(rows: DataFrame, *carried: str) -> DataFrame:
    """(class, node, doc_id, text_key, carried columns) of rows that have a class and a doc_id: node is the smallest doc_id, or a hash of the class where that id belongs to another class too."""
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    out = rows.where("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(first, *[F.first(c).alias(c) for c in carried])
    out = table(out.select("class", "first.*", *carried))
    several = out.groupBy("doc_id").agg(F.min("class").alias("keeps_"), F.count("*").alias("n_")).where("n_ > 1").select(F.col("doc_id").alias("d_"), "keeps_")
    if not several.head(1):
        return out.withColumn("node", F.col("doc_id"))
    mine = F.col("keeps_").isNull() | (F.col("class") == F.col("keeps_"))
    return table(out.join(several, F.col("doc_id") == F.col("d_"), "left").withColumn("node", F.when(mine, F.col("doc_id")).otherwise(F.xxhash64("class"))).drop("d_", "keeps_"))


def members_of(rows: DataFrame, classes_: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key of each of ``rows`` (doc_id, text_key, n_shingles, class): the smallest doc_id of its component."""
    joined = classes_.select("class", "node", "doc_id").join(found.withColumnRenamed("node", "c_n"), F.col("node") == F.col("c_n"), "left").select(F.col("class").alias("c_"), F.coalesce("component", "node").alias("component"), "doc_id")
    least = joined.groupBy("component").agg(F.min("doc_id").alias("least")).withColumnRenamed("component", "l_")
    named = joined.join(least, F.col("component") == F.col("l_")).select("c_", F.col("least").alias("component"))
    out = rows.select("doc_id", "n_shingles", "class", "text_key").join(named, F.col("class") == F.col("c_"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "text_key")


def differences(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """u, v, their set sizes, whether they are linked, and the hashes that only one of the two full sets holds."""
    num, den = share

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, linked, parts = [], [], []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                d = np.setxor1d(x, y, assume_unique=True)
                sizes.append((len(x), len(y)))
                linked.append((den + num) * len(d) <= (den - num) * (len(x) + len(y)))
                parts.append(d)
            ends = np.cumsum([0] + [len(d) for d in parts]).astype(np.int32)
            diff = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
            sizes = np.array(sizes, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes[:, 0]), pa.array(sizes[:, 1]), pa.array(linked, pa.bool_()), diff], ["u", "v", "nu", "nv", "linked", "diff"])

    both = pairs.select("u", "v")
    for k in "uv":
        both = both.join(sets.select(F.col("node").alias(f"{k}_n"), F.col("set").alias(f"{k}_set")), F.col(k) == F.col(f"{k}_n")).drop(f"{k}_n")
    return both.select("u", "v", "u_set", "v_set").mapInArrow(f, "u long, v long, nu long, nv long, linked boolean, diff array<bigint>")


def _stars(rows: DataFrame, pivots: int) -> DataFrame:
    """(ps, node) for each member of a key with the pivots ps. Keys of the same pivots are one: what is near whom goes by the pivots alone."""
    by = [F.min_by("node", F.xxhash64("node", F.lit(i))).alias(f"p{i}") for i in range(pivots)]
    chosen = rows.groupBy("key").agg(F.count("*").alias("n_"), *by)
    several = F.array_distinct(F.array(*[f"p{i}" for i in range(pivots)]))
    chosen = chosen.select(F.col("key").alias("k_"), F.when(F.col("n_") >= WIDE, several).otherwise(F.array("p0")).alias("ps"))
    return rows.select("key", "node").join(chosen, F.col("key") == F.col("k_")).select("ps", "node").distinct()


def _pairs(stars: DataFrame) -> DataFrame:
    """(u, v) for each pivot u and each member v that is no pivot, and for two pivots (u < v), each once."""
    rows = stars.select(F.explode("ps").alias("u"), F.col("node").alias("v"), F.array_contains("ps", F.col("node")).alias("pivot"))
    return rows.where("NOT pivot OR u < v").select("u", "v").distinct()


def _regions(stars: DataFrame, tried: DataFrame, eps: float) -> DataFrame:
    """(u, v, home) of members that are no pivots: their home and the regions within the window. A member's distances are one row: it has met no more pivots than it has keys, times PIVOTS."""
    far = (2 * F.size("diff") / (F.col("nu") + F.col("nv") + F.size("diff"))).alias("dist")
    known = tried.select("v", F.struct(far, "u").alias("x")).groupBy("v").agg(F.collect_list("x").alias("met"))
    rows = stars.where(~F.array_contains("ps", F.col("node"))).join(known, F.col("node") == F.col("v"))
    rows = rows.select("v", F.filter("met", lambda x: F.array_contains(F.col("ps"), x["u"])).alias("met")).withColumn("near", F.array_min("met"))
    inside = F.filter("met", lambda x: x["dist"] <= F.col("near.dist") + (2 * eps + 1e-9))
    rows = rows.select("v", "near", F.explode(inside).alias("x"))
    return rows.groupBy(F.col("x.u").alias("u"), "v").agg(F.max(F.col("x.u") == F.col("near.u")).alias("home"))


def _meetings(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Keys of the next round: (key, node, c, held, asks, home, d, size, room, before), from members (u, v, nu, nv, linked, diff, home, c) of regions.

    ``room``: differences of the node from here on in the order of the rarest, those left out that no other member has. ``before``: those before.
    ``asks``: the node is not linked with the pivot. ``held``: the difference is among the rarest of the node, as many as the module's docstring says.
    """
    num, den = share
    whole, part = den + num, den - num
    several = rows.groupBy("u").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("home").alias("any")).where("lo < hi AND any").select(F.col("u").alias("h_"))
    rows = rows.join(several, F.col("u") == F.col("h_"), "left_semi")
    spread = rows.select("u", "v", F.explode("diff").alias("e"))
    common = spread.groupBy("u", "e").agg(F.count("*").alias("df")).where("df > 1").select(F.col("u").alias("u_"), F.col("e").alias("e_"), "df")
    kept = spread.join(common, (F.col("u") == F.col("u_")) & (F.col("e") == F.col("e_"))).groupBy("u", "v").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("es"))
    sized = rows.select(F.col("u").alias("u_"), F.col("v").alias("v_"), "nu", "nv", "linked", "home", "c", F.size("diff").cast("long").alias("d"))
    kept = kept.join(sized, (F.col("u") == F.col("u_")) & (F.col("v") == F.col("v_")))  # a row for each pair
    alone = F.col("d") - F.size("es")
    held = F.col("d") - F.floor((F.col("d") * whole + (F.col("nu") - F.col("nv")) * part) / (2 * whole)) - alone
    asks = F.when(~F.col("linked"), F.col("d") - F.greatest(F.lit(1), F.ceil((F.col("d") * whole - (F.col("nu") + F.col("nv")) * part) / (2 * whole))) + 1 - alone).otherwise(0)
    wide = kept.select("u", "v", "es", "d", "nv", "home", "c", held.alias("held"), asks.alias("asks")).where("greatest(held, asks) > 0")
    each = wide.select("u", "v", "es", "held", "asks", "home", "c", "d", "nv", F.size("es").alias("k"), F.posexplode(F.slice("es", F.lit(1), F.greatest("held", "asks").cast("int"))).alias("i", "s"))
    flags = (F.col("i") < F.col("held")).alias("held"), (F.col("i") < F.col("asks")).alias("asks")
    return each.select(F.xxhash64("u", "s.e").alias("key"), F.col("v").alias("node"), "c", *flags, "home", "d", F.col("nv").alias("size"), (F.col("k") - F.col("i")).cast("long").alias("room"), F.transform(F.slice("es", F.lit(1), F.col("i")), lambda x: x["e"]).alias("before"))


def _open(rows: DataFrame) -> DataFrame:
    """Rows of the keys in which a member that asks may meet one of another component that is held, one of them at home."""
    by = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("held").alias("h"), F.max("asks").alias("a"), F.max("home").alias("o")).where("lo < hi AND h AND a AND o")
    return rows.join(by.select(F.col("key").alias("k_")), F.col("key") == F.col("k_"), "left_semi")


def _direct(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(u, v): the pairs of the keys that no bound excludes, each once."""
    (num, den), (a, b) = share, (rows.where("asks").alias("a"), rows.where("held").alias("b"))
    both = F.col("a.size") + F.col("b.size")
    # the first difference that two linked members share leaves both room for as many as they must share
    must = (F.col("a.d") + F.col("b.d")) * (den + num) - both * (den - num)
    room = F.least("a.room", "b.room") * 2 * (den + num)
    ring = F.abs(F.col("a.d") - F.col("b.d")) * (den + num) <= both * (den - num)  # |D(x)| and |D(y)| differ by no more than x and y do
    sizes = F.least("a.size", "b.size") * den >= F.greatest("a.size", "b.size") * num
    first = ~F.arrays_overlap("a.before", "b.before")  # each pair once for a pivot
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.c") != F.col("b.c")) & (F.col("a.home") | F.col("b.home")) & sizes & ring & (room >= must) & first
    return a.join(b, meet).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def _shared(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], n: int, m: int, total: int) -> np.ndarray:
    """How many of ``total`` elements the n sets of x and the m sets of y have in common, pair by pair, from (set, element) of either.

    Elements of the same sets are one of a weight. Frequent ones are columns of a matrix product, the others are met pair by pair."""
    draw, name = np.random.default_rng(5), np.zeros(total, np.uint64)
    for of, at in (x, y):
        np.add.at(name, at, draw.integers(0, 1 << 63, n if of is x[0] else m, dtype=np.uint64)[of])
    _, first, which, weight = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
    kept = np.zeros(total, bool)
    kept[first] = True
    (xo, xa), (yo, ya) = ((of[kept[at]], which[at[kept[at]]]) for of, at in (x, y))
    dx, dy = np.bincount(xa, minlength=len(first)), np.bincount(ya, minlength=len(first))
    often, few = dx * dy * RARE > n * m, (dx > 0) & (dy > 0)
    few &= ~often
    out = np.zeros((n, m), np.int32)
    place, kind = np.cumsum(often) - 1, np.float32 if weight.sum() < 1 << 24 else np.float64
    columns = weight[often].astype(kind)
    (xd, xc), (yd, yc) = ((of[often[at]], place[at[often[at]]]) for of, at in ((xo, xa), (yo, ya)))
    for lo in range(0, len(columns), 1024):
        w = columns[lo : lo + 1024]
        a, b = np.zeros((n, len(w)), kind), np.zeros((m, len(w)), kind)
        for held, of, c in ((a, xd, xc), (b, yd, yc)):
            some = (c >= lo) & (c < lo + 1024)
            held[of[some], c[some] - lo] = 1
        a *= w
        for i in range(0, n, 512):
            out[i : i + 512] += (a[i : i + 512] @ b.T).astype(np.int32)
    xo, xa, yo, ya = xo[few[xa]], xa[few[xa]], yo[few[ya]], ya[few[ya]]
    by = np.argsort(ya, kind="stable")
    yo, start = yo[by], np.searchsorted(ya[by], np.arange(len(first)))
    many, flat = dy[xa], out.reshape(-1)
    ends = np.cumsum(many)
    lo = 0
    while lo < len(xa):  # a million pairs at a time
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), "right")))
        t = many[lo:hi]
        e = np.cumsum(t)
        met = yo[np.repeat(start[xa[lo:hi]] - (e - t), t) + np.arange(e[-1])]
        np.add.at(flat, np.repeat(xo[lo:hi], t) * m + met, np.repeat(weight[xa[lo:hi]].astype(np.int32), t))
        lo = hi
    return out


def _joined(x: pa.Table, y: pa.Table | None, share: tuple[int, int]) -> pa.Table:
    """(u, v) that join the members of x linked with members of y (v, nv, c, home, diff), or with others of x: two for a member at most. Members of one c are joined already."""
    num, den = share
    sides = [x] if y is None else [x, y]
    v, size, c, home = ([t[k].to_numpy(zero_copy_only=False) for t in sides] for k in ("v", "nv", "c", "home"))
    diffs = [[np.asarray(d.values.to_numpy()) for d in t["diff"]] for t in sides]
    d = [np.array([len(z) for z in some], np.int64) for some in diffs]
    every, at = np.unique(np.concatenate([z for some in diffs for z in some] or [np.zeros(0, np.int64)]), return_inverse=True)
    common = np.bincount(at, minlength=len(every)) > 1
    place, rows, lo = np.cumsum(common) - 1, [], 0
    for n in d:
        some = at[lo : lo + int(n.sum())]
        rows.append((np.repeat(np.arange(len(n)), n)[common[some]], place[some[common[some]]]))
        lo += int(n.sum())
    n, m = len(d[0]), len(d[-1])
    shared, near = _shared(rows[0], rows[-1], n, m, int(common.sum())), np.zeros((n, m), bool)
    for lo in range(0, n, 512):
        k = slice(lo, lo + 512)
        near[k] = (d[0][k, None] + d[-1][None, :] - 2 * shared[k]) * (den + num) <= (size[0][k, None] + size[-1][None, :]) * (den - num)
        near[k] &= (c[0][k, None] != c[-1][None, :]) & (home[0][k, None] | home[-1][None, :])
    del shared
    free, met, out = near.any(axis=1), np.zeros(m, bool), []
    for first in np.flatnonzero(free).tolist():
        front = np.array([first]) if free[first] else np.zeros(0, np.int64)
        while len(front):
            free[front] = False
            found = np.flatnonzero(near[front].any(axis=0) & ~met)
            met[found] = True
            front = np.flatnonzero(near[:, found].any(axis=1) & free)
            out += [(v[0][first], z) for z in (*v[-1][found].tolist(), *v[0][front].tolist()) if z != v[0][first]]
    return pa.table({"u": pa.array([z for z, _ in out], pa.int64()), "v": pa.array([z for _, z in out], pa.int64())})


def _leaf_links(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(u, v): links that join the members (u, v, nv, linked, diff, home) of regions of at most LEAF members, region by region."""
    alone = F.when(F.col("linked"), F.col("u")).otherwise(F.col("v")).alias("c")  # those that are linked with the pivot are one

    def f(t: pa.Table) -> pa.Table:
        return _joined(t, None, share)

    return rows.select("u", "v", "nv", alone, "diff", "home").groupBy("u").applyInArrow(f, "u long, v long")


def _blocks(rows: DataFrame, half: int) -> DataFrame:
    """(u, v, b): members (u, v, home, c, diff) of regions by blocks of ``half`` members and ELEMENTS differences or so, those at home first, then by component."""
    each = rows.select("u", "v", "home", "c", F.greatest(F.size("diff"), F.lit(ELEMENTS // half)).cast("long").alias("w"))
    before = F.sum("w").over(Window.partitionBy("u").orderBy(F.desc("home"), "c", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("w")
    return each.select("u", "v", "home", "c", F.floor(before / ELEMENTS).cast("long").alias("b"))


def _tiles(blocks: DataFrame) -> DataFrame:
    """(u, x, y) of the blocks x <= y of a region that may hold links: members of two components, one of them at home."""
    by = blocks.groupBy("u", "b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("home").alias("home"))
    a, b = by.alias("a"), by.alias("b")
    several = F.least("a.lo", "b.lo") < F.greatest("a.hi", "b.hi")
    return a.join(b, (F.col("a.u") == F.col("b.u")) & (F.col("a.b") <= F.col("b.b")) & several & (F.col("a.home") | F.col("b.home"))).select("a.u", F.col("a.b").alias("x"), F.col("b.b").alias("y"))


def _tile_links(rows: DataFrame, blocks: DataFrame, tiles: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(u, v): links that join the members (u, v, nv, diff, home, c) of regions across components, tile by tile."""

    def f(t: pa.Table) -> pa.Table:
        x, y, b = t["x"][0], t["y"][0], t["b"]
        if x == y:
            return _joined(t, None, share)
        return _joined(*(t.filter(pc.equal(b, k)) for k in (x, y)), share)

    placed = blocks.select(F.col("u").alias("p_u"), F.col("v").alias("p_v"), "b")
    held = rows.select("u", "v", "nv", "c", "home", "diff").join(placed, (F.col("u") == F.col("p_u")) & (F.col("v") == F.col("p_v"))).drop("p_u", "p_v")
    wanted = tiles.select(F.col("u").alias("t_u"), "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("t_b"))
    each = held.join(wanted, (F.col("u") == F.col("t_u")) & (F.col("b") == F.col("t_b"))).select("u", "x", "y", "b", "v", "nv", "c", "home", "diff")
    return each.groupBy("u", "x", "y").applyInArrow(f, "u long, v long")


def linked_components(members: DataFrame, sets: DataFrame, share: tuple[int, int], pivots: int = PIVOTS, leaf: int = LEAF, edges: DataFrame | None = None) -> tuple[DataFrame, int]:
    """((node, component) of all nodes that are linked with another, rounds of pivots), from written tables of members (key, node) and sets (node, set), and links (u, v) that are known."""
    eps, none = 1 - share[0] / share[1], F.array().cast("array<bigint>")
    zero = lambda c, x=0: F.lit(x).cast("long").alias(c)
    yes = [F.lit(True).alias(c) for c in ("held", "asks", "home")]
    sizes = sets.select(F.col("node").alias("s_"), (F.octet_length("set") / 8).cast("long").alias("size"))
    rows = members.select("key", "node", F.col("node").alias("c"), *yes, zero("d"), zero("room", 1), none.alias("before")).join(sizes, F.col("node") == F.col("s_")).drop("s_")
    total, turn = sets.count(), 0
    edges = sets.sparkSession.createDataFrame([], "u long, v long") if edges is None else edges
    while True:
        counts = rows.groupBy("key").agg(F.sum(F.col("held").cast("long")).alias("h"), F.sum(F.col("asks").cast("long")).alias("a"))
        pairs = counts.agg(F.sum(F.col("h").cast("double") * F.col("a"))).first()[0] or 0
        if pairs <= PAIRS_PER_NODE * total + PAIRS:
            last = differences(_direct(rows, share), sets, share).where("linked").select("u", "v")
            return components(table(edges.unionByName(last)) if pairs else edges), turn
        turn += 1
        stars = table(_stars(rows, pivots))
        tried = table(differences(_pairs(stars), sets, share))
        regions = _regions(stars, tried, eps).withColumnRenamed("u", "u_").withColumnRenamed("v", "v_")
        inside = table(tried.join(regions, (F.col("u") == F.col("u_")) & (F.col("v") == F.col("v_"))).drop("u_", "v_"))
        wide = inside.groupBy("u").agg(F.count("*").alias("n_"), F.min("linked").alias("all_"), F.max("home").alias("any_")).where("n_ > 1 AND NOT all_ AND any_").select(F.col("u").alias("w_"), (F.col("n_") > leaf).alias("wide"))
        inner = inside.join(wide, F.col("u") == F.col("w_")).drop("w_")
        found = _leaf_links(inner.where("NOT wide"), share)
        edges = table(edges.unionByName(tried.where("linked").select("u", "v")).unionByName(found))
        large = inner.where("wide")
        if not large.head(1):
            forget(stars, tried, inside)
            return components(edges), turn
        named = components(edges).withColumnRenamed("node", "n_")
        large = table(large.join(named, F.col("v") == F.col("n_"), "left").withColumn("c", F.coalesce("component", "v")).drop("n_", "component", "wide"))
        blocks = table(_blocks(large, max(1, leaf // 2)))
        tiles = table(_tiles(blocks))
        vast = tiles.groupBy("u").agg(F.count("*").alias("n_")).where(F.col("n_") > TILES).select(F.col("u").alias("h_"))
        edges = table(edges.unionByName(_tile_links(large, blocks, tiles.join(vast, F.col("u") == F.col("h_"), "left_anti"), share)))
        before, rows = rows, large.join(vast, F.col("u") == F.col("h_"), "left_semi")
        if not rows.head(1):
            forget(stars, tried, inside, large, blocks, tiles)
            return components(edges), turn
        rows = table(_open(_meetings(rows, share)))
        forget(stars, tried, inside, large, blocks, tiles, *([before] if turn > 1 else []))
