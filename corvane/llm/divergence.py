"""Source divergence audit: how far the sources of a language are from each other, and which terms set each apart, in whole numbers.

Terms are maximal runs of letters A-Z (in lower case) and of bytes from \\x80 on. Each language keeps the ``V`` terms that at least ``least`` of its documents
hold. A group (language, source), and each language, gives each kept term ``p = 1 + floor(1e9 * (count + 2) / (N + 2 V))``, with ``N`` the sum of its counts.
Groups differ in a term by ``floor((p - q)**2 / (p + q))``.

Counts are summed in each task, then by (language, source, term). Pairs of groups are made in tiles: the groups of a language lie in blocks of ``BLOCK``, its
terms in chunks of about ``CHUNK`` by hash. A block's counts in a chunk are one packed row, which is sent to each tile (block by block) that the block takes part in. A
tile sums its submatrix over one chunk of terms after another; a long vocabulary is dealt out in spans of ``SPAN`` chunks, whose submatrices are added. So no
task holds more than two blocks of a chunk and one submatrix, however hot a source, long a vocabulary, or many the sources. Differences are
symmetric: a pair of blocks is one tile. Kept counts are joined by (language, term) and by (language, source), never gathered by either.

Null text, lang and source are read as ''. A group without terms is a group all the same, with count 0 everywhere; a language without kept terms gives 0 for each
pair and no terms. Repeated rows are documents each; doc_id isn't read, nor are other columns, whatever their names. A very long text is one row of one task. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import chunks, columns, read, table

LEAST, TOP, SCALE = 10, 10, 1_000_000_000
BLOCK, CHUNK, SPAN = 64, 4096, 64
#: Terms of all groups that a task sums before it sends them.
HELD = 1 << 19
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split(b" ")


def group_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences of each term in a group, and documents of the group that hold it."""

    def sent(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            size, names = len(n), pa.array(list(n), pa.binary()).cast(pa.string())
            same = [pa.array([x], pa.string()).take(pa.array(np.zeros(size, np.int64))) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*same, names, pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "df"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in chunks(batches):
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = Counter(terms(text))
                found.pop(b"", None)
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(found)
                df.update(found.keys())
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from sent(held)
                held = {}
        yield from sent(held)

    rows = _named(docs, "text").mapInArrow(f, "lang string, source string, term string, n long, df long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _named(docs: DataFrame, *more: str) -> DataFrame:
    return columns(docs, "lang", "source", *more).select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), *more)


def _share(n, total) -> F.Column:
    """1 + floor(SCALE * (n + 2) / total), exactly; ``total`` (N + 2 V) is 0 only where no term is kept."""
    return F.when(total > 0, 1 + F.call_function("div", (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), F.greatest(total, F.lit(1)).cast("decimal(20,0)"))).otherwise(1).cast("long")


def _submatrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """From rows of a block in a chunk, those of a tile's span one after another by chunk and side: (lang, i, j, value) of each tile and span."""
    now = total = left = None
    firsts = (0, 0)

    def done() -> pa.RecordBatch:
        i, j = (x.ravel() for x in np.indices(total.shape))
        keep = i != j if firsts[0] == firsts[1] else np.ones(len(i), bool)
        return pa.RecordBatch.from_arrays([pa.array([now[0]] * int(keep.sum()), pa.string()), pa.array(i[keep] + firsts[0]), pa.array(j[keep] + firsts[1]), pa.array(total.ravel()[keep])], ["lang", "i", "j", "value"])

    for b in batches:
        for r in range(b.num_rows):
            lang, bi, bj, span, side, width, none, g, t, p = (b.column(b.schema.get_field_index(c))[r] for c in ("lang", "bi", "bj", "span", "side", "width", "none", "g", "t", "p"))
            tile = (lang.as_py(), bi.as_py(), bj.as_py(), span.as_py())
            if tile != now:
                if total is not None:
                    yield done()
                now, total, firsts = tile, None, (tile[1] * size, tile[2] * size)
            full = np.repeat(none.values.to_numpy()[:, None], width.as_py(), axis=1)
            if g.is_valid:
                full[g.values.to_numpy(), t.values.to_numpy()] = p.values.to_numpy()
            if side.as_py() == 0:
                left = full
            if side.as_py() == 1 or tile[1] == tile[2]:
                if total is None:
                    total = np.zeros((len(left), len(full)), np.int64)
                for i, row in enumerate(left):
                    total[i] += ((full - row) ** 2 // (full + row)).sum(axis=1)
    if total is not None:
        yield done()


def _pairs(kept: DataFrame, groups: DataFrame, vocabulary: DataFrame, size: int, span: int) -> DataFrame:
    """(lang, i, j, value) for each two groups of a language, in both orders."""
    blocks = groups.groupBy("lang", F.floor(F.col("i") / size).cast("int").alias("block")).agg(F.first("chunks").alias("chunks"), F.first("blocks").alias("blocks"), F.transform(F.array_sort(F.collect_list(F.struct("i", "none"))), lambda x: x["none"]).alias("none"))
    widths = vocabulary.groupBy(F.col("lang").alias("w_lang"), F.col("chunk").alias("w_chunk")).agg(F.count("*").cast("int").alias("width"))
    at = F.struct((F.col("i") % size).cast("int").alias("g"), "t", "p")
    packed = kept.groupBy(F.col("lang").alias("p_lang"), F.floor(F.col("i") / size).cast("int").alias("p_block"), F.col("chunk").alias("p_chunk")).agg(F.collect_list(at).alias("cells"))
    packed = packed.select("p_lang", "p_block", "p_chunk", *[F.col("cells")[c].alias(c) for c in "gtp"])
    rows = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.join(widths, (F.col("lang") == F.col("w_lang")) & (F.col("chunk") == F.col("w_chunk")), "left")
    rows = rows.join(packed, (F.col("lang") == F.col("p_lang")) & (F.col("block") == F.col("p_block")) & (F.col("chunk") == F.col("p_chunk")), "left")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = rows.select("lang", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), F.floor(F.col("chunk") / span).cast("int").alias("span"), "chunk", F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), F.coalesce("width", F.lit(0)).alias("width"), "none", "g", "t", "p")
    tiles = tiles.repartition("lang", "bi", "bj", "span").sortWithinPartitions("lang", "bi", "bj", "span", "chunk", "side")
    one = tiles.mapInArrow(lambda batches: _submatrices(batches, size), "lang string, i long, j long, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    same = F.floor(F.col("i") / size) == F.floor(F.col("j") / size)
    return one.unionByName(one.where(~same).select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """(lang, source, part, item, value, rank): each other source of a group's language by its distance, and the terms that the group has most beyond its language."""
    counts = table(group_counts(docs))
    vocabulary = table(counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("df").alias("df")).where(F.col("df") >= least).select("lang", "term", "all"))
    langs = table(_named(docs).distinct())
    by_lang = langs.select(F.col("lang").alias("l_")).distinct().join(vocabulary.groupBy(F.col("lang").alias("v_")).agg(F.count("*").alias("kept"), F.sum("all").alias("total")), F.col("l_") == F.col("v_"), "left")
    by_lang = table(by_lang.select("l_", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), F.coalesce("total", F.lit(0).cast("long")).alias("total")))
    terms_ = vocabulary.join(by_lang, F.col("lang") == F.col("l_"))
    q, chunks_ = _share(F.col("all"), F.col("total") + 2 * F.col("kept")), F.greatest(F.lit(1), F.ceil(F.col("kept") / chunk)).cast("int")
    terms_ = terms_.select("lang", "term", q.alias("q"), F.pmod(F.xxhash64("term"), chunks_).cast("int").alias("chunk"))
    terms_ = table(terms_.withColumn("t", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1))
    known = terms_.select(F.col("lang").alias("k_lang"), F.col("term").alias("k_term"), "q", "chunk", "t")
    kept = table(counts.select("lang", "source", "term", "n").join(known, (F.col("lang") == F.col("k_lang")) & (F.col("term") == F.col("k_term"))).drop("k_lang", "k_term"))
    sums = kept.groupBy(F.col("lang").alias("s_lang"), F.col("source").alias("s_source")).agg(F.sum("n").alias("own"))
    groups = langs.join(sums, (F.col("lang") == F.col("s_lang")) & (F.col("source") == F.col("s_source")), "left").join(by_lang, F.col("lang") == F.col("l_"))
    room = F.coalesce("own", F.lit(0).cast("long")) + 2 * F.col("kept")
    of_lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", room.alias("room"), _share(F.lit(0).cast("long"), room).alias("none"), chunks_.alias("chunks"), (F.row_number().over(of_lang.orderBy("source")) - 1).alias("i"), F.ceil(F.count("*").over(of_lang) / block).cast("int").alias("blocks"))
    groups = table(groups)
    side = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "room", "i")
    kept = kept.join(side, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source"))).withColumn("p", _share(F.col("n"), F.col("room")))
    pairs = _pairs(kept.select("lang", "i", "chunk", "t", "p"), groups, terms_, block, span)
    names = groups.select(F.col("lang").alias("n_lang"), "source", F.col("i").alias("n_i"))
    others = groups.select(F.col("lang").alias("o_lang"), F.col("source").alias("item"), F.col("i").alias("o_i"))
    pairs = pairs.join(names, (F.col("lang") == F.col("n_lang")) & (F.col("i") == F.col("n_i"))).join(others, (F.col("lang") == F.col("o_lang")) & (F.col("j") == F.col("o_i")))
    value = F.expr("((p - q) * (p - q)) div (p + q)")
    apart = kept.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")).unionByName(ranked(apart).where(F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
w AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(t) AS term FROM d) GROUP BY ALL),
v AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, source, term, sum(w.n)::HUGEINT AS n FROM w JOIN v USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
vs AS (SELECT lang, count(v.term)::HUGEINT AS kept, coalesce(sum(v.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang FROM g) LEFT JOIN v USING (lang) GROUP BY ALL),
gs AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS own FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT gs.lang, gs.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (own + 2 * kept) AS p, 1 + (1000000000 * (v.n + 2)) // (total + 2 * kept) AS q
  FROM gs JOIN vs USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gs.lang AND c.source = gs.source AND c.term = v.term),
s AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
o AS (SELECT lang, source, 'pair' AS part, item, value FROM s
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o) WHERE part = 'pair' OR rank <= 10
"""
