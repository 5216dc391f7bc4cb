"""Quality classifier: interpolated modified Kneser-Ney models of the words of trusted text, one for each language.

Words are runs of letters (and bytes of other scripts), runs of digits, and single marks, as written. Each document is a start mark, its words and an end
mark. Grams of up to ``ORDER`` words are 64-bit hashes that hold the language too. Trusted are labels of quality 1 that aren't toxic.

Model. Counts cover every trusted document; they are summed in each task, then by gram; continuation counts, discounts by language and order and what contexts leave to the
lower order are grouped and joined by Spark from there, order by order. An interpolated model's log-probability of a document is a sum over all its grams
of a value that each gram has alone: ``log p(w) + log left(w)`` of a word, and of a longer gram that occurs in trusted text
``log p(gram) - log p(suffix) - log left(context) + log left(gram)``; other grams add nothing, unknown words the share of a new word.

Scores. Grams of all documents are therefore joined with the model by gram, and values are summed by document. Tasks first sum the grams of some megabytes of
text: a row holds the grams of one shard of the hashes and where they occur, packed, and meets the model's shard; no gram is hot, since a task sends it once. Shards
follow the input's size; they are sent in ``PASSES`` turns (counts in ``LEARN_PASSES``), which bounds the shuffle's disk. For a trusted document, grams that no other trusted document
has count as unseen (leave-one-out), so that its perplexity is comparable with that of others.

Three scores are held against quantiles of trusted documents, by language: the perplexity; ``contrast``, the sum of what the log ratios of contexts
of its words in rejected labelled text (quality 0 or toxic) to documents that hold them in trusted text have beyond ``EVIDENCE`` (contexts, as in
continuation counts: copies of a text count once), which finds single words that trusted text avoids; and ``repeated``, the share of word pairs that occur
before in the same 64 words. A document above a limit is rejected. Languages of fewer than ``LEAST`` trusted documents share one model and the limits of all.

Null and empty texts have no perplexity and are rejected, texts of white space too; a null language is a language of its own; null doc_ids are scored and never
trusted; repeated rows are scored each; repeated labels count once, the worst of them; columns other than doc_id, lang and text are not read; a very long
text is one batch of one task (about 20 bytes a byte); without trusted documents nothing but empty text is rejected. ``docs`` is read once a pass, so it
should be a table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import chunks, columns, forget, kept_by, mix, read, rolling, table, utf8

ORDER, PASSES, LEARN_PASSES, SLICES = 2, 5, 2, 2
QUANTILE, LEAST, EVIDENCE = 0.997, 100, math.log(6)
#: Text that a task sums at a time; text for each shard of the model; labels of at most so many rows are broadcast, more are joined by shuffle.
BATCH_BYTES, SHARD_BYTES, BROADCAST_ROWS = 5 << 19, 16 << 20, 2_000_000
#: Bits of a gram's hash that are sent; its shard holds others. A shard's grams don't grow with the input, so a foreign gram is met with probability 1e-8 at most.
SENT = np.uint64((1 << 48) - 1)
PACKED_ROWS = 1 << 19
#: What Python workers get at a time of texts, and of packed rows; counts that they give back at a time.
SENT_BYTES, SENT_ROWS = 4 << 20, 1 << 16
REPEAT_SPAN = 64
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x2545F4914F6CDD1D)
_MULTIPLY = np.random.default_rng(2024).integers(1, 2**62, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 mark
_KIND[:33] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def word_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text that has some between START and END, and the number of entries of each text."""
    kind = _KIND[data]
    first = np.ones(len(data), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    edges = np.flatnonzero(first)
    stops = np.append(edges[1:], len(data))
    real = kind[edges] > 0
    starts, stops, r, out, at = edges[real], stops[real], rolling(), [], 0
    while at < len(starts):  # blocks of about the span of the powers
        end = max(at + 1, int(np.searchsorted(stops, starts[at] + (1 << 20), "right")))
        lo, hi = starts[at], stops[end - 1]
        out.append(r.of(r.prefix(data[lo:hi]), starts[at:end] - lo, stops[at:end] - lo))
        at = end
    words = np.concatenate(out) if out else np.zeros(0, np.uint64)
    sizes = np.diff(np.searchsorted(starts, offsets))
    held = sizes > 0
    total = np.where(held, sizes + 2, 0)
    ends = np.cumsum(total)
    stream = np.empty(int(total.sum()), np.uint64)
    inside = np.ones(len(stream), bool)
    inside[(ends - total)[held]] = inside[ends[held] - 1] = False
    stream[inside], stream[(ends - total)[held]], stream[ends[held] - 1] = words, START, END
    return stream, total


def all_grams(stream: np.ndarray, sizes: np.ndarray, seeds: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: hash, context (the gram without its last word; of a word its language), suffix (without its first; of a word itself) and text of all grams.

    The hash of a longer gram is made from those of its context and its suffix; ``seeds`` has each text's language."""
    place = np.repeat(np.arange(len(sizes)), sizes)
    word = mix(stream * _MULTIPLY[0] + seeds[place] * _MULTIPLY[1])
    out = [(word, seeds[place], word, place)]
    for _ in range(order - 1):
        lower, of = out[-1][0], out[-1][3]
        same = of[1:] == of[:-1]
        context, suffix = lower[:-1][same], lower[1:][same]
        out.append((gram_hash(context, suffix), context, suffix, of[1:][same]))
    return out


def gram_hash(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    return mix(context * _MULTIPLY[2] + suffix * _MULTIPLY[3])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of about ``BATCH_BYTES`` of text at a time."""
    kept_by("quality")  # nothing but room: workers of a pipeline hold the vocabulary of its last stage
    held, size = [], 0
    for b in chunks(batches):
        n = b.column(b.schema.get_field_index("text")).nbytes
        if held and size + n > BATCH_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield pa.Table.from_batches(held)


def _parts(g: np.ndarray, shards: int) -> np.ndarray:
    return ((g >> np.uint64(24)) % np.uint64(shards)).astype(np.int32)


def gram_counts(rows: DataFrame, order: int, turn: int, passes: int) -> DataFrame:
    """(k, context, suffix, code, n, df) of the grams of a pass (longer ones by their context), from (text, seed, code, good); of rejected text only pairs of words, as k = -2, for their contexts."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batches(batches):
            with np.errstate(over="ignore"):
                stream, sizes = word_stream(*utf8(t["text"]))
                good, code = t["good"].to_numpy(), t["code"].to_numpy()
                made = all_grams(stream, sizes, t["seed"].to_numpy().view(np.uint64), order)
            for k, (g, context, suffix, place) in enumerate(made, 1):
                here = _parts(g if k == 1 else context, passes) == turn
                for kind in (k, -2) if k == 2 else (k,):
                    mine = np.flatnonzero(here & (good[place] == (kind > 0)))
                    by = mine[np.argsort(g[mine], kind="stable")]  # texts of a gram stay in order
                    key, doc = g[by], place[by]
                    if not len(key):
                        continue
                    new = np.append(True, key[1:] != key[:-1])
                    at = np.flatnonzero(new)
                    df = np.add.reduceat((new | np.append(True, doc[1:] != doc[:-1])).astype(np.int32), at, dtype=np.int32)
                    columns_ = [np.full(len(at), kind, np.int32), context[by[at]].view(np.int64), suffix[by[at]].view(np.int64), code[doc[at]], np.diff(np.append(at, len(key))), df]
                    counted = pa.RecordBatch.from_arrays([pa.array(x) for x in columns_], ["k", "context", "suffix", "code", "n", "df"])
                    yield from (counted.slice(lo, SENT_ROWS) for lo in range(0, len(at), SENT_ROWS))

    out = rows.select("text", "seed", "code", "good").mapInArrow(f, "k int, context long, suffix long, code int, n long, df int")
    return out.groupBy("k", "context", "suffix", "code").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def discounts(counts: DataFrame) -> DataFrame:
    """(d_code, d1, d2, d3): by language the discounts of counts 1, 2 and 3 or more, from (code, n)."""
    by = counts.groupBy(F.col("code").alias("d_code")).agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in range(1, 5)])
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.0)
    one = lambda i: F.when(F.col(f"n{i}") > 0, F.greatest(F.lit(0.0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))).otherwise(0.0)
    return by.select("d_code", *[one(i).alias(f"d{i}") for i in range(1, 4)])


def _hashed(rows: DataFrame) -> DataFrame:
    """``rows`` (context, suffix, and others) with g, the gram's hash."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            context, suffix = (b.column(b.schema.get_field_index(c)).to_numpy().view(np.uint64) for c in ("context", "suffix"))
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(gram_hash(context, suffix).view(np.int64))], [*b.schema.names, "g"])

    return rows.mapInArrow(f, rows.withColumn("g", F.lit(0).cast("long")).schema)


def model(docs: DataFrame, order: int, shards: int, passes: int, turns: int = LEARN_PASSES, slices: int = SLICES) -> tuple[list[DataFrame], DataFrame]:
    """From (text, seed, code, good) of labelled documents (code: a small number for the language): for each order the model (g, word, value, df, contexts), packed by shard and written part by part,
    and (seed, new): log-probability of an unknown word by language.

    A word has the documents and contexts that hold it, and is a ``word`` if a trusted document predicts it, as START is not.
    """
    counted = [table(gram_counts(docs, order, turn, turns), batch_bytes=SENT_BYTES) for turn in range(turns)]
    counts = reduce(DataFrame.unionByName, counted)
    of = lambda k: counts.where(F.col("k") == k)
    left, spare = {}, {}
    seen = table(of(-2).groupBy(F.col("suffix").alias("x_")).agg(F.count("*").alias("contexts")))

    def spared(rows: DataFrame, d: DataFrame) -> DataFrame:
        rows = rows.join(d, F.col("code") == F.col("d_code"))
        return rows.withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))).drop("d_code", "d1", "d2", "d3")

    # rows of each order with the counts that its order goes by
    known, out, new = None, [], None
    for k in range(1, order + 1):
        if k == 1:
            rows = of(1).select(F.col("suffix").alias("g"), "context", "suffix", "code", "n", "df")
        else:
            rows = of(k).drop("k")
            rows = _hashed(rows) if k < order else rows
        if k < order:  # how many words stand before each
            more = of(k + 1).groupBy(F.col("suffix").alias("s_")).agg(F.count("*").alias("m"))
            rows = table(rows.join(more, F.col("g") == F.col("s_"), "left").withColumn("n", F.col("m") if k == 1 else F.coalesce("m", "n")).drop("s_", "m"))
        d = table(discounts(rows))
        totals = spared(rows.where("n IS NOT NULL"), d).groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("spared"), F.count("*").alias("kinds"))
        left[k] = table(totals.select(F.col("context").alias("c_"), "total", (F.col("spared") / F.col("total")).alias("left"), "kinds"))
        parts = [(turn, i) for turn in range(turns) for i in range(slices)] if k == order else [None]
        for part in parts:  # the longest grams are the most: a share of their contexts at a time, and their counts go when they have been used
            some = rows if part is None else counted[part[0]].where((F.col("k") == k) & (F.pmod(F.xxhash64("context"), F.lit(slices)) == part[1])).drop("k")
            some = spared(some, d).join(left[k], F.col("context") == F.col("c_"))
            if k == 1:
                some = some.withColumn("p", (F.col("n") - F.col("d")) / F.col("total") + F.col("left") / (F.col("kinds") + 1)).withColumn("step", F.log("p"))
                new = table(left[1].select(F.col("c_").alias("seed"), F.log(F.greatest(F.col("left"), F.lit(1e-6)) / (F.col("kinds") + 1)).alias("new")))
            else:
                below = known.select(F.col("g").alias("b_"), F.col("p").alias("q"))
                some = some.join(below, F.col("suffix") == F.col("b_"))
                some = some.withColumn("p", (F.col("n") - F.col("d")) / F.col("total") + F.col("left") * F.col("q"))
                some = some.withColumn("step", F.log("p") - F.log("q") - F.when(F.col("left") > 0, F.log("left")).otherwise(0.0))
            if part is None:
                known = table(some.select("g", "p", "step", "df"))
                spare[k] = known
            else:
                out.append(table(_sharded(some.select("context", "suffix", F.col("step").alias("value"), F.col("df").cast("long").alias("df")), shards, passes)))
                if part[1] == slices - 1:
                    forget(counted[part[0]])
    for k in range(1, order):
        side = left[k + 1].where("left > 0").select("c_", F.log("left").alias("l_"))
        rows = spare[k].join(side, F.col("g") == F.col("c_"), "left").withColumn("value", F.coalesce("step", F.lit(0.0)) + F.coalesce("l_", F.lit(0.0)))
        if k == 1:
            rows = rows.join(seen, F.col("g") == F.col("x_"), "full").withColumn("g", F.coalesce("g", "x_")).withColumn("word", F.col("p").isNotNull())
        else:
            rows = rows.withColumns({"word": F.lit(False), "contexts": F.lit(0)})
        zero = lambda c, t: F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)).alias(c)
        out.append(table(_sharded(rows.select("g", "word", zero("value", "double"), zero("df", "long"), zero("contexts", "long")), shards, passes)))
    forget(seen, *left.values(), *spare.values())
    return out, new


def _repeats(pairs: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """How many pairs of words of each text occur before in their block of ``REPEAT_SPAN`` words."""
    block = pairs ^ mix((of.astype(np.uint64) << np.uint64(32)) + ((np.arange(len(pairs)) - np.searchsorted(of, of)) // REPEAT_SPAN).astype(np.uint64))
    by = np.argsort(block, kind="stable")
    twice = np.zeros(len(block), bool)
    twice[by[1:]] = block[by[1:]] == block[by[:-1]]
    return np.bincount(of, twice, texts)


def _packed(rows: DataFrame, order: int, shards: int, turn: int, passes: int) -> DataFrame:
    """Grams of a pass and where they occur: for each task's batch and shard a row of packed arrays, from (key, text, seed, good)."""

    mine = np.arange(turn, shards, passes, dtype=np.int32)
    names = ["batch", "shard", "grams", "cells", "docs", "counts", "good", "keys", "size", "again"]

    def packed(t: pa.Table, batch: int) -> Iterator[pa.RecordBatch]:  # its arrays go with it, before the next batch's are made
        keys, good = t["key"].to_numpy(), t["good"].to_numpy().astype(np.uint8)
        with np.errstate(over="ignore"):
            stream, sizes = word_stream(*utf8(t["text"]))
            seeds = t["seed"].to_numpy().view(np.uint64)
            every = all_grams(stream, sizes, seeds, order)
            made = [(x[0], x[3]) for x in every]
            repeats = _repeats(*made[1], len(sizes)) if turn == 0 else np.zeros(len(sizes))  # sent once, with sizes
        del every, stream
        g, place = np.concatenate([x for x, _ in made]), np.concatenate([x for _, x in made])
        del made
        here = _parts(g, shards)
        keep = here % passes == turn
        g, place, here = g[keep], place[keep], here[keep]
        g &= SENT
        if len(sizes) <= 1 << 16:  # a gram and its text fit 64 bits, sorted shard by shard
            by = np.argsort(here.astype(np.uint16) if shards <= 1 << 16 else here, kind="stable")
            here, both = here[by], ((g << np.uint64(16)) | place.astype(np.uint64))[by]
            cuts = np.flatnonzero(np.diff(here, prepend=-1, append=-1))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                both[lo:hi].sort()
            g, place = both >> np.uint64(16), both & np.uint64((1 << 16) - 1)
        else:
            by = np.lexsort((place, g, here))
            g, place, here = g[by], place[by], here[by]
        cell = np.append(True, (g[1:] != g[:-1]) | (place[1:] != place[:-1]) | (here[1:] != here[:-1])) if len(g) else np.zeros(0, bool)
        at = np.flatnonzero(cell)
        n = np.diff(np.append(at, len(g))).astype(np.uint32)
        g, place, here = g[at], place[at].astype(np.uint32), here[at]
        if not sizes.any():
            return
        place = place.astype(np.uint16 if len(sizes) <= 1 << 16 else np.uint32)
        marks = np.packbits(good).tobytes()
        home = int(mine[batch % len(mine)])  # has the batch's documents; their sizes go once
        told = [x.tobytes() for x in (keys, *((sizes - (sizes > 0), repeats / np.maximum(sizes - 1, 1)) if turn == 0 else (np.zeros(len(sizes), np.int64), repeats)))]
        bounds = np.searchsorted(here, np.append(mine, shards))
        for j, shard in enumerate(mine.tolist()):
            i0 = bounds[j]
            i1 = int(np.searchsorted(here, shard, "right"))
            if i0 == i1 and shard != home:
                continue
            gs, ps, ns = g[i0:i1], place[i0:i1], n[i0:i1]
            start = np.append(True, gs[1:] != gs[:-1]) if len(gs) else np.zeros(0, bool)
            cells = np.diff(np.append(np.flatnonzero(start), len(gs))).astype(np.uint32)
            planes = np.ascontiguousarray(gs[start].view(np.uint8).reshape(-1, 8)[:, :6].T)  # bytes of a place together: the highest are in runs
            row = [x.tobytes() for x in (planes, cells, ps, ns.astype(np.uint16 if int(ns.max(initial=0)) < 1 << 16 else np.uint32))]
            row += [marks, *(told if shard == home else (None, None, None))]
            yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([shard], pa.int32()), *[pa.array([x], pa.binary()) for x in row]], names)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, t in enumerate(_batches(batches)):
            # a task that runs again and gets its rows in another order gives other batches
            name = hashlib.blake2b(t["key"].to_numpy().tobytes() + f"{task} {i}".encode(), digest_size=8).digest()
            yield from packed(t, int.from_bytes(name, "little", signed=True))

    schema = "batch long, shard int, grams binary, cells binary, docs binary, counts binary, good binary, keys binary, size binary, again binary"
    return rows.select("key", "text", "seed", "good").mapInArrow(f, schema)


def _met(packed: DataFrame, known: DataFrame) -> DataFrame:
    """Sums of a turn by document (key): value, found (words that the model knows), contrast, size, again, copies.

    A shard gives a row back for each batch, with the sums of its documents packed; those of a batch are added up in one task. A document thus has one row a turn, however many shards there are.
    """
    names = ["batch", "docs", "value", "found", "strange", "contrast", "keys", "size", "again"]

    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        of = lambda c, t: np.frombuffer(b"".join(right[c].to_pylist()), t)
        known_g = of("g", np.uint64)
        by = np.argsort(known_g, kind="stable")
        known_g = known_g[by]
        word, value = of("word", np.uint8)[by], of("value", np.float64)[by]
        df, contexts = (of(c, np.uint32)[by].astype(np.int64) for c in ("df", "contexts"))
        out = []
        for raw in zip(*(left[c] for c in ("grams", "cells", "docs", "counts", "good")), strict=True):
            planes = np.frombuffer(raw[0].as_buffer(), np.uint8).reshape(6, -1)
            g = np.zeros((planes.shape[1], 8), np.uint8)
            g[:, :6] = planes.T
            g = g.view(np.uint64).ravel()
            cells = np.frombuffer(raw[1].as_buffer(), np.uint32)
            total = int(cells.sum(dtype=np.int64))
            doc, n = (np.frombuffer(raw[i].as_buffer(), np.uint16 if len(raw[i].as_buffer()) == 2 * total else np.uint32) for i in (2, 3))
            good = np.unpackbits(np.frombuffer(raw[4].as_buffer(), np.uint8)).astype(np.int64)
            if len(known_g):
                at = np.searchsorted(known_g, g)
                at[at == len(known_g)] = 0
                hit = known_g[at] == g
            else:
                at, hit = np.zeros(len(g), np.int64), np.zeros(len(g), bool)
            at, hit = np.repeat(at[hit], cells[hit]), np.repeat(hit, cells)
            doc, n = doc[hit], n[hit].astype(np.float64)
            others = df[at] - good[doc]  # trusted documents but this one
            seen = others > 0
            rare = np.flatnonzero(contexts[at])
            ratio = np.maximum(np.log((contexts[at[rare]] + 0.5) / (np.maximum(others[rare], 0) + 0.5)) - EVIDENCE, 0)
            rare, ratio = rare[ratio > 0], ratio[ratio > 0]
            sums = [np.bincount(doc, w, len(good)) for w in (value[at] * n * seen, n * (word[at] & seen))]
            held = np.flatnonzero((sums[0] != 0) | (sums[1] != 0)).astype(doc.dtype)
            out.append([x.tobytes() for x in (held, sums[0][held], sums[1][held].astype(np.uint32), doc[rare], ratio)])
        arrays = [pa.array([x[i] for x in out], pa.binary()) for i in range(5)]
        return pa.table([left["batch"], *arrays, left["keys"], left["size"], left["again"]], names=names)

    def add(rows: pa.Table) -> pa.Table:
        own = [i for i, x in enumerate(rows["keys"]) if x.is_valid]
        if len(own) != 1:
            raise ValueError("a batch has no documents: its task ran again and got its rows in another order")
        keys, size, again = (np.frombuffer(rows[c][own[0]].as_buffer(), t) for c, t in (("keys", np.int64), ("size", np.int64), ("again", np.float64)))
        kind = np.uint16 if len(keys) <= 1 << 16 else np.uint32
        joined = lambda c, t: np.frombuffer(b"".join(rows[c].to_pylist()), t)
        doc, strange = joined("docs", kind), joined("strange", kind)
        sums = [np.bincount(d, joined(c, t), len(keys)) for d, c, t in ((doc, "value", np.float64), (doc, "found", np.uint32), (strange, "contrast", np.float64))]
        here = np.flatnonzero((size > 0) | (sums[0] != 0) | (sums[1] != 0) | (sums[2] != 0))
        columns_ = [keys, *[x.astype(np.float64) for x in (*sums, size, again, size > 0)]]
        return pa.table([pa.array(x[here]) for x in columns_], names=["key", "value", "found", "contrast", "size", "again", "copies"])

    met = packed.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(f, "batch long, docs binary, value binary, found binary, strange binary, contrast binary, keys binary, size binary, again binary")
    return met.groupBy("batch").applyInArrow(add, "key long, value double, found double, contrast double, size double, again double, copies double")


def _sharded(known: DataFrame, shards: int, passes: int) -> DataFrame:
    """The model's grams (g, or context and suffix) packed: for each ``PACKED_ROWS`` of a task and each shard a row of arrays; what ``known`` lacks is zero."""

    def packed(b: pa.Table) -> Iterator[pa.RecordBatch]:
        of = lambda c, t: b[c].to_numpy().astype(t) if c in b.column_names else np.zeros(b.num_rows, t)
        with np.errstate(over="ignore"):
            g = b["g"].to_numpy().view(np.uint64) if "g" in b.column_names else gram_hash(b["context"].to_numpy().view(np.uint64), b["suffix"].to_numpy().view(np.uint64))
        here, g = _parts(g, shards), g & SENT
        by = np.lexsort((g, here))
        here, arrays = here[by], [g[by], *(of(c, t)[by] for c, t in (("word", np.uint8), ("value", np.float64), ("df", np.uint32), ("contexts", np.uint32)))]
        cuts = np.flatnonzero(np.diff(here, prepend=-1, append=-1))
        held = here[cuts[:-1]]
        binary = [pa.array([x[lo:hi].tobytes() for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()) for x in arrays]
        yield pa.RecordBatch.from_arrays([pa.array(held), *binary, pa.array(held % passes)], ["shard", "g", "word", "value", "df", "contexts", "turn"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACKED_ROWS:
                yield from packed(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from packed(pa.Table.from_batches(held))

    return known.mapInArrow(f, "shard int, g binary, word binary, value binary, df binary, contexts binary, turn int")


def judgements(labels: DataFrame) -> DataFrame:
    """(l_doc, good) of labelled documents, each once: quality 1 and not toxic (null: not), by the worst of its labels."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return columns(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("l_doc")).agg(F.min(good).alias("good_"))


def row_key(doc: str = "doc_id", text: str = "text"):
    return F.xxhash64(doc, text)


def scores(docs: DataFrame, labels: DataFrame, order: int = ORDER, passes: int = PASSES, least: int = LEAST, quantile: float = QUANTILE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, lang, key, perplexity, contrast, repeated, their limits, kept."""
    known = table(judgements(labels))
    few = known.count() <= BROADCAST_ROWS
    known = F.broadcast(known) if few else known.hint("shuffle_hash")
    rows = columns(docs, "doc_id", "lang", "text").join(known, F.col("doc_id") == F.col("l_doc"), "left").drop("l_doc")
    names = rows.select("doc_id", "lang", row_key().alias("key"), F.coalesce("good_", F.lit(False)).alias("good"), F.octet_length("text").alias("bytes"))
    names = table(names)
    total = names.agg(F.sum("bytes")).first()[0] or 0
    shards = passes * max(1, -(-total // (SHARD_BYTES * passes)))
    by_lang = names.groupBy("lang").agg(F.count_if("good").alias("n"))
    own = F.col("n") >= least
    seed = F.when(own, F.xxhash64(F.coalesce("lang", F.lit("\0")))).otherwise(F.lit(0).cast("long")).alias("seed")
    code = F.when(own, F.row_number().over(Window.orderBy("lang"))).otherwise(0).alias("code")  # a row for each language
    langs = table(by_lang.select(F.col("lang").alias("l_"), seed, code))
    seeded = rows.join(langs, F.col("lang").eqNullSafe(F.col("l_"))).withColumn("key", row_key())
    learn = seeded.where("good_ IS NOT NULL").select("text", "seed", "code", F.col("good_").alias("good"))
    if langs.where("seed = 0").head(1):  # languages of few trusted documents share a model of all of them
        learn = learn.unionByName(learn.where("seed <> 0").withColumns({"seed": F.lit(0).cast("long"), "code": F.lit(0)}))
    order = max(order, 2)
    learnt, new = model(learn, order, shards, passes)
    learnt = reduce(DataFrame.unionByName, learnt)
    every = seeded.select("key", "text", "seed", F.coalesce("good_", F.lit(False)).alias("good"))
    sums = None
    for turn in range(passes):
        part = table(_met(_packed(every, order, shards, turn, passes), learnt.where(F.col("turn") == turn)), batch_bytes=SENT_BYTES)
        sums = part if sums is None else sums.unionByName(part)
    sums = sums.groupBy(F.col("key").alias("k_")).agg(*[F.sum(n).alias(n) for n in ("value", "found", "contrast", "size", "again", "copies")])
    out = names.drop("bytes").join(sums, F.col("key") == F.col("k_"), "left").join(langs.drop("code"), F.col("lang").eqNullSafe(F.col("l_"))).join(new.withColumnRenamed("seed", "s_"), F.col("seed") == F.col("s_"), "left")
    log_p = (F.col("value") + (F.col("size") - F.col("found")) * F.col("new")) / F.col("size")
    out = out.select("doc_id", "lang", "key", "good", "seed", F.exp(-log_p).alias("perplexity"), (F.col("contrast") / F.col("copies")).alias("contrast"), (F.col("again") / F.col("copies")).alias("repeated"), F.col("size").isNotNull().alias("words_"))
    out = table(out)
    measures = ("perplexity", "contrast", "repeated")
    trusted = out.where("good AND perplexity IS NOT NULL")
    q = [F.percentile_approx(m, quantile, 10_000).alias(f"most_{m}") for m in measures]
    own, everyone = trusted.where("seed <> 0").groupBy(F.col("seed").alias("q_")).agg(*q), trusted.agg(*q).select(F.lit(0).cast("long").alias("q_"), "*")
    limits = own.unionByName(everyone)
    out = out.join(limits, F.col("seed") == F.col("q_"), "left").drop("q_", "seed", "good")
    inside = F.col("words_")
    for m in measures:
        inside = inside & F.coalesce(F.col(m) <= F.col(f"most_{m}"), F.lit(True))
    return out.withColumn("kept", inside).drop("words_")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, lang, text and any others) that are kept."""
    rejected = table(scores(docs, labels).where("NOT kept").select(F.col("key").alias("k_")).distinct())
    side = F.broadcast(rejected) if rejected.count() <= BROADCAST_ROWS else rejected.hint("shuffle_hash")
    return docs.withColumn("key_", row_key()).join(side, F.col("key_") == F.col("k_"), "left_anti").drop("key_")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("key")
