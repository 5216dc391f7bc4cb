"""The quality classifier against a plain model in Python."""

import math
import random
import re
import weakref
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import common, quality, tokens
from tests.test_growth import shuffled

WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


def stream(text):
    w = WORDS.findall(text or "")
    return ["<s>", *w, "</s>"] if w else []


def grams(text, k):
    w = stream(text)
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


class Plain:
    """Interpolated modified Kneser-Ney by recursion over the words before; ``own``: grams that only this document has are unseen."""

    def __init__(self, texts, order):
        self.order, self.df = order, Counter()
        self.n = {order: Counter(g for t in texts for g in grams(t, order))}
        for t in texts:
            self.df.update({g for k in range(1, order + 1) for g in grams(t, k)})
        for k in range(order - 1, 0, -1):
            longer = {g for t in texts for g in grams(t, k + 1)}
            self.n[k] = Counter(g[1:] for g in longer)
            if k > 1:
                for g, c in Counter(g for t in texts for g in grams(t, k) if g[0] == "<s>").items():
                    self.n[k][g] = c
        self.d, self.context = {}, {}
        for k, n in self.n.items():
            r = Counter(n.values())
            y = r[1] / (r[1] + 2 * r[2]) if r[1] else 0.0
            self.d[k] = [max(0.0, i - (i + 1) * y * r[i + 1] / r[i]) if r[i] else 0.0 for i in (1, 2, 3)]
            self.context[k] = defaultdict(lambda: [0, 0.0, 0])
            for g, c in n.items():
                x = self.context[k][g[:-1]]
                x[0], x[1], x[2] = x[0] + c, x[1] + self.d[k][min(c, 3) - 1], x[2] + 1

    def p(self, g):
        """As trained, nothing left out."""
        k = len(g)
        if k == 0:
            return 1 / (self.context[1][()][2] + 1)
        if g[:-1] not in self.context[k]:
            return self.p(g[1:])
        total, spared, _ = self.context[k][g[:-1]]
        c = self.n[k].get(g, 0)
        return (c - (self.d[k][min(c, 3) - 1] if c else 0)) / total + spared / total * self.p(g[1:])

    def log_p(self, g, own):
        """With backing off: a seen gram has its own probability, another one what its context leaves and its suffix."""
        seen = lambda x: self.df[x] - own > 0
        k = len(g)
        if k == 1:
            return math.log(self.p(g)) if seen(g) else math.log(max(self.context[1][()][1] / self.context[1][()][0], 1e-6) * self.p(()))
        left = lambda: math.log(self.context[k][g[:-1]][1] / self.context[k][g[:-1]][0]) if seen(g[:-1]) and self.context[k].get(g[:-1], [0, 0])[1] > 0 else 0.0
        return math.log(self.p(g)) if seen(g) else left() + self.log_p(g[1:], own)

    def perplexity(self, text, own):
        w = stream(text)
        if not w:
            return None
        return math.exp(-sum(self.log_p(tuple(w[max(0, i - self.order + 1) : i + 1]), own) for i in range(1, len(w))) / (len(w) - 1))


def corpus(seed):
    rng = random.Random(seed)
    names = [f"{a}{b}" for a in "bdfgklmn" for b in ("a", "e", "io", "ou")]
    word = lambda: "".join(rng.choice(names) for _ in range(1 if rng.random() < 0.6 else 3))
    prose = lambda n: " ".join(rng.choice(["", "", "The "]) + word() + rng.choice(["", "", ",", "."]) for _ in range(n))
    rows = [(i, "en", prose(rng.randint(5, 60))) for i in range(160)]
    rows += [(200 + i, "fr", "é" + prose(20)) for i in range(5)] + [(300, None, "x7 90 ##"), (301, "en", ""), (302, "en", None), (303, "en", " \n "), (None, "en", prose(9)), (5, "en", prose(30)), (310, "en", prose(30).replace(" ", " bad ", 1)), (320, "en", "bado " * 70_000)]
    labels = [(i, 1, 0) for i in range(120)] + [(i, 1, None) for i in (200, 201)] + [(i, 0, 0) for i in range(120, 130)] + [(7, 0, 0), (310, 1, 1), (999, 1, 0), (302, None, 1)]
    return rows, labels


@pytest.mark.parametrize("order", [2, 3])
def test_perplexity_against_plain_model(spark, order):
    """Perplexities of all documents, in languages with a model of their own and with the common one."""
    rows, labels = corpus(order)
    worst = {}
    for d, q, t in labels:
        if q is not None:
            worst[d] = worst.get(d, True) and q == 1 and not t
    good = [r for r in rows if worst.get(r[0])]
    models = {"en": Plain([t for _, lang, t in good if lang == "en"], order), None: Plain([t for _, _, t in good], order)}
    got = quality.scores(spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), order=order)
    keyed = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("key", quality.row_key())
    found = {r["key"]: r for r in got.collect()}
    assert len(found) == len(rows)
    for r in keyed.collect():
        want = models["en" if r["lang"] == "en" else None].perplexity(r["text"], bool(worst.get(r["doc_id"], False)))
        have = found[r["key"]]["perplexity"]
        assert (want is None) == (have is None) and (want is None or math.isclose(want, have, rel_tol=1e-9)), (r, want, have)
        assert want is not None or not found[r["key"]]["kept"]


def test_plain_model_sums_to_one():
    rows, _ = corpus(4)
    m = Plain([t for _, _, t in rows], 2)
    words = {g[0] for g in m.n[1]}
    unknown = m.context[1][()][1] / m.context[1][()][0] * m.p(())
    assert math.isclose(sum(m.p((w,)) for w in words) + unknown, 1)
    total, spared, _ = m.context[2][("The",)]
    assert math.isclose(sum(m.p(("The", w)) for w in words) + spared / total * unknown, 1)


def test_batches_and_shards_change_nothing(spark, monkeypatch):
    """Scores of repeated rows, small batches and many shards are those of one batch."""
    rows, labels = corpus(9)
    docs, known = spark.createDataFrame(rows + rows[:4], "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    pick = lambda df: sorted((str(r["doc_id"]), r["key"], round(r["perplexity"] or 0, 6), round(r["contrast"] or 0, 6), round(r["repeated"] or 0, 5)) for r in df.collect())
    a = pick(quality.scores(docs, known))
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(quality, "SHARD_BYTES", 900)
    assert a == pick(quality.scores(docs.repartition(5), known, passes=3))


def test_contrast_and_repeats(spark):
    """A word that only rejected text has, and text that repeats itself, are rejected; clean text stays."""
    rng = random.Random(1)
    vocabulary = [f"{a}{b}{c}" for a in "stkl" for b in "aeiou" for c in ("n", "r", "m", "sh")]
    prose = lambda n=60: " ".join(rng.choice(vocabulary) for _ in range(n))
    insult = lambda t: t.replace(" ", " zounds ", 1)
    rows = [(i, "en", prose()) for i in range(150)] + [(200 + i, "en", insult(prose())) for i in range(12)] + [(300, "en", insult(prose())), (301, "en", prose()), (302, "en", "tan tan tan tan " * 20), (303, "en", "&%$ " * 50)]
    labels = [(i, 1, 0) for i in range(150)] + [(200 + i, 1, 1) for i in range(12)]
    got = {r["doc_id"]: r["kept"] for r in quality.scores(spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert not any(got[i] for i in (*range(200, 212), 300, 302, 303)) and got[301] and sum(got[i] for i in range(150)) >= 148


def test_rows_do_not_grow_with_shards(spark, monkeypatch):
    """A document's sums are one row a turn, into however many shards the model is cut."""
    rng = random.Random(2)
    rows = [(i, "en", " ".join(f"{rng.choice('bdfgkl')}{rng.choice('aeiou')}{rng.choice('nrst')}" for _ in range(40))) for i in range(1200)]
    docs, known = spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1), spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    a = quality.scores(docs, known, passes=1).collect()
    monkeypatch.setattr(quality, "SHARD_BYTES", 6000)
    packed = lambda: quality._packed(docs.select("doc_id", "text").withColumns({"key": F.col("doc_id"), "seed": F.lit(0).cast("long"), "good": F.lit(False)}), 2, 33, 0, 1)
    b, n = quality.scores(docs, known, passes=1).collect(), packed().count()
    pick = lambda rows: {r["doc_id"]: (round(r["perplexity"], 9), round(r["contrast"], 9), r["kept"]) for r in rows}
    assert len(a) == 1200 and pick(a) == pick(b)
    assert n == 33
    model = quality._sharded(spark.createDataFrame([(1, True, 0.5, 1, 0)], "g long, word boolean, value double, df long, contexts long"), 33, 1)
    for k, v in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", "33")):
        spark.conf.set(k, v)
    try:
        sums, n = shuffled(spark, lambda: quality._met(packed(), model))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sums) == 1200 and n < 200  # not a row for each document and shard


def test_a_worker_drops_the_vocabulary_of_another_operator():
    """A worker that has encoded texts doesn't hold the vocabulary and its pieces while it counts grams; the next encoder gives the same ids."""
    path = tokens.default_vocabulary()
    e = tokens.encoder(path, False)
    assert tokens.encoder(path, False) is e
    held, ids = weakref.ref(e), next(iter(e.encode(["some words of a text"]))).tolist()
    del e
    assert held() is not None
    assert [t.num_rows for t in quality._batches(iter([pa.RecordBatch.from_pydict({"text": ["a b", None]})]))] == [2]
    assert held() is None
    assert next(iter(tokens.encoder(path, False).encode(["some words of a text"]))).tolist() == ids


def test_workers_get_some_megabytes_of_text_at_a_time(spark):
    """Rows of a task reach Python in batches of the bytes asked for, where one had held 10,000 rows; the session's setting stays."""
    before = spark.conf.get(common.ARROW_BYTES)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    rows = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("word "), 800).alias("text"))
    got = common.table(rows.mapInArrow(sizes, "n long, size long"), batch_bytes=quality.SENT_BYTES).collect()
    assert sum(r["n"] for r in got) == 6000 and max(r["size"] for r in got) < 1.5 * quality.SENT_BYTES
    assert spark.conf.get(common.ARROW_BYTES) == before
