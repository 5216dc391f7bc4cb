"""The corpus operators against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import components, decontaminate, licenses, mixing, near, neighbours, quality, queries, secrets, substrings, tokens
from tests.compare import DATA, same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies long, size string, class int, perplexity_ string, `c_` int, n_words int"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    long = " ".join(word() for _ in range(60_000))
    shared = " ".join(word() for _ in range(60))
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (None, "no id " + shared), (None, None), (5, long), (6, long[:-5] + " end"), (7, "same text here twice"), (7, "same text here twice"), (8, "same text here twice"), (9, shared), (10, "x " + shared + " y"), (11, "é" * 300), (12, "\U0001f600 password = 'abcdefghijklmnop' " + "ab" * 20)]
    return spark.createDataFrame([(i, t, None if k % 5 == 0 else "en", None if k % 3 == 0 else "s", None, 1, "2", 3, "4", 5, 6) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA), queries.ORACLES[name])


def removed(rows):
    seen, out = {}, {}
    for i, b in sorted(rows):
        cover = bytearray(len(b))
        for s in range(len(b) - 99):
            if seen.setdefault(b[s : s + 100], (i, s)) != (i, s):
                cover[s : s + 100] = b"\1" * 100
        out[i] = (len(b), sum(cover), (b"\0" + bytes(cover)).count(b"\0\1"), hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [substrings.HOT, 2])
def test_substrings(spark, docs, hot):
    got = substrings.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), hot).collect()
    assert {r[0]: tuple(r[1:5]) for r in got} == removed([(i, (t or "").encode()) for i, t in docs])


def test_intervals_are_shared_prefixes():
    rng = np.random.default_rng(0)
    text = np.concatenate([np.append(rng.integers(1, 4, 300), 0) for _ in range(20)] + [np.append(np.tile([1, 2], 100), 0)]).astype(np.int16)
    order = substrings.sorted_suffixes(text, 8)
    group, n = substrings.intervals(text, order, 8), len(text)
    inside = [i for i in range(n) if i + 8 <= n and not (text[i : i + 8] == 0).any()]
    by = {}
    for place, i in enumerate(order.tolist()):
        if i in set(inside):
            by.setdefault(group[place], set()).add(text[i : i + 8].tobytes())
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({text[i : i + 8].tobytes() for i in inside})


def word_set(text, n):
    w = SPACED.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, docs, n):
    rng, rows = random.Random(2), list(docs)
    for k in range(60):  # a group of near copies
        w = docs[3][1].split()
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        rows.append((10_000 + k, " ".join(w)))
    sets = {i: word_set(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j, k in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 450)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r[0]: r[1] for r in got} == {x: find(x) for x in linked}


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[:1600], rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)]))
    x = near.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    j, n = near.estimate(x[:1], x[1:], np.array([2000.0]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert n[0] == 256 and abs(j[0] - true) < 0.12


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 600])
def test_decontamination(spark, docs, block):
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()] + [(900, "Short ONE"), (901, None), (902, "!!")]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    rows = [*docs, (5000, f"pre {items[0][1].upper()} post. short, one!"), (5001, None)]
    want = {}
    for i, t in rows:
        w, hit, names = split(t), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    names |= found
                    hit |= set(range(k, k + size))
        want[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    table, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(table, bench, block_bytes=block).collect()
    assert {r[0]: tuple(r[1:6]) for r in got} == want
    kept = decontaminate.drop_contaminated(table, bench, block_bytes=block).collect()
    assert {r[0] for r in kept} == {i for i, x in want.items() if not x[4]}
    hits = next(r["hits"] for r in got if r["doc_id"] == 5000)
    assert [rows[-2][1][h["start"] : h["end"]] for h in hits][-1] == "short, one"


def test_token_file(spark, docs):
    rows = spark.createDataFrame([*docs, (7_000, None), (7_001, "<|endoftext|> a  b\n\n c")], "doc_id long, text string")
    from tokenizers import Tokenizer

    t, at, want = Tokenizer.from_file(tokens.default_vocabulary()), 0, {}
    for i, x in sorted((r[0], r[1] or "") for r in rows.collect()):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for bits, block in ((False, tokens.BLOCK), (True, 1000)):
        got = tokens.read_token_file(tokens.token_file(rows, bits=bits, block=block), block).collect()
        assert {r[0]: tuple(r[1:]) for r in got} == want


def test_planes_and_crc():
    rng = np.random.default_rng(1)
    for n in (1, 7, 4096):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32)
        for bits in (False, True):
            assert (tokens.from_planes(n, *tokens.to_planes(ids, bits)) == ids).all()
    a, b = b"abc" * 50, b"xyz" * 1000
    assert tokens.crc32_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_separator_scan(spark):
    rng = np.random.default_rng(6)
    files = {f: rng.integers(0, 4, n).astype("<u2") for f, n in ((0, 103), (1, 1), (2, 40))}
    files[3] = np.array([3] * 25, "<u2")
    rows = [(f, k, 2, bytearray(x[k * 10 : k * 10 + 10].tobytes())) for f, x in files.items() for k in range(-(-len(x) // 10))]
    want = []
    for f, x in files.items():
        n = [0]
        for v in x.tolist():
            n = [*n[:-1], n[-1] + 1] if v else [*n, 0]
        want += [(f, k, c, True) for k, c in enumerate(n[:-1])] + ([(f, len(n) - 1, n[-1], False)] if n[-1] else [])
    got = tokens.separator_scan(spark.createDataFrame(rows, "file int, block int, width int, ids binary"), 0).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    got = {r[0]: r[1] for r in tokens.op2_token_counts(spark, DATA).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in docs}


def test_quality_separates_labels(spark):
    rows = quality.op5_quality(spark, DATA.replace("sf0.001", "sf0.01")).toPandas().merge(spark.read.parquet(DATA.replace("sf0.001", "sf0.01") + "/labels.parquet").toPandas(), on="doc_id")
    clean, junk = rows[(rows.quality == 1) & (rows.toxic == 0)], rows[rows.quality == 0]
    assert clean.kept.mean() > 0.95 and junk.kept.mean() < 0.5


def test_neighbours(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    bad = [(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [1.0]), (None, list(rows[0][1])), (9100, list(rows[0][1])), (9101, list(rows[0][1]))]
    table = spark.createDataFrame([(r[0], list(r[1])) for r in rows] + bad, "vec_id long, embedding array<double>")
    good = sorted([(r[0], r[1]) for r in rows] + bad[-2:])
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], float)
    hit = total = 0
    got = neighbours.nearest(table, "vec_id % 100 = 0").toPandas()
    assert set(got.query_id) == {i for i in ids.tolist() if i % 100 == 0}
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[np.searchsorted(ids, q)]) ** 2).sum(1))
        d[np.searchsorted(ids, q)] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and np.allclose(g.score, d[np.searchsorted(ids, g.vec_id)], atol=0)
        hit, total = hit + len(set(best) & set(g.vec_id)), total + 10
    assert hit >= 0.9 * total
    assert neighbours.nearest(table.limit(0), "vec_id % 100 = 0").count() == 0


def test_ledger_scans_only_what_is_new(spark):
    one = spark.createDataFrame([("a", "token=abcdefghijkl0"), ("b", "nothing"), ("c", "token=abcdefghijkl0")], "path string, text string")
    new, found = secrets.scan_history(one)
    assert new.count() == 2 and {r["path"]: len(r["spans"]) for r in found.collect()} == {"a": 1, "b": 0, "c": 1}
    two = one.union(spark.createDataFrame([("d", "AKIA" + "A" * 16)], "path string, text string"))
    more, found = secrets.scan_history(two, new)
    assert more.count() == 1 and {r["path"]: len(r["spans"]) for r in found.collect()} == {"a": 1, "b": 0, "c": 1, "d": 1}


def test_licenses(spark, docs):
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    sh = lambda t: {tuple(w[i : i + 5]) for w in [split(t)] for i in range(max(1, len(w) - 4))} if split(t) else set()
    got = {r["doc_id"]: r["licenses"] for r in licenses.op9_licenses(spark, DATA).collect()}
    want = {i: ",".join(sorted(k for k, t in licenses.TEMPLATES if len(sh(t) & sh(x)) >= 0.8 * len(sh(t)) and len(sh(t)) <= 4)) for i, x in docs}
    short = {k for k, t in licenses.TEMPLATES if len(sh(t)) <= 4}
    assert {i: ",".join(k for k in x.split(",") if k in short) for i, x in got.items()} == want and any(want.values())


def test_awkward_tables(spark, awkward):
    n = awkward.count()
    labels = spark.createDataFrame([(4, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "x")], "item_id long, text string")
    for table, rows in ((awkward, n), (awkward.limit(0), 0)):
        assert substrings.dedup_substrings(table).count() == rows
        assert near.near_duplicates(table).count() == rows
        assert decontaminate.decontaminate(table, bench).count() == rows
        assert tokens.read_token_file(tokens.token_file(table)).count() == rows
        assert mixing.mix_sources(mixing.with_size(table.select("doc_id", "source", "text"))).count() == rows
        assert quality.scores(table, labels).count() == rows
        assert secrets.scan_history(table.withColumnRenamed("doc_id", "path"))[1].count() == rows
        licenses.license_scan(table).count()
    got = {r["doc_id"]: r for r in near.near_duplicates(awkward, 2).collect()}
    assert got[8]["component_id"] == 7 and got[6]["component_id"] == 5 and got[1]["component_id"] == 1 and got[3]["n_shingles"] == 0


def test_pipeline_stages(spark, awkward, tmp_path):
    folder = DATA
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"copies": F.lit(1), "size": F.lit("x"), "kept_": F.lit(0)})
    docs = docs.unionByName(awkward, allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        held, docs = docs.count(), spark.read.parquet(f"{tmp_path}/{name}")
        assert 0 < docs.count() <= (2 * held if name == "mixing" else held), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward.limit(0), folder).count() == 0
