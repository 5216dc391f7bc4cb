"""The Jaccard join, ranked search and the divergence audit against brute force, and on awkward tables."""

import random

import duckdb
import numpy as np
import pytest

from corvane.llm import decontaminate, divergence, jaccard, mixing, near, ranking, regions

AWKWARD = "doc_id long, text string, lang string, source string, term string, n int, u long, v long, key string, score int, bucket int"


def brute(rows, n, num, den):
    """Set size, and smallest doc_id reachable by links, by comparing all pairs."""
    sets, root = {}, {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i], root[i] = ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()), i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            x, y = sets[i], sets[j]
            if x and y and min(len(x), len(y)) * den >= max(len(x), len(y)) * num and den * len(x & y) >= num * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def families():
    """Groups of edited copies, a template with parts of its own, and short texts."""
    r, rows = random.Random(3), []
    word = lambda: f"w{r.randrange(10**6)}"
    for size in (6, 12, 30, 60, 120, 300, 60, 30):
        base = [word() for _ in range(size)]
        for _ in range(r.choice([2, 5, 20, 60])):
            t = list(base)
            for _ in range(r.randrange(0, max(1, size // 12) + 1)):
                k, o = r.randrange(len(t)), r.random()
                t[k : k + 1] = [word()] if o < 0.4 else [] if o < 0.7 else [word(), t[k]]
            rows.append(" ".join(t))
    template = [word() for _ in range(70)]
    rows += [" ".join(template + [word() for _ in range(r.choice([2, 4, 8, 20, 50]))]) for _ in range(120)]
    rows += [" ".join(word() for _ in range(r.randrange(0, 12))) for _ in range(100)]
    return list(enumerate(rows))


@pytest.mark.parametrize("few", [True, False])
def test_jaccard_join(spark, families, monkeypatch, few):
    """Directly; and in regions however few the pairs, of which the larger are cut again."""
    if not few:
        monkeypatch.setattr(regions, "PAIRS", 0)
        monkeypatch.setattr(regions, "PAIRS_PER_NODE", 0)
        monkeypatch.setattr(regions, "WIDE", 4)
        monkeypatch.setattr(regions.linked_components, "__defaults__", (3, 12, None))
    rows = families if few else families[60:200]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(rows, 3, 90, 100)


def test_linked_sets_send_common_keys():
    rng = np.random.default_rng(1)
    some = lambda n, odd: rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(odd)
    with np.errstate(over="ignore"):
        for _ in range(1500):
            m = int(rng.integers(1, 400))
            n = max(m, int(min(m / 0.9, m * (1 + rng.random() * 0.12))))
            need = -(-90 * (m + n) // 190)
            if need > m:
                continue
            base = some(need, 0)
            x, y = (np.unique(np.concatenate([base, some(k - need, 1)])) for k in (m, n))
            a, b = jaccard.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), (90, 100))
            assert len(set(a.tolist()) & set(b.tolist())) >= jaccard.common(len(x), (90, 100))


def test_templates_end_in_few_rounds(spark):
    """Many documents that share most of their words, but no links: one round of pivots, not one for each document."""
    r = random.Random(9)
    base = " ".join(f"t{i}" for i in range(90))
    rows = [(i, base + " " + " ".join(f"w{r.randrange(10**9)}" for _ in range(12))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = regions.classes(jaccard.signed_sets(docs, 3, (90, 100)), "n_shingles", "keys")
    members = jaccard._members(nodes, (90, 100))
    sets = regions.full_sets(docs, nodes, 3)
    found, rounds = regions.linked_components(members, sets, (90, 100))
    assert found.count() == 0 and rounds <= 3


@pytest.mark.parametrize("own", [8, 30, 50])
def test_near_duplicate_templates_end(spark, monkeypatch, own):
    """The same for near-duplicates, at similarities of about 0.8, 0.5 and 0.4."""
    r, turns = random.Random(own), []
    base, joined = " ".join(f"t{i}" for i in range(70)), regions.linked_components
    rows = [(i, base + " " + " ".join(f"w{r.randrange(10**9)}" for _ in range(own))) for i in range(1500)]

    def counted(*a, **k):
        turns.append(joined(*a, **k))
        return turns[-1]

    monkeypatch.setattr(near, "linked_components", counted)
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    linked = 69 / (69 + 2 * own) >= 0.8
    assert got.where("NOT kept").count() == (1499 if linked else 0) and turns[0][1] <= 3


def test_reruns_of_a_mix_agree(spark):
    """Rows of one size without a doc_id, or with a repeated one, get the same copies in whatever order they come."""
    rows = [(None if i % 2 else i % 7, f"text {i:03d}", "s") for i in range(200)]
    got = [{r["text"]: r["copies"] for r in mixing.mix_sources(mixing.with_size(spark.createDataFrame(some, "doc_id long, text string, source string").repartition(k))).collect()} for some, k in ((rows, 1), (rows[::-1], 5))]
    assert got[0] == got[1] and len(got[0]) == 200 and len(set(got[0].values())) > 1


def test_items_without_an_id_are_one(spark):
    bench = spark.createDataFrame([(None, "alpha beta"), (None, "gamma delta"), (3, "beta gamma")], "item_id long, text string")
    got = decontaminate.decontaminate(spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string"), bench).first()
    assert (got["n_items"], got["items"], got["n_hit"]) == (2, ["", "3"], 4)


def awkward(spark):
    long = " ".join(f"w{i % 7919}" for i in range(60_000))
    shared = " ".join(f"s{i}" for i in range(40))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (4, "other text"), (None, shared), (None, None), (5, long), (6, long + " end"), (7, "same text here twice"), (7, "same text here twice"), (8, "Same text HERE twice"), (9, shared), (10, "É" * 30 + " one \U0001f600 x1y")]
    return [(i, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else "s", "t", 1, 2, 3, "k", 4, 5) for k, (i, t) in enumerate(texts)]


def with_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, (rows, columns) in tables.items():
        con.sql(f"CREATE TABLE {name} ({columns})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    got = con.sql(sql)
    return got.columns, sorted(map(str, got.fetchall()))


def test_awkward_tables(spark):
    rows = awkward(spark)
    docs = spark.createDataFrame(rows, AWKWARD)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(docs).collect())
    sizes = {"1": 0, "2": 0, "3": 0}
    assert [(i, n) for i, n, _ in got if i in sizes] == [("1", 0), ("2", 0), ("3", 0)]
    assert [c for i, _, c in got if i in ("7", "8")] == [7, 7, 7] and [c for i, _, c in got if i in ("5", "6")] == [5, 5] and sorted(c for i, n, c in got if n == 38) == [9, 9]
    assert [n for i, n, _ in got if i == "4"] == [1, 1] and len(got) == len(rows)
    assert jaccard.jaccard_join(docs.limit(0)).count() == 0
    plain = [r[:4] for r in rows]
    for repeat, items in ((1, [(1, "same one TEXT"), (1, "w1 w2"), (None, "s1 end"), (3, None), (4, "zzz")]), (9, [(2, "twice é one x1y")])):
        many = plain * repeat
        want = with_duckdb(ranking.OP12_SQL, documents=(many, "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR"), benchmark=(items, "item_id BIGINT, text VARCHAR"))
        bench = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, term int, df string")
        terms = ranking.item_terms(bench)
        post = ranking.postings(spark.createDataFrame([r for r in rows] * repeat, AWKWARD), terms if repeat == 1 else None)
        assert sorted(str(tuple(r)) for r in ranking.search(terms, post).select(*want[0]).collect()) == want[1]
    assert ranking.search(terms, ranking.postings(docs.limit(0), terms)).count() == 0
    assert ranking.search(ranking.item_terms(bench.limit(0)), post).count() == 0


@pytest.mark.parametrize("size", [(), (10, 10, 3, 20, 2)])
def test_divergence_in_tiles(spark, size):
    """More groups than a block holds, more terms than a chunk holds, a language without kept terms, groups without terms."""
    r, rows = random.Random(2), awkward(spark)
    words = [f"{a}{b}" for a in "abcdeé" for b in "ghijklm"]
    rows += [(100 + k, " ".join(r.choice(words) for _ in range(r.randrange(40))), "fr" if k % 3 else None, f"src{r.randrange(8)}", "t", 1, 2, 3, "k", 4, 5) for k in range(300)]
    rows += [(900, None, "fr", "empty", "t", 1, 2, 3, "k", 4, 5), (901, "rare words", "xx", "a", "t", 1, 2, 3, "k", 4, 5), (902, None, "xx", None, "t", 1, 2, 3, "k", 4, 5)]
    want = with_duckdb(divergence.OP13_SQL, documents=([x[:4] for x in rows], "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR"))
    docs = spark.createDataFrame(rows, AWKWARD)
    assert sorted(str(tuple(x)) for x in divergence.audit(docs, *size).select(*want[0]).collect()) == want[1]
    assert divergence.audit(docs.limit(0)).count() == 0
