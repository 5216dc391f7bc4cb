"""What queries shuffle, and the rows that they give by brute force, where plain ways grow with the product of their inputs."""

import random

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from corvane import config as c
from corvane.operators import ann, asof, ingest, retrieve, understand
from corvane.streaming import frames, state


def shuffled(spark, run):
    """The rows of a run, and how many rows its stages shuffled."""
    sc = spark.sparkContext

    def written() -> int:
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    return run().collect(), written() - before


def test_requests_of_a_day_meet_rows_once(spark):
    r, iso = random.Random(3), lambda n: str(np.datetime64("2021-01-01") + n)
    ranges = [(i, "abc"[i % 3], "" if i % 11 == 0 else iso(r.randrange(40)), "" if i % 7 == 0 else iso(r.randrange(20, 90))) for i in range(1500)]
    days = [(i, iso(i % 60)) for i in range(1200)] + [(5, iso(5)), (6, iso(9)), (2000, ""), (2001, None)]
    rows, asked = spark.createDataFrame(ranges, "doc_id long, topic string, effective_date string, expire_date string"), spark.createDataFrame(days, "query_id long, as_of string")
    want = {}
    for q, d in days:
        for i, t, a, b in ranges if d else ():
            if (a or b) and (not a or a <= d) and (not b or d <= b):
                n, best = want.get((q, t), (0, ("", 0)))
                want[q, t] = n + 1, max(best, (a, -i)) if n else (a, -i)
    got, n = shuffled(spark, lambda: asof.latest_in_force(asked, rows, "topic", "query_id", "doc_id"))
    assert {(x["query_id"], x["topic"]): (x["in_force"], x["latest"]) for x in got} == {k: (n, -b[1]) for k, (n, b) in want.items()}
    assert n < 40_000  # requests by rows in force are 700,000


def vectors(spark, n: int, dims: int = 8):
    """Few different components, so that scores tie, and rows that hold no vector."""
    x = np.random.default_rng(7).integers(-3, 4, (n, dims)) / 4
    x[0] = 0
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def best(scores: np.ndarray, k: int, names) -> list:
    order = sorted((j for j in names if scores[j] > -np.inf), key=lambda j: (-scores[j], j))
    return order[:k]


def test_cosine_keeps_rows_by_task(spark):
    x, rows = vectors(spark, 3000)
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    holes = spark.createDataFrame([(9000, None), (9001, [1.0, None] + [0.0] * 6)], rows.schema)
    size = np.sqrt((x * x).sum(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        got, n = shuffled(spark, lambda: retrieve.cosine_top(queries, rows.unionByName(holes), 6))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q in range(0, 3000, 20):
        s = np.round(np.divide(x @ x[q], size * size[q], out=np.zeros(len(x)), where=size * size[q] > 0), 9)
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == best(s, 6, range(len(x)))
    tasks = 2 * spark.sparkContext.defaultParallelism
    assert n <= 150 + 3002 + 150 * 6 * tasks  # a batch of 20 rows gave 6 of each query before


def test_lsh_gives_the_rows_of_the_join(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    _, rows = vectors(spark, 1500)
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    as_vector = array_to_vector(F.col("embedding").cast("array<double>")).alias("v")
    every, ask = rows.select("vec_id", as_vector), queries.select("query_id", as_vector)
    lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.5, numHashTables=2, seed=11).fit(every)
    pairs = lsh.approxSimilarityJoin(ask, every, 1.2, "d").select(F.col("datasetA.query_id").alias("q"), F.col("datasetB.vec_id").alias("v"), F.round("d", 9).alias("d")).collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (r["q"], r["d"], r["v"])):
        want.setdefault(r["q"], []).append((r["v"], r["d"]))
    got, n = shuffled(spark, lambda: retrieve.lsh_top(queries, rows, 5, 0.5, 2, 1.2))
    have = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        have.setdefault(r["query_id"], []).append((r["vec_id"], r["distance"]))
    assert have == {q: v[:5] for q, v in want.items()}
    assert n <= 75 + 1500 + 75 * 5 * 2 * spark.sparkContext.defaultParallelism


def test_dot_products_in_one_pass(spark):
    family = ann.Family(dims=8)
    x, rows = vectors(spark, 900)
    queries = rows.where("vec_id < 700").select(F.col("vec_id").alias("query_id"), "embedding")
    got = ann.dot_top(queries, rows, 4, family)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # one for each 512 queries before
    found = {}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    scores = np.round(x[:700] @ x.T, 9)
    assert found == {q: best(scores[q], 4, [j for j in range(900) if j != q]) for q in range(700)}


def test_sweep_scans_once(spark):
    family = ann.Family(dims=8)
    x, rows = vectors(spark, 700)
    queries = rows.where("vec_id < 600").select(F.col("vec_id").alias("query_id"), "embedding")
    swept = ann.sweep_by_query(queries, rows, 3, family)
    assert "MapInArrow" not in swept._jdf.queryExecution().optimizedPlan().toString()  # the pass was run for counts and for hits, for each 512 queries
    h = family.hashes(x)
    got = {(r["query_id"], r["tables"], r["level"]): (r["candidates"], r["others"]) for r in swept.collect()}
    for q in range(0, 600, 37):
        for tables in (1, 4, 8):
            for level in range(6):
                same = ((h >> level) == (h[q] >> level)).reshape(len(x), 8, 2).all(2)[:, :tables].any(1)
                assert got[q, tables, level] == (same.sum() - 1, 699)


def test_bucket_search_without_rows_of_candidates(spark):
    family = ann.Family(dims=8)
    x, rows = vectors(spark, 900)
    queries = rows.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = ann.search(queries, rows, 4, 3, 1, family)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    h, scores = family.hashes(x), np.round(x @ x.T, 9)
    for q in range(0, 900, 9):
        met = ((h >> 1) == (h[q] >> 1)).reshape(900, 8, 2).all(2)[:, :3].any(1)
        assert found.get(q, []) == best(scores[q], 4, [j for j in range(900) if j != q and met[j]])


def test_all_queries_in_one_scan_of_documents(spark):
    r = random.Random(1)
    words = ["".join("abcdefghij"[int(c)] for c in f"{i:03}") for i in range(400)]
    text = lambda n: " ".join(words[min(int(r.expovariate(0.02)), 399)] for _ in range(n))
    docs, queries = [(i, text(r.randrange(0, 30))) for i in range(700)], [(i, text(5)) for i in range(1500)] + [(1500, "nothing"), (1501, None)]
    got = retrieve.sparse_overlap(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(docs, "doc_id long, text string"), 4)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # documents were cut into tokens for each 1,024 queries at most
    found = {}
    for x in sorted(got.collect(), key=lambda x: x["rank"]):
        found.setdefault(x["query_id"], []).append((x["doc_id"], x["score"]))
    assert len(found) == 1502
    for q, query in queries[:1500:50] + queries[-2:]:
        scores = []
        for i, t in docs:
            have, asked = t.split(), (query or "").split()
            scores.append((-round(sum(min(have.count(w), 4) for w in asked) / max(len(have), 1), 9), i))
        assert found[q] == [(i, -s) for s, i in sorted(scores)[:4]]


def test_parents_without_rows_of_common_words(spark):
    r = random.Random(2)
    words = ["".join("abcdefghij"[int(c)] for c in f"{i:02}") for i in range(30)] + ["7", "12"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, queries = [(f"c{i}", f"p{i // 2}", i, text(6)) for i in range(1200)], [(i, text(3)) for i in range(40)]
    summaries = spark.createDataFrame(rows, "chunk_id string, parent_id string, ord long, body string")
    got, n = shuffled(spark, lambda: retrieve.summary_parents(spark.createDataFrame(queries, "query_id long, query string"), summaries))
    found = {}
    for x in sorted(got, key=lambda x: x["rank"]):
        found.setdefault(x["query_id"], []).append((x["parent_id"], x["score"]))
    for q, query in queries:
        best_of, asked = {}, query.split()
        for _, parent, i, body in rows:
            hits = [w for w in asked if any(w in t for t in body.split())]
            if hits:
                s = round(len(hits) / len(asked) + (0.2 if any(w.isdigit() for w in hits) else 0.0), 9)
                best_of[parent] = min(best_of.get(parent, (0, 0)), (-s, i))
        assert found[q] == [(p, -s) for p, (s, _) in sorted(best_of.items(), key=lambda x: x[1])[:3]]
    assert n < 8_000  # 52,887 before


def test_frames_call_the_state_twice_a_batch():
    calls = []

    class Held:
        value = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "update":
                    self.value = args[0]
                return self.value if name == "get" else self.value is not None and name == "exists"

            return call

    class Handle:
        def getValueState(self, *_):
            return Held()

        getMapState = getValueState

    stream = "".join(f"event: delta\r\ndata: {i}é\r\n\r\n" for i in range(50)).encode()
    pieces = [(i, stream[at : at + 3]) for i, at in enumerate(range(0, len(stream), 3))]
    machine, got = frames._Frames(), []
    machine.init(Handle())
    for part in (1, 2, 0):
        mine = pd.DataFrame([x for x in pieces if x[0] % 3 == part][::-1], columns=["seq", "piece"])
        for out in machine.handleInputRows((4,), iter([mine, mine]), None):
            got += out.itertuples(index=False, name=None)
    assert got == [(4, i, "delta", f"{i}é") for i in range(50)]
    assert len(calls) == 6  # several for each piece before


def test_sessions_of_frames_share_a_key():
    """A hundred sessions and one without a name take as many calls to the state as one, and each has its own frames."""
    calls, held = [], []

    class Place:
        def get(self):
            calls.append("get")
            return held[-1] if held else None

        def update(self, value):
            calls.append("update")
            held.append(value)

    class Handle:
        def getValueState(self, *_):
            return Place()

    text = lambda i: f"event: delta\ndata: {i}é\n\ndata: last {i}\n\n".encode()
    pieces = [(s, k, text(s)[at : at + 5]) for s in (*(str(2**60 + i) for i in range(100)), None) for k, at in enumerate(range(0, len(text(s)), 5))]
    machine, got = frames._Frames(), []
    machine.init(Handle())
    for part in (1, 0):
        mine = pd.DataFrame([x for x in pieces if x[1] % 2 == part], columns=["session", "seq", "piece"])
        for out in machine.handleInputRows((7,), iter([mine]), None):
            got += out.itertuples(index=False, name=None)
    assert got == [row for s in (*(2**60 + i for i in range(100)), None) for row in ((s, 0, "delta", f"{s}é"), (s, 1, "message", f"last {s}"))]
    assert len(calls) == 4


def test_memory_calls_the_state_by_session():
    """Forty keys of a session take as many calls as one, and each expires at its own time."""
    calls, timers = [], set()

    class Held:
        value = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("update", "clear"):
                    self.value = args[0] if args else None
                return self.value if name == "get" else self.value is not None and name == "exists"

            return call

    class Handle:
        def getValueState(self, *_):
            return Held()

        def registerTimer(self, at):
            calls.append("timer")
            timers.add(at)

        def deleteTimer(self, at):
            calls.append("timer")
            timers.discard(at)

    class Now:
        def __init__(self, passed):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: passed

    machine = state._Memory()
    machine.init(Handle())
    rows = pd.DataFrame([("short", f"k{i % 40}", i, f"v{i}", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i % 7 + i % 40)) for i in range(200)], columns=["kind", "key", "ord", "value", "ts"])
    said = [r for out in machine.handleInputRows((4,), iter([rows[:90], rows[90:]]), Now(0)) for r in out.itertuples(index=False)]
    want = {k: max((t, o) for k2, o, t in zip(rows["key"], rows["ord"], rows["ts"], strict=True) if k2 == k) for k in rows["key"]}
    assert {(r.session, r.kind, r.key): (r.ts, r.ord) for r in said} == {(4, "short", k): x for k, x in want.items()} and len(said) == 40
    assert len(calls) <= 4
    gone = []
    for _ in range(100):
        if not timers:
            break
        at = min(timers)
        timers.discard(at)
        gone += [(at, r.key, r.event) for out in machine.handleExpiredTimer((4,), Now(at), Now(at)) for r in out.itertuples(index=False)]
    assert sorted(gone) == sorted((int((t + pd.Timedelta(hours=4)).value // 1_000_000), k, "expired") for k, (t, _) in want.items())


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_closure_names_its_steps_once(spark):
    """The plan of the closure grows with its steps, not twofold with each."""
    rows = spark.createDataFrame([(["citation_guard"], ["search"], True), ([], [], False)], "f array<string>, t array<string>, s boolean")
    df = rows.select(understand.normal_features(F.col("f"), F.col("t"), F.col("s")).alias("n"))
    assert plan(df).count("array_distinct") <= 1 + len(c.FEATURE_NEEDS)
    assert df.collect()[1]["n"][:2] == ["rag", "citation_guard"]


def test_chunks_are_squeezed_once_on_all_cores(spark):
    docs = spark.createDataFrame([(i, f"a  {i} text\t" * 80, f"u{i % 2}") for i in range(40)], "doc_id long, text string, source_url string").coalesce(1)
    df = ingest.two_level_chunks(docs).where("chunk_level = 'small'").select("chunk_id", "chunk_text_hash")
    assert plan(df).count(r"(?U)\s+") == 1 and "RepartitionByExpression" in plan(df)
    assert len({r["chunk_text_hash"] for r in df.collect()}) == df.count()


def test_expansions_name_their_parts_once(spark):
    rows = spark.createDataFrame([("2024 本科 学费 5000元。", "章程", "招生", "第一章")], "c string, t string, p string, s string")
    df = rows.select(ingest.expansions(F.col("c"), F.col("t"), F.col("p"), F.col("s")).alias("e"))
    assert plan(df).count("regexp_extract_all") == 1
    assert df.first()["e"][0].startswith("招生 第一章")
