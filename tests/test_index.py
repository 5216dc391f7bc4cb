"""The chunk index, the way from requests to answers, and the steps around it."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.config import VARIANTS
from corvane.operators import ablation, answer, gateway, index
from corvane.operators.retrieve import TIME_WORDS_RETRIEVAL
from corvane.sources import reports, tables

NOTE = "来源：https://a.gov.cn/x）\n网页标题：2024 招生公告\n发布时间：2024-03-01\n抓取时间：2024-03-02\n\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("notes")
    (path / "README.md").write_text("not read")
    (path / "other.txt").write_text("not read")
    (path / "01-招生公告.md").write_text(NOTE + "第一章 总则\n" + "2024 年招生计划为 3000 人，学费 5000元。" * 12)
    (path / "02-学费说明.md").write_text("学费标准：文科 4400元，理工类 5000元。电话 12345。\n" * 9)
    (path / "03-宿舍.md").write_text("宿舍为四人间，住宿费每年 800元，报到时缴纳。\n" * 10)
    return str(path)


@pytest.fixture(scope="module")
def built(spark, folder, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('index')}/chunks"
    assert index.load(spark, path) is None
    state = index.build(tables.markdown_corpus(spark, folder), path)
    rows = index.load(spark, path)
    assert state["status"] == "ok" and state["chunk_count"] == rows.count() > 5
    return rows


def test_markdown_becomes_a_corpus(spark, folder, tmp_path):
    rows = tables.markdown_corpus(spark, folder).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["topic"]) for r in rows] == [(0, "招生公告"), (1, "学费说明"), (2, "宿舍")]
    assert rows[0]["source_url"] == "https://a.gov.cn/x" and rows[0]["publish_date"] == "2024-03-01" and rows[0]["title"] == "2024 招生公告" and rows[0]["effective_date"] == "2024-03-01"
    assert rows[1]["title"] == "学费说明" and rows[1]["publish_date"] == ""
    assert tables.markdown_corpus(spark, f"{tmp_path}/none").count() == 0


def test_chunks_have_context_and_auxiliary_queries(built):
    rows = built.collect()
    small = [r for r in rows if r["chunk_level"] == "small"]
    assert len({r["ord"] for r in rows}) == len(rows) and all(r["page_content"].startswith("标题：") for r in rows)
    assert any("章节点：" in r["page_content"] for r in small) and all(r["sparse_view"].startswith(r["page_content"]) for r in rows)
    assert any("辅助查询：" in r["sparse_view"] for r in small) and all(len(r["embedding"]) == 32 for r in rows)


def test_index_is_kept_and_replaced(spark, folder, tmp_path):
    path, corpus = f"{tmp_path}/i", tables.markdown_corpus(spark, folder)
    assert index.load_or_build(corpus.where("doc_id < 2"), path).select("doc_id").distinct().count() == 2
    assert index.load_or_build(corpus, path).select("doc_id").distinct().count() == 2
    index.reindex(corpus, path)
    assert index.load(spark, path).select("doc_id").distinct().count() == 3
    corpus.write.mode("overwrite").parquet(path)
    assert index.load(spark, path) is None
    empty = index.load_or_build(corpus.limit(0), f"{tmp_path}/e")
    assert index.views(empty)[0].collect()[0]["text"] == index.PLACEHOLDER
    asked = spark.createDataFrame([(1, "empty corpus")], "query_id long, query string")
    assert index.hybrid(asked, empty).count() == 0


def test_reindex_embeds_new_texts_only(spark, folder, tmp_path):
    path, corpus = f"{tmp_path}/i", tables.markdown_corpus(spark, folder)
    provider = lambda some: [[float(len(x)), 1.0] for x in some]
    assert index.opened(spark, path) == (None, "missing")
    one = index.build(corpus.where("doc_id < 2"), path, provider)
    held = index.load(spark, path)
    two, three = index.build(corpus, path, provider), index.build(corpus, path, provider)
    assert one["embedded"] == one["chunk_count"] and two["embedded"] == two["chunk_count"] - one["chunk_count"] and three["embedded"] == 0 and three["version"] == 3
    assert held.count() == one["chunk_count"]  # a reader keeps what it has loaded
    rows = index.load(spark, path)
    assert {tuple(r["embedding"]) for r in rows.collect()} == {tuple(r["embedding"]) for r in index.embedded(rows.drop("embedding"), "page_content", provider).collect()}
    broken = index.build(corpus.withColumn("text", F.concat("text", F.lit(" more words than before, for all of them"))), path, lambda some: 1 / 0)
    rows = index.load(spark, path)
    assert broken["status"] == "ok" and {(r["embedding_source"], len(r["embedding"])) for r in rows.collect()} == {("local", 32)}
    file = next(Path(rows.inputFiles()[0].removeprefix("file://")).parent.glob("*.parquet"))
    file.write_bytes(b"damaged")
    found, why = index.opened(spark, path)
    assert found is None and why and why != "missing"


def test_equal_scores_go_by_year_then_channel(spark, built):
    """The temporal part only breaks ties: an expired chunk of the year that is asked for doesn't pass one with a better score."""
    schema = "ord long, chunk_id string, chunk_level string, parent_id string, parent_text string, chunk_text string, page_content string, sparse_view string, title string, topic string, publish_date string, effective_date string, expire_date string, queries array<string>, embedding array<double>"
    made = lambda i, text, title, start, end: (i, f"c{i}", "small", f"p{i}", text, text, text, text, title, "t", "", start, end, [], [1.0] + [0.0] * 31)
    rows = spark.createDataFrame([made(1, "old news of 2020", "a", "2020-01-01", "2020-12-31"), made(2, "fees 2021 fees fees", "b", "2021-01-01", "2999-12-31"), made(3, "other words", "c", "2021-01-01", "2999-12-31")], schema)
    asked = spark.createDataFrame([(1, "最新 fees 2020")], "query_id long, query string")
    got = index.hybrid(asked, rows).orderBy("rank").collect()
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True) and got[0]["ord"] != 1


def test_ablation_is_each_variant_alone(spark, built):
    """Predictions of the shared plan are those of running each variant by itself."""
    asked = spark.createDataFrame([("a", "住宿费每年多少"), ("b", "2024 招生公告")], "case_id string, query string")
    got = {}
    for r in ablation.predictions(asked, built, 2).orderBy("rank").collect():
        got.setdefault((r["variant"], r["case_id"]), []).append(r["ord"])
    alone = asked.select(F.when(F.col("case_id") == "a", 1).otherwise(2).cast("long").alias("query_id"), "query")
    channels = index.channel_rows(alone, built, 12)
    want = {"bm25_only": channels["sparse"], "dense_only": channels["dense"], "exact_only": channels["exact"], "rrf_hybrid_rewrite_off": index.hybrid(alone.withColumn("depth", F.lit(2)), built).withColumnRenamed("ord", "doc_id")}
    for variant, rows in want.items():
        for q, case in ((1, "a"), (2, "b")):
            assert got.get((variant, case), []) == [r["doc_id"] for r in rows.where(f"query_id = {q} AND rank <= 2").orderBy("rank").collect()], variant
    assert {v for v, _ in got} == set(VARIANTS) and got[("rrf_hybrid_small2big_off", "a")] == got[("rrf_hybrid_rewrite_off", "a")]


def test_embedding_provider(spark):
    rows = spark.createDataFrame([(i, "t" * i) for i in range(40)], "id long, text string")
    sizes = index.embedded(rows, "text", lambda some: [[3.0 if len(some) <= 16 else 0.0, 4.0] for _ in some])
    assert {tuple(r["embedding"]) for r in sizes.collect()} == {(0.6, 0.8)} and sizes.first()["embedding_source"] == "provider"
    for bad in (lambda some: [[1.0]], lambda some: 1 / 0):
        got = index.embedded(rows, "text", bad)
        assert {r["embedding_source"] for r in got.collect()} == {"local"} and len(got.first()["embedding"]) == 32


def test_hybrid_over_chunks(spark, built):
    asked = spark.createDataFrame([(1, "住宿费每年 800元"), (2, "2024 招生公告"), (3, "")], "query_id long, query string")
    rows = index.chunks_of(index.hybrid(asked, built), built)
    best = {r["query_id"]: r for r in rows.where("rank = 1").collect()}
    assert best[1]["topic"] == "宿舍" and best[2]["topic"] == "招生公告"
    dated = [r["publish_date"] != "" for r in rows.where("query_id = 2").orderBy("rank").collect()]
    assert dated == sorted(dated, reverse=True)
    parent = best[1]["parent_id"]
    focus = asked.where("query_id = 1").withColumns({"focus": F.array(F.lit(parent)), "depth": F.lit(3)})
    near = index.chunks_of(index.hybrid(focus, built), built).collect()
    assert len(near) == 3 and all((r["score"] > 0.9) == (r["parent_id"] == parent) for r in near)
    assert index.chunks_of(index.hybrid(asked, built, cut=index.whitespace), built).count() > 0
    assert best[1]["parent_text"] == index.chunks_of(index.hybrid(asked, built), built).where("query_id = 1 AND rank = 1").select(index.small_to_big(built).alias("x")).first()["x"]


def test_reranker(spark):
    rows = spark.createDataFrame([(q, "a", 10 * q + i, "a" * i, "", 1.0 / i, i) for q in (1, 2, 3) for i in (1, 2, 3)], "query_id long, query string, doc_id long, text string, publish_date string, score double, rank int")

    def provider(query, texts, n):
        if len(texts[0]) == 1 and query == "a":
            return [(2, 0.9), (7, 0.8), (0, 0.7), (2, 0.1), (-1, 1.0)]

    got = index.rerank_with(rows, 2, provider).orderBy("query_id", "rank").collect()
    assert [(r["doc_id"], r["score"], r["degraded"]) for r in got if r["query_id"] == 1] == [(13, 0.9, False), (11, 0.7, False)]
    broken = index.rerank_with(rows, 2, lambda *a: 1 / 0)
    assert broken.count() == 6 and all(r["degraded"] for r in broken.collect())


def test_answers(spark, built, tmp_path):
    requests = [(1, "  2024 招生公告 学费标准 ", None, None), (2, "住宿费每年多少", ["宿舍"], None), (3, "qqqq zzzz", None, None), (4, "学费", None, ["retrieve"]), (5, None, None, None)]
    asked = spark.createDataFrame(requests, "query_id long, query string, hints array<string>, fail array<string>")
    paths = iter(range(99))

    def kept(df):
        path = f"{tmp_path}/{next(paths)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    out = answer.answer(asked, built, top_k=3, words=TIME_WORDS_RETRIEVAL, table=kept)
    got = {r["query_id"]: r for r in out.collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert len(got[1]["sources"]) <= 3 and got[1]["blocks"] and got[1]["sources"][0]["title"] == "2024 招生公告"
    assert got[4]["reason"] == "retrieval_error" and got[4]["sources"] is None and got[4]["blocks"] == []
    assert got[3]["status"] == "degraded" and got[3]["retried"]
    facts = spark.createDataFrame([(1, "f1: a", 0.2), (1, "f2: b", 0.9), (1, "f3: c", 0.1)], "query_id long, fact string, score double")
    more = answer.graph_evidence(out.where("query_id = 1"), facts).first()
    assert [s["chunk_id"] for s in more["sources"][-2:]] == ["graph-1", "graph-2"] and more["blocks"][-2:] == ["[graph] f2: b", "[graph] f1: a"]


def test_gateway_steps(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    lit = F.lit
    assert value(gateway.fail_features(lit(" rag, ,web,rag"))) == ["rag", "web"] and value(gateway.failed(F.array(lit("rag")), "web", "rag"))
    assert value(gateway.soft_pass(lit(False), lit("timeout"))) and not value(gateway.soft_pass(lit(False), lit(" "))) and not value(gateway.soft_pass(lit(True), lit("x")))
    assert value(gateway.special_memory(lit("请详细说，最好用表格"))) == "偏好详细回答" and value(gateway.special_memory(lit("x"))) is None
    assert value(gateway.long_memory_snippet(lit("问"), lit(" a \n b "))) == "用户关注：问；系统回应摘要：a b"
    assert value(gateway.preview(lit("a  b"), 3)) == "a b" and value(gateway.preview(lit("abcdef"), 3)) == "abc..."
    assert value(gateway.setting(lit("x"), "double", 0.5)) == 0.5 and value(gateway.setting(lit(" 2 "), "int", 1)) == 2 and value(gateway.setting(lit("4, x,8"), "array<int>", [1])) == [4, 8] and value(gateway.setting(lit(None).cast("string"), "array<int>", [1])) == [1]
    assert value(gateway.skill_note(lit(" "), lit("s"), lit("g"))) == "s"
    assert value(gateway.evidence_blocks(F.array(lit("<script>x</script>ok")))) == ["[外部证据1] [已移除脚本片段]ok"]
    assert value(gateway.variant_flag(lit("rrf_hybrid_rewrite_on"), "rewrite")) and value(gateway.variant_base(lit("rrf_hybrid_rewrite_on"))) == "rrf_hybrid"
    notes, audit = gateway.route_notes(lit("smalltalk"), lit("r"), F.array(lit("rag"), lit("web_search")), F.array(lit("rag")))
    assert value(notes) == ["auto_disable:web_search"] and value(audit) == ["query_router:label:smalltalk:r", "query_router:auto_disable:web_search"]
    assert value(gateway.cache_key(lit("a"), lit(None).cast("string"))) != value(gateway.cache_key(lit(None).cast("string"), lit("a")))
    assert gateway.feature_catalog(spark).count() == 5 and gateway.tool_catalog(spark, ("a.edu",)).where("size(domains) = 1").count() == 2
    asked = spark.createDataFrame([(["use_saved_skill"], " "), (["use_saved_skill"], "s1"), (["rag"], None)], "features array<string>, saved_skill_id string")
    assert [r["x"] for r in asked.select(gateway.rejected(asked).alias("x")).collect()] == [True, False, False]
    rows = spark.createDataFrame([(["citation_guard"], ["s"], [], "fine", "main", None, True, []), (["citation_guard"], [], [], "api key sk-abcdefghijkl", "main", "m", False, ["a"])], "features array<string>, sources array<string>, degraded array<string>, text string, route string, model string, cache_hit boolean, audit array<string>")
    good, bad = gateway.assembled(rows, "[notice]", "[cut]").collect()
    assert (good["text"], good["status"], good["audit"]) == ("fine", "ok", ["generation:main:unknown:cache_hit"])
    assert (bad["text"], bad["status"], bad["degraded"]) == ("[cut]", "degraded", ["citation_guard"]) and bad["audit"][-1].startswith("safety_audit:output_sanitized:")


def test_gateway_tables(spark, tmp_path):
    queries = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    pages = spark.createDataFrame([(1, "u1", "<p>a b</p>"), (2, "u2", "<p>b</p>"), (3, "u3", "<p>c</p>")], "page_id long, url string, html string")
    hits = gateway.page_hits(queries, pages)
    assert [r["url"] for r in hits.orderBy("n").collect()] == ["u2", "u1"] or [r["url"] for r in hits.orderBy("n").collect()] == ["u1", "u2"]
    assert len(gateway.web_blocks(queries, hits).first()["blocks"]) == 2
    assert gateway.web_hits(queries, ("x.edu",)).first()["url"] == "https://x.edu/search?keyword=a%20b"
    effects = gateway.memory_effects(spark.createDataFrame([("s", 1, "简短 q", "t"), ("s", 2, "q2", "t2")], "session string, ord long, question string, text string"))
    assert sorted((r["ord"], r["kind"]) for r in effects.collect()) == [(1, "long"), (1, "short"), (1, "special"), (2, "long"), (2, "short")]
    entries = spark.createDataFrame([("s", "long", k, k.upper(), t) for k, t in (("a", 1), ("b", 3), ("c", 2))], "session string, kind string, key string, value string, verified long")
    assert gateway.memory_context(entries).first()["blocks"] == ["B", "C"]
    deltas = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", None), ("b", 1, "z", None), ("b", 2, None, "e"), ("c", 1, None, "e")], "session string, seq long, delta string, error string")
    assert {(r["session"], r["text"], r["status"]) for r in gateway.delivered(deltas, "!").collect()} == {("a", "xy", "ok"), ("b", "z\n!", "degraded"), ("c", "!", "failed")}
    items = spark.createDataFrame([("k", 1, 1.0, 1, None), ("k", 1, 2.0, 2, "e"), ("k", 2, 3.0, 1, None)], "key string, id long, t double, seq long, error string")
    assert sorted((r["id"], r["failed"]) for r in gateway.stream_outcome(items).collect()) == [(1, True), (2, False)]
    results = spark.createDataFrame([("a", True, "ok", 10.0), ("b", True, "failed", 20.0), ("c", True, "degraded", 30.0), ("d", False, "ok", 5.0)], "name string, ok boolean, status string, latency_ms double")
    cases = spark.createDataFrame([("a", "x", False), ("b", "x", True), ("c", "y", False), ("d", "y", False)], "name string, category string, should_fail boolean")
    got = {r["category"]: (r["total"], r["pass_rate"], r["p95_latency_ms"]) for r in gateway.evaluated(results, cases).collect()}
    assert got == {"x": (2, 1.0, 20.0), "y": (2, 0.5, 30.0), None: (4, 0.75, 30.0)}
    reports.write_report(results, f"{tmp_path}/r")
    assert reports.read_report(spark, f"{tmp_path}/r", results._jdf.schema().toDDL()).count() >= 1 and reports.read_report(spark, f"{tmp_path}/none") is None
    reports.append_lines(results.limit(1), f"{tmp_path}/l")
    reports.append_lines(results.limit(2), f"{tmp_path}/l")
    assert spark.read.json(f"{tmp_path}/l").count() == 3
