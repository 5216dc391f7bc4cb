"""Retrieval queries on tables of their own: what they search, how often, and what counts as relevant."""

import pytest

from corvane.plans import retrieval, service


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Thirty documents that hold the first item, one that only has its numbers, others without; an item that none holds."""
    d = str(tmp_path_factory.mktemp("tables"))
    text = lambda i: f"alpha beta gamma number {i}" if i < 30 else "1 2 3 4 5 6 7 8 9 10" if i == 30 else f"other words {i}"
    docs = [(i, text(i), "en", "s", len(text(i))) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    items = [(0, " Alpha beta GAMMA "), (1, "10 9 8 7 6 5 4 3 2 1"), (2, "zzz qqq vvv"), (3, None), (4, "!!"), (5, "other words 31"), (5, "other words 32")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    return d


def test_retry_searches_once(spark, folder):
    """Rankings are written, not searched for again by each of their readers."""
    rows = retrieval.retry_union(spark, folder)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 1  # that of the retry
    assert {r["retried"] for r in rows.collect()} == {True, False}


def test_ablation_counts_all_that_hold_the_item(spark, folder):
    """Relevant are documents that hold an item, however many and whatever the exact channel finds, not those that have its numbers; the dense channel is one of them."""
    got = {r["variant"]: r for r in service.ablation_variants(spark, folder).collect()}
    assert set(got) == {"bm25", "exact", "sparse", "dense", "rrf"} and {r["total"] for r in got.values()} == {2}
    assert got["exact"]["avg_recall"] == round((round(5 / 30, 4) + 1) / 2, 4)  # of the item with two texts, two documents hold one; both are found
