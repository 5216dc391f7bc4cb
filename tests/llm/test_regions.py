"""Regions of more members than one task compares."""

import random

import pytest

from corvane.llm import near, regions
from tests.llm.test_joins import brute


@pytest.fixture(scope="module")
def copies():
    """Copies of one text with up to an eighth of the words changed: some are linked with most others, some with few or none."""
    r, base = random.Random(11), [f"t{i}" for i in range(80)]
    rows = []
    for i in range(260):
        t = list(base)
        for k in r.sample(range(len(t)), r.randrange(11)):
            t[k] = f"w{r.randrange(200)}"
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("rare", [300, 0])
def test_large_regions_are_joined_in_tiles(spark, copies, monkeypatch, rare):
    """In one round, by products and by pairs."""
    turns, joined = [], regions.linked_components
    monkeypatch.setattr(regions, "PAIRS", 0)
    monkeypatch.setattr(regions, "PAIRS_PER_NODE", 0)
    monkeypatch.setattr(regions, "RARE", rare, raising=False)

    def counted(*a, **k):
        turns.append(joined(*a, **(k | {"leaf": 24})))
        return turns[-1]

    monkeypatch.setattr(near, "linked_components", counted)
    got = near.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string"), 2)
    want = {i: c for i, (_, c) in brute(copies, 2, 80, 100).items()}
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want and len(set(want.values())) > 5
    assert turns[0][1] == 1
