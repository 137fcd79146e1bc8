"""Entries of documents are shuffled once; only documents of very many bytes go by sorted ranges, with the same parts."""

import random

import pytest
from pyspark.sql import functions as F

from siteweave.plans import documents


@pytest.fixture
def sections(rows):
    rng = random.Random(7)
    a = rows("doc int, id string, v double", *((None if k % 10 == 9 else 1 if k % 2 else k % 7, f"i{k}", rng.random()) for k in range(300)))
    return {"a": a.repartition(3), "b": rows("doc int, text string", *((k % 5, "x" * k) for k in range(60)))}


def test_one_shuffle(sections):
    """F7"""
    made = documents.nested(sections, ["doc"], 500)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


@pytest.mark.parametrize("limit", [1, 2_000])
def test_ranges_give_the_same_parts(spark, sections, limit):
    """without a limit, in part and all by ranges; documents without a key are not lost."""
    want = sorted(map(str, documents.nested(sections, ["doc"], 500).collect()))
    assert sorted(map(str, documents.nested(sections, ["doc"], 500, limit).collect())) == want
    back, broken = documents.unnested(documents.nested(sections, ["doc"], 500, limit), {"a": "id string, v double", "b": "text string"}, ["doc"])
    assert broken.count() == 0
    assert sorted(map(str, back["a"].collect())) == sorted(map(str, sections["a"].collect()))


def test_written_compressed(spark, sections, monkeypatch):
    """what is written is a fraction of the entries."""
    from pathlib import Path

    from siteweave.workload import documents_q

    paths = []
    kept = documents_q.scratch_path
    monkeypatch.setattr(documents_q, "scratch_path", lambda *a: paths.append(kept(*a)) or paths[-1])
    back, _ = documents_q.read_back(spark, sections, {"a": "id string, v double", "b": "text string"}, ["doc"], 500)
    assert back["b"].agg(F.sum(F.length("text"))).first()[0] == sum(range(60))
    files = [f for f in Path(paths[0].removeprefix("file:")).glob("part-*")]
    assert files and all(f.name.endswith(".json.gz") for f in files)
