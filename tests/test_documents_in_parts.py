"""Documents of several tables in parts, and the way back."""

import random

import pytest
from pyspark.sql import functions as F

from siteweave.plans import documents

SCHEMAS = {"a": "id string, v double, deep struct<x: int, y: array<string>>", "b": "n int, text string"}


@pytest.fixture
def sections(rows):
    rng = random.Random(6)
    deep = [(1 if k % 3 else k, f"i{k}", rng.random(), (k, [None, "\"q\" \\ é\n"] if k % 2 else None)) for k in range(200)]
    a = rows("doc int, id string, v double, deep struct<x: int, y: array<string>>", *deep, (1, None, None, None), (1, None, None, None))
    b = rows("doc int, n int, text string", *((k, k, "x" * (3_000 if k == 4 else 5)) for k in range(6)))
    return {"a": a, "b": b}


@pytest.mark.parametrize("size", [1, 500, 1 << 20])
def test_rows_come_back_from_parts_of_bounded_size(sections, size):
    made = documents.nested(sections, ["doc"], size)
    longest = max(len(r.entries.encode()) for r in made.filter("kind = 'a'").collect())
    assert longest < size + 200 and (size < 1 << 20 or made.count() == len({(r.doc, k) for k, df in sections.items() for r in df.collect()}))
    tables, broken = documents.unnested(made, SCHEMAS, ["doc"])
    assert broken.count() == 0
    for kind, df in sections.items():
        assert sorted(map(str, df.collect())) == sorted(map(str, tables[kind].collect()))


def test_half_a_document_is_none(sections):
    made = documents.nested(sections, ["doc"], 500)
    lost = made.filter("not (doc = 1 and kind = 'a' and part = 2)")
    torn = lost.withColumn("entries", F.when((F.col("doc") == 2) & (F.col("kind") == "b"), F.lit('[{"n":')).otherwise(F.col("entries")))
    twice = torn.unionByName(torn.filter("doc = 3 and kind = 'b'"))
    tables, broken = documents.unnested(twice, SCHEMAS, ["doc"])
    assert {(r.doc, r.kind) for r in broken.collect()} == {(1, "a"), (2, "b"), (3, "b")}
    assert not {1} & {r.doc for r in tables["a"].collect()} and {r.doc for r in tables["b"].collect()} == {0, 1, 4, 5}


def test_empty_sections(sections):
    none = {k: df.limit(0) for k, df in sections.items()}
    made = documents.nested(none, ["doc"])
    assert made.count() == 0 and all(t.count() == 0 for t in documents.unnested(made, SCHEMAS, ["doc"])[0].values())
