import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from siteweave.llm import hilbert_shards as H


@pytest.mark.parametrize("dims,bits", [(1, 3), (2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_unit_steps(spark, dims, bits):
    side = 1 << bits
    cells = [tuple(c) for c in itertools.product(range(side), repeat=dims)]
    names = [f"c{k}" for k in range(dims)]
    table = spark.createDataFrame(cells, ", ".join(f"{n} int" for n in names)).withColumn("place", H.hilbert_index(names, bits))
    rows = sorted((r["place"], tuple(r[n] for n in names)) for r in table.collect())
    assert [p for p, _ in rows] == list(range(side**dims))
    assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for (_, x), (_, y) in itertools.pairwise(rows))


def check(rows, texts, shards):
    rows = [r.asDict() for r in rows]
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    counts = [0] * shards
    slots = [[] for _ in range(shards)]
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        counts[r["shard"]] += 1
        slots[r["shard"]].append(r["slot"])
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_law_with_copies_nulls_repeats_and_clashing_columns(docs, clashing):
    texts = [*(f"text {k} " * (k % 17) for k in range(90)), *["copy"] * 60, None, "", None, "é"]
    rows = [*enumerate(texts), (3, texts[3]), (None, "no id"), (None, None)]
    table = clashing(docs(*rows), "place", "level_0", "shard", "slot", "_at", "_part")
    found = H.shard_documents(table)
    check(found.collect(), rows, 24)
    # equal texts lie in neighbouring shards
    assert found.filter(F.col("text_crc32") == zlib.crc32(b"copy")).select("shard").distinct().count() <= 60 // 6 + 2


@pytest.mark.parametrize("n", [0, 1, 23, 25])
def test_few_rows(docs, n):
    rows = [(k, f"t{k}") for k in range(n)]
    table = docs(*rows) if n else docs("a").filter("false")
    check(H.shard_documents(table).collect(), rows, 24)


def test_manifest_covers_its_rows(spark, small):
    sharded = H.shard_documents(spark.read.parquet(f"{small}/documents.parquet"))
    parts = {r["shard"]: r for r in H.shard_manifest(sharded).collect()}
    assert len(parts) == 24 and sum(r["rows"] for r in parts.values()) == sharded.count()
    for r in sharded.collect():
        assert all(parts[r["shard"]][f"level_{k}_min"] <= r[f"level_{k}"] <= parts[r["shard"]][f"level_{k}_max"] for k in range(4))


def test_runs_in_the_jvm(docs):
    plan = H.shard_documents(docs("a", "b"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
