from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siteweave.sources import readers
from siteweave.workload import checks_q


@pytest.mark.parametrize("name", ["manifest_reader", "prior_cameras", "prior_occlusion", "missing_priors"])
def test_documents_are_bounded_and_all_rows_come_back(spark, small, tmp_path, monkeypatch, name):
    expected = sorted(map(str, getattr(checks_q, name)(spark, small).collect()))
    monkeypatch.setattr(checks_q, "ENTRIES", 20)
    monkeypatch.setattr(checks_q, "scratch_path", lambda spark, kind: str(tmp_path / kind))
    assert sorted(map(str, getattr(checks_q, name)(spark, small).collect())) == expected
    kind, field = ("manifests", "run") if name == "manifest_reader" else ("priors", "pitch_deg")
    sizes = [p.read_text().count(f'"{field}"') for p in Path(tmp_path, kind).rglob("*.txt")]
    table = "events" if kind == "manifests" else "customer"
    assert sum(sizes) == spark.read.parquet(f"{small}/{table}.parquet").count() and 0 < max(sizes) <= 20


def test_one_hot_part_comes_in_several_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(checks_q, "ENTRIES", 20)
    rows = spark.range(95).select(F.lit(7).alias("part"), "id", F.col("id").cast("string").alias("entry"))
    checks_q._documents(rows, "id", "[", "]", str(tmp_path / "out"))
    docs = readers.json_documents(spark, str(tmp_path / "out"), "*.txt").select(F.from_json("text", "array<long>").alias("x")).collect()
    assert len(docs) == 5 and sorted(k for r in docs for k in r["x"]) == list(range(95))
