import random

import corpus_pipeline
from siteweave.llm.queries import QUERIES

from .test_decontaminate import brute as contaminated
from .test_jaccard_join import components, shingles
from .test_language_id import noise


def test_every_stage_against_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rng = random.Random(10)
    planted = [(10**6 + k, noise(rng), None, "src0", 1) for k in range(15)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in after.collect()} == {i for i, _ in before}
            break
        assert after.columns == columns
        kept = sorted(r["doc_id"] for r in after.collect())
        if name == "language_id":
            expected = [i for i, t in before if i < 10**6 and any(c.isalpha() for c in t or "")]
        elif name == "ngram_jaccard":
            expected = [int(i) for i, n, c in components(before) if i == c or n == 0]
        else:
            expected = [r[0] for r in contaminated(before, items) if not r[-1]]
        assert kept == sorted(expected), name
        docs = after


def test_near_duplicates_of_five_words_at_four_fifths(spark, docs, small):
    rng = random.Random(4)
    rows = []
    for added in range(10, 32, 2):  # 100 shingles and as many more, similarity 0.91 to 0.77
        base = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        rows += [" ".join(base), " ".join([*base, *(f"x{added}-{k}" for k in range(added))])]
    rows = list(enumerate(rows))
    sets = [shingles(t, 5) for _, t in rows]
    near = [100 * len(x & y) >= 80 * len(x | y) for x, y in zip(sets[::2], sets[1::2], strict=True)]
    between = [x and 100 * len(a & b) < 85 * len(a | b) for x, a, b in zip(near, sets[::2], sets[1::2], strict=True)]
    assert any(between) and not all(near)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs(*rows), small).collect())
    assert kept == sorted([i for i in range(0, len(rows), 2)] + [2 * k + 1 for k, x in enumerate(near) if not x])


def test_run_equals_its_stages_and_queries_are_complete(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "best_fit_packing"]
    assert corpus_pipeline.run(spark, small).count() > 0
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_empty_documents(spark, small, docs):
    none = docs("a").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, small).count() == 0
