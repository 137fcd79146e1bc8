import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.llm import mixing
from siteweave.llm.mixing import even, mix_documents, mixed_texts, shard_table, split, taken_words


def targets(sizes, weights=(1, 2, 3), most=3):
    """By the rule as it is said: share by weight, stop at ``most`` times the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    stopped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        left, shares = total - sum(stopped.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] >= most * sizes[s] * shares]
        if not over:
            return stopped | {s: left * w[s] / shares for s in free}
        stopped |= {s: most * sizes[s] for s in over}


def corpus(spark, rows):
    schema = "doc_id long, text string, source string, size int, key int, shard int, epoch int, _id int, start int"
    return spark.createDataFrame([(i, t, s, 1, 2, 3, 4, 5, 6) for i, t, s in rows], schema)


def words(n, tag):
    return " ".join(f"{tag}{k}" for k in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    out = [(i, words(rng.randrange(1, 40), f"a{i}_"), "hot") for i in range(300)]
    out += [(300 + i, words(rng.randrange(1, 9), f"b{i}_"), f"s{i % 7}") for i in range(60)]
    out += [(400, words(5_000, "long"), "s3"), (401, None, "s1"), (402, "", "empty"), (403, " \t\n\x0b", "empty"), (404, words(11, "n"), None)]
    out += [(405, words(9, "r"), "é")] * 3 + [(None, words(4, "x"), "hot"), (None, words(4, "x"), "hot"), (406, "no break here", "Z")]
    return out


@pytest.mark.parametrize("block_words", [8_192, 16])
def test_sources_have_their_quota_and_documents_at_most_three_turns(spark, rows, block_words):
    mix = mix_documents(corpus(spark, rows), shards=5, block_words=block_words)
    found = taken_words(mix).collect()
    size = {i: len((t or "").split(" ")) if (t or "").strip() else 0 for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes, taken = Counter(), Counter()
    for i, _, s in rows:
        sizes[s] += size[i]
    assert Counter(r.doc_id for r in found) == Counter(i for i, _, _ in rows)
    want = targets(sizes)
    for r in found:
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[source[r.doc_id]])
        assert r.target == pytest.approx(want[source[r.doc_id]]) and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert {s: taken[s] for s in sizes} == {s: int(want[s] + 1e-9) for s in sizes}


def test_results_do_not_depend_on_partitions_or_weights_alone(spark, rows):
    table = corpus(spark, rows)
    cols = ["doc_id", "source", "epoch", "shard", "place", "length"]
    once = Counter(map(tuple, mix_documents(table, shards=4).select(cols).collect()))
    again = Counter(map(tuple, mix_documents(table.repartition(7, F.rand(3)), shards=4).select(cols).collect()))
    assert once == again
    assert once != Counter(map(tuple, mix_documents(table, shards=4, seed=2).select(cols).collect()))


def test_blocks_are_drawn_once_and_shards_get_even_numbers_of_them(spark, rows):
    mix = mix_documents(corpus(spark, rows), shards=6, block_words=16, keep=["text"])
    texts = mixed_texts(mix).select("shard", "doc_id", "epoch", "length", "text", "source").collect()
    assert len({(r.doc_id, r.epoch) for r in texts if r.doc_id not in (None, 405)}) == sum(r.doc_id not in (None, 405) for r in texts)
    for r in texts:
        assert len(r.text.split(" ")) == r.length or r.doc_id == 406
    by_shard = defaultdict(int)
    for r in shard_table(mix).collect():
        by_shard[r.shard] += r.words
    assert sum(by_shard.values()) == sum(r.length for r in texts)
    places = [r.shard for r in texts]
    assert len([1 for a, b in zip(places, places[1:], strict=False) if a != b]) == len(set(places)) - 1, "a shard stands in one piece"


def test_split_keeps_quotas_and_capacities_and_is_hypergeometric():
    quotas, capacities = np.array([40, 0, 25, 35]), even(100, 7)
    dealt = split(quotas, capacities, [1, 2])
    assert dealt.sum(axis=0).tolist() == quotas.tolist() and dealt.sum(axis=1).tolist() == capacities.tolist() and dealt.min() >= 0
    first = np.array([split(quotas, capacities, [seed])[0] for seed in range(3_000)])
    n = capacities[0]
    assert np.allclose(first.mean(axis=0), n * quotas / 100, atol=0.15)
    spread = n * quotas / 100 * (1 - quotas / 100) * (100 - n) / 99
    assert np.allclose(first.var(axis=0), spread, atol=0.35)


def test_sources_in_chunks(spark, monkeypatch):
    """More sources than one split holds: chunks are split first, each chunk's sources afterwards."""
    monkeypatch.setattr(mixing, "SPLIT_CELLS", 12)
    rows = [(i, words(1 + i % 5, "w"), f"s{i % 31:02}") for i in range(400)]
    mix = mix_documents(corpus(spark, rows), shards=3, block_words=2)
    runs = Counter()
    for r in mix.filter("length > 0").collect():
        runs[r.shard] += 1
    assert set(runs) == {0, 1, 2}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, got = targets(sizes), Counter()
    for r in mix.collect():
        got[r.source] += r.length
    assert {s: got[s] for s in sizes} == {s: int(want[s] + 1e-9) for s in sizes}


def test_no_rows_and_no_words(spark):
    empty = corpus(spark, [])
    assert mix_documents(empty).count() == 0 and taken_words(mix_documents(empty)).count() == 0
    blank = corpus(spark, [(1, None, "a"), (2, " ", None)])
    assert sorted(tuple(r) for r in taken_words(mix_documents(blank)).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
