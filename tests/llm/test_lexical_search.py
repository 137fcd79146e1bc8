import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from siteweave.llm import lexical_search
from siteweave.llm.lexical_search import Item, Strata, count_terms, ranked_search, word_runs

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(LOWER) for t in PATTERN.findall(text or "")]


def brute(docs, items, k=20):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        asked, scored = Counter(terms(text)), []
        for i, c in counted:
            m = 75 + (25 * c.total() * n_docs) // max(n_terms, 1)
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in asked.items() if c[t])
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, **options):
    return sorted((tuple(r) for r in ranked_search(docs, items, **options).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioubcdß9") for _ in range(rng.randrange(1, 5))) for _ in range(120)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(120)], k=n))
    docs = [(i, text(rng.choice([1, 3, 10, 10, 50, 200]))) for i in range(600)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # ties
    docs += [(7, "other text of a used id"), (None, text(20)), (2000, None), (2001, ""), (2002, "-- ,;"), (2003, text(30_000)), (-4, "Ä É " + vocabulary[3])]
    docs += [(2010, docs[8][1])] * 3
    items = [(f"q{i}", text(rng.choice([1, 2, 8, 30]))) for i in range(25)]
    items += [("q1", "another text of a used id " + vocabulary[0]), ("q0", items[0][1]), ("none", None), ("empty", "  "), ("unknown", "zzzzzz"), (None, vocabulary[2].upper()),
              ("repeats", f"{vocabulary[9]} " * 7 + vocabulary[30])]
    return docs, items


def tables(spark, docs, items):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, n int, terms string")
    return docs, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, block int")


@pytest.mark.parametrize("small", [False, True])
def test_lists_equal_brute_force(spark, corpus, monkeypatch, small):
    options = {}
    if small:  # several blocks of items, parts, chunks and visits
        for name, value in {"PART_ROWS": 90, "CHUNK_ROWS": 60, "FIRST_VISIT": 3}.items():
            monkeypatch.setattr(lexical_search, name, value)
        options = {"block_bytes": 300}
    assert found(*tables(spark, *corpus), **options) == brute(*corpus)


def test_strata_out_of_reach_are_not_visited():
    rng = np.random.default_rng(5)
    n = 4_000
    m, sizes = np.sort(rng.integers(75, 900, n)), np.ones(n, dtype=np.int64)
    strata = Strata.build(np.arange(n), m, sizes, np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64), np.array([3]))
    item = Item(0, np.array([0]), np.array([2]))
    visited = strata.search(item, np.zeros(n, dtype=np.int64), 20)
    shares = 2 * 3 * (10**9 // (1000 + 12 * m))
    order = np.lexsort((np.arange(n), -shares))[:20]
    assert item.ids.tolist() == order.tolist() and item.scores.tolist() == shares[order].tolist()
    assert visited < n / 2


def test_long_texts_are_cut_between_words():
    text = ("Wörter und Zahlen 12 " * 500).encode()
    whole = [w for run in word_runs(text) for w in run]
    assert [w for run in word_runs(text, 64) for w in run] == whole == [t.encode() for t in terms(text.decode())]
    assert count_terms(text, {b"und": 0, b"12": 4}) == (2_000, {0: 500, 4: 500})


def test_empty_tables(spark, corpus):
    docs, items = tables(spark, *corpus)
    assert ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search(docs, items.limit(0)).count() == 0
    assert ranked_search(docs.filter("text is null"), items).count() == 0
    got = defaultdict(list)
    for item, rank, _, _ in found(docs, items.filter("item_id = 'q3'"), k=3):
        got[item].append(rank)
    assert got == {"q3": [1, 2, 3]}
