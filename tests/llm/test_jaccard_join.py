import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.llm import jaccard_join as J
from siteweave.llm.shingles import BLOCK, shingle_sets
from siteweave.operators import ranking
from .conftest import by_id

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(rows, percent=85):
    """Smallest id reachable, by comparing every pair."""
    sets = [(i, shingles(t)) for i, t in rows]
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                label[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return sorted((str(i), len(s), str(least[find(k)])) for k, (i, s) in enumerate(sets))


def result(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def near_copies(seed, originals=12, copies=14, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    out = []
    for _ in range(originals):
        base = [rng.choice(vocabulary) for _ in range(words)]
        if rng.random() < 0.5:
            base[5:5] = passage
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                w = w[: rng.randint(1, len(w))]
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("hot", [J.HOT, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(docs, seed, hot):
    texts = near_copies(seed)
    assert result(J.near_duplicates(docs(*texts), hot=hot)) == components(list(enumerate(texts)))


@pytest.mark.parametrize("sent", [1 << 16, 0])
def test_documents_of_large_components_are_dealt_out(docs, monkeypatch, sent):
    """Components beyond the limit are joined in parts, their keys broadcast or not; exact copies and rows without id among them."""
    monkeypatch.setattr(J, "COMPONENT_ROWS", 2)
    monkeypatch.setattr(ranking, "SENT_KEYS", sent)
    texts = near_copies(3)
    rows = [*enumerate(texts), *((200 + k, texts[0]) for k in range(9)), (None, texts[0]), (None, texts[1]), (300, None)]
    assert result(J.near_duplicates(docs(*rows))) == components(rows)
    kept = sorted(str(r["doc_id"]) for r in J.keep_one(docs(*rows)).collect())
    assert kept == sorted(i for i, n, c in components(rows) if i == c or n == 0)


def test_chains_ties_repeats_and_odd_texts(docs, clashing):
    base = [f"t{k}" for k in range(80)]
    chain = []
    for k in range(12):  # each links to the next only
        base = [*base[:3], f"new{k}", f"more{k}", *base[5:]] if k % 2 else [*base[:70], f"new{k}", *base[71:]]
        chain.append(" ".join(base))
    long = " ".join(f"x{k}" for k in range(60_000))
    texts = [*chain, None, "", " \t\n", "one", "ONE", "one two", "a b c d", "A  b\tc\nd", "a a a a a a", long, long + " end", "w" * (2 * BLOCK) + " b c d e"]
    rows = [*enumerate(texts), (3, texts[3]), (100, texts[0]), (None, texts[1])]
    table = clashing(docs(*rows), "cid", "token", "row_key", "component_id", "text_hash")
    assert result(J.near_duplicates(table)) == components(rows)


def test_links_at_the_threshold(docs):
    # 85 of 100 shingles in common link, 84 of 99 do not
    exact = " ".join(f"a{k}" for k in range(103))
    short = " ".join(f"a{k}" for k in range(88))
    other = " ".join(f"b{k}" for k in range(102))
    less = " ".join(f"b{k}" for k in range(87))
    rows = by_id(J.near_duplicates(docs(exact, short, other, less)), "doc_id")
    assert [rows[k]["component_id"] for k in range(4)] == [0, 0, 2, 3]
    assert [rows[k]["n_links"] for k in range(4)] == [1, 1, 0, 0]


def test_one_group_of_copies_makes_no_quadratic_output(docs):
    rng = random.Random(5)
    base = [f"v{k}" for k in range(150)]
    texts = [" ".join(base)]
    for k in range(300):
        w = list(base)
        w[rng.randrange(150)] = f"own{k}"
        texts.append(" ".join(w))
    rows, links, roots = J.link_sets(docs(*texts))
    assert links.count() < 3 * len(texts)
    assert roots.select("root").distinct().count() == 1


@pytest.mark.parametrize("part", [J.PART_SETS, 20])
def test_every_link_is_counted(docs, monkeypatch, part):
    monkeypatch.setattr(J, "PART_SETS", part)
    monkeypatch.setattr(J, "COLUMNS", 100)
    rng = random.Random(5)
    base = [f"v{k}" for k in range(150)]
    texts = [" ".join(base)]
    for k in range(300):
        w = list(base)
        w[rng.randrange(150)] = f"own{k}"
        texts.append(" ".join(w))
    texts += [*near_copies(3), texts[7], texts[9].upper(), "", None]
    table = docs(*texts)
    sets = [frozenset(shingles(t)) for t in texts]
    classes = {s for s in sets if s}
    degree = {s: sum(s != t and 100 * len(s & t) >= 85 * len(s | t) for t in classes) for s in classes}
    rows = by_id(J.near_duplicates(table), "doc_id")
    assert [rows[k]["n_links"] for k in range(len(texts))] == [degree.get(s, 0) for s in sets]
    assert {degree[s] for s in sets[:301]} == {300}
    pairs = [tuple(r) for r in J.every_link(table, J.link_sets(table), pairs=True).collect()]
    assert len(pairs) == len(set(pairs)) == sum(degree.values()) // 2 > 45_000


def test_keep_one_keeps_columns_and_one_of_each(docs, clashing):
    text = "a b c d e f g h"
    rows = [(5, text), (2, text), (2, text), (9, "x y z"), (None, text), (11, None), (12, ""), (12, "")]
    table = clashing(docs(*rows), "_row_key", "_gone")
    kept = J.keep_one(table)
    assert kept.columns == table.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == [("11", ""), ("12", ""), ("12", ""), ("2", text), ("9", "x y z")]


def test_empty_table(docs):
    nothing = docs("a").filter("false")
    assert J.near_duplicates(nothing).count() == 0 and J.keep_one(nothing).count() == 0


def test_shingle_hashes_follow_words_across_blocks():
    words = [f"é{k % 977}x" for k in range(300_000)]
    text = " ".join(words)
    [one] = shingle_sets([text.encode()], 4)
    assert len(one) == len(shingles(text))
    many = shingle_sets([b"a b c d e", b"", b"A\tB\nC d e", b"b c d e", b"a b", b"ab"], 4)
    assert np.array_equal(many[0], many[2]) and set(many[3]) <= set(many[0])
    assert [len(s) for s in many] == [2, 0, 2, 1, 1, 1] and many[4][0] != many[5][0]


def test_connected_finds_long_chains(spark):
    chain = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1001, 1200).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    roots = {r["cid"]: r["root"] for r in J.connected(chain.unionByName(star)).collect()}
    assert roots == {**{k: 1 for k in range(1, 301)}, **{k: 1000 for k in range(1000, 1200)}}
