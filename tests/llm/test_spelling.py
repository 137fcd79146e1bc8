import random
import re
import zlib
from collections import Counter

import pytest

from siteweave.llm.spelling import Vectors, chain_ends, count_words, group_variants, grow, near_words, one_edit, search, variants_sql

LOWER = {c: c + 32 for c in range(65, 91)}


def one_away(a, b):
    """One inserted, deleted or replaced code point, by trying all of them."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def forms(counts, ratio=2):
    out = {}
    near = {w: [v for v in counts if one_away(w, v)] for w in counts}
    form = {}
    for w, partners in near.items():
        best = min(partners, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def table(spark, counts):
    return spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word string, n long, root string, node int")


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(12)
    words = {"".join(rng.choice("entiahoé") for _ in range(rng.randrange(3, 8))) for _ in range(500)}
    for w in list(words)[:200]:
        k = rng.randrange(len(w))
        words |= {w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "ß" + w[k + 1 :]}
    words |= {"a", "b", "ab", "", "zzzzz", "Äöü", "😀abc", "😀abcd", "x" * 3_000, "x" * 3_001}
    return {w: rng.choice([3, 3, 4, 6, 12, 24, 25, 100, 1000]) for w in sorted(words)}


@pytest.mark.parametrize("options", [{}, {"part_words": 20}, {"part_words": 3}, {"part_words": 5, "groups": ["e"]}, {"groups": list("entiaho")}])
def test_variants_equal_brute_force(spark, vocabulary, options):
    """Also with a trie cut into many nodes, and with full vectors of more words than a node may have."""
    assert result(group_variants(table(spark, vocabulary), **options)) == forms(vocabulary)


def test_words_of_one_vector(spark):
    """One hot vector: all words are permutations within a letter group."""
    rng = random.Random(3)
    words = {"".join(rng.choice("bz") for _ in range(9)) for _ in range(300)}
    counts = {w: 3 + k for k, w in enumerate(sorted(words))}
    pairs = near_words(table(spark, counts), part_words=16).collect()
    assert sorted((r.word, r.other) for r in pairs) == sorted((a, b) for a in words for b in words if one_away(a, b))
    assert all(r.n == counts[r.word] and r.other_n == counts[r.other] for r in pairs)


def test_search_spends_one_surplus_and_one_deficit(vocabulary):
    vectors = Vectors(("en", "ti", "ah"))
    trie = grow([(vectors(w), w, n) for w, n in vocabulary.items()], 0)
    for word in list(vocabulary)[::7]:
        found = sorted(w for _, w, _ in search(trie, 0, vectors(word), word))
        assert found == sorted(w for w in vocabulary if one_away(word, w) and (len(w) > len(word) or len(w) == len(word) and w > word))
    assert one_edit("abc", "abxc") and one_edit("abc", "axc") and not one_edit("abc", "acbd")


def test_counts_and_planted_misspellings(spark):
    rng = random.Random(8)
    words = ["Thonre", "éauÖx", "STRASSE", "naïve", "abcd", "über×mut", "longerword"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", "-", "1", "日", "¿"]) for _ in range(60))) for i in range(300)]
    docs += [(None, "Thonre Thonre"), (3, docs[3][1]), (999, None), (998, ""), (997, "thonre " * 50_000)]
    want = Counter()
    for i, text in docs:
        for run, n in Counter(re.findall("[A-Za-zÀ-ÿ]+", text or "")).items():
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += n
    frame = spark.createDataFrame([(i, t, 1, "y") for i, t in docs], "doc_id long, text string, n int, word string").repartition(3)
    got = {r.word: r.n for r in count_words(frame, misspell=7).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    plain = {r.word for r in count_words(frame).collect()}
    assert plain == {"thonre", "éauÖx", "strasse", "naïve", "über×mut", "longerword"}


def test_chains_and_empty_tables(spark):
    chain = spark.createDataFrame([(f"w{k:03}", f"w{k + 1:03}") for k in range(37)] + [("a", "w000"), ("b", "c")], "word string, root string")
    ends = {r.word: r.root for r in chain_ends(chain).collect()}
    assert ends == {f"w{k:03}": "w037" for k in range(37)} | {"a": "w037", "b": "c"}
    empty = spark.createDataFrame([], "word string, n long")
    assert group_variants(empty).count() == 0 and near_words(empty).count() == 0
    assert result(group_variants(spark.createDataFrame([("solo", 4), (None, 3), ("nul", None)], "word string, n long"))) == {"solo": (None, "solo", 4, 0, None)}
    assert count_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert "97" in variants_sql()
