import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from siteweave.llm import language_id as L
from .conftest import by_id


def test_held_out_accuracy(spark, small):
    d = spark.read.parquet(f"{Path(small).parent}/sf0.01/documents.parquet")
    found = by_id(L.learn_and_identify(d), "doc_id")
    truth = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    assert {k for k, r in found.items() if r["held_out"]} == {k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2}
    kept = [k for k, r in found.items() if r["held_out"]]
    assert sum(found[k]["lang_pred"] == truth[k] for k in kept) >= 0.98 * len(kept)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in set(truth.values()) for r in found.values())


@pytest.fixture(scope="module")
def model(spark, small):
    d = spark.read.parquet(f"{Path(small).parent}/sf0.01/documents.parquet")
    return L.fit_languages(d.select("lang", "text"))


@pytest.fixture(scope="module")
def samples(spark, small):
    d = spark.read.parquet(f"{Path(small).parent}/sf0.01/documents.parquet")
    rows = sorted(d.filter("length(text) > 2000").collect(), key=lambda r: r["doc_id"])
    return {lang: [r["text"] for r in rows if r["lang"] == lang] for lang in ("de", "en", "es", "fr")}


def test_mixtures_are_told_apart(docs, model, samples):
    mixed = samples["en"][0][:1500] + "\n" + samples["de"][0][:1500]
    rows = by_id(L.identify_languages(docs(mixed, samples["fr"][1]), model), "doc_id")
    assert set(rows[0]["languages"]) >= {"en", "de"} and 0.3 < rows[0]["score"] < 0.7
    assert rows[1]["lang_pred"] == "fr" and rows[1]["score"] > 0.9


def test_batches_do_not_change_a_text(docs, model, samples):
    texts = [t for own in samples.values() for t in own[:4]]
    together = L.language_sets(model, texts, 8, 2.0)
    alone = [L.language_sets(model, [t], 8, 2.0)[0] for t in texts]
    for a, b in zip(together, alone, strict=True):
        assert [k for k, _ in a] == [k for k, _ in b]
        assert np.allclose([s for _, s in a], [s for _, s in b], atol=1e-3)


def test_odd_texts_repeats_and_clashing_columns(docs, model, samples, clashing):
    texts = [None, "", "12 34 !?", "🙂 🙂", "é", "ÀÉ", samples["es"][0] * 20, (6, samples["es"][0] * 20)]
    found = L.identify_languages(clashing(docs(*texts), "lang_pred", "score", "languages", "shares", "text_hash"), model).collect()
    by = sorted((r["doc_id"], r["lang_pred"], r["score"] > 0) for r in found)
    assert [b[1:] for b in by[:4]] == [("und", False)] * 4
    assert all(b[1] != "und" and b[2] for b in by[4:]) and [b[1] for b in by[6:]] == ["es", "es"]


def test_without_labels_or_rows(docs):
    plain = docs("some text", lang=None)
    assert [r["lang_pred"] for r in L.learn_and_identify(plain).collect()] == ["und"]
    assert L.learn_and_identify(plain.filter("false")).count() == 0


def test_drop_unknown_without_labels_keeps_clean_rows(docs):
    kept = L.drop_unknown(docs("some text", None, "12 3", "é", "", lang=None))
    assert sorted(r["text"] for r in kept.collect()) == ["some text", "é"]


def noise(rng, words=40):
    return " ".join("".join(rng.choice("qxzjkvwpyßøþ") for _ in range(rng.randrange(4, 12))) for _ in range(words))


def test_texts_without_a_language_are_not_known(docs, model, samples):
    """Random letters are likelier without a language; clean texts, short ones, mixtures and quotes of noise are not."""
    rng = random.Random(10)
    clean = [t for own in samples.values() for t in own[:5]] + [samples["en"][0][:40], samples["de"][0][:9], samples["fr"][0] + samples["es"][0], samples["en"][1] + noise(rng)]
    junk = [noise(rng) for _ in range(20)] + [noise(rng, 4_000), noise(rng, 3)]
    found = by_id(L.identify_languages(docs(*clean, *junk, None, "1 2"), model), "doc_id")
    assert [found[k]["known"] for k in sorted(found)] == [True] * len(clean) + [False] * (len(junk) + 2)
    assert all(found[len(clean) + k]["lang_pred"] != "und" for k in range(len(junk)))


def brute_mixture(model, text, rounds, penalty):
    """The largest proportions and the margin over no language, word by word in plain floats."""
    g = L.grams([text])
    ends = [*g.word_starts[1:], len(g.buckets)]
    words = [[math.fsum(float(row[b]) for b in g.buckets[a:z]) for row in model.log_p] for a, z in zip(g.word_starts, ends, strict=True)]
    tops = [max(w) for w in words]
    p = [[math.exp(max(x - t, -60.0)) for x in w] for w, t in zip(words, tops, strict=True)]

    def fit(langs):
        shares = [1 / len(langs)] * len(langs)
        for _ in range(rounds):
            parts = [[w[k] * s for k, s in zip(langs, shares, strict=True)] for w in p]
            shares = [math.fsum(x[j] / sum(x) for x in parts) / len(p) for j in range(len(langs))]
        return shares, math.fsum(math.log(sum(w[k] * s for k, s in zip(langs, shares, strict=True))) for w in p)

    every, _ = fit(range(len(model.languages)))
    order = sorted(range(len(every)), key=lambda k: (-every[k], k))
    best, ll = {order[0]: 1.0}, fit(order[:1])[1]
    for size in range(2, len(order) + 1):
        shares, more = fit(order[:size])
        if more - ll <= penalty * math.log(len(p) + 1):
            break
        best, ll = dict(zip(order[:size], shares, strict=True)), more
    none = -len(g.buckets) * math.log(1 << L.BUCKET_BITS)
    return best, ll + math.fsum(tops) - penalty * math.log(len(p) + 1) * (len(best) - 2) - none


def test_mixtures_equal_brute_force(model, samples):
    rng = random.Random(2)
    texts = [own[0][:600] for own in samples.values()] + [samples["en"][0][:500] + " " + samples["de"][0][:500] + " " + samples["fr"][0][:300], noise(rng), "é", "a b c"]
    sets, margins = L.fitted_sets(model, texts, 8, 2.0)
    for text, found, margin in zip(texts, sets, margins, strict=True):
        best, expected = brute_mixture(model, text, 8, 2.0)
        assert dict(found) == pytest.approx(best, abs=2e-3), text[:40]
        assert margin == pytest.approx(expected, rel=1e-3, abs=0.05)


def test_words_of_texts():
    g = L.grams(["ab  c", "éx", "A1B"])
    assert list(g.words) == [2, 1, 2] and len(g.word_starts) == 5
    assert len(g.buckets) == 2 + 1 + 3 + 1 + 1


def test_drop_unknown_keeps_columns_and_clean_rows(docs, clashing):
    table = clashing(docs(*(("word text here " * 5) for _ in range(20)), (50, None), (51, "123 ..."), (52, ""), (3, "7"), (None, "letters")), "_gone", "_hash")
    kept = L.drop_unknown(table)
    assert kept.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([*map(str, range(20)), "None"])
