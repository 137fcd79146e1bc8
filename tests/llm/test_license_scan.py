import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from siteweave.llm.license_scan import BASE, NOTICES, RareWordIndex, scan_licenses, word_idf
from siteweave.llm.queries import QUERIES
from .conftest import by_id

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    words = WORD.findall(lower_az(text))
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def base_columns(row):
    return tuple(row[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels"))


def test_base_phrases_equal_brute_force_on_the_given_table(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = by_id(QUERIES["op1_license_scan"](spark, small), "doc_id")
    assert {k: base_columns(r) for k, r in rows.items()} == {k: brute(t) for k, t in texts.items()}
    assert any(r["n_base"] for r in rows.values())
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows.values())


def test_odd_texts_repeated_rows_and_clashing_columns(docs, clashing):
    long = "Mit Licensé " + "x " * 200_000 + "MIT\nLicense, CC-BY"
    texts = [None, "", "...", "MIT license mit LICENSE", long, "cc by cc by", "É apache; license", (3, "MIT license mit LICENSE")]
    found = scan_licenses(clashing(docs(*texts), "text_hash", "places", "labels")).collect()
    got = sorted((r["doc_id"], *base_columns(r)) for r in found if r["doc_id"] != 3)
    want = sorted((k, *brute(t)) for k, t in enumerate(texts) if not isinstance(t, tuple) and k != 3)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert [base_columns(r) for r in found if r["doc_id"] == 3] == [brute(texts[3])] * 2


def test_notices_need_their_key_phrases(docs):
    notice = next(t for t in NOTICES if t.label == "bsd")
    words = notice.text.split()
    broken = " ".join(w for w in words if w != "binary")
    worn = " ".join("foo" if w == "met" else w for w in words)
    rows = by_id(scan_licenses(docs(f"intro {notice.text} outro", broken, worn, "source and binary forms of things")), "doc_id")
    assert [rows[k]["labels"] for k in range(4)] == ["bsd", "", "bsd", ""]
    assert rows[0]["score"] == 1 and 0.6 <= rows[2]["score"] < 1 and rows[1]["score"] == 0
    assert rows[0]["places"][0]["start"] == 1 and rows[0]["n_base"] == 0


def brute_notices(words, index, min_share=0.6):
    """Every start of every template: key phrases first, then the share of weight."""
    found = {}
    for t, template in enumerate(index.templates):
        wanted = template.text.split()
        for start in range(-len(wanted), len(words) + 1):
            same = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(wanted)]
            keys = [template.text] if template.base else template.keys
            at = [next(i for i in range(len(wanted)) if wanted[i : i + len(k.split())] == k.split()) for k in keys]
            if all(all(same[a : a + len(k.split())]) for a, k in zip(at, keys, strict=True)):
                share = sum(w for w, ok in zip(index.weights[t], same, strict=True) if ok) / sum(index.weights[t])
                if template.base or share >= min_share:
                    found[t, start] = share
    return found


def test_labels_and_scores_equal_brute_force(spark, docs):
    """Notices cut, edited, doubled and run together, in a corpus where their words stand in every document."""
    rng = random.Random(1)
    texts = []
    for template in NOTICES:
        words = template.text.split()
        edited = [w if rng.random() > 0.15 else "edit" for w in words]
        texts += [template.text, " ".join(edited), " ".join(words[2:]), f"{template.text} {rng.choice(NOTICES).text} {template.text}", " ".join(words[: len(words) // 2])]
    texts += ["the " * 300, "following conditions met"]
    table = docs(*texts)
    index = RareWordIndex([*BASE, *NOTICES], word_idf(table, [*BASE, *NOTICES]))
    rows = by_id(scan_licenses(table), "doc_id")
    for k, text in enumerate(texts):
        found = brute_notices(text.split(), index)
        label = lambda t: index.templates[t].label
        assert rows[k]["labels"] == ",".join(sorted({label(t) for t, _ in found})), text
        assert abs(rows[k]["score"] - min(1.0, max(found.values(), default=0.0))) < 1e-9
        assert rows[k]["places"] is not None and len(rows[k]["places"]) == len(found)


def test_edits_outside_the_key_phrase_and_words_of_every_document(docs):
    bsd = next(t for t in NOTICES if t.label == "bsd").text
    edited = bsd.replace("following", "next").replace("conditions", "terms").replace("met", "kept")
    mit = next(t for t in NOTICES if t.label == "mit").text
    assert by_id(scan_licenses(docs(edited)), "doc_id")[0]["labels"] == "bsd"
    rows = by_id(scan_licenses(docs(f"{mit} mit license", f"x {mit} mit license")), "doc_id")
    assert all(r["labels"] == "mit" and r["score"] > 0.99 and r["n_base"] == 1 for r in rows.values())
    alone = by_id(scan_licenses(docs("MIT License")), "doc_id")[0]
    assert alone["labels"] == "mit" and alone["score"] == 1


def test_many_places_of_a_common_word_cost_a_pass(docs):
    index = RareWordIndex([*BASE, *NOTICES], {})
    began = time.process_time()
    assert index.places(b"the license public general mit".split() * 40_000) == {}
    assert time.process_time() - began < 2


def test_empty_table(docs):
    assert scan_licenses(docs("a").filter("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("gnu general public license apache cc by mit x the".split()), max_size=30))
def test_index_finds_every_phrase(words):
    index = RareWordIndex([*BASE, *NOTICES], {b"license": 0.1, b"gnu": 3.0})
    found = index.places([w.encode() for w in words])
    mine = sorted(s for t, s in found if index.templates[t].base)
    assert len(mine) == brute(" ".join(words))[1]
