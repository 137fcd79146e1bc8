import re

import pytest
from pyspark.sql import functions as F

from siteweave.llm import decontaminate as D
from .conftest import by_id
from .test_license_scan import WORD, lower_az

ITEM = "item_id long, text string"


def brute(docs, items, size=13, share=20):
    wins = []
    for i, t in items:
        w = WORD.findall(lower_az(t))
        if w and i is not None:
            wins += [(i, w[k : k + size]) for k in range(max(1, len(w) - size + 1))]
    out = []
    for i, t in docs:
        w = WORD.findall(lower_az(t))
        hit, named = set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    named.add(str(item))
        out.append((i, len(w), len(hit), tuple(sorted(named)), bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in df.collect()), key=str)


q = [f"q{k}" for k in range(30)]
DOCS = [
    None, "", "?!", " ".join(q), "x " * 300 + " ".join(q[:13]), " ".join(q[:12]), "Short; ANSWER here", "short answerhere", "short answer",
    " ".join(["a"] * 40), "pre " + ", ".join(q[3:17]).upper() + "! post " + " ".join(q[10:25]), "é" * 5 + " " + " ".join(q[:14]),
    " ".join(f"u{k}" for k in range(30_000)) + " " + " ".join(q),
]
ITEMS = [(1, " ".join(q)), (10, " ".join(q[5:])), (2, "short answer"), (2, "short answer"), (3, None), (4, "!!"), (None, "x x"), (5, " ".join(["a"] * 20))]


@pytest.mark.parametrize("block", [D.BLOCK_CHARS, 300])
def test_flags_equal_brute_force(spark, docs, clashing, block):
    rows = [*enumerate(DOCS), (3, DOCS[3]), (3, DOCS[5]), (None, DOCS[6])]
    table = clashing(docs(*rows), "items", "spans", "n_hit", "text_hash", "item", "block", "copies")
    items = clashing(spark.createDataFrame(ITEMS, ITEM), "window", "block")
    found = D.contamination(table, items, block_chars=block)
    assert result(found) == brute(rows, ITEMS)


@pytest.mark.parametrize("block", [D.BLOCK_CHARS, 400])
def test_a_prompt_that_a_third_of_the_items_share(spark, docs, monkeypatch, block):
    """Its windows name all those items; they are sent in parts, over several passes."""
    monkeypatch.setattr(D, "PART_ITEMS", 7)
    prompt = " ".join(f"p{k}" for k in range(15))
    items = [(k, f"{prompt} own{k} " + " ".join(f"i{k}w{j}" for j in range(14))) if k % 3 == 0 else (k, " ".join(f"i{k}w{j}" for j in range(16))) for k in range(90)]
    rows = list(enumerate([prompt, f"a b {prompt} own9 i9w0", items[1][1], items[3][1] + " x " + items[4][1], "clean"]))
    found = D.contamination(docs(*rows), spark.createDataFrame(items, ITEM), block_chars=block)
    assert result(found) == brute(rows, items)


def test_spans_point_into_the_text_as_it_was(spark, docs):
    text = "Né, " + "; ".join(q[:15]).upper() + "."
    row = D.contamination(docs(text), spark.createDataFrame([(1, " ".join(q[:15]))], ITEM)).first()
    [span] = row["spans"]
    assert (span["first"], span["last"]) == (1, 15)
    assert text[span["start"] : span["stop"]] == "; ".join(q[:15]).upper()


def test_drop_keeps_clean_rows_and_columns(spark, docs, clashing):
    rows = [(1, "clean text"), (2, " ".join(q)), (2, "clean too"), (None, " ".join(q)), (4, None)]
    table = clashing(docs(*rows), "_gone", "_hash", "text_hash")
    kept = D.drop_contaminated(table, spark.createDataFrame(ITEMS, ITEM))
    assert kept.columns == table.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.filter(F.col("text").isNotNull()).collect()) == [(1, "clean text"), (2, "clean too")]
    assert kept.count() == 3


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], ITEM)
    assert D.contamination(docs("a").filter("false"), spark.createDataFrame(ITEMS, ITEM)).count() == 0
    assert result(D.contamination(docs("a b"), none)) == [(0, 2, 0, (), False)]


def test_words_of_bytes_and_of_characters_agree():
    text = "ÀB c_d 1É x\x7fy\x80z"
    from siteweave.llm.common import cut_words

    assert [w.decode() for w in cut_words(text.encode())] == re.findall(WORD, lower_az(text))
