import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from siteweave.llm.token_counts import MODEL, PieceCounter, count_tokens

PATH = public_tokenizers.path(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


SMALL = PieceCounter(PATH, 60, 6)
BITS = ["a", "b", "e", "the ", "  ", " ", "é", "ö", "\n", "</s>", "漢", "🙂", "tion", "<0x41>", "▁", "0", "="]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), min_size=30, max_size=300).map("".join) | st.text(min_size=61, max_size=400))
def test_spliced_count_equals_the_whole(text):
    assert SMALL.count_all([text]) == [len(SMALL.model.encode(text))]


@pytest.mark.parametrize("unit", ["a", " ", "0", "=", "ab", "漢", "🙂", "th"])
def test_texts_without_boundaries_widen_to_the_whole(unit):
    assert SMALL.count_long(unit * 500) == len(SMALL.model.encode(unit * 500))


def test_table_equals_the_library(spark, docs, library, clashing):
    texts = [None, "", " ", "plain text", "word " * 4096, "é" * 40_000, "x" * 20_000, "</s> <s> <unk>", ("many words. " * 6000), (3, "plain text")]
    rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
    found = count_tokens(clashing(docs(*texts), "n_bytes", "n_tokens", "over_limit")).collect()
    n = {t: len(library.encode(t or "")) for _, t in rows}
    expected = sorted((i, len((t or "").encode()), n[t], n[t] > 4096) for i, t in rows)
    assert sorted(tuple(r) for r in found) == expected
    assert count_tokens(docs("a").filter("false")).count() == 0


def test_given_table_equals_the_library(spark, small, library):
    from siteweave.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op7_token_counts"](spark, small).collect()}
    assert found == {k: len(library.encode(t or "")) for k, t in texts.items()}


def test_bad_chunks_are_refused():
    with pytest.raises(ValueError):
        PieceCounter(PATH, 10, 10)
