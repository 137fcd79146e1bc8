import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siteweave.llm import packing as P

PATH = public_tokenizers.path(P.TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_equal_the_library_over_all_code_points(library):
    encode = P.token_ids(PATH)
    assert encode.fast is not None
    points = [*range(0xD800), *range(0xE000, 0x11000), *range(0x1F300, 0x1F700)]
    texts = [f"a{c}b {c}{c} 1{c}2  {c}'s{c}\n{c}  {c}x ,{c}. {c}" for c in map(chr, points)]
    assert [encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    special = "a<|endoftext|> b <|endoftext|>"
    assert encode(special) == library.encode(special, add_special_tokens=False).ids and 50256 in encode(special)


def test_pieces_equal_the_library_and_fill_sequences(docs, library, clashing):
    texts = [None, "", "short", "word " * 9000, "one two " * 700, "x" * 30_000, "<|endoftext|>", *(f"text {k} " * (k % 60) for k in range(300)), (2, "short")]
    rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
    table = clashing(docs(*texts), "piece", "start", "length", "_group", "offset")
    out = P.pack_documents(table, group=120).toPandas()
    expected = []
    for i, t in rows:
        ids = np.array(ids_of(library, t), dtype="<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids), 2048), len(ids)] if first < len(ids) else [0, len(ids)]
        expected += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)
    assert sorted(got) == sorted(expected)
    for _, bin_ in out.sort_values("offset").groupby("sequence_id"):
        assert bin_["length"].sum() <= 2048
        assert list(bin_["offset"]) == list(bin_["length"].cumsum() - bin_["length"])


def test_ids_are_kept_on_demand(docs, library):
    [row] = P.tokenised_pieces(docs("some text"), keep_ids=True).collect()
    assert row["ids"] == ids_of(library, "some text")


def test_empty_table(docs):
    assert P.pack_documents(docs("a").filter("false")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_rule_places_every_item_as_stated(lengths):
    """Against a plain statement of the rule with bins in a list."""
    lengths = sorted(lengths, reverse=True)
    bins, offsets = P.sum_of_squares(np.array(lengths, dtype=np.int64), 40)
    fill = []
    for n, b, at in zip(lengths, bins, offsets, strict=True):
        counts = np.bincount([40 - f for f in fill if f < 40], minlength=41)
        costs = {}
        for gap in {40 - f for f in fill if 40 - f >= n}:
            after = counts.copy()
            after[gap] -= 1
            if gap > n:
                after[gap - n] += 1
            costs[gap] = int((after[1:] ** 2).sum())
        costs.pop(0, None)
        if costs:
            best = min(costs, key=lambda g: (costs[g], g))
            assert 40 - fill[b] == best
        else:
            assert b == len(fill)
            fill.append(0)
        assert at == fill[b]
        fill[b] += n
    assert all(f <= 40 for f in fill)


def test_packs_close_to_the_bound():
    lengths = np.sort(np.random.default_rng(3).integers(1, 2049, 20_000))[::-1]
    bins, _ = P.sum_of_squares(lengths, 2048)
    assert bins.max() + 1 <= 1.01 * lengths.sum() / 2048


def test_repeated_rows_are_spread_over_groups(spark):
    """A third and more of all pieces are one row over and over: groups stay near their size."""
    rows = [(None, 0, 0, 1, 7)] * 3_000 + [(k, 0, 0, 1 + k % 9, k) for k in range(3_000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = P.pack_pieces(pieces, capacity=16, group=500).collect()
    sizes = Counter(r.sequence_id >> 32 for r in packed)
    assert len(packed) == 6_000 and len(sizes) == 12 and max(sizes.values()) < 1_000
