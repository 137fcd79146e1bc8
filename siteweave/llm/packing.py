"""Packing of documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import cut
from .common import importable, map_batches, slices

TOKENIZER = "byte_bpe_50k.json"


class TokenIds:
    """Ids as ``tokenizers`` gives them for a byte-level BPE file without added special tokens.

    The file's vocabulary is in merge order, so ``tiktoken`` gives the same ids
    from it some four times faster (a test compares the two over all code points).
    Texts that hold an added token's string, and files of another kind, go through
    ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = self._ranked(spec)

    def _ranked(self, spec: dict) -> tiktoken.Encoding | None:
        split = spec.get("pre_tokenizer") or {}
        vocab = spec["model"].get("vocab")
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if spec["model"].get("type") != "BPE" or spec.get("normalizer") or not plain:
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable}
        letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in self.added}
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        in_order = all(vocab[m.replace(" ", "")] == 256 + k for k, m in enumerate(merges))
        if not in_order or len(ranks) != 256 + len(merges):
            return None
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(t in text for t in self.added):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens: full ones, of which only the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised_pieces(
    documents: DataFrame,
    *,
    tokenizer: str | None = None,
    capacity: int = 2048,
    end_id: int = 0,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` (and ``ids``) of every piece of every text; a map."""
    path = tokenizer or TOKENIZER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(path if "/" in path else public_tokenizers.path(path))
        for part in slices(batches):
            at, rows = [], []
            for k, text in enumerate(part.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                for piece, (start, length) in enumerate(cut_pieces(len(ids), capacity)):
                    own = ids[start : start + length]
                    at.append(k)
                    rows.append((piece, start, length, zlib.crc32(own.tobytes()), own if keep_ids else None))
            columns = [part.column("_id").take(pa.array(at, pa.int64()))]
            columns += [pa.array([r[0] for r in rows], pa.int32())]
            columns += [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)]
            if keep_ids:
                columns.append(pa.array([r[4] for r in rows], pa.list_(pa.int64())))
            names = ["_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["_id"].dataType.simpleString()
    more = ", ids array<long>" if keep_ids else ""
    return map_batches(texts, run, f"_id {kind}, piece int, start long, length long, ids_crc32 long{more}")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the order given (longest first packs best).

    ``open_bins[g]`` counts open bins with ``g`` tokens left. An item goes into an
    open bin, of the gap that makes the sum of the squared counts smallest: the
    count of that gap falls as the count of what stays rises. Ties take the
    smallest gap. A new bin opens only where no open bin has room.
    """
    open_bins = np.zeros(capacity + 1, dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    no_room = np.iinfo(np.int64).max
    for k, n in enumerate(lengths):
        n = int(n)
        # twice (bins of the new gap - bins of the old gap + 1); a filled bin leaves no gap to count
        growth = 2 * (open_bins[: capacity - n + 1] - open_bins[n:] + 1)
        growth[0] -= 1
        growth[open_bins[n:] == 0] = no_room
        best = int(growth.argmin())
        if growth[best] < no_room:
            gap = best + n
            bin_no = waiting[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, bin_no = capacity, len(fill)
            fill.append(0)
        bins[k], offsets[k] = bin_no, fill[bin_no]
        fill[bin_no] += n
        if gap > n:
            open_bins[gap - n] += 1
            waiting[gap - n].append(bin_no)
    return bins, offsets


def pack_pieces(pieces: DataFrame, *, capacity: int = 2048, group: int = 40_000, id_col: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id, offset`` to pieces of at most ``capacity`` tokens.

    Pieces are dealt by the hash of a running number of their written rows into
    groups of about ``group``, so that a group fits a task whatever the number of
    pieces and however often one is repeated; each is packed by itself and leaves a
    few unfilled bins in tens of thousands.
    """
    pieces = cut(pieces)
    groups = max(1, -(-pieces.count() // group))
    numbered = pieces.withColumn("_group", F.monotonically_increasing_id())
    dealt = numbered.withColumn("_group", F.pmod(F.xxhash64("_group"), F.lit(groups)))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long"

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["_group"].iloc[0])
        rows = packing_order(rows.drop(columns="_group"), id_col)
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(number << 32) + bins, offset=offsets)

    importable(pieces.sparkSession)
    return dealt.groupBy("_group").applyInPandas(pack, schema)


def packing_order(rows: pd.DataFrame, id_col: str) -> pd.DataFrame:
    return rows.sort_values(["length", id_col, "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")


def pack_documents(documents: DataFrame, *, capacity: int = 2048, group: int = 40_000, **kw) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset``: every piece of every document and its place.

    A document is its ids and ``end_id``. Only longer ones than ``capacity`` are
    cut, into full pieces of which the first may be shorter. Tokens are made once
    and written without their ids (``keep_ids`` keeps them); what is dealt into
    groups is a few numbers a piece.

    A null or empty text is the end id alone. Repeated documents are packed each.
    Only id and text are read. An empty table gives no rows.
    """
    pieces = tokenised_pieces(documents, capacity=capacity, **kw)
    return pack_pieces(pieces, capacity=capacity, group=group, id_col="_id").withColumnRenamed("_id", kw.get("id_col", "doc_id"))
