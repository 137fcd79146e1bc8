"""Token counts of whole texts; huge texts by overlapping chunks spliced at proven boundaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices

MODEL = "piece_bpe_32k.model"
SPACE = "▁"


class PieceCounter:
    """Counts the pieces that a sentencepiece BPE model gives for a text.

    A merge makes a piece of the vocabulary, so no merge crosses two neighbouring
    characters that stand side by side in no piece. Such a place is a proven
    boundary: the pieces left and right of it do not depend on one another, and
    every encoding of a stretch around it splits there.
    """

    def __init__(self, path: str, chunk: int, overlap: int):
        if not 0 < overlap < chunk:
            raise ValueError("the overlap must be shorter than the chunk")
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        self.neighbours = set()
        for i in range(self.model.get_piece_size()):
            if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i)):
                piece = self.model.id_to_piece(i)
                self.neighbours.update(zip(piece, piece[1:], strict=False))

    def stable(self, text: str, at: int) -> bool:
        """Whether a boundary at ``at`` is proven."""
        shown = lambda c: SPACE if c == " " else c
        return (shown(text[at - 1]), shown(text[at])) not in self.neighbours

    def begins(self, text: str, start: int, stop: int) -> list[int]:
        """Places in ``text`` where the pieces of one chunk begin; bytes of one character share its place."""
        return [start + begin for begin, _ in self.model.encode(text[start:stop], return_type="offset_mapping")["offsets"]]

    def count_all(self, texts: list[str]) -> list[int]:
        counts = [len(ids) for ids in self.model.encode([t for t in texts if len(t) <= self.chunk], num_threads=1)]
        short = iter(counts)
        return [next(short) if len(t) <= self.chunk else self.count_long(t) for t in texts]

    def count_long(self, text: str) -> int:
        """Chunks with offsets, spliced at the last proven boundary that both chunks of an overlap have.

        Where an overlap has none, it is doubled to the left and both sides are
        encoded again, at worst from the last splice on. A chunk that has to reach
        further without one grows until the text ends.
        """
        total, spliced, start, stop = 0, 0, 0, min(self.chunk, len(text))
        left = self.begins(text, start, stop)
        while stop < len(text):
            overlap = self.overlap
            while True:
                next_start = max(stop - overlap, spliced)
                next_stop = min(max(next_start, stop - self.overlap) + self.chunk, len(text))
                right = self.begins(text, next_start, next_stop)
                both = set(right).intersection(left)
                at = next((p for p in range(stop - 1, next_start, -1) if p in both and self.stable(text, p)), None)
                if at is not None or next_start == spliced:
                    break
                overlap *= 2
            if at is None:
                # no boundary since the last splice: keep the whole stretch and lengthen it
                stop = min(stop + (stop - start), len(text))
                left = self.begins(text, start, stop)
                continue
            total += sum(spliced <= b < at for b in left)
            spliced, start, stop, left = at, next_start, next_stop, right
        return total + sum(b >= spliced for b in left)


@lru_cache(maxsize=2)
def piece_counter(path: str, chunk: int, overlap: int) -> PieceCounter:
    return PieceCounter(path, chunk, overlap)


def count_tokens(
    documents: DataFrame,
    *,
    model: str = MODEL,
    limit: int = 4096,
    chunk: int = 16_384,
    overlap: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every whole text; a map.

    Counts are those of the model for the whole text, without begin, end or added
    tokens. Texts of more than ``chunk`` characters are encoded in chunks of that
    size with ``overlap`` characters in common (see ``PieceCounter.count_long``).
    ``model`` is a path, or the name of a file of the public tokenizers.

    Null and empty texts have 0 tokens. Repeated documents are counted each. Only
    id and text are read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model if "/" in model else public_tokenizers.path(model), chunk, overlap)
        for part in slices(batches):
            counts = pa.array(counter.count_all([t or "" for t in part.column("text").to_pylist()]), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("n_bytes"), counts], names=["_id", "n_bytes", "n_tokens"])

    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.select("*", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = texts.schema["_id"].dataType.simpleString()
    counted = map_batches(texts, run, f"_id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
