"""Benchmark decontamination: one automaton over normalised items, one scan of every text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import as_bytes, cut_words, map_batches, slices

#: Windows whose automaton is sent to the executors at once, in characters of normalised text. An automaton takes about
#: 70 bytes a character, so this bounds a worker's share at some 150 MB.
BLOCK_CHARS = 2 << 20

#: Items that one window names at once.
PART_ITEMS = 1 << 10

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SPAN = "struct<first:long,last:long,start:long,stop:long>"


def item_windows(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``window, items``: each run of ``size`` consecutive words of an item, or the whole shorter item, with its items.

    Items without words and items without id give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for item, text in zip(part.column("item").to_pylist(), as_bytes(part.column("text")), strict=True):
                words = cut_words(text)
                if words:
                    rows += {(item, b" ".join(words[i : i + size])) for i in range(max(1, len(words) - size + 1))}
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["item", "window"]
            )

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    windows = map_batches(items.filter(F.col("item").isNotNull()), run, "item string, window binary")
    return windows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


_BUILT: list = [None, None]


def _automaton(sent: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a broadcast block, built once in each worker."""
    if _BUILT[0] is not sent.value:
        found = ahocorasick.Automaton()
        for window, items in sent.value:
            word = f" {window.decode('latin-1')} "
            before = found.get(word, (0, []))[1]  # a window may come in several parts
            found.add_word(word, (window.count(b" ") + 1, before + items))
        if len(found):
            found.make_automaton()
        _BUILT[:] = sent.value, found
    return _BUILT[1]


def scan_text(words: list[bytes], found: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged runs (first and last word) inside occurrences of windows, and the items that they belong to."""
    if not words or not len(found):
        return [], set()
    text = f" {b' '.join(words).decode('latin-1')} "
    hits = list(found.iter(text))
    if not hits:
        return [], set()
    blanks = np.flatnonzero(np.frombuffer(text.encode("latin-1"), dtype=np.uint8) == 32)
    ends = np.searchsorted(blanks, [end for end, _ in hits])
    runs: list[list[int]] = []
    for first, last in sorted((int(e) - n, int(e) - 1) for e, (_, (n, _)) in zip(ends, hits, strict=True)):
        if runs and first <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    return [(a, b) for a, b in runs], {item for _, (_, items) in hits for item in items}


def original_spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words with their place in the text as it was, in characters."""
    if not runs:
        return []
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    chars = lambda byte: len(text[:byte].decode("utf-8"))
    return [{"first": a, "last": b, "start": chars(places[a][0]), "stop": chars(places[b][1])} for a, b in runs]


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 13,
    share: int = 20,
    block_chars: int = BLOCK_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``id, text_hash, n_words, n_hit, items, spans, contaminated`` for every document.

    Texts and items are lowered (A-Z) and cut into words. A word inside any
    occurrence of a window of an item is hit; a document is contaminated when
    ``n_hit > 0`` and ``share * n_hit >= n_words``. Spans give hit runs as words
    and as characters of the text as it was.

    The windows and the ids of their items go to the executors in blocks of about
    ``block_chars`` characters, one automaton each: one block for a usual benchmark, so texts are
    read once by a map; a larger benchmark takes a further pass per block, whose
    hits are merged per text. No document is shuffled with its text.

    Null and empty texts have no words. Items of fewer words than a window are one
    window; items without words or id match nothing. Repeated documents are judged
    each, repeated items count once. Only the named columns are read. Without
    documents there are no rows, without items nothing is hit.
    """
    spark = documents.sparkSession
    windows = item_windows(benchmark, window, item_col, item_text_col)
    # a window that very many items share comes in parts, so that what is sent stays bounded whatever is shared
    parts = F.sequence(F.lit(1), F.size("items"), F.lit(PART_ITEMS))
    windows = windows.select("window", F.explode(F.transform(parts, lambda p: F.slice("items", p, PART_ITEMS))).alias("items"))
    size = F.length("window") + 2 + F.aggregate("items", F.lit(0), lambda n, item: n + F.octet_length(item) + 1)
    total = windows.agg(F.sum(size).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_chars))
    if blocks > 1:
        windows = cut(windows.withColumn("block", F.pmod(F.xxhash64("window", "items"), F.lit(blocks))))
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.select("*", F.xxhash64("text").alias("text_hash"))
    kind = texts.schema["_id"].dataType.simpleString()

    def one_pass(block: DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast([(bytes(r["window"]), list(r["items"])) for r in block.select("window", "items").collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _automaton(sent)
            span = pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "stop")])
            for part in slices(batches):
                n_words, items, spans = [], [], []
                for text in as_bytes(part.column("text")):
                    words = cut_words(text)
                    runs, hit = scan_text(words, found)
                    n_words.append(len(words))
                    items.append(sorted(hit))
                    spans.append(original_spans(text, runs))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"),
                        part.column("text_hash"),
                        pa.array(n_words, pa.int64()),
                        pa.array(items, pa.list_(pa.string())),
                        pa.array(spans, pa.list_(span)),
                    ],
                    names=["_id", "text_hash", "n_words", "items", "spans"],
                )

        return map_batches(texts, run, f"_id {kind}, text_hash long, n_words long, items array<string>, spans array<{SPAN}>")

    if blocks == 1:
        found = one_pass(windows)
    else:
        passes = [one_pass(windows.filter(F.col("block") == b)).withColumn("block", F.lit(b)) for b in range(blocks)]
        merged = reduce(DataFrame.unionByName, passes).groupBy("_id", "text_hash")
        found = merged.agg(
            F.sum((F.col("block") == 0).cast("int")).alias("copies"),
            F.max("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        )
        found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "_copy")
    found = found.withColumn("n_hit", covered_words("spans"))
    contaminated = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return found.select(
        F.col("_id").alias(id_col), "text_hash", "n_words", "n_hit", "items", "spans", contaminated.alias("contaminated")
    )


def covered_words(spans: str) -> Column:
    """Number of words in the union of sorted runs, which may overlap."""
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, s: Column) -> Column:
        fresh = F.greatest(s["last"] - F.greatest(s["first"] - 1, acc["end"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], s["last"]).alias("end"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """Documents without the contaminated ones, all columns kept.

    The flags are written once; what is dropped goes by id and text, so of two rows with one id only the
    contaminated one leaves.
    """
    id_col, text_col = kw.get("id_col", "doc_id"), kw.get("text_col", "text")
    flags = contamination(documents, benchmark, **kw).filter("contaminated")
    gone = cut(flags.select(F.col(id_col).alias("_gone"), F.col("text_hash").alias("_hash")).distinct())
    same = documents[id_col].eqNullSafe(gone["_gone"]) & (F.xxhash64(documents[text_col].cast("string")) == gone["_hash"])
    return documents.join(gone, same, "left_anti")


def contamination_sql(window: int = 13, share: int = 20) -> str:
    """DuckDB SQL with the digest of every document."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = (
        f"list_filter(string_split(regexp_replace(translate(coalesce(text, ''), '{upper}', '{low}'), "
        "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda w: w <> '')"
    )
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), {window}) AS n, array_to_string(list_slice(w, i, i + least(len(w), {window}) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {window} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
placed AS (
  SELECT row_no, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n)),
hit AS (SELECT row_no, i, placed.n, item_id FROM placed JOIN win ON placed.g = win.g AND placed.n = win.n),
covered AS (SELECT row_no, count(*) AS n_hit FROM (SELECT DISTINCT row_no, unnest(range(i, i + n)) AS k FROM hit) GROUP BY row_no),
named AS (
  SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row_no, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {share} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (row_no) LEFT JOIN named USING (row_no)"""
