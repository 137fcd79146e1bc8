"""Ranked lexical search over an index stratified by document length."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranking import running_total
from ..session import cut
from .common import WORD_TABLE, as_bytes, map_batches, slices

#: Bytes of the terms of the items that are ranked in one pass; a longer item is a pass of its own.
BLOCK_BYTES = 2 << 20

#: Documents of a part of the index, and the documents and postings that are searched at once inside it.
PART_ROWS, CHUNK_ROWS, CHUNK_POSTINGS = 1 << 14, 1 << 16, 1 << 21

#: Documents of an item's first visit; each further visit takes twice as many.
FIRST_VISIT = 1_024

#: Bytes of a text that are cut into words at once.
RUN_BYTES = 1 << 20


def word_runs(text: bytes, step: int = RUN_BYTES) -> Iterator[list[bytes]]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lowered, a run of the text at a time."""
    text, start = text.translate(WORD_TABLE), 0
    while start < len(text):
        stop = text.find(b" ", start + step)
        stop = len(text) if stop < 0 else stop
        yield text[start:stop].split()
        start = stop


def count_terms(text: bytes, number: dict[bytes, int]) -> tuple[int, Counter]:
    """Number of all terms of a text, and the counts of those that are in ``number``."""
    n, counts = 0, Counter()
    for words in word_runs(text):
        n += len(words)
        counts.update(map(number.get, words))
    counts.pop(None, None)
    return n, counts


def forward_index(documents: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``id, n, terms, tfs``: a document's length and its counts of the numbered terms, in the order of their numbers."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counted = [count_terms(text, shared.value) for text in as_bytes(part.column("text"))]
            found = [sorted(c.items()) for _, c in counted]
            at = np.concatenate([[0], np.cumsum([len(f) for f in found], dtype=np.int64)]).astype(np.int32)
            flat = np.array([pair for f in found for pair in f], dtype=np.int32).reshape(-1, 2)
            lists = [pa.ListArray.from_arrays(at, np.ascontiguousarray(flat[:, k])) for k in (0, 1)]
            lengths = pa.array([n for n, _ in counted], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), lengths, *lists], names=["id", "n", "terms", "tfs"])

    slim = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(slim, run, "id long, n long, terms array<int>, tfs array<int>")


@dataclass
class Item:
    """A query: its distinct terms by number, how often each stands in it, and the best documents so far."""

    number: int
    terms: np.ndarray
    repeats: np.ndarray
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    scores: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))

    def least(self, k: int) -> int:
        """Score that a document must reach to enter the list."""
        return int(self.scores[-1]) if len(self.scores) >= k else 1

    def offer(self, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        best = np.lexsort((ids, -scores))[:k]
        self.ids, self.scores = ids[best], scores[best]


@dataclass
class Strata:
    """Postings of some documents, by term, then stratum (equal ``m``), then ``tf``; documents are numbered stratum by stratum."""

    ids: np.ndarray
    starts: np.ndarray  # first document of each stratum, and the number of documents
    term_at: dict[int, tuple[int, int]]  # term: its runs in the arrays below
    run_stratum: np.ndarray  # a run: postings of one term in one stratum
    run_start: np.ndarray  # first posting of each run, and the number of postings
    run_best: np.ndarray  # largest share of a document's score in the run
    doc: np.ndarray
    share: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weight: np.ndarray) -> Strata:
        order = np.argsort(m, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        norms, starts, counts = np.unique(m[order], return_index=True, return_counts=True)
        doc = np.repeat(place, sizes)
        stratum = np.repeat(np.arange(len(norms)), counts)[doc]
        # an impact is computed once for every tf of a stratum
        kinds, kind = np.unique(stratum * (int(tfs.max(initial=0)) + 1) + tfs, return_inverse=True)
        tf_of, m_of = kinds % (int(tfs.max(initial=0)) + 1), norms[kinds // (int(tfs.max(initial=0)) + 1)]
        impact = (1_000_000_000 * tf_of) // (1000 * tf_of + 12 * m_of)
        order_of = np.lexsort((kind, terms))  # kinds are numbered by stratum, then tf
        doc, terms, stratum, share = doc[order_of], terms[order_of], stratum[order_of], (weight[terms] * impact[kind])[order_of]
        new = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (stratum[1:] != stratum[:-1])])) if len(terms) else np.empty(0, dtype=np.int64)
        first = np.flatnonzero(np.concatenate([[True], terms[new][1:] != terms[new][:-1]])) if len(new) else np.empty(0, dtype=np.int64)
        ends = np.append(first[1:], len(new))
        return cls(
            ids[order],
            np.append(starts, len(ids)),
            {int(t): (int(a), int(b)) for t, a, b in zip(terms[new][first], first, ends, strict=True)},
            stratum[new],
            np.append(new, len(terms)),
            np.maximum.reduceat(share, new) if len(new) else np.empty(0, dtype=np.int64),
            doc,
            share,
        )

    def search(self, item: Item, scores: np.ndarray, k: int) -> int:
        """Visits strata in the order of their bounds until no other can hold a better document; returns documents visited.

        ``scores``: zeros, one a document; zeros again afterwards. A stratum whose
        bound equals the least score of the list is visited: equal scores go by id.
        """
        bounds = np.zeros(len(self.starts) - 1, dtype=np.int64)
        known = [(*self.term_at[t], r) for t, r in zip(item.terms.tolist(), item.repeats.tolist(), strict=True) if t in self.term_at]
        for a, b, repeats in known:
            bounds[self.run_stratum[a:b]] += repeats * self.run_best[a:b]
        order = np.argsort(-bounds, kind="stable")
        held = np.cumsum(np.diff(self.starts)[order])
        falling = -bounds[order]
        at, want, seen = 0, FIRST_VISIT, 0
        while at < len(order):
            stop = int(np.searchsorted(falling, -item.least(k), side="right"))  # strata that may still enter
            if at >= stop:
                break
            upto = min(stop, int(np.searchsorted(held, (held[at - 1] if at else 0) + want)) + 1)
            visit = np.sort(order[at:upto])
            breaks = np.flatnonzero(np.diff(visit) > 1)
            lows, highs = visit[np.append(0, breaks + 1)], visit[np.append(breaks, len(visit) - 1)] + 1
            for a, b, repeats in known:
                runs = self.run_stratum[a:b]
                firsts, lasts = self.run_start[a + np.searchsorted(runs, lows)], self.run_start[a + np.searchsorted(runs, highs)]
                for p, q in zip(firsts.tolist(), lasts.tolist(), strict=True):
                    if p < q:
                        scores[self.doc[p:q]] += repeats * self.share[p:q]
            for low, high in zip(self.starts[lows].tolist(), self.starts[highs].tolist(), strict=True):
                line = scores[low:high]
                rows = np.flatnonzero(line >= item.least(k))
                item.offer(self.ids[low:high][rows], line[rows], k)
                line[:] = 0
                seen += high - low
            at, want = upto, 2 * want
        return seen


def search_part(batches: Iterator[pa.RecordBatch], weight: np.ndarray, items: list[Item], k: int) -> list[Item]:
    """Lists of all ``items`` over the rows ``id, m, terms, tfs`` of one part of the index, a chunk of rows at a time."""

    def chunks() -> Iterator[list[pa.RecordBatch]]:
        held, rows, postings = [], 0, 0
        for batch in batches:
            if held and (rows + batch.num_rows > CHUNK_ROWS or postings + len(batch.column("terms").flatten()) > CHUNK_POSTINGS):
                yield held
                held, rows, postings = [], 0, 0
            held.append(batch)
            rows, postings = rows + batch.num_rows, postings + len(batch.column("terms").flatten())
        if held:
            yield held

    for held in chunks():
        rows = pa.Table.from_batches(held).combine_chunks()
        flat = {c: np.asarray(pa.concat_arrays([x.flatten() for x in rows.column(c).chunks])).astype(np.int64) for c in ("terms", "tfs")}
        sizes = np.asarray(rows.column("terms").combine_chunks().value_lengths()).astype(np.int64)
        strata = Strata.build(np.asarray(rows.column("id")), np.asarray(rows.column("m")), sizes, flat["terms"], flat["tfs"], weight)
        scores = np.zeros(rows.num_rows, dtype=np.int64)
        for item in items:
            strata.search(item, scores, k)
    return items


def ranked_search(
    documents: DataFrame,
    items: DataFrame,
    *,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id, rank, id, score``: the ``k`` best documents for each item, equal scores by ascending id.

    A term's weight is ``floor(1000 * ln((2N + 2) / (2df + 1)))``, a document's ``m``
    is ``75 + (25 * n * N) div L``; a score sums ``weight * ((10**9 * tf) div
    (1000 * tf + 12 * m))`` over the item's terms with repeats. N: documents with a
    term; L: all their terms; n: those of the document; df: documents with the term.

    One pass reads the documents and keeps their lengths and their counts of the
    items' terms. The other terms take no part in any score and are not indexed;
    the numbers N, L and df are of all documents. These rows are dealt into parts by
    a running number, of a bounded number of rows each, and grouped by equal ``m``
    inside the part: a hot ``m`` is in every part. A task turns chunks of its part
    into postings by term, stratum and tf, computes each impact once for a tf of a
    stratum, and visits, for each item, the strata in the order of their bounds
    until none can enter its list; that test is exact. Lists of all parts are
    merged per item.

    Items are a stated query set. They are ranked in blocks whose terms have
    ``block_bytes`` at most (or one longer item), which bounds what the driver
    collects and broadcasts; each block is a pass over the documents.

    Null texts have no terms; documents without terms count nowhere. Documents
    without id count in N, L and df and are not returned. Repeated documents are
    ranked each; equal rows of ``items`` count once, items of one id with other
    texts are ranked each for itself. Items without terms and empty tables give no
    rows. Only ids and texts are read.
    """
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).filter(F.length("text") > 0).distinct()
    asked = asked.withColumn("bytes", F.octet_length("text").cast("long"))
    asked = cut(running_total(asked, ["item_id", "text"], "bytes", [], "start"))
    asked = cut(asked.select("item_id", "text", F.expr(f"start div {block_bytes}").alias("block"), F.monotonically_increasing_id().alias("item_no")))
    found = [_ranked_block(documents, asked.filter(F.col("block") == r["block"]), k, id_col, text_col) for r in asked.select("block").distinct().sort("block").toLocalIterator()]
    kind = items.schema[item_id].dataType.simpleString()
    if not found:
        found = [documents.sparkSession.createDataFrame([], "item_no long, id long, score long")]
    lists = found[0]
    for other in found[1:]:
        lists = lists.unionByName(other)
    best = W.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("id"))
    ranked = lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    named = ranked.join(asked.select("item_no", "item_id"), "item_no")
    return named.select(F.col("item_id").cast(kind).alias(item_id), "rank", F.col("id").alias(id_col), "score")


def _ranked_block(documents: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``item_no, id, score`` of one block of items: the best ``k`` of every part."""
    rows = [(r["item_no"], Counter(w for run in word_runs(r["text"].encode()) for w in run)) for r in asked.select("item_no", "text").toLocalIterator()]
    number = {term: n for n, term in enumerate(sorted(set().union(*(c for _, c in rows))))}
    spark = documents.sparkSession
    index = cut(forward_index(documents, number, id_col, text_col).withColumn("no", F.monotonically_increasing_id()))
    n_docs, n_terms, n_rows = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    df = np.zeros(len(number), dtype=np.int64)
    for term, n in index.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    asked_terms = [(no, np.array([number[t] for t in c], dtype=np.int64), np.array(list(c.values()), dtype=np.int64)) for no, c in rows]
    shared = spark.sparkContext.broadcast((weight, asked_terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, given = shared.value
        for item in search_part(batches, weights, [Item(*x) for x in given], k):
            columns = np.full(len(item.ids), item.number), item.ids, item.scores
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["item_no", "id", "score"])

    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-n_rows // CHUNK_ROWS), min(slots, -(-n_rows // PART_ROWS)))
    norm = F.expr(f"75 + (25 * n * {n_docs}L) div {max(n_terms, 1)}L")
    held = index.filter((F.size("terms") > 0) & F.col("id").isNotNull()).select("id", norm.alias("m"), "terms", "tfs", "no")
    dealt = held.repartition(parts, "no").sortWithinPartitions("m").drop("no")
    return map_batches(dealt, run, "item_no long, id long, score long")


def search_sql(k: int = 20) -> str:
    """DuckDB SQL over ``documents`` and ``benchmark``."""
    terms = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc_no, doc_id, {terms.format("text")} AS ws FROM documents),
t AS (SELECT doc_no, doc_id, len(ws) AS n, unnest(ws) AS term FROM d),
tf AS (SELECT doc_no, doc_id, n, term, count(*) AS tf FROM t GROUP BY doc_no, doc_id, n, term),
g AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, sum(len(ws)) AS n_terms FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY term, n_docs),
i AS (SELECT row_number() OVER () AS item_no, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_no, item_id, unnest({terms.format("text")}) AS term FROM i),
qn AS (SELECT item_no, item_id, term, count(*) AS r FROM q GROUP BY item_no, item_id, term),
s AS (
  SELECT item_no, item_id, doc_no, doc_id,
    CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + CAST((25 * n * n_docs) // n_terms AS BIGINT))))) AS BIGINT) AS score
  FROM qn JOIN tf USING (term) JOIN w USING (term), g
  WHERE doc_id IS NOT NULL GROUP BY item_no, item_id, doc_no, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= {k}"""
