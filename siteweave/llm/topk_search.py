"""Exact top-k inner-product search by term-at-a-time accumulation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .common import map_batches

#: Rows of a block of candidates and of queries: a block of scores is what one task holds.
CANDIDATE_BLOCK, QUERY_BLOCK = 8_192, 512
#: Queries that are scored together: their score arrays stay in the processor's cache.
STEP = 16


def whole_weights(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def is_finite(vector: Column) -> Column:
    """False for null vectors and for null, infinite or not-a-number components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: bad(x.cast("double"))), F.lit(True))


def postings(weights: list[np.ndarray]) -> list[tuple[int, np.ndarray | None, np.ndarray]]:
    """Per term with a weight in the block: term, rows, weights; ``None`` as rows where most rows have the term."""
    width = max((len(w) for w in weights), default=0)
    dense = np.zeros((width, len(weights)), dtype=np.int64)
    for row, w in enumerate(weights):
        dense[: len(w), row] = w
    if dense.size and np.abs(dense).max() < 1 << 10 and width < 1 << 10:
        dense = dense.astype(np.int32)
    out = []
    for term in range(width):
        rows = np.flatnonzero(dense[term])
        if 2 * len(rows) > len(weights):
            out.append((term, None, dense[term].copy()))
        elif len(rows):
            out.append((term, rows, dense[term, rows]))
    return out


def accumulate(queries: np.ndarray, terms: list, n_rows: int) -> np.ndarray:
    """Scores of ``queries`` (rows) against the rows of a block, one term after the other."""
    narrow = all(values.dtype == np.int32 for _, _, values in terms) and (not queries.size or np.abs(queries).max() < 1 << 10)
    kind = np.int32 if narrow else np.int64
    queries = queries.astype(kind)
    scores = np.zeros((len(queries), n_rows), dtype=kind)
    product = np.empty_like(scores)
    for term, rows, values in terms:
        if term >= queries.shape[1]:
            break
        weight = queries[:, term]
        if not weight.any():
            continue
        if rows is None:
            np.multiply(weight[:, None], values.astype(kind, copy=False), out=product)
            scores += product
        else:
            scores[:, rows] += weight[:, None] * values.astype(kind, copy=False)
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of one score array: partition by score, then order by score and id; ``own`` is left out."""
    if own is None:
        rows = np.arange(len(scores))
    else:
        rows = np.flatnonzero(ids != own)
        scores = scores[rows]
    if len(scores) > k:
        cut_at = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut_at)
        rows, scores = rows[keep], scores[keep]
    order = np.lexsort((ids[rows], -scores.astype(np.int64)))[:k]
    return ids[rows[order]], scores[order]


def exact_top_k(
    vectors: DataFrame,
    *,
    k: int = 20,
    every: int = 20,
    scale: int = 64,
    candidate_block: int = CANDIDATE_BLOCK,
    query_block: int = QUERY_BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` best rows for each query, by exhaustive scoring.

    Components become ``floor(scale * x)``. Queries are the rows whose id is
    divisible by ``every``; candidates all rows but those with the query's id. A
    block of candidates is turned into postings per term; each query scatters its
    weights, term by term, into a dense score array over the block, and partition
    selection keeps ``k`` rows of it. The lists of all blocks are merged per query,
    ties by smaller id.

    Rows are dealt into blocks by the hash of a running number of the written rows,
    queries by that of id and vector, of which each stands once; so blocks are bounded
    in rows however often an id is repeated. A block of candidates meets the blocks
    of queries, a stated query set, in one join, and is scored where it lies; nothing
    is broadcast. Scores are exact while they fit 64 bits.

    Rows without id, with a null vector or with a null or non-finite component
    take no part; shorter vectors count as zero beyond their end. A repeated row
    is a candidate each time, and one query. Only id and vector are read. Without
    rows there is no result.
    """
    vector = F.col(vector_col)
    given = vectors.filter(F.col(id_col).isNotNull() & is_finite(vector))
    given = cut(given.select(F.col(id_col).cast("long").alias("id"), whole_weights(vector, scale).alias("w")))
    queries = given.filter(F.col("id") % every == 0).distinct()
    sizes = given.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("id") % every == 0).cast("long")).alias("q")).first()
    n_rows, n_queries = max(1, -(-sizes["n"] // candidate_block)), max(1, -(-(sizes["q"] or 0) // query_block))

    block = lambda n, *key: F.pmod(F.xxhash64(*key), F.lit(n)).cast("long")
    packed = lambda df, key: df.groupBy(key).agg(
        F.collect_list("id").alias(f"{key}_ids"), F.collect_list("w").alias(f"{key}_weights")
    )
    numbered = given.withColumn("no", F.monotonically_increasing_id())
    rows = packed(numbered.withColumn("r", block(n_rows, "no")), "r")
    asked = packed(queries.withColumn("q", block(n_queries, "id", "w")), "q")
    everywhere = asked.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))))
    pairs = rows.join(everywhere, "r").select("r_ids", "r_weights", "q_ids", "q_weights")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from _score_blocks(*(c[row] for c in batch.columns), k).to_batches()

    scored = map_batches(pairs, run, "query_id long, id long, score long, query_no long")
    order = W.partitionBy("query_id", "query_no").orderBy(F.col("score").desc(), F.col("id"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _arrays(lists: pa.ListScalar) -> list[np.ndarray]:
    values, at = lists.values, 0
    flat, out = np.asarray(values.flatten()), []
    for n in values.value_lengths().to_pylist():
        out.append(flat[at : at + n])
        at += n
    return out


def _score_blocks(row_ids: pa.Scalar, row_weights: pa.Scalar, query_ids: pa.Scalar, query_weights: pa.Scalar, k: int) -> pa.Table:
    ids, asked = np.asarray(row_ids.values), np.asarray(query_ids.values)
    terms = postings(_arrays(row_weights))
    weights = _arrays(query_weights)
    width = max((len(w) for w in weights), default=0)
    queries = np.zeros((len(asked), width), dtype=np.int64)
    for row, w in enumerate(weights):
        queries[row, : len(w)] = w
    # queries of one id but other vectors are told apart by their weights
    numbers = [int.from_bytes(hashlib.blake2b(w.tobytes(), digest_size=8).digest(), "little", signed=True) for w in weights]
    held = set(ids.tolist())
    found: list[tuple] = []
    for start in range(0, len(asked), STEP):
        scores = accumulate(queries[start : start + STEP], terms, len(ids))
        for row, line in enumerate(scores, start):
            own = int(asked[row])
            best_ids, best_scores = best(line, ids, own if own in held else None, k)
            found.append((np.full(len(best_ids), own), best_ids, best_scores, np.full(len(best_ids), numbers[row])))
    columns = [np.concatenate([f[c] for f in found]) if found else np.empty(0) for c in range(4)]
    query, best_id, score, number = (pa.array(c.astype(np.int64)) for c in columns)
    return pa.table({"query_id": query, "id": best_id, "score": score, "query_no": number})


def top_k_sql(k: int = 20, every: int = 20, scale: int = 64) -> str:
    """DuckDB SQL over ``embeddings``."""
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT row_no, vec_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS term FROM v),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, c.row_no, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM t q JOIN t c ON q.term = c.term AND q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id
  GROUP BY q.vec_id, c.vec_id, c.row_no)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {k}"""
