"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import running_total
from ..session import cut
from .common import importable

#: Words of a block, and the most blocks of a mix: with more words, blocks grow.
BLOCK_WORDS, MOST_BLOCKS = 8_192, 1 << 22

#: Numbers of a table (sources of a chunk times shards) that one split holds.
SPLIT_CELLS = 1 << 22


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def split(quotas: np.ndarray, capacities: np.ndarray, seed: Sequence[int], node: int = 1) -> np.ndarray:
    """Blocks of every source (columns) for every shard (rows): ``quotas`` dealt out to shards of ``capacities``.

    A node of the tree draws, without replacement, the blocks of its left half of
    shards from its own; the right half gets the rest. Rows sum up to the
    capacities, columns to the quotas.
    """
    if len(capacities) == 1:
        return quotas[None, :]
    half = len(capacities) // 2
    draw = np.random.default_rng([*seed, node]).multivariate_hypergeometric
    left = draw(quotas, int(capacities[:half].sum()), method="marginals")
    parts = (split(left, capacities[:half], seed, 2 * node), split(quotas - left, capacities[half:], seed, 2 * node + 1))
    return np.concatenate(parts)


def even(total: int, shards: int) -> np.ndarray:
    """``total`` as ``shards`` numbers that differ by one at most."""
    return np.full(shards, total // shards, dtype=np.int64) + (np.arange(shards) < total % shards)


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``sizes`` (source, source_size) with ``source_no``, ``weight``, ``quota`` (whole words) and ``target``.

    Sources are numbered by code point, null last; weights repeat along the
    numbers. Targets share the sum of all sizes by weight. A source stops at
    ``most`` times its size; its excess is shared again by weight among the others,
    round by round, until none is above. A round is one aggregate over the sources.
    """
    sizes = sizes.withColumn("_null", F.col("source").isNull())
    named = running_total(sizes, ["_null", "source"], F.lit(1), [], "source_no").drop("_null")
    cycle = F.array(*(F.lit(int(w)).cast("long") for w in weights))
    named = cut(named.withColumn("weight", F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int"))))
    cap = F.col("source_size") * most
    total, weight = named.agg(F.sum("source_size"), F.sum("weight")).first()
    left, stopped = total or 0, -1
    full = F.lit(False)
    while weight:
        full = cap * weight <= F.col("weight") * left
        now = named.agg(F.count_if(full).alias("n"), F.sum(F.when(full, cap)).alias("c"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if now["n"] == stopped:
            break
        stopped, left, weight = now["n"], (total or 0) - (now["c"] or 0), now["w"]
    if not weight:
        share, target = cap, cap.cast("double")
    else:
        share = F.when(full, cap).otherwise(F.expr(f"weight * {left} div {weight}"))
        target = F.when(full, cap.cast("double")).otherwise((F.col("weight") * left).cast("double") / F.lit(float(weight)))
    return named.withColumns({"quota": share.cast("long"), "target": target})


def shard_quotas(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """``source_no, shard, first, n``: each shard's run in the permuted blocks of each source.

    ``blocks``: source_no, n_blocks. Sources are taken in chunks: the tree first
    splits the chunks' totals, then, inside each chunk and independently, that
    chunk's sources among shards of the capacities it was given. This has the law
    of one split over all sources, and no step holds more than a chunk.
    """
    spark = blocks.sparkSession
    chunk = max(1, SPLIT_CELLS // shards)
    dealt = blocks.withColumn("chunk", F.expr(f"source_no div {chunk}"))
    sums = sorted(tuple(r) for r in dealt.groupBy("chunk").agg(F.sum("n_blocks")).collect())
    totals = np.array([n for _, n in sums], dtype=np.int64)
    given = split(totals, even(int(totals.sum()), shards), [seed, 0]) if len(sums) else np.zeros((shards, 0), dtype=np.int64)
    capacity = {c: given[:, k].copy() for k, (c, _) in enumerate(sums)}

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("source_no")
        number, quotas = (np.asarray(group.column(c)) for c in ("source_no", "n_blocks"))
        which = group.column("chunk")[0].as_py()
        counts = split(quotas.astype(np.int64), capacity[which], [seed, 1, which]).T  # sources, shards
        first = np.cumsum(counts, axis=1) - counts
        source, shard = np.nonzero(counts)
        columns = number[source], shard, first[source, shard], counts[source, shard]
        return pa.table({n: pa.array(np.asarray(c, dtype=np.int64)) for n, c in zip(("source_no", "shard", "first", "n"), columns, strict=True)})

    importable(spark)
    return dealt.groupBy("chunk").applyInArrow(run, "source_no long, shard long, first long, n long")


def mix_documents(
    documents: DataFrame,
    *,
    weights: Sequence[int] = (1, 2, 3),
    most: int = 3,
    shards: int = 64,
    seed: int = 13,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row for each time that the mix takes a document, and one for each document that it does not take.

    Columns: ``document_no`` (one number a document), id, source, ``size`` (words),
    ``source_size``, ``target`` and ``quota`` (words of the source, the latter
    whole), ``epoch`` (from 0), ``shard``, ``place`` (sort a shard by it to read it
    shuffled), ``length`` (words taken) and the columns ``keep``. Where nothing is
    taken, epoch, shard and place are null and length is 0.

    The documents of a source stand in the order of a checksum of seed and id; its
    words, repeated ``most`` times at most, form a stream that ends at its quota.
    Blocks of ``block_words`` cut the stream; a document belongs to the block in
    which it starts and stays whole, but for the one at the quota, of which only
    the words up to it are taken. So every source has its quota exactly. Block
    quotas are partitioned among shards by :func:`split`; each shard draws its run
    of the source's permuted blocks, so that no block is drawn twice, and ``place``
    shuffles inside the shard.

    Numbers of words and blocks are running totals over range partitions, so that
    a source with most rows is spread. Blocks grow with the input and never exceed
    ``MOST_BLOCKS``. What the driver sees: one number for a chunk of sources.

    A null or blank text has size 0 and is not taken. A null id counts as empty, a
    null source is a source of its own, the last. Repeated rows are documents of
    their own. An empty table gives no rows; further columns are not read.
    Results do not depend on the partitions, nor on the run.
    """
    text = F.col(text_col).cast("string")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    slim = documents.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"),
        key.alias("key"),
        F.xxhash64(text).alias("text_hash"),
        *(F.col(c).alias(f"_keep_{k}") for k, c in enumerate(keep)),
    )
    slim = cut(slim.withColumn("document_no", F.monotonically_increasing_id()))
    sources = cut(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    words = sources.agg(F.sum("quota")).first()[0] or 0
    per_block = max(block_words, -(-words // MOST_BLOCKS))
    blocks = sources.select("source_no", F.ceil(F.col("quota") / per_block).cast("long").alias("n_blocks")).filter("n_blocks > 0")

    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    listed = blocks.select("source_no", each(F.col("n_blocks")).alias("block"))
    listed = listed.withColumn("hash", F.xxhash64("source_no", "block", F.lit(seed)))
    permuted = running_total(listed, ["source_no", "hash", "block"], F.lit(1), ["source_no"], "rank").drop("hash")
    runs = shard_quotas(blocks, shards, seed)
    drawn = runs.select("source_no", "shard", "first", each(F.col("n")).alias("rank")).withColumn("rank", F.col("first") + F.col("rank"))
    drawn = cut(permuted.join(drawn, ["source_no", "rank"]).select("source_no", "block", "shard"))

    placed = running_total(slim, ["source", "key", "size", "text_hash"], "size", ["source"], "start")
    placed = placed.join(sources, placed["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    position = lambda e: F.col("start") + e * F.col("source_size")
    epochs = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")), lambda e: (position(e) < F.col("quota")) & (F.col("size") > 0))
    taken = placed.withColumn("epoch", F.explode_outer(epochs))
    taken = taken.withColumns(
        {
            "block": F.expr(f"(start + epoch * source_size) div {per_block}"),
            "length": F.when(F.col("epoch").isNull(), 0).otherwise(F.least("size", F.col("quota") - position(F.col("epoch")))).cast("long"),
        }
    )
    place = F.when(F.col("epoch").isNotNull(), F.xxhash64("key", "text_hash", "epoch", F.lit(seed)))
    return taken.join(drawn, ["source_no", "block"], "left").select(
        "document_no",
        F.col("_id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        "quota",
        F.col("epoch").cast("int").alias("epoch"),
        F.col("shard").cast("int").alias("shard"),
        place.alias("place"),
        "length",
        *(F.col(f"_keep_{k}").alias(c) for k, c in enumerate(keep)),
    )


def mixed_texts(mix: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: the texts taken, each shard in its own partition, shuffled; ``mix`` was made with ``keep=[text_col]``.

    Texts cut at a quota end behind their last word taken.
    """
    words = F.regexp_extract_all(text_col, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.when(F.col("length") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("length").cast("int")), "")).otherwise(F.col(text_col))
    taken = mix.filter("length > 0").withColumn(text_col, part)
    shards = int(mix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return taken.repartition(shards, "shard").sortWithinPartitions("shard", "place")


def shard_table(mix: DataFrame) -> DataFrame:
    """Words and documents of each source in each shard: how near the shards come to the mix."""
    source = [c for c in mix.columns if c == "source"]
    return mix.filter("length > 0").groupBy("shard", *source).agg(F.sum("length").alias("words"), F.count(F.lit(1)).alias("documents"))


def taken_words(mix: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document: id, size, source_size, target and ``taken``, the words of all its turns."""
    firsts = [F.first(c).alias(c) for c in (id_col, "size", "source_size", "target")]
    return mix.groupBy("document_no").agg(*firsts, F.sum("length").alias("taken")).drop("document_no")


def mixing_sql(weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 13) -> str:
    """DuckDB SQL over ``documents`` for :func:`taken_words`: targets by one pass in the order of size over weight."""
    cycle = ", ".join(map(str, weights))
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{cycle}][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(weights)}] AS weight FROM s),
r AS (
  SELECT *, {most} * source_size AS cap, sum(source_size) OVER () AS total,
    coalesce(sum({most} * source_size) OVER o, 0) AS before, sum(weight) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w WINDOW o AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * rest <= weight * (total - before) AS full_up FROM r),
a AS (SELECT *, total - coalesce(sum(cap) FILTER (full_up) OVER (), 0) AS free, sum(weight) FILTER (NOT full_up) OVER () AS shares FROM f),
t AS (
  SELECT source, source_size,
    CASE WHEN full_up THEN CAST(cap AS DOUBLE) ELSE CAST(weight * free AS DOUBLE) / CAST(shares AS DOUBLE) END AS target,
    CAST(CASE WHEN full_up THEN cap ELSE (weight * free) // shares END AS BIGINT) AS quota
  FROM a),
p AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM d)
SELECT p.doc_id, p.size, t.source_size, t.target,
  CAST({" + ".join(f"greatest(0, least(size, quota - start - {e} * source_size))" for e in range(most))} AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source"""
