"""Nested documents of several tables, in numbered parts of bounded size, and the way back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranking import running_total
from ..session import cut

#: Bytes of the entries of one part; a longer entry is a part of its own.
PART_BYTES = 1 << 20

#: Bytes of the entries of one document and kind that a task may take whole; more are spread over sorted ranges.
WHOLE_BYTES = 1 << 25

#: Hash buckets in which bytes are summed to find out whether there are such documents.
BUCKETS = 1 << 14


def nested(sections: Mapping[str, DataFrame], keys: Sequence[str], part_bytes: int = PART_BYTES, limit: int = WHOLE_BYTES) -> DataFrame:
    """``keys, kind, part, parts, entries``: the rows of each section as JSON objects, in arrays of about ``part_bytes``.

    ``sections``: for each kind a table with ``keys`` and any further columns, nested
    ones too. Entries of a document and kind stand in the order of their text and are
    cut by the running total of their bytes. ``parts`` is how many there are of that
    document and kind; their numbers rise, with gaps behind very long entries.
    Equal rows are entries each; a kind without rows has no part.

    The entries are written once and shuffled once, by document and kind. Only those in
    hash buckets of more than ``limit`` bytes go by sorted ranges, so that a document
    with most rows is spread over parts and no task follows its size.
    """
    keys = list(keys)
    rows = [
        df.select(*keys, F.lit(kind).alias("kind"), F.to_json(F.struct(*(c for c in df.columns if c not in keys)), {"ignoreNullFields": "false"}).alias("entry"))
        for kind, df in sections.items()
    ]
    group = [*keys, "kind"]
    whole = cut(reduce(DataFrame.unionByName, rows)).withColumn("_bytes", F.octet_length("entry").cast("long") + 1)
    bucket = F.pmod(F.xxhash64(*group), F.lit(BUCKETS)).alias("_bucket")
    hot = cut(whole.groupBy(bucket).agg(F.sum("_bytes").alias("_sum")).filter(F.col("_sum") > limit).select("_bucket"))
    if hot.isEmpty():
        made = _by_group(whole, group, part_bytes)
    else:
        dealt = whole.withColumn("_bucket", bucket)
        made = _by_group(dealt.join(hot, "_bucket", "left_anti"), group, part_bytes)
        made = made.unionByName(_by_range(dealt.join(hot, "_bucket", "left_semi").drop("_bucket"), group, part_bytes))
    entries = F.concat(F.lit("["), F.array_join("_list", ","), F.lit("]"))
    return made.select(*group, "part", "parts", entries.alias("entries"))


def _in_parts(placed: DataFrame, group: Sequence[str], part_bytes: int) -> DataFrame:
    """``group, part, _list``: entries by the bytes ``_before`` them."""
    return placed.groupBy(*group, F.expr(f"_before div {part_bytes}").alias("part")).agg(F.sort_array(F.collect_list("entry")).alias("_list"))


def _by_group(rows: DataFrame, group: Sequence[str], part_bytes: int) -> DataFrame:
    """Parts and their number, from one shuffle: totals, lists and counts all stay where their group is."""
    before = W.partitionBy(*group).orderBy("entry").rowsBetween(W.unboundedPreceding, -1)
    made = _in_parts(rows.withColumn("_before", F.coalesce(F.sum("_bytes").over(before), F.lit(0))), group, part_bytes)
    return made.withColumn("parts", F.count(F.lit(1)).over(W.partitionBy(*group)))


def _by_range(rows: DataFrame, group: Sequence[str], part_bytes: int) -> DataFrame:
    """The same parts from sorted ranges, for groups that no task should hold."""
    made = cut(_in_parts(running_total(rows, [*group, "entry"], "_bytes", group, "_before"), group, part_bytes))
    counts = made.groupBy(*(F.col(c).alias(f"_counted_{c}") for c in group)).agg(F.count(F.lit(1)).alias("parts"))
    same = reduce(lambda s, c: s & F.col(c).eqNullSafe(F.col(f"_counted_{c}")), group, F.lit(True))
    return made.join(counts, same).select(*group, "part", "_list", "parts")


def unnested(documents: DataFrame, schemas: Mapping[str, str], keys: Sequence[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables of each kind, documents and kinds that miss parts or cannot be read).

    ``schemas``: the columns of each kind's rows beside ``keys``. Of a document and
    kind that is not whole, or that a part of no valid JSON belongs to, no row is
    given: half a document would look like a whole one.
    """
    keys = list(keys)
    group = [*keys, "kind"]
    parsed = documents.withColumn("_ok", F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("entries")), F.lit("ARRAY")), F.lit(False)))
    state = parsed.groupBy(*group).agg(F.count_distinct("part").alias("found"), F.max("parts").alias("parts"), F.bool_and("_ok").alias("readable"), F.count(F.lit(1)).alias("_rows"))
    whole = (F.col("found") == F.col("parts")) & (F.col("_rows") == F.col("parts")) & F.col("readable")
    broken = cut(state.filter(~whole).select(*group, "found", "parts", "readable"))
    good = documents.join(broken.select(*group), group, "left_anti")
    tables = {}
    for kind, schema in schemas.items():
        own = good.filter(F.col("kind") == kind)
        tables[kind] = own.select(*keys, F.explode(F.from_json("entries", f"array<struct<{schema}>>")).alias("_e")).select(*keys, "_e.*")
    return tables, broken
