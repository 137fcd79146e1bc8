"""Rules over versions: answers as given and as normalised, or under stored and present rules, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intake import ANCHOR_ALIAS
from ..operators.rules import issue_change, row_issues
from ..session import cut

Rules = Callable[[DataFrame], DataFrame]
PLAN_STAGE = "plan_buildings"


def version_issues(rows: DataFrame, rules: Rules) -> DataFrame:
    """``doc_id, version, entity_id, rule`` of ``rows`` with a column ``version``, by one pass of the rules.

    The version is made part of the document's key, so that set rules (duplicates,
    references, coverage) look at each version for itself.
    """
    keyed = rows.withColumn("doc_id", F.concat(F.col("version").cast("string"), F.lit("#"), F.col("doc_id").cast("string"))).drop("version")
    found = rules(keyed)
    at = F.locate("#", F.col("doc_id"))
    return found.select(
        F.expr("substring(doc_id, locate('#', doc_id) + 1)").alias("doc_id"), F.substring("doc_id", F.lit(1), at - 1).cast("int").alias("version"), "entity_id", "rule"
    )


def normalize_answers(docs: DataFrame, rows: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents as they go on, their rows, the issues of both versions).

    ``docs``: doc_id, requested_stage, stage; ``rows``: doc_id, id, anchor_status and
    what the rules need. A missing stage is supplied from the request; in answers of
    the plan stage the reversed status word becomes the known one. Documents that
    would change are checked as given (version 0) and normalised (version 1) in one
    pass. The normalised one is taken only if nothing is left to object to; else the
    document stays as it was, with no change. A stage that differs from the requested
    one is an issue of either version. Added to the documents: ``changes`` (made),
    ``issues_before`` and ``issues_after`` (the latter null where nothing would change).
    """
    fill = F.col("stage").isNull()
    aliased = rows.filter(F.col("anchor_status") == ANCHOR_ALIAS[0]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_alias"))
    plan = F.col("requested_stage") == PLAN_STAGE
    wanted = docs.join(aliased, "doc_id", "left").withColumn("_wanted", fill.cast("int") + F.when(plan, F.coalesce("_alias", F.lit(0))).otherwise(0))
    wanted = cut(wanted.drop("_alias"))
    versions = F.explode(F.when(F.col("_wanted") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("version")
    asked = wanted.select("doc_id", "requested_stage", "stage", versions)
    renamed = (F.col("version") == 1) & plan & (F.col("anchor_status") == ANCHOR_ALIAS[0])
    both = rows.join(asked.select("doc_id", "requested_stage", "version"), "doc_id")
    both = cut(both.withColumn("anchor_status", F.when(renamed, F.lit(ANCHOR_ALIAS[1])).otherwise(F.col("anchor_status"))).drop("requested_stage"))
    stage = F.when((F.col("version") == 1) & fill, F.col("requested_stage")).otherwise(F.col("stage"))
    wrong = asked.withColumn("_differs", ~stage.eqNullSafe(F.col("requested_stage"))).withColumn("id", F.lit("document"))
    found = version_issues(both, rules).unionByName(version_issues(wrong, lambda df: row_issues(df, {"wrong_stage": F.col("_differs")})))
    found = cut(found)
    count = lambda v: F.count_if(F.col("version") == v).alias(f"_n{v}")
    counts = found.groupBy(F.col("doc_id").alias("_doc")).agg(count(0), count(1))
    judged = wanted.join(counts, F.col("doc_id").cast("string") == F.col("_doc"), "left").fillna(0, ["_n0", "_n1"])
    use = (F.col("_wanted") > 0) & (F.col("_n1") == 0)
    judged = judged.withColumn("_use", use)
    out = judged.select(
        *(c for c in docs.columns if c != "stage"),
        F.when(use & fill, F.col("requested_stage")).otherwise(F.col("stage")).alias("stage"),
        F.when(use, F.col("_wanted")).otherwise(0).cast("int").alias("changes"),
        F.col("_n0").alias("issues_before"),
        F.when(F.col("_wanted") > 0, F.col("_n1")).alias("issues_after"),
    )
    taken = judged.select("doc_id", F.col("_use").cast("int").alias("version"))
    return out, both.join(taken, ["doc_id", "version"], "left_semi").drop("version"), found


def revalidate(runs: DataFrame, schema: str, rules: Rules, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues of stored answers under former and present rules, runs that cannot be judged again).

    ``runs``: run_id, finish_reason, answer (the text as stored); ``schema`` is that of
    an answer's rows. The present rules run on the stored text; ``stored`` has the
    issues recorded then. A cut-off answer or one that is no JSON object is refused.
    """
    answer = F.try_parse_json("answer")
    whole = (F.col("finish_reason") == "stop") & F.coalesce(F.schema_of_variant(answer).startswith("OBJECT"), F.lit(False))
    marked = runs.withColumn("_whole", F.coalesce(whole, F.lit(False)))
    # written, so that the rules do not parse an answer once for every column they name
    parsed = cut(marked.filter("_whole").select(F.from_json("answer", schema).alias("a")).select("a.*"))
    return issue_change(stored, rules(parsed)), marked.filter("not _whole").select("run_id", F.lit("incomplete").alias("refused"))
