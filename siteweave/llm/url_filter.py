"""URL filter: host rules, then a weighted vocabulary found by one Aho-Corasick pass."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az, map_batches

#: verdict, host, path; a rule fits its host and all subdomains.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Term to weight. Weight 1 is strict: one hit rejects. Less is soft: ``min_soft`` distinct ones reject.
VOCABULARY = {
    "porn": 1.0, "porno": 1.0, "xxx": 1.0, "viagra": 1.0, "cialis": 1.0, "hentai": 1.0, "camgirls": 1.0,
    "casino": 0.6, "escort": 0.6, "poker": 0.5, "betting": 0.5, "jackpot": 0.5, "spam": 0.6, "pills": 0.6,
    "pharmacy": 0.4, "cheap": 0.4, "farm": 0.3, "loans": 0.5, "replica": 0.5, "bonus": 0.4, "torrent": 0.5,
    "warez": 0.6, "crack": 0.5, "keygen": 0.6, "adult": 0.5, "sexy": 0.5, "nude": 0.6,
}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lowered, and path up to ``?`` or ``#``; empty without ``://`` or url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return lower_az(part(1)), part(2)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does."""
    name = verdict = F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


@lru_cache(maxsize=8)
def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        found.add_word(term, (k, len(term)))
    if terms:
        found.make_automaton()
    return found


def terms_in(text: str, terms: tuple[str, ...]) -> set[int]:
    """Numbers of the terms that stand in ``text`` between characters other than a-z and 0-9."""
    inside = lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()
    if not terms:
        return set()
    return {k for end, (k, n) in automaton(terms).iter(text) if not inside(end - n) and not inside(end + 1)}


def judge_urls(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    vocabulary: Mapping[str, float] = VOCABULARY,
    min_soft: int = 2,
) -> DataFrame:
    """``id, host, path, rule, verdict, strict_hits, soft_hits, weight`` for every url.

    A fitting rule decides; the longest wins. Else the whole lower-cased url goes
    once through the automaton: one strict term or ``min_soft`` distinct soft
    terms block, anything else is allowed. No row is moved: the work is a map.

    A null, empty or scheme-less url has empty host and path and is judged by its
    text alone (null: allow). Repeated rows are judged each. Only the id and the
    url are read, so other columns cannot clash. An empty table gives no rows.
    """
    terms = tuple(vocabulary)
    weights = [float(vocabulary[t]) for t in terms]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [terms_in(u or "", terms) for u in batch.column("_lowered").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("_id", "host", "path", "rule", "_ruled")),
                    pa.array([sum(weights[k] >= 1 for k in h) for h in hits], pa.int64()),
                    pa.array([sum(weights[k] < 1 for k in h) for h in hits], pa.int64()),
                    pa.array([round(sum(weights[k] for k in sorted(h)), 6) for h in hits], pa.float64()),
                ],
                names=["_id", "host", "path", "rule", "_ruled", "strict_hits", "soft_hits", "weight"],
            )

    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    base = pages.select(F.col(id_col).alias("_id"), lower_az(url).alias("_lowered"), host.alias("host"), path.alias("path"))
    name, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    base = base.select("*", name.alias("rule"), ruled.alias("_ruled"))
    kind = base.schema["_id"].dataType.simpleString()
    scored = map_batches(base, 
        count,
        f"_id {kind}, host string, path string, rule string, _ruled string, strict_hits long, soft_hits long, weight double",
    )
    rejected = (F.col("strict_hits") >= 1) | (F.col("soft_hits") >= min_soft)
    verdict = F.coalesce(F.col("_ruled"), F.when(rejected, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(
        F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "strict_hits", "soft_hits", "weight"
    )


def verdict_sql(min_soft: int = 2) -> str:
    """DuckDB SQL with the same rows over ``pages``."""
    hit = lambda t: f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN 1 ELSE 0 END"
    total = lambda keep: " + ".join(hit(t) for t, w in VOCABULARY.items() if keep(w))
    cases = [
        (len(h + p), f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN ", h + p, what)
        for what, h, p in RULES
    ]
    cases.sort(reverse=True)
    rule = "CASE " + " ".join(f"{c}'{name}'" for _, c, name, _ in cases) + " END"
    ruled = "CASE " + " ".join(f"{c}'{what}'" for _, c, _, what in cases) + " END"
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), '{upper}', '{low}') AS u,
         translate(coalesce(regexp_extract(url, '{pattern}', 1), ''), '{upper}', '{low}') AS host,
         coalesce(regexp_extract(url, '{pattern}', 2), '') AS path
  FROM pages),
seen AS (
  SELECT *, {rule} AS rule, {ruled} AS ruled, {total(lambda w: w >= 1)} AS strict_hits, {total(lambda w: w < 1)} AS soft_hits
  FROM cut)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN strict_hits >= 1 OR soft_hits >= {min_soft} THEN 'block' ELSE 'allow' END) AS verdict
FROM seen"""
