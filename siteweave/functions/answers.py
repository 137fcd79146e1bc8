"""Model answers as text: fences, extraction, strict JSON, redaction, leak patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what must not leave the house, by check name
LEAK_PATTERNS = {
    "private_home_path": r"/home/[A-Za-z0-9_\-]+/",
    "workspace_endpoint": r"https://ws-[a-z0-9]+\.",
    "api_key_shape": r"\bsk-(?:ws-)?[A-Za-z0-9._-]{18,}",
    "github_token_shape": r"\bgh[pousr]_[A-Za-z0-9]{20,}",
}
# fixed values: shape of a secret, what masks it, files that stay inside, size limit, link syntax
KEY_SHAPE = r"\bsk-[A-Za-z0-9_-]{8,}\b"
MASK = "[REDACTED]"
BLOCKED_SUFFIXES = (".pt", ".pth", ".safetensors", ".env", ".pem", ".key", ".pyc")
SIZE_LIMIT = 10 * 1024 * 1024
LINK = r"!?\[[^\]]*\]\(([^)]+)\)"


def strip_wrapping(text: Column) -> Column:
    """Without a reasoning block and code fence."""
    plain = F.regexp_replace(F.trim(text), r"(?is)<think>.*?</think>", "")
    return F.regexp_replace(plain, r"(?is)^\s*```(?:json)?\s*|\s*```\s*$", "")


FENCED = r"(?s)^```[^\n]*\n(.*\n)?[ \t]*```$"


def strip_fence(text: Column) -> Column:
    """Without white space and one code fence whose first and last line are its own."""
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(plain.rlike(FENCED), F.regexp_extract(plain, FENCED, 1)).otherwise(plain)


def with_strict_json(df: DataFrame, text: str, into: str) -> DataFrame:
    """Adds ``into``: the answer as VARIANT where it is one JSON object, at most in a fence; null for anything around it.

    The parser stops after the first value, so the text is read as an array's
    content: a second member is text behind the object. Only a text with a closing
    bracket could end that array early; it is read as an object's member as well.
    """
    body, listed = "_body", "_listed"
    df = df.withColumn(body, strip_fence(F.col(text)))
    object_like = F.startswith(F.ltrim(body), F.lit("{"))
    df = df.withColumn(listed, F.when(object_like, F.try_parse_json(F.concat(F.lit("["), F.col(body), F.lit("]")))))
    named = F.try_parse_json(F.concat(F.lit('{"a":'), F.col(body), F.lit("}")))
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull() & (~F.contains(body, F.lit("]")) | named.isNotNull())
    return df.withColumn(into, F.when(F.col(listed).isNotNull() & alone, F.try_variant_get(listed, "$[0]", "variant"))).drop(body, listed)


def outer_object(text: Column) -> Column:
    """First ``{`` to last ``}``, empty when there is none."""
    return F.regexp_extract(strip_wrapping(text), r"(?s)\{.*\}", 0)


def outer_array(text: Column) -> Column:
    return F.regexp_extract(strip_wrapping(text), r"(?s)\[.*\]", 0)


def parse_object(text: Column) -> Column:
    """The object inside an answer that may have prose around it, as VARIANT; null where it is not valid JSON."""
    return F.try_parse_json(F.nullif(outer_object(text), F.lit("")))


def model_matches(requested: Column, returned: Column) -> Column:
    """The requested model or a dated snapshot of it."""
    return F.coalesce((returned == requested) | F.startswith(returned, F.concat(requested, F.lit("-"))), F.lit(False))


def redact(text: Column, secret: Column | None = None) -> Column:
    if secret is not None:
        text = F.when(F.length(secret) > 0, F.replace(text, secret, F.lit(MASK))).otherwise(text)
    return F.regexp_replace(text, KEY_SHAPE, F.lit(MASK))


def leaks(text: Column) -> Column:
    """Array of the checks a text fails."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in LEAK_PATTERNS.items()]))
