import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """``docs(text, ...)`` or ``docs((id, text), ...)`` as a table of documents."""

    def make(*texts, lang="en"):
        rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        data = [(i, t, lang, f"src{i % 3 if i is not None else 0}", len(t or "")) for i, t in rows]
        return spark.createDataFrame(data, DOCUMENTS)

    return make


@pytest.fixture
def clashing():
    """Adds columns whose names an operator uses inside."""

    def add(df, *names):
        from pyspark.sql import functions as F

        extra = {n: F.lit("x") for n in (*names, "_id", "key", "n", "label", "score", "word", "id") if n not in df.columns}
        return df.withColumns(extra)

    return add


def by_id(df, *key):
    """Rows as dicts by the columns ``key``."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in rows}
