import re

from hypothesis import given, settings
from hypothesis import strategies as st

from siteweave.llm import url_filter as U
from .conftest import by_id

TERMS = tuple(U.VOCABULARY)


def brute_terms(text):
    return {k for k, t in enumerate(TERMS) if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", text)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*TERMS, "-", ".", "/", "s", "é", "9", "x"]), max_size=8).map("".join))
def test_boundaries_equal_brute_force(text):
    assert U.terms_in(text, TERMS) == brute_terms(text)


def judge(spark, urls, clashing=lambda df, *n: df, **kw):
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return [r for _, r in sorted(by_id(U.judge_urls(clashing(table, "host", "path", "rule", "verdict", "_lowered"), **kw), "page_id").items())]


def test_hosts_paths_rules_and_verdicts(spark, clashing):
    urls = {
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "http://net/": ("net", "/", "net/", "block"),
        "http://net": ("net", "", None, "allow"),
        "http://internet/": ("internet", "/", None, "allow"),
        "https://x.example.com/de/1": ("x.example.com", "/de/1", "example.com/de/", "block"),
        "https://a.org/fr/casino-poker": ("a.org", "/fr/casino-poker", "org/fr/", "allow"),
        "ftp://h#a://b": ("h", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://x.com/PORN.html": ("x.com", "/PORN.html", None, "block"),
        "http://x.com/cheap": ("x.com", "/cheap", None, "allow"),
        "http://cheap.x.com/?a=pills": ("cheap.x.com", "/", None, "block"),
        "http://x.com/cheap/cheap": ("x.com", "/cheap/cheap", None, "allow"),
        "http://x.com/a\nb?c": ("x.com", "/a\nb", None, "allow"),
        "http://x.com/" + "y" * 100_000: ("x.com", "/" + "y" * 100_000, None, "allow"),
    }
    rows = judge(spark, urls, clashing)
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows] == list(urls.values())


def test_repeats_empty_table_and_no_vocabulary(spark):
    twice = spark.createDataFrame([(1, "http://porn/"), (1, "http://porn/")], "page_id long, url string")
    assert [r["verdict"] for r in U.judge_urls(twice).collect()] == ["block", "block"]
    assert U.judge_urls(twice.filter("false")).count() == 0
    assert judge(spark, ["http://porn/"], vocabulary={}, rules=())[0]["verdict"] == "allow"
