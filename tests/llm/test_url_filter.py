import re

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.url_filter import GlobAutomaton, filter_urls


def as_regex(glob):
    return re.compile("".join({"*": "(?s:.*)", "?": "(?s:.)", "~": "[^/]*"}.get(c, re.escape(c)) for c in glob))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab/*?~", max_size=30), min_size=1, max_size=8), st.lists(st.text("ab/", max_size=20), min_size=1, max_size=10))
def test_automaton_like_regular_expressions(globs, texts):
    found = GlobAutomaton(globs).matches([t.encode() for t in texts])
    assert found.tolist() == [[as_regex(g).fullmatch(t) is not None for g in globs] for t in texts]


CASES = [
    ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.net/fr/", "example.net", "/fr/", "net/", "block"),
    ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    ("http://example.net", "example.net", "", None, "allow"),
    ("x://example.com/de/1#y", "example.com", "/de/1", "example.com/de/", "block"),
    ("x://example.com/DE/1", "example.com", "/DE/1", None, "allow"),
    ("https://w.org/fr/a", "w.org", "/fr/a", "org/fr/", "allow"),
    ("https://w.org?u=http://b.net/", "w.org", "", None, "allow"),
    ("//example.net/en/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://ÄA.net/\n", "Äa.net", "/\n", "net/", "block"),
    ("a://" + "b" * 5_000 + ".net/" + "c" * 9_000, "b" * 5_000 + ".net", "/" + "c" * 9_000, "net/", "block"),
]


def test_cases(spark):
    rows = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(CASES)], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in filter_urls(rows).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[1:] for c in CASES]


def test_no_rules_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert filter_urls(rows, rules=[]).first()["verdict"] == "allow"
    assert filter_urls(rows.limit(0)).collect() == []
