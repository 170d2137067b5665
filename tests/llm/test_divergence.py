import re
from collections import Counter, defaultdict

from weftline.llm.divergence import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    """Rows of the audit of (text, lang, source) in plain Python."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(FOLD))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for (lang, source), own in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(of):
            total = sum(of[t] for t in kept)  # noqa: B023
            return {t: 1 + 10**9 * (of[t] + 5) // (total + 5 * len(kept)) for t in kept}  # noqa: B023

        p, q = shares(own), shares(sum((c for (other, _), c in counts.items() if other == lang), Counter()))
        pairs = [(-sum(abs(p[t] - r[t]) for t in kept), s) for (other, s), c in counts.items() if other == lang and s != source for r in [shares(c)]]
        terms = [(q[t] - p[t], t) for t in kept if own[t] and p[t] > q[t]]
        for part, items in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
            out |= {(lang, source, part, item, -value, rank) for rank, (value, item) in enumerate(items, 1)}
    return out


def found(spark, rows, **kw):
    table = spark.createDataFrame([(i, *r, "x", 3) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int")
    out = [tuple(r) for r in divergence(table, **kw).collect()]
    assert len(out) == len(set(out))
    return set(out)


ROWS = [
    ("The cat, the CAT and the dog", "en", "a"), ("the dog barks at 9 cats", "en", "a"), ("ÉTÉ été Straße", "de", "b"), ("straße Straße x1y", "de", None),
    ("the the the the", "en", "b"), (None, "en", "c"), ("", None, None), ("a dog", "en", None), ("12 34", "en", "d"), ("solo", "fr", "a"), ("solo solo", "fr", "b"),
    ("the cat", "en", "b"), ("the cat", "en", "b"), ("日本 語 日本", "ja", "z"), ("日本", "ja", "é"), ("word " * 5_000, "en", "a"), ("word", "en", "c"),
]


def test_like_brute_force(spark):
    for least, top in ((1, 50), (2, 2), (3, 50), (99, 50)):
        assert found(spark, ROWS, least_docs=least, top=top, spread=3) == brute(ROWS, least, top)


def test_no_kept_terms_pairs_differ_by_nothing(spark):
    got = found(spark, [("x", "en", "a"), ("y", "en", "b"), ("z", "en", "c")], least_docs=2)
    assert got == {("en", s, "pair", o, 0, i) for s, rest in (("a", "bc"), ("b", "ac"), ("c", "ab")) for i, o in enumerate(rest, 1)}


def test_empty_table_and_single_source(spark):
    assert found(spark, []) == set()
    assert found(spark, [("x", "en", "a")]) == set()


def test_hot_group(spark):
    rows = [("hot term here", "en", "a")] * 400 + [("rare words there", "en", str(i % 7)) for i in range(100)]
    assert found(spark, rows) == brute(rows, 30, 50)
