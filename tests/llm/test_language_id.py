import itertools

import duckdb
import numpy as np

from tests.llm import brute
from weftline.llm.language_id import features, fit, forward_backward, identify, op6_language_id, posteriors, remainder, trained

SF = "/root/testdata/sf0.01"


def enumerated(scores, moves):
    """Label probabilities by summing over all label sequences."""
    n, labels = scores.shape
    out = np.zeros_like(scores)
    for path in itertools.product(range(labels), repeat=n):
        weight = np.prod([scores[t, y] for t, y in enumerate(path)]) * np.prod([moves[a, b] for a, b in itertools.pairwise(path)])
        for t, y in enumerate(path):
            out[t, y] += weight
    return out / out.sum(1, keepdims=True)


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([5, 1, 3])
    moves = rng.random((3, 3)) + 0.1
    parts = [rng.random((n, 3)) + 0.01 for n in lengths]
    want = [enumerated(p, moves) for p in parts]
    for stretch in (1, 2, 64):
        got = posteriors(np.concatenate(parts), lengths, moves, stretch)
        assert np.allclose(got, np.concatenate(want))
    padded = np.ones((5, 3, 3))
    for i, p in enumerate(parts):
        padded[: len(p), i] = p
    both, _ = forward_backward(padded, lengths, moves)
    for i, w in enumerate(want):
        assert np.allclose(both[: len(w), i], w)


def test_features():
    number, buckets = features(["Abc", "12", "abc!", "", "x"])
    own = [sorted(buckets[number == i].tolist()) for i in range(5)]
    assert own[0] == own[2] and own[1] == own[3] == []
    assert len(own[0]) == 1 + (5 + 4 + 3) + 6 and len(own[4]) == 1 + (3 + 2 + 1) + 2
    assert features([])[0].size == 0


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in op6_language_id(spark, SF).collect()}
    rows = duckdb.sql(f"select doc_id, lang, text from '{SF}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    right = [got[i]["lang_pred"] == lang for i, lang, text in rows if got[i]["held_out"] and any(c.isalpha() for c in text)]
    assert np.mean(right) > 0.95 and len(right) > 100
    assert all(got[i]["held_out"] == (brute.remainder(i, 5) == 0) and 0 <= got[i]["score"] <= 1 for i, _, _ in rows)


def test_switches_and_hard_cases(spark):
    words = {"en": ["the", "house", "with", "thing"], "de": ["der", "schön", "nicht", "auch"]}
    rng = np.random.default_rng(1)
    segments = [(lang, rng.choice(words[lang], 12).tolist()) for lang in ("en", "de") for _ in range(60)]
    model = fit(segments, ["de", "en"])
    rows = [(1, "the house with der schön nicht auch der"), (2, None), (3, "12 !! --"), (4, ""), (None, "the thing " * 5_000), (4, "the")]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, score int")
    got = sorted(identify(df, model, spans=True).collect(), key=lambda r: (r["doc_id"] or 0, r["lang_pred"]))
    assert [(r["doc_id"], r["lang_pred"]) for r in got] == [(None, "en"), (1, "de"), (2, "und"), (3, "und"), (4, "en"), (4, "und")]
    assert [(s["start"], s["words"], s["label"]) for s in got[1]["spans"]] == [(0, 3, "en"), (3, 5, "de")]
    assert got[2]["score"] == 0.0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "the", None), (None, "der", "de")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in identify(df, trained(df)).collect()} == {"und"}
    assert identify(df.limit(0), trained(df)).collect() == []
    assert sorted(r[0] for r in df.select(remainder("doc_id", 5) > 0).collect())[0] is False
