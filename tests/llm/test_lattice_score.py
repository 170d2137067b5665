import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.cases import documents, frame
from weftline.llm.lattice_score import from_existing, score_texts, weighted

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
LEARNS = "crc32(cast(cast(doc_id as string) as binary)) % 7 != 2"


def all_segmentations(lattice, text):
    weight = {p: math.exp(w) for p, w in zip(lattice.pieces, lattice.log_weights, strict=True)}
    ahead = [1.0] + [0.0] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            ahead[end] += ahead[start] * weight.get(text[start:end], 0.0)
    return ahead[-1]


def test_forward_sums_all_segmentations():
    lattice = from_existing(VOCABULARY)
    words = [b"the", b"international", "naïve".encode(), b"x", b"\x00\xff", b"qqqqqqqqq", b""]
    found = lattice.log_probabilities(words)
    for word, p in zip(words[:-1], found, strict=False):
        assert math.isclose(p, math.log(all_segmentations(lattice, b" " + word)), rel_tol=1e-9)
    assert found[-1] == lattice.end


def test_weights_make_a_distribution():
    lattice = weighted([b" a", b" ", b"a", b"aa"], np.array([3.0, 1.0, 2.0, 1.0]), 1.0)
    total = math.exp(lattice.end) + sum(np.exp(lattice.log_probabilities([b"a" * n for n in range(1, 120)])))
    # the open word of no letters has the weight of its mark alone
    assert math.isclose(total + math.exp(lattice.log_weights[1]), 1.0, rel_tol=1e-6)


def test_expected_uses_by_finite_difference():
    lattice = weighted([b" a", b" ", b"a", b"aa", b"b"], np.array([3.0, 1.0, 2.0, 1.0, 1.0]), 1.0)
    words, counts = [b"aaa", b"ab", b"a"], np.array([2, 5, 1])
    uses = lattice.expected(words, counts)
    for k in range(5):
        moved = weighted(lattice.pieces, np.ones(5), 1.0)
        moved.log_weights = lattice.log_weights.copy()
        moved.log_weights[k] += 1e-6
        slope = (moved.log_probabilities(words) - lattice.log_probabilities(words)) @ counts / 1e-6
        assert math.isclose(uses[k], slope, abs_tol=1e-4)


def test_scores_follow_the_contract(spark):
    rows = documents()
    got = {r["doc_id"]: r for r in score_texts(frame(spark, rows).repartition(5), VOCABULARY, F.expr(LEARNS)).collect()}
    assert len(got) == len(rows)
    for doc_id, _, n_tokens, n_known, train, base in brute.base_scores(rows):
        r = got[doc_id]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, n_known, train)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0


def test_score_is_the_running_product(spark):
    rows = [(1, "aa b aa"), (3, "b"), (4, None), (5, "aa aa aa aa aa c")]
    got = {r["doc_id"]: r for r in score_texts(frame(spark, rows), VOCABULARY, F.expr("doc_id < 5"), steps=1).collect()}
    start = from_existing(VOCABULARY)
    counts = {b"aa": 2, b"b": 2, b"": 3}
    uses = np.round(start.expected([b"aa", b"b"], np.array([2, 2])) * 1e6) / 1e6
    lattice = start.reweighted(uses, 3.0)
    n, v, d = 7, 3, 0.5
    for doc_id, text in rows:
        own = [*(text or "").encode().split(), b""]
        strength, score = got[doc_id]["strength"], 0.0
        for i, w in enumerate(own):
            p = max(counts.get(w, 0) - d, 0) / n + d * v / n * math.exp(lattice.log_probabilities([w])[0])
            score += math.log10((strength * p + own[:i].count(w)) / (strength + i))
        assert math.isclose(got[doc_id]["score"], score, abs_tol=1e-6)


@pytest.mark.parametrize("learns", ["false", "cast(null as boolean)"])
def test_nothing_to_learn_from(spark, learns):
    rows = score_texts(frame(spark, [(None, "a b"), (None, None), (2, "")]), VOCABULARY, F.expr(learns)).collect()
    assert sorted(r["n_tokens"] for r in rows) == [1, 1, 3]
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in rows)


def test_empty_table(spark):
    assert score_texts(frame(spark, []), VOCABULARY, F.expr(LEARNS)).collect() == []
