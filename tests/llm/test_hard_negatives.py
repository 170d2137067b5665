import math
import random

import numpy as np
from pyspark.sql import functions as F

from weftline.llm.hard_negatives import augmented, grown, hard_negatives, measured, products


def brute(rows, positives=5, negatives=3, low=50, high=95):
    """Rows of the answer for (id, vector, label) in Python's integers."""
    good = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    sizes = [len(v) for _, _, v in good]
    usual = min(set(sizes), key=lambda n: (-sizes.count(n), n), default=0)
    good = [r for r in good if len(r[2]) == usual]
    out = []
    for i, label, a in good:
        if i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), j, other == label) for j, other, v in good if j != i)
        for score, j, _ in [s for s in scored if s[2]][:positives]:
            fits = [s for s in scored if not s[2] and low * -score <= 100 * -s[0] <= high * -score]
            out += [(i, j, rank, n, -score, -s) for rank, (s, n, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def found(spark, rows, **kw):
    table = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, v string, leaf int").repartition(3)
    return sorted(map(tuple, hard_negatives(table, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 50 == 0, **kw).collect()))


def floats(v):
    return [float(np.float32(x)) for x in v]


def clustered(seed, n, dims=6, labels=4):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(7, dims))
    return [(i, floats(middles[i % 7] + 0.4 * rng.normal(size=dims)), int(rng.integers(labels))) for i in range(n)]


def test_like_brute_force_over_many_leaves(spark):
    rows = clustered(1, 900)
    want = brute(rows)
    assert len(want) > 100
    assert found(spark, rows, sample_rows=200, block_rows=60, leaf_rows=8) == want
    assert found(spark, rows) == want
    assert found(spark, rows, positives=2, negatives=7, low=20, high=100, sample_rows=100, block_rows=100, leaf_rows=16) == brute(rows, 2, 7, 20, 100)


def test_hot_copies_ties_and_repeated_rows(spark):
    rows = clustered(2, 200)
    hot = rows[3][1]
    rows += [(1_000 + i, hot, i % 3) for i in range(500)] + [(50, rows[50][1], rows[50][2])] * 3 + [(100, floats([1] * 6), 9), (2_000, floats([0] * 6), 1), (2_050, floats([0] * 6), 2)]
    assert found(spark, rows, sample_rows=100, block_rows=50, leaf_rows=8) == brute(rows)


def test_rows_that_take_no_part(spark):
    rows = clustered(3, 60)
    bad = [(100, None, 1), (150, [], 1), (200, [None] * 6, 1), (250, [float("nan")] + [1.0] * 5, 2), (300, [float("inf")] * 6, 2), (None, [1.0] * 6, 1), (350, [1.0] * 6, None), (400, [1.0] * 5, 1)]
    assert found(spark, rows + bad) == brute(rows + bad) == brute(rows)
    assert found(spark, bad[:3]) == [] == found(spark, [])


def test_alone_and_negative_scores(spark):
    assert found(spark, [(0, [1.0, 0.0], 1)]) == []
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [-0.8, 0.1], 2), (50, [0.0, 1.0], 2), (4, [0.0, -1.0], 2)]
    assert found(spark, rows) == brute(rows)


def test_scores_beyond_exact_doubles(spark):
    rng = random.Random(1)
    rows = [(i, floats(rng.uniform(0, 3e6) for _ in range(4)), i % 2) for i in range(0, 120)]
    assert max(r[4] for r in brute(rows)) > 2**53
    assert found(spark, rows, block_rows=40, leaf_rows=8) == brute(rows)


def test_tree_bounds_hold():
    rng = np.random.default_rng(4)
    rows = np.floor(rng.normal(size=(700, 5)) * 256)
    rows[:300] = rows[0]
    norm = float((rows**2).sum(1).max())
    wide = augmented(rows, norm)
    tree, leaves = grown(wide, 20)
    measured(tree, wide, leaves)
    assert sorted(np.concatenate(leaves)) == list(range(700)) and len(leaves) > 15
    dealt, _ = tree.deal(wide)
    assert all((dealt[some] == leaf).all() for leaf, some in enumerate(leaves))
    asked = rows[::9]
    exact = products(asked, rows, norm)
    low, high = tree.scores(asked, norm)
    for leaf, some in enumerate(leaves):
        assert (low[:, leaf] <= exact[:, some].min(1)).all() and (exact[:, some].max(1) <= high[:, leaf]).all()
    assert (products(asked, rows, 2.0**60) == exact).all()
