import numpy as np
from pyspark.sql import functions as F

from weftline.llm.vector_search import Index, best_of_block, fit, search, shelves

IS_QUERY = "vec_id % 20 = 0"


def exact(rows, k):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for i, v in zip(ids, vectors, strict=True):
        if i % 20 == 0:
            scores = vectors @ v
            order = np.lexsort((ids, -scores))
            out[int(i)] = [int(ids[j]) for j in order if ids[j] != i][:k]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, list string")


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r)
    return out


def test_recall_order_and_scores(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(20, 24))
    rows = [(i, (middles[i % 20] + rng.normal(size=24)).tolist()) for i in range(3_000)]
    got = found(search(table(spark, rows), "vec_id", "embedding", F.expr(IS_QUERY), sample_rows=1_000, block_rows=100))
    want = exact(rows, 20)
    assert set(got) == set(want)
    hits = sum(len({r["vec_id"] for r in got[q]} & set(want[q])) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    vectors = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows}
    for q, answers in got.items():
        assert [r["rank"] for r in answers] == list(range(1, 21))
        assert all(abs(r["score"] - vectors[q] @ vectors[r["vec_id"]]) < 1e-9 for r in answers)
        keys = [(-r["score"], r["vec_id"]) for r in answers]
        assert keys == sorted(keys)


def test_few_candidates_come_whole(spark):
    rows = [(i, [1.0, float(i), 0.0]) for i in range(0, 60, 5)]
    got = found(search(table(spark, rows), "vec_id", "embedding", F.expr(IS_QUERY)))
    assert {q: [r["vec_id"] for r in a] for q, a in got.items()} == exact(rows, 20)


def test_bad_vectors_take_no_part(spark):
    good = [(i, [1.0, 0.5]) for i in range(0, 41)]
    bad = [(100, None), (120, []), (140, [0.0, 0.0]), (160, [None, 1.0]), (180, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (None, [1.0, 1.0]), (220, [1.0, 1.0, 1.0])]
    got = found(search(table(spark, good + bad), "vec_id", "embedding", F.expr(IS_QUERY)))
    assert set(got) == {0, 20, 40}
    # all tie: the smallest ids
    assert [r["vec_id"] for r in got[0]] == list(range(1, 21))
    assert [r["vec_id"] for r in got[20]] == list(range(20))


def test_repeated_rows_count_once(spark):
    rows = [(i, [1.0, float(i)]) for i in range(10)] * 3
    got = found(search(table(spark, rows), "vec_id", "embedding", F.expr(IS_QUERY)))
    assert [r["vec_id"] for r in got[0]] == sorted(range(1, 10))


def test_empty_and_all_bad(spark):
    assert search(table(spark, []), "vec_id", "embedding", F.expr(IS_QUERY)).collect() == []
    assert search(table(spark, [(0, None)]), "vec_id", "embedding", F.expr(IS_QUERY)).collect() == []


def test_codes_approximate_residuals():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(2_000, 16))
    index: Index = fit(rows, lists=8, parts=8)
    home, codes = index.encode(rows)
    built = index.centroids[home] + np.concatenate([b[codes[:, j]] for j, b in enumerate(index.books)], 1)
    assert ((built - rows) ** 2).sum() < 0.2 * (rows**2).sum()


def test_recall_where_queries_are_unlike_the_rows(spark):
    """Rows in tight clusters find each other in one list; queries from elsewhere need many. Some rows are much longer than others."""
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(300, 24))
    length = rng.lognormal(0, 0.5, size=300)
    rows = [(i, (rng.normal(size=24) if i % 20 == 0 else length[i % 299] * (middles[i % 299] + 0.05 * rng.normal(size=24))).tolist()) for i in range(4_000)]
    got = found(search(table(spark, rows), "vec_id", "embedding", F.expr(IS_QUERY), sample_rows=2_000))
    want = exact(rows, 20)
    assert set(got) == set(want)
    assert sum(len({r["vec_id"] for r in got[q]} & set(want[q])) for q in want) >= 0.9 * 20 * len(want)


def test_short_lists_are_not_met_one_by_one():
    """A query without near lists probes most of them; before, it met each alone, so that meetings grew as the rows to the power 1.5."""
    rng = np.random.default_rng(7)
    for lists in (200, 400):
        held, centroids = rng.integers(150, 250, size=lists), rng.normal(size=(lists, 16))
        held[3], held[5] = 9_000, 0
        shelf, blocks = shelves(held, centroids, 4_000)
        sizes = np.bincount(shelf, held)
        assert len(blocks) == len(sizes)
        assert blocks.sum() <= 2 * held.sum() / 4_000 + 2
        assert all(sizes[s] <= 4_000 or (shelf == s).sum() - (shelf[5] == s) == 1 for s in range(len(sizes)))
        assert (sizes / blocks).max() <= 4_000
    assert shelves(np.array([0]), np.zeros((1, 2)), 5)[1].tolist() == [1]


def test_ties_beyond_those_scored_again_go_to_the_smaller_ids():
    rng = np.random.default_rng(2)
    one = rng.normal(size=8)
    vectors = np.concatenate([np.repeat(one[None], 30, 0), 0.1 * rng.normal(size=(20, 8))])
    ids, home = rng.permutation(50), np.repeat([4, 9], [30, 20])
    probed = np.array([[True, True], [True, False], [False, True], [False, False]])
    names = np.array([ids[2], ids[40], ids[41], 99])
    queries = np.stack([one, one, one, one])
    got = best_of_block(vectors, vectors, ids, home, queries, names, probed, 5, 10)
    exact = np.einsum("qd,rd->qr", queries, vectors)
    for q in range(4):
        want = [i for i in np.lexsort((ids, -exact[q])) if ids[i] != names[q] and probed[q, int(home[i] == 9)]][:5]
        assert got[1][got[0] == names[q]].tolist() == ids[want].tolist()


def test_recall_of_rows_without_clusters(spark):
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3_000, 32)))]
    got = found(search(table(spark, rows), "vec_id", "embedding", F.expr(IS_QUERY), sample_rows=1_000, block_rows=700, rerank=60))
    want = exact(rows, 20)
    assert set(got) == set(want)
    assert sum(len({r["vec_id"] for r in got[q]} & set(want[q])) for q in want) >= 0.9 * 20 * len(want)


def test_many_near_copies_whose_codes_are_alike():
    """More rows than are scored again may be among the nearest: all of them are looked at."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=8) + 0.01 * rng.normal(size=(300, 8))
    built, ids = np.repeat(vectors.mean(0)[None], 300, 0), np.arange(300)
    names = np.array([0, 20])
    got = best_of_block(vectors, built, ids, np.zeros(300, int), vectors[names], names, np.ones((2, 1), bool), 20, 40)
    for q in names:
        exact = np.einsum("rd,d->r", vectors, vectors[q])
        assert len(set(got[1][got[0] == q]) & set([i for i in np.argsort(-exact) if i != q][:20])) >= 18
