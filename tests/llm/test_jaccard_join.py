import numpy as np
import pytest

from tests.llm import brute
from tests.llm.cases import documents, frame, text_of
from weftline.llm.jaccard_join import jaccard_groups, parity_bitmap


@pytest.mark.parametrize(("k", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (2, 60, 3)])
def test_like_all_pairs(spark, k, percent, seed):
    rows = documents(seed)
    got = jaccard_groups(frame(spark, rows).repartition(5), shingle=k, percent=percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute.jaccard_components(rows, k, percent))


def test_chains_of_near_copies(spark):
    import random

    rng = random.Random(9)
    words = text_of(rng, 80).split()
    rows = []
    for i in range(60):  # each a little other than the one before
        words = words[1:] + [text_of(rng, 1)]
        rows.append((1_000 - i, " ".join(words)))
    got = jaccard_groups(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute.jaccard_components(rows))


def test_few_listed_words_change_nothing(spark):
    rows = documents(4)
    got = jaccard_groups(frame(spark, rows), order_words=3).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, c) for i, _, c in brute.jaccard_components(rows))


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (7, None), (None, ""), (8, "A B C D E")]
    got = jaccard_groups(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (0, 2, 3), (3, 2, 3), (3, 2, 3), (7, 0, 7), (8, 2, 3)]


def test_near_copies_around_the_threshold(spark):
    import random

    rng = random.Random(11)
    base = text_of(rng, 120).split()
    rows = []
    for i in range(40):  # some pairs are similar enough, most are just not
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(120)] = text_of(rng, 1)
        rows.append((i, " ".join(words)))
    got = jaccard_groups(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute.jaccard_components(rows))


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    for size in (0, 5, 300, 5_000):
        x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        y = np.unique(np.concatenate([x[size // 10 :], rng.integers(0, 1 << 63, 40, dtype=np.uint64)]))
        bits = np.bitwise_xor(parity_bitmap(x), parity_bitmap(y)).view(np.uint8)
        assert np.unpackbits(bits).sum() <= len(np.setxor1d(x, y))


def test_empty_table(spark):
    assert jaccard_groups(frame(spark, [])).collect() == []
