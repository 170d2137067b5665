import pytest

from tests.llm import brute
from tests.llm.cases import documents, frame
from weftline.llm.substring_dedup import remove_repeats
from weftline.llm.super_kmers import runs


@pytest.mark.parametrize(("window", "bucket_strings"), [(50, 2_000), (7, 2_000), (7, 1), (50, 1)])
def test_like_brute_force(spark, window, bucket_strings):
    rows = documents()
    got = remove_repeats(frame(spark, rows).repartition(5), window=window, bucket_strings=bucket_strings).collect()
    want = {(i, n, gone, kept.decode()) for i, n, gone, kept in brute.kept_words(rows, window)}
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got} == want
    assert len(got) == len(rows)


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (5, text), (5, text), (9, text), (9, "short")]
    got = sorted(((r["doc_id"] or 99, r["n_removed"]) for r in remove_repeats(frame(spark, rows)).collect()))
    assert got == [(5, 0), (5, 0), (9, 0), (9, 60), (99, 60)]


def test_empty_table(spark):
    assert remove_repeats(frame(spark, [])).collect() == []


def test_runs_cover_all_windows():
    import numpy as np

    items = np.random.default_rng(2).integers(0, 9, 500).astype(np.uint64)
    starts, counts, _ = runs(items, 20, 4)
    assert starts[0] == 0 and counts.sum() == 481 and (starts[1:] == np.cumsum(counts)[:-1]).all()


def test_the_largest_id_is_no_null(spark):
    rows = [((1 << 63) - 1, "a b c"), (None, "d e")]
    got = {r["doc_id"]: r["n_words"] for r in remove_repeats(frame(spark, rows)).collect()}
    assert got == {(1 << 63) - 1: 3, None: 2}
