import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tests.llm.cases import documents, frame
from weftline.llm.suffix_array import common_prefixes, repeats, suffix_array
from weftline.llm.suffix_dedup import remove_byte_repeats


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(min_size=1, max_size=60), st.text("ab", min_size=1, max_size=80).map(str.encode)))
def test_suffix_array_and_prefixes(data):
    sa = suffix_array(np.frombuffer(data, np.uint8))
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert sa.tolist() == want
    lengths = common_prefixes(data, sa)
    for before, here in zip(want, want[1:], strict=False):
        k = 0
        while max(before, here) + k < len(data) and data[before + k] == data[here + k]:
            k += 1
        assert lengths[here] == k


@settings(max_examples=80, deadline=None)
@given(st.text("ab", min_size=1, max_size=70).map(str.encode), st.integers(1, 9))
def test_repeats(data, length):
    strings = [data[i : i + length] for i in range(len(data) - length + 1)]
    flags = repeats(data, length)
    assert [bool(f) for f in flags[: len(strings)]] == [strings.count(s) > 1 for s in strings]


@pytest.mark.parametrize(("window", "bucket_strings"), [(400, 2_000), (60, 2_000), (60, 1), (30, 1)])
def test_like_brute_force(spark, window, bucket_strings):
    rows = documents()
    got = remove_byte_repeats(frame(spark, rows).repartition(5), window=window, bucket_strings=bucket_strings).collect()
    want = {(i, n, gone, spans, brute.sha(kept)) for i, n, gone, spans, kept in brute.kept_bytes(rows, window)}
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), brute.sha(bytes(r["kept"]))) for r in got} == want


def test_repeated_rows_repeat_each_other(spark):
    rows = [(1, "q" * 10 + "xyz" * 200), (1, "q" * 10 + "xyz" * 200), (None, "abc")]
    got = sorted((r["n_bytes"], r["n_removed"]) for r in remove_byte_repeats(frame(spark, rows)).collect())
    assert got == [(3, 0), (610, 610), (610, 610)]


def test_empty_table(spark):
    assert remove_byte_repeats(frame(spark, [])).collect() == []


def prose(random, size):
    return "".join(random.choice(list("abcdefgh "), size))


def test_strings_that_share_a_phrase_but_no_window_do_not_travel(spark, monkeypatch):
    import weftline.llm.suffix_dedup as module

    random, travelled = np.random.default_rng(3), []
    monkeypatch.setattr(module, "_shard_repeats", lambda strings, *rest, f=module._shard_repeats: travelled.append(strings.count()) or f(strings, *rest))
    phrase = prose(random, 200)
    rows = [(i, prose(random, 600) + phrase + prose(random, 600)) for i in range(40)]
    assert {r["n_removed"] for r in remove_byte_repeats(frame(spark, rows)).collect()} == {0}
    assert travelled == [0]


@pytest.mark.parametrize("size", [399, 400, 401, 480])
def test_passages_of_a_window_or_more_at_any_place(spark, size):
    """The length is counted in bytes: a passage of many words that is shorter than a window stays."""
    random = np.random.default_rng(size)
    passage = " ".join("".join(random.choice(list("abcdefgh"), 4)) for _ in range(100))[:size]
    ends = [chr(48 + i) for i in range(30)]  # other bytes before and after each passage
    rows = [(i, prose(random, i * 37 % 500) + e + passage + e + prose(random, i * 91 % 700)) for i, e in enumerate(ends)]
    rows += [(100 + i, prose(random, 900)) for i in range(10)]
    got = sorted((r["doc_id"], r["n_removed"]) for r in remove_byte_repeats(frame(spark, rows).repartition(3)).collect())
    assert len(passage.split()) > 50
    assert got == sorted((i, n) for i, _, n, *_ in brute.kept_bytes(rows, 400))
    assert all((n > 0) == (i < 100 and size >= 400) for i, n in got)


def test_a_line_that_goes_on_repeating_makes_few_rows(spark, monkeypatch):
    """Its minimiser stands in every line; before, each of the 200 lines of each string had a row with a window of bytes."""
    import weftline.llm.suffix_dedup as module

    random, made = np.random.default_rng(8), {}
    monkeypatch.setattr(module, "materialise", lambda df, name, f=module.materialise: made.setdefault(name, f(df, name)))
    monkeypatch.setattr(module, "free", lambda *tables: None)
    line = prose(random, 17) + "."
    rows = [(i, prose(random, 100 + i) + line * 200 + prose(random, 150)) for i in range(20)]
    rows += [(100 + i, prose(random, 90) + line * (3 + i) + prose(random, 300)) for i in range(8)]  # less and more than a window
    got = remove_byte_repeats(frame(spark, rows).repartition(3), window=60, bucket_strings=3).collect()
    want = {(i, n, gone, spans, brute.sha(kept)) for i, n, gone, spans, kept in brute.kept_bytes(rows, 60)}
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), brute.sha(bytes(r["kept"]))) for r in got} == want
    assert made["packed"].count() <= 12 * len(rows)
