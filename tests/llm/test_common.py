import threading

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.common import free, hash_words, hashed_words, materialise, sequence_hashes, settled, text_slices


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=6), st.booleans())
def test_hashed_words(texts, lower):
    hashes, sizes = hashed_words(texts, lower)
    split = [bytes(c + 32 if 65 <= c <= 90 and lower else c for c in t).split() for t in texts]
    assert sizes.tolist() == list(map(len, split))
    words = [w for part in split for w in part]
    seen = {}
    for w, h in zip(words, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert hash_words(words).tolist() == hashes.tolist()


def test_text_slices():
    texts = pa.array(["a b", None, "", "x " * 400_000, "b a"])
    found = list(text_slices(texts))
    assert [f[0] for f in found] == [0, 4]
    assert found[0][2].tolist() == [2, 0, 0, 400_000] and found[1][2].tolist() == [2]
    assert found[0][1][0] == found[1][1][1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 12))
def test_sequence_hashes(items, n):
    found = sequence_hashes(np.array(items, np.uint64), n).tolist()
    want = [tuple(items[i : i + n]) for i in range(len(items) - n + 1)]
    assert len(found) == len(want)
    assert len(set(found)) == len(set(want)) == len(set(zip(found, want, strict=True)))


def test_settled_deletes_its_own_tables_only(spark):
    there = lambda df: df.count() if df is not None else 0
    kept = {}

    def stage():
        kept["inner"] = settled(lambda: materialise(spark.range(3), "deep"), "inner")
        own = materialise(spark.range(4), "own")
        # another call of another thread writes a table meanwhile
        thread = threading.Thread(target=lambda: kept.setdefault("other", materialise(spark.range(5), "other")))
        thread.start()
        thread.join()
        kept["own"] = own
        return own.union(kept["inner"])

    before = materialise(spark.range(2), "before")
    out = settled(stage, "out")
    assert there(out) == 7 and there(kept["other"]) == 5 and there(before) == 2
    for gone in ("own", "inner"):
        with pytest.raises(Exception, match="(?i)path|file"):
            there(kept[gone])
    free(out, kept["other"], before)
    for gone in (out, kept["other"], before):
        with pytest.raises(Exception, match="(?i)path|file"):
            there(gone)
