import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import documents, frame
from weftline.llm.packing import dearest, pack_pieces, packed_documents, plan, slots, token_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


def token_ids(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


HARD = [
    (800, "It's  o'clock’s 1st 2nd 3,000 über-cool <|endoftext|> </w> don't"), (801, "x\u2028y\u00a0z\u200b — «é» ﬁ Ⅷ ǅ İ ẞ"),
    (802, "日本語 テキスト 한국어 русский عربى"), (803, "a_b__c ~~ !!! ''' 's S 'S 'Re"), (804, "\x00\x1f tab\ttab\nline\r\n"),
]


def test_pieces_are_the_whole_texts(spark):
    rows = documents() + HARD
    got = defaultdict(list)
    for r in token_pieces(frame(spark, rows), PATH, capacity=64).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], bytes(r["ids"])))
    for doc_id, text in rows:
        parts = sorted(got[doc_id])
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert all(p[2] == 64 for p in parts[:-1]) and [p[1] for p in parts] == [64 * i for i in range(len(parts))]
        assert b"".join(p[3] for p in parts) == array("I", token_ids(text)).tobytes(), (doc_id, text)


def check_packed(rows, capacity):
    inside = defaultdict(list)
    for r in rows:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in inside.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return inside


def test_op_rows(spark):
    rows = documents()
    got = packed_documents(frame(spark, rows)).collect()
    check_packed(got, 4096)
    by_doc = defaultdict(dict)
    for r in got:
        by_doc[r["doc_id"]][r["piece"]] = r
    for doc_id, text in rows:
        ids = token_ids(text)
        for piece, at in enumerate(range(0, len(ids), 4096)):
            r = by_doc[doc_id].pop(piece)
            part = ids[at : at + 4096]
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(part), zlib.crc32(array("I", part).tobytes()))
        assert not by_doc[doc_id]
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= -(-total // 4096) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 300), max_size=30))
def test_plan_holds_every_piece_once(histogram):
    groups = plan(histogram, 100)
    held = defaultdict(int)
    for times, inside in groups:
        assert times > 0 and sum(inside) <= 100
        for n in inside:
            held[n] += times
    assert dict(held) == histogram
    table = slots(groups, 100)
    assert (np.diff(table["length"]) >= 0).all()


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    lengths, counts = np.unique(np.minimum(1 + rng.exponential(700, 20_000).astype(int), 4096), return_counts=True)
    used = sum(t for t, _ in plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), 4096))
    assert used <= 1.01 * -(-int((lengths * counts).sum()) // 4096)


def test_knapsack():
    counts = dearest(np.array([3, 5, 7]), np.array([3.1, 5.6, 7.0]), 13)
    assert counts.tolist() == [1, 2, 0]


def test_pack_pieces_keeps_other_columns(spark):
    rows = spark.createDataFrame([(i, 0, 1 + i % 9, f"n{i}", -1) for i in range(500)], "doc_id long, piece int, length long, offset string, x int")
    got = pack_pieces(rows, capacity=10).collect()
    check_packed(got, 10)
    assert len(got) == 500 and set(got[0].asDict()) == {"doc_id", "piece", "length", "x", "sequence_id", "offset"}


@pytest.mark.parametrize("rows", [[], [(None, None), (None, None), (4, "")]])
def test_empty_tables_and_null_ids(spark, rows):
    got = packed_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    check_packed(got, 4096)


def test_repeated_ids_have_places_of_their_own(spark):
    rows = [(7, t, "en") for t in ("one two", "two one", "one six", "six one")] * 3
    got = [tuple(r) for r in packed_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).select("sequence_id", "offset", "length", "ids_crc32").collect()]
    again = [tuple(r) for r in packed_documents(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string").repartition(5)).select("sequence_id", "offset", "length", "ids_crc32").collect()]
    assert sorted(got) == sorted(again) and len({r[:2] for r in got}) == 12
