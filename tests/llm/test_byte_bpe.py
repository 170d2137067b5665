import base64

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tests.llm.cases import documents, frame
from tests.llm.test_packing import HARD
from weftline.llm.byte_bpe import Utf8Decoder, decode_ids, encode_texts, encoder

PATH = P.path("byte_bpe_multi_50k.tiktoken")
OWN = encoder(PATH, P.PATTERN)


def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


LIBRARY = library()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aehinorstl' \n", max_size=80), st.text("äöüßéèñ¿日本語🎉 ", max_size=40)))
def test_like_the_library(text):
    ids = OWN.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert OWN.decoder.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=30))
def test_streaming_decode_of_any_bytes(data):
    decoder = Utf8Decoder({i: bytes([i]) for i in range(256)})
    assert decoder.decode(data) == data.decode("utf-8", "replace")


def test_small_stores_change_nothing(monkeypatch):
    import weftline.llm.byte_bpe as module

    monkeypatch.setattr(module, "STATES", 20)
    own = module.Encoder(module.read_ranks(PATH), P.PATTERN)
    for _, text in documents()[:30] + HARD:
        assert own.encode(text) == LIBRARY.encode_ordinary(text)


def test_tables(spark):
    rows = documents() + HARD
    encoded = encode_texts(frame(spark, rows).repartition(3), PATH, P.PATTERN)
    got = {r["doc_id"]: r for r in decode_ids(encoded, PATH, P.PATTERN).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        want = LIBRARY.encode_ordinary(text or "")
        assert bytes(got[doc_id]["ids"]) == b"".join(i.to_bytes(4, "little") for i in want)
        assert brute.sha(got[doc_id]["text"].encode()) == brute.sha((text or "").encode())


def test_empty_table_and_null_ids(spark):
    assert decode_ids(encode_texts(frame(spark, []), PATH, P.PATTERN), PATH, P.PATTERN).collect() == []
    assert encode_texts(frame(spark, [(None, "a"), (None, "a")]), PATH, P.PATTERN).count() == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.binary(min_size=1, max_size=40), st.text("aehinorst' ", min_size=1, max_size=64).map(str.encode)), min_size=1, max_size=8))
def test_many_pre_tokens_in_lockstep(pieces):
    got = [np.frombuffer(ids, np.uint32).tolist() for ids in OWN.lockstep.encode(pieces)]
    assert got == [[OWN.transducer.ranks[t] for t in OWN.transducer.merge(piece)] for piece in pieces]


def test_new_short_words_take_no_transitions_of_their_own(monkeypatch):
    import weftline.llm.byte_bpe as module

    monkeypatch.setattr(module, "UNITS", 300)
    monkeypatch.setattr(module, "PIECES", 200)
    own = module.Encoder(module.read_ranks(PATH), P.PATTERN)
    made = [f"{a}{b}{c}th" for a in ("qan", "onr", "ble", "ti", "É") for b in ("zhe", "in", "ere", "日本") for c in ("wof", "ent", "x", "-in")]
    texts = [" ".join(made), "\n".join(made), "  ".join(made), " ".join(made) + " ", "", " ", " ".join(made[::3]) + " a\n b\t c"]
    for batch in (texts, texts[:2], texts[::-1]):
        assert [np.frombuffer(ids, np.uint32).tolist() for ids in own.packed(batch)] == LIBRARY.encode_ordinary_batch(batch)
    assert len(own.transducer.states) == 1
