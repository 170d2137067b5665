import json
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm.packing import UnitIds
from weftline.llm.word_merges import WordMerges, byte_letters, fits

UNITS = UnitIds(public_tokenizers.path("word_bpe_49k.json"))
MODEL = json.loads(UNITS.tokenizer.to_str())["model"]
MERGES = WordMerges(MODEL)


def library(words):
    return [array("I", x.ids).tobytes() for x in UNITS.tokenizer.encode_batch(words, add_special_tokens=False)]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.text("abcdefghijklmnopqrstuvwxyzàéèüßñçøőşž", min_size=1, max_size=30), st.text("!?.,;:-*'\"=_~#", min_size=1, max_size=30)), max_size=40))
def test_words_like_the_library(words):
    words = [w for w in words if UNITS.split(w) == [w]]
    assert MERGES.encode(words) == library(words)


def test_long_and_repeated_words():
    words = ["a" * n for n in range(1, 70)] + ["é" * n for n in range(1, 40)] + ["ab" * 5_000, "!" * 3_000, "=-" * 999, "1", "²", "a", "a"]
    assert MERGES.encode(words) == library(words)
    assert MERGES.encode(words[::-1]) == library(words)[::-1]
    assert MERGES.encode([]) == []


@settings(deadline=None, max_examples=40)
@given(st.lists(st.text(st.characters(max_codepoint=0x24F), max_size=60), max_size=20))
def test_units_of_latin_texts(texts):
    ends = [array("I", x.ids + [1]).tobytes() for x in UNITS.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert UNITS.encode(texts) == ends


def test_other_models_are_left_to_the_library():
    assert fits(MODEL) and UNITS.merged == UNITS.merged.__self__.encode
    for name, value in {"dropout": 0.1, "byte_fallback": True, "ignore_merges": True, "continuing_subword_prefix": "##", "type": "Unigram"}.items():
        assert not fits(MODEL | {name: value})
    with pytest.raises(KeyError):
        WordMerges({"vocab": {"a": 0}, "merges": []})


def test_a_small_model_by_hand():
    letters = byte_letters()
    assert len(set(letters)) == 256
    vocab = {x: i for i, x in enumerate(letters)} | {"ab": 256, "abc": 257, "bc": 258}
    model = {"type": "BPE", "vocab": vocab, "merges": ["b c", ["a", "bc"], ["a", "b"]]}
    ids = {w: array("I", x).tolist() for w, x in zip(("abc", "ab", "aabcb"), WordMerges(model).encode(["abc", "ab", "aabcb"]), strict=True)}
    assert ids == {"abc": [257], "ab": [256], "aabcb": [vocab["a"], 257, vocab["b"]]}
    assert library_of(model, "aabcb") == ids["aabcb"]


def library_of(model, word):
    from tokenizers import models, pre_tokenizers

    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    own = Tokenizer(models.BPE(model["vocab"], merges))
    own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return own.encode(word).ids
