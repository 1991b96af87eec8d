"""Texts that spell an added token have the unmodified tokenizer's ids."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ferry.llm import packing

PATH = packing.default_tokenizer()
ENCODER, REFERENCE = packing.Encoder(PATH), Tokenizer.from_file(PATH)


def reference(text):
    return [*REFERENCE.encode(text, add_special_tokens=False).ids, packing.END]


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>数", "<|endof text|>", "<|ENDOFTEXT|>"])
def test_added_tokens_have_the_tokenizers_ids(text):
    assert ENCODER.same and ENCODER(text).tolist() == reference(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", "endoftext", " ", "\n", "é", "a1", "数"]), max_size=12).map("".join))
def test_mixtures_have_the_tokenizers_ids(text):
    assert ENCODER(text).tolist() == reference(text)
