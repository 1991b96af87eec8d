"""Whole texts with very long runs of white space have the tokenizer's ids."""

import pytest
from tokenizers import Tokenizer

from ferry.llm import packing


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n \t " * 500_000, " " * 99_999, " " * 100_000])
def test_long_blanks_have_the_tokenizers_ids(run):
    text, path = f"before{run}after  it", packing.default_tokenizer()
    assert packing.Encoder(path)(text).tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, packing.END]
