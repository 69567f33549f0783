"""Texts are encoded by units as the library encodes them whole, and the library is asked once for each unit."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer, normalizers

from decklens.llm import token_files

SIGNS = [*"ab'stdmrevl \n\t\r.,!?-12\x0b\x1c\x85\xa0éß×ªº²٠ः ᠎  　​“”’—中字か한ก😀", "'s", "'re", "'ll", " '", "  ", "\n\n", " a", " the", "<|endoftext|>"]


def ids(tokenizer, text):
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("part", [1, 7, 1 << 20])
def test_ids_are_those_of_the_library(part):
    untouched, encoder, rng = Tokenizer.from_file(token_files.TOKENIZER), token_files.UnitEncoder(token_files.TOKENIZER), random.Random(part)
    encoder.PART, encoder.MAX_UNITS = part, 300
    texts = ["", "x" * 50, *["".join(rng.choices(rng.sample(SIGNS, rng.choice([3, len(SIGNS)])), k=rng.choice([1, 3, 10, 80]))) for _ in range(1500)]]
    for some in (texts, texts[::-1], [], [""]):
        assert encoder(some) == [ids(untouched, t) for t in some]
    assert len(encoder.known) == 300


def test_kinds_are_those_of_the_library():
    untouched, encoder = Tokenizer.from_file(token_files.TOKENIZER), token_files.UnitEncoder(token_files.TOKENIZER)
    texts = [f"a{c}a 1{c}1 !{c}! {c} {c}{c}b '{c}s {c}'s\n{c}\n{c} x" for c in map(chr, range(0x800))]
    assert encoder(texts) == [ids(untouched, t) for t in texts]


def test_known_units_are_not_encoded_again(monkeypatch):
    encoder, asked = token_files.UnitEncoder(token_files.TOKENIZER), []
    texts = ["One two, three!\nFour 'five' (six); seven's 8th.", "Überall  two spaces", "Four"]
    first = encoder(texts)
    encode = encoder._bytes
    monkeypatch.setattr(encoder, "_bytes", lambda some: asked.extend(some) or encode(some))
    assert encoder(texts * 3) == first * 3 and asked == []
    # New words beside known ones are alone asked for, in one text.
    encoder(["One two? Nine (ten)"])
    assert len(asked) == 1 and sorted(asked[0].split("\n")) == [" Nine", ")", "?", "ten"]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    lower = Tokenizer.from_file(token_files.TOKENIZER)
    lower.normalizer = normalizers.Lowercase()
    path = str(tmp_path / "lower.json")
    lower.save(path)
    texts = ["One TWO, three's\n  FOUR", "", "É"]
    assert token_files.UnitEncoder(path)(texts) == [ids(lower, t) for t in texts]
