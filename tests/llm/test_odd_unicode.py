"""Ids of odd texts are those of the tokenizers library, whichever way they are made; the library's own errors are not hidden."""

import random

import public_tokenizers
import pytest

from promptscreen.llm import packing

RANGES = [(0, 0x80), (0x80, 0x250), (0x300, 0x370), (0x370, 0x600), (0x600, 0x900), (0x0E00, 0x0E80), (0x1100, 0x1200), (0x2000, 0x2070), (0x20A0, 0x2C00), (0x3000, 0x30FF), (0x4E00, 0x5000), (0xAC00, 0xAD00), (0xE000, 0xE010), (0xFE00, 0xFF00), (0xFFF0, 0x10000), (0x10000, 0x10200), (0x1D400, 0x1D500), (0x1F300, 0x1FAFF), (0xE0020, 0xE0080), (0x10FFF0, 0x110000)]


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path(packing.TOKENIZER)))
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_random_characters():
    rng = random.Random(6)
    ranges = lambda: [rng.choice(RANGES) for _ in range(rng.randint(1, 4))]
    texts = []
    for _ in range(3000):
        own = ranges()
        texts.append("".join(chr(rng.randrange(*rng.choice(own))) if rng.random() < 0.85 else rng.choice([" ", "  ", "\n", "\r\n", "\t", " ", "　", "'s", "'LL", "12", "<|endoftext|>"]) for _ in range(rng.randint(0, 40))))
    encode = packing.encoder(str(public_tokenizers.path(packing.TOKENIZER)))
    assert encode(texts) == plain(texts)


def test_joined_and_long_runs():
    texts = ["\U0001f468‍\U0001f469‍\U0001f467️" * 50, "é" * 500, " " * 5000 + "x", "\n" * 3000, "a" * 20_000, "​" * 400, "١٢٣٤" * 100, "Ⅷ½²" * 100, "'s't're've" * 100, "\x00\x01\x7f\x85  " * 30]
    encode = packing.encoder(str(public_tokenizers.path(packing.TOKENIZER)))
    assert encode(texts) == plain(texts)


def test_errors_are_not_hidden():
    encode = packing.encoder(str(public_tokenizers.path(packing.TOKENIZER)))
    with pytest.raises(TypeError):
        encode([None])


def test_strings_of_added_tokens():
    """As the library has it: ids of their own, and what stands around them is split apart."""
    encode = packing.encoder(str(public_tokenizers.path(packing.TOKENIZER)))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x<|endoftext|>y", "<|endoftext", "a  <|endoftext|>\n\n'll " * 300]
    assert encode(texts) == plain(texts)
    assert encode.__name__ == "fast" and encode(texts)[0] == [64, 220, 50256, 275]
