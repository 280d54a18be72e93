"""Ids of remembered words against whole texts, and what is handed to the tokenizer for them."""

import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

FILE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "Bé", "ß", " ", " ", "  ", "\n", "\r\n", "\t", " ", "　", "\x1c", "'s", "'ll", " 's", "12", "Ġ", "日本", "😀", "...", "<|endoftext|>"]


def random_texts(n):
    rng = random.Random(9)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("plain", [False, True])
def test_ids_are_those_of_whole_texts(monkeypatch, plain):
    from tagloom.llm import packing

    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    whole = Tokenizer.from_file(FILE)
    whole.encode_special_tokens = plain
    words = packing.WordTokenizer(FILE, plain=plain)
    for text in random_texts(3000):
        assert words(text) == array("I", whole.encode(text, add_special_tokens=False).ids).tobytes(), repr(text)


def test_unknown_words_of_a_text_are_one_string(monkeypatch):
    from tagloom.llm import packing

    words = packing.WordTokenizer(FILE)
    alone, encoded = [], words._encoded
    monkeypatch.setattr(words, "_encoded", lambda pieces: encoded(alone.extend(pieces) or pieces))
    words("first " + " ".join(f"w{i}x" for i in range(300)))
    assert alone == ["first"]


def test_words_met_again_outlive_one_new_start_of_the_memory(monkeypatch):
    from tagloom.llm import packing

    class Counting:
        def __init__(self, own):
            self.own, self.seen = own, []

        def encode(self, text, **kwargs):
            self.seen += text.split()
            return self.own.encode(text, **kwargs)

    monkeypatch.setattr(packing, "CACHE_WORDS", 30)
    words = packing.WordTokenizer(FILE)
    words._whole = Counting(words._whole)
    for i in range(100):
        words("x often met " + " ".join(f"rare{i}n{j}" for j in range(8)))
    assert words._whole.seen.count("often") == words._whole.seen.count("met") == 1
