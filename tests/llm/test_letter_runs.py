"""Words put together from runs of letters and marks, against ids of whole texts."""

import random
from array import array

import public_tokenizers
import pytest
from tokenizers import AddedToken, Tokenizer, pre_tokenizers

FILE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["word", "Bé", "ɏ", "ɐ", "×", "日", "ª", " ", " ", " ", "\n", "\n\n", ",", "$$$", "_", "'", "'s", "-", "12", "<|", "endoftext", "|>", "\xad"]


def ids(whole, text):
    return array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("plain", [False, True])
def test_runs_give_the_ids_of_whole_texts(monkeypatch, plain):
    from tagloom.llm import packing

    monkeypatch.setattr(packing, "CACHE_WORDS", 60)
    whole = Tokenizer.from_file(FILE)
    whole.encode_special_tokens = plain
    words, rng = packing.WordTokenizer(FILE, plain=plain), random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(30)))
        assert words(text) == ids(whole, text), repr(text)


def test_a_run_is_encoded_once_for_all_marks_around_it():
    from tagloom.llm import packing

    class Counting:
        def __init__(self, own):
            self.own, self.seen = own, []

        def encode(self, text, **kwargs):
            self.seen += text.split()
            return self.own.encode(text, **kwargs)

    whole, words = Tokenizer.from_file(FILE), packing.WordTokenizer(FILE)
    words._whole = Counting(words._whole)
    for text in ["x often, met", "x often.\nMet! y", "x often$$$ y"]:
        assert words(text) == ids(whole, text)
    assert words._whole.seen.count("often") == 1


@pytest.mark.parametrize("kind", ["added token", "no pattern"])
def test_other_vocabularies_are_not_cut_to_runs(tmp_path, kind):
    from tagloom.llm import packing

    whole = Tokenizer.from_file(FILE)
    if kind == "added token":
        whole.add_tokens([AddedToken("n,", normalized=False)])
    else:
        whole.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
    whole.save(str(tmp_path / "own.json"))
    words = packing.WordTokenizer(str(tmp_path / "own.json"))
    for text in ["x often, then... when, then", "men, women,\nand all. (others)"]:
        assert words(text) == ids(whole, text)
