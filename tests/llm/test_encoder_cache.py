"""The encoder's cache: words as Arrow columns, each encoded once while there is room."""

import random

import public_tokenizers
import pytest

from ticketloom.llm import encode

TOKENIZERS = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.mark.parametrize("name", TOKENIZERS)
@pytest.mark.parametrize("room", [40, 600_000])
def test_ids_equal_those_of_whole_texts(monkeypatch, name, room):
    monkeypatch.setattr(encode, "CACHE_WORDS", room)
    made = encode.Encoder(public_tokenizers.path(name))
    rng = random.Random(3)
    parts = ["paper", "tray.", "tray", "(x)", "é", "İ.", "漢!", "...", "it's", "a\tb", "\n", " ", "",
             "<|endoftext|>", "é", "ab.,", "\n.", "12%"]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(300)] + ["", "..."]
    for first in range(0, len(texts), 60):
        some = texts[first:first + 60]
        assert made.encode([one.encode() for one in some]) == [made.whole(one) for one in some]


def test_a_word_is_encoded_once_however_many_follow(monkeypatch):
    made = encode.Encoder(public_tokenizers.path(TOKENIZERS[0]))
    texts = [[" ".join(f"{chr(97 + k)}w{i}q{m}" for i in range(100_000)).encode() for m in ("", ".")]
             for k in range(4)]
    for some in texts:
        made.encode([b"x " + one for one in some])
    monkeypatch.setattr(made, "whole", lambda text: pytest.fail("encoded again"))
    monkeypatch.setattr(made, "tokenizer", None)
    made.encode([b"x " + texts[0][1]])
