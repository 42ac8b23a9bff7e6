"""Ids of white-space pieces against the tokenizers library, on random texts of letters that change under lower-casing or NFC."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veridan.llm.token_files import Pieces

LETTERS = [*"aZzkKHEi.,!?;:*'&%$#| 0\n\t-_", "İ", "I", "̇", "́", "̱", "é", "É", "ß", "ÿ", "Σ", "ς", "क़", "日", "K", "²", "½", "ﬁ", "Ⅷ", "ͅ", "ǰ", "̸", "<", "Å", " ", " "]


@pytest.mark.parametrize("limit", [500_000, 50])
def test_pieces_equal_the_library(limit):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library, rng = Pieces(path), Tokenizer.from_file(path), random.Random(5)
    own.limit = limit
    for _ in range(10):
        texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 30))) for _ in range(1000)]
        texts += [None, "", "İ.", "İ!", "fİ, x", "word. word, word", "H̱. x", "क़. क़, y"]
        for t, ids, e in zip(texts, own.ids(texts), library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False), strict=True):
            assert ids.tolist() == e.ids, repr(t)
