import random

import numpy as np
import public_tokenizers
import pytest

from papershed.llm import tokens as T

PARTS = ["É.", "don,", "naïve!", "ŒUVRE", "Ĳ", "ªº", "ß", " ", "  ", "\n", " \n", "\n ", " ", "\t", "a", "b's", "don't", "<|endoftext|>", "12", "漢字", "\x1c", "İ", "Σ", "word"]


@pytest.mark.parametrize("name, spaces", [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "leading")])
def test_ids_are_those_of_whole_texts(name, spaces):
    encoder = T.Encoder(T.specification(public_tokenizers.path(name)), spaces)
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "WORDS_KEPT", 10)
    encoder = T.Encoder(T.specification(public_tokenizers.path("byte_bpe_50k.json")), "leading")
    encoder.encode([" ".join(f"w{k}" for k in range(500))])
    assert len(encoder.words) <= 10
