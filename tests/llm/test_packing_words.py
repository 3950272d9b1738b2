import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Full

from promptloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_new_plain_words_of_a_text_are_looked_at_together(monkeypatch):
    t, looked = packing.Tokenizer(PATH), []
    monkeypatch.setattr(t, "word", lambda x, plain=t.word: looked.append(x) or plain(x))
    t.encode("Some plain Wörter, of all kinds: 3.14 (and) ÀÉÎ ß x" + "y" * 100)
    assert not looked


@pytest.mark.parametrize("text", ["Ab ab AB ab, " + "z" * 100 + " " + "Z" * 100, "ÀÉ 12ab ß! a-b_c 'x'", "plain and <|endoftext|> then plain", "á plain", "÷ × ª ¹", "a b c"])
def test_words_met_before_or_not_give_the_same_tokens(text):
    t, want = packing.Tokenizer(PATH), np.array(Full.from_file(PATH).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert [t.encode(text) for _ in range(2)] == [want, want]
