import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loreforge.llm.tokens import WordTokens, tokenizer_path

TEXTS = ["a <|endoftext|> b", "plain words", "<|endoftext|>", "x<|startoftext|>y <|endoftext|><|endoftext|> z", "", "<|ENDOFTEXT|> <|endoftext| >", "plain words <|endoftext|>\nmore"]


@pytest.mark.parametrize("name, glued", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens_get_the_ids_of_the_tokenizer_as_loaded(name, glued):
    fresh, encoder = Tokenizer.from_file(tokenizer_path(name)), WordTokens(tokenizer_path(name), glued)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(TEXTS)] == [fresh.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert encoder.encode(TEXTS[:1]) == encoder._ids(TEXTS[:1]) and encoder.encode([]) == []


MIXED = st.text(st.one_of(st.sampled_from("aBzéßÀİıΣςńǅﬁ²½٣가힣ᄀ\u0307\u0301.,'!?-_ \n\t\u00a0\u3000日語"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.mark.parametrize("name, glued", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_of_any_text_are_those_of_a_fresh_tokenizer(name, glued):
    fresh, encoder = Tokenizer.from_file(tokenizer_path(name)), WordTokens(tokenizer_path(name), glued)
    fixed = ["ilk KAYSERİ.", "İ", "İ.İ", "KAYSERİ.\nİSTANBUL, x", "a İ! b", "'İs it's", "Σ. ΣΑΣ.", "ᄀ\u1161. x", "e\u0301. f"]

    @settings(max_examples=400, deadline=None)
    @given(st.lists(MIXED, max_size=4))
    def check(texts):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]

    check()
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(fixed)] == [fresh.encode(t, add_special_tokens=False).ids for t in fixed]
