"""Ids by words equal the library's on whole texts, also when words come back or the table turns over."""

from ledgerline.llm import word_tokens
from ledgerline.llm.queries import WORD_BPE

TEXTS = [
    "a.b. c! d? e.g. 3.14. word, word. Word", "<|x|> <| y", "\x1cq word \x1f", "É. naïve. ñandú, İx", "日本 abc.",
    "... ! ,", "x" * 80 + ". " + "x" * 80, "", "  ", "word. word, word! Word?",
]


def test_ids_equal_the_library(monkeypatch):
    for kept in (word_tokens.KEPT_WORDS, 3):
        monkeypatch.setattr(word_tokens, "KEPT_WORDS", kept)
        tokens = word_tokens.WordTokens(WORD_BPE)
        for text in TEXTS * 3:
            assert tokens.encode(text).tolist() == tokens.library.encode(text, add_special_tokens=False).ids
