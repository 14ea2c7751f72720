"""Token ids of a vocabulary with word ends, made by the tokenizers library word by word.

The vocabulary's pattern never joins characters across white space, so a text's ids are
those of its words in turn. Ids of recent words are kept in a table of bounded size, and
only new words go to the library. Texts for which cutting at white space might differ from
the library's normalising (special tokens, letters beyond U+02FF, rare controls) go to it
whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from tokenizers import Tokenizer

from ledgerline.llm.bpe_dp import byte_letters

KEPT_WORDS = 300_000
_WHOLE = re.compile("[\x1c-\x1fİ]|[^\x00-˿]|<\\|")
_WHOLE_ASCII = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")


def _goes_whole(text: str) -> bool:
    if text.isascii():
        return any(mark in text for mark in _WHOLE_ASCII)
    return _WHOLE.search(text) is not None


class WordTokens:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._letters = byte_letters()
        self._words: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def size(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether a sentence can end with it."""
        out = np.zeros(self.size(), bool)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            out[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?") and token.endswith("</w>")
        return out

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """A word of letters is one piece, so the library's model gets it without the steps
        before; other words go through all of them."""
        letters, tokenize = self._letters, self.library.model.tokenize
        out = []
        for w in words:
            if w.isalpha():
                # A byte's letter is itself where it is an ASCII letter.
                piece = w if w.isascii() else "".join([letters[b] for b in w.encode()])
                out.append(array("I", [t.id for t in tokenize(piece)]).tobytes())
            else:
                out += self._library([w])
        return out

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def encode(self, text: str) -> np.ndarray:
        if _goes_whole(text):
            return np.frombuffer(self._library([text])[0], np.uint32)
        # The vocabulary is in lower case, so spellings share an entry.
        words = text.lower().split()
        ids = list(map(self._words.get, words))
        gaps = [i for i, x in enumerate(ids) if x is None]
        if gaps:
            extra = self._learn({words[i] for i in gaps})
            for i in gaps:
                ids[i] = extra[words[i]]
        return np.frombuffer(b"".join(ids), np.uint32)

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of words outside the newer table; they enter it. A word's single closing mark
        is a piece of its own, so the word before it is looked up alone."""
        have, older = self._words, self._older
        extra, unknown, closed = {}, set(), []
        for w in new:
            if w in older:
                extra[w] = older[w]
            elif w[-1] in ".,!?" and w[:-1].isalpha():
                closed.append((w, w[:-1], w[-1]))
            else:
                unknown.add(w)
        for _, *parts in closed:
            for part in parts:
                if part in have or part in extra:
                    continue
                if part in older:
                    extra[part] = older[part]
                else:
                    unknown.add(part)
        if unknown:
            unknown = list(unknown)
            extra.update(zip(unknown, self._word_ids(unknown)))
        joined = {w: (extra[s] if s in extra else have[s]) + (extra[m] if m in extra else have[m]) for w, s, m in closed}
        if len(have) + len(extra) > KEPT_WORDS:
            self._older, self._words = have, {}
        self._words.update([(w, x) for w, x in extra.items() if len(w) <= 64])
        extra.update(joined)
        return extra


_LOADED: dict[str, WordTokens] = {}


def load(path: str) -> WordTokens:
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]
