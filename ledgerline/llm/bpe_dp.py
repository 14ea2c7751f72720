"""Byte-level BPE by dynamic programming over prefixes, and decoding.

For every prefix of a piece the last token of its encoding is unique: it is the one token
that ends there and is compatible with the last token of the prefix before it. An
Aho-Corasick automaton over the vocabulary lists the tokens that end at each place (the
suffix matches); the pair test decides; back-pointers give the ids. Two tokens are
compatible when BPE over their joined bytes keeps the border: no merge across it, between
a part on the right edge of the first and one on the left edge of the second, comes before
the merges that use those parts up.

Text is cut into pieces by the vocabulary's own pattern. Tables are loaded once per Python
worker; encodings of recent words and of recent pieces are kept in tables of bounded size.

Work is by row in Arrow batches of bounded size. Defined cases: a null or empty text has no
ids and decodes to the empty text; texts are encoded whole, however long; repeated rows are
encoded alike; an empty table stays empty; columns of docs called token_ids or decoded are
replaced; the strings of special tokens in a text are encoded as those tokens, as the
tokenizers library does.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ledgerline.llm.common import map_texts

# Fixed value: the pattern that byte-level vocabularies cut text by.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# A space that no word follows directly, or white space of which definitions differ.
_UNEVEN = re.compile(r" (?=\s|$)|[\x1c-\x1f]")
#: Entries of each of the two generations of a table of recent results, and the longest key.
KEPT = 150_000
KEPT_LENGTH = 64
_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself where
    it prints, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class Recent:
    """Results of a function by its text, the recent ones kept in two generations."""

    def __init__(self, compute: Callable[[str], bytes]):
        self.compute = compute
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        found = self.young.get(text)
        if found is None:
            found = self.old.get(text)
            if found is None:
                found = self.compute(text)
            if len(self.young) >= KEPT:
                self.old, self.young = self.young, {}
            if len(text) <= KEPT_LENGTH:
                self.young[text] = found
        return found

    def all(self, texts: list[str]) -> list[bytes]:
        found = list(map(self.young.get, texts))
        return [self(t) if x is None else x for t, x in zip(texts, found)] if None in found else found


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab, merges = stored["model"]["vocab"], stored["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in stored["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        self.length = [0] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
            self.length[i] = len(token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.rank, self.parts, self.made = {}, {}, {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank.setdefault((a, b), rank)
            if c not in self.made:
                self.made[c], self.parts[c] = rank, (a, b)
        self.automaton = ahocorasick.Automaton()
        special_ids = set(self.special.values())
        # Bytes are written as the characters of the same number, so ASCII pieces are as they are.
        for token, i in vocab.items():
            if i not in special_ids and (len(token) == 1 or i in self.parts):
                self.automaton.add_word(self.bytes_of[i].decode("latin-1"), i)
        self.written = [np.int32(i).tobytes() for i in range(size)]
        self.automaton.make_automaton()
        self.special_pattern = (
            re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")")
            if self.special else None
        )
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self._pairs: dict[tuple[int, int], bool] = {}
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._piece = Recent(self._encode_piece)
        self._stretch = Recent(self._encode_stretch)
        self._after_space = Recent(lambda word: self._encode_stretch(" " + word))

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts along one edge of a token, with the rank at which each is used up."""
        key = (token, side)
        if key not in self._edges:
            out, used = [], _NEVER
            while True:
                out.append((token, used))
                if token not in self.parts:
                    break
                used, token = self.made[token], self.parts[token][side]
            self._edges[key] = out
        return self._edges[key]

    def compatible(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            # Equal ranks are merged from the left, so the left part is used up first.
            known = not any(
                rank < used_x and rank <= used_y
                for x, used_x in self._edge(a, 1)
                for y, used_y in self._edge(b, 0)
                if (rank := self.rank.get((x, y))) is not None
            )
            if len(self._pairs) > 500_000:
                self._pairs.clear()
            self._pairs[(a, b)] = known
        return known

    def _encode_piece(self, piece: str) -> bytes:
        """Ids of a piece, as 32-bit integers."""
        text = piece if piece.isascii() else piece.encode().decode("latin-1")
        # last[n]: the last token of the first n bytes; none has been found yet where it is -1.
        last = [-1] * (len(text) + 1)
        length, pair, compatible = self.length, self._pairs.get, self.compatible
        for end, token in self.automaton.iter(text):
            at = end + 1
            if last[at] < 0:
                before = at - length[token]
                if before == 0:
                    last[at] = token
                elif (a := last[before]) >= 0:
                    known = pair((a, token))
                    if known or (known is None and compatible(a, token)):
                        last[at] = token
        out, at = [], len(text)
        while at:
            token = last[at]
            out.append(self.written[token])
            at -= length[token]
        out.reverse()
        return b"".join(out)

    def _encode_stretch(self, text: str) -> bytes:
        """Ids of a stretch that starts and ends at piece borders."""
        if (text[1:] if text[0] == " " else text).isalpha():
            return self._encode_piece(text)
        return b"".join(self._piece.all(PIECES.findall(text)))

    def _plain(self, text: str) -> list[bytes]:
        if not text:
            return []
        plain = text.isascii() or max(text) <= "\u0557"
        if not plain and any(unicodedata.category(c) == "Cn" for c in set(text)):
            # Unicode versions class such characters differently; the library's cut counts.
            pieces = [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]
            return self._piece.all(pieces)
        if _UNEVEN.search(text):
            return self._piece.all(PIECES.findall(text))
        # A piece begins at every single space, so words can be looked up one by one.
        first, *rest = text.split(" ")
        return [self._stretch(first) if first else b"", *self._after_space.all(rest)]

    def encode(self, text: str) -> np.ndarray:
        if self.special_pattern is None:
            parts = self._plain(text)
        else:
            parts = []
            for piece in self.special_pattern.split(text):
                if piece in self.special:
                    parts.append(self.written[self.special[piece]])
                elif piece:
                    parts += self._plain(piece)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))


def encode(
    docs: DataFrame, vocabulary: str, text_col: str = "text", decoded: bool = False, keep_text: bool = True
) -> DataFrame:
    """docs with token_ids, and with decoded: the text those ids decode to. vocabulary is a
    file that every worker can read. Without keep_text the text column is left out."""

    def make():
        bpe = load(vocabulary)

        def work(texts: pa.Array) -> dict:
            ids = [bpe.encode(t) for t in texts.to_pylist()]
            out = {"token_ids": list_array(ids, pa.int32())}
            if decoded:
                out["decoded"] = pa.array([bpe.decode(x) for x in ids], pa.string())
            return out

        return work

    fields = [T.StructField("token_ids", T.ArrayType(T.IntegerType(), True))]
    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))
    return map_texts(docs, text_col, make, fields, keep_text)
