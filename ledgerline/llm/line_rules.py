"""Quality rules, line first: lines that fail a rule go, then documents that lose too much.

A line (split at newlines) with a word fails when one of these holds:

- markup: at least half as many of the characters # * $ % & | < > { } as words that are
  not made of them alone;
- punctuation: no closing punctuation at its end and fewer than five words, or at least
  half as many exclamation marks as words and more than two;
- navigation: separators (| > » › • · and a hyphen between spaces) cut it into three or more
  items, and more than half of these have at most three words and no closing punctuation;
- boilerplate: it holds one of the phrases of BOILERPLATE, in any letter case.

In a line that ends with closing punctuation hyphens are dashes of a sentence and cut nothing,
nor does a dot between two l (Catalan). Links side by side without any separator are words in a
row like a title's, and stay.

A document is rejected when base counts fail (fewer than 50 words, or more than half of the
words inside repeated three-word windows), or when the lines that pass hold less than half
of its word characters.

Work is by row, in Arrow batches of bounded size; no rows move. Defined cases: a null text
has no words and is rejected; texts are read whole; repeated rows are judged alike; columns
with the names of results are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerline.llm.common import map_texts
from ledgerline.llm.textscan import Texts, counts_per, repeats

# Characters counted as symbols in the base counts.
SYMBOLS = "#*$%&|<>"
MARKUP = "#*$%&|<>{}»›•"
CLOSING = ".!?…:;\"')]}»”’"
BOILERPLATE = (
    "all rights reserved",
    "terms of service",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "subscribe to our newsletter",
    "click here to",
    "skip to content",
    "back to top",
)
ITEMS, ITEM_WORDS = 3, 3
MIN_WORDS = 50
MAX_REPEATED = 0.5
MAX_LOST = 0.5

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE | re.ASCII)
_MARKUP = re.compile("[" + re.escape(MARKUP) + "]")
_ONLY_MARKUP = re.compile("[" + re.escape(MARKUP) + "]+")
_SEPARATOR = r"[|>»›•]|(?<![lL])·|·(?![lL])"
_BARS = re.compile(_SEPARATOR)
_BARS_AND_HYPHENS = re.compile(_SEPARATOR + r"|(?<=[\x20\x09])-(?=[\x20\x09])")


def is_navigation(line: str, end: str) -> bool:
    """Whether a line, whose last character that is no space is end, is a bar of links."""
    pieces = (_BARS if end and end in CLOSING.replace("»", "") else _BARS_AND_HYPHENS).split(line)
    if len(pieces) < ITEMS:
        return False
    items = short = 0
    for piece in pieces:
        words = _WORDS.findall(piece)
        if words:
            items += 1
            short += len(words) <= ITEM_WORDS and words[-1][-1] not in CLOSING
    return items >= ITEMS and 2 * short > items


def line_passes(line: str, found: list[str]) -> bool:
    words = sum(1 for w in found if not _ONLY_MARKUP.fullmatch(w))
    if 2 * len(_MARKUP.findall(line)) >= words:
        return False
    end = line.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1:]
    if end not in CLOSING and words < 5:
        return False
    shouts = line.count("!")
    if shouts > 2 and 2 * shouts >= words:
        return False
    if is_navigation(line, end):
        return False
    return not _BOILERPLATE.search(line)


def clean(text: str) -> tuple[str, int]:
    """The text without failing lines, and the word characters that are left. Lines without
    a word stay where they are."""
    kept, chars = [], 0
    for line in text.split("\n"):
        words = _WORDS.findall(line)
        if not words:
            kept.append(line)
        elif line_passes(line, words):
            kept.append(line)
            chars += sum(map(len, words))
    return "\n".join(kept), chars


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    t = Texts(texts)
    raw, bounds = t.raw, t.bounds
    n_words = np.diff(t.word_bounds)
    lead = (raw & 0xC0) != 0x80  # first byte of each code point
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True

    # Lines: between newlines and text bounds.
    newline = np.flatnonzero(raw == 10)
    line_starts = np.sort(np.concatenate([bounds[:-1], newline + 1]))
    line_docs = np.repeat(np.arange(t.size), 1 + counts_per(raw == 10, bounds))
    line_ends = np.empty_like(line_starts)
    last = np.ones(len(line_docs), bool)
    last[:-1] = line_docs[1:] != line_docs[:-1]
    line_ends[last] = bounds[1:]
    line_ends[~last] = newline
    has_word = np.searchsorted(t.starts, line_starts) < np.searchsorted(t.starts, line_ends)
    lines = t.hashes(line_starts[has_word], line_ends[has_word])
    _, again = repeats(line_docs[has_word], lines)

    # Words inside three-word windows that occur at least twice in their text.
    windows, first = t.windows(3)
    several, _ = repeats(t.docs[first], windows)
    covered = np.zeros(len(t.starts) + 3, bool)
    for j in range(3):
        covered[first[several] + j] = True
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": counts_per(t.inside & lead, bounds),
        "n_symbols": counts_per(symbol[raw], bounds),
        "n_dup_lines": np.bincount(line_docs[has_word][again], minlength=t.size).astype(np.int64),
        "n_repeat_words": counts_per(covered[: len(t.starts)], t.word_bounds),
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_rules(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the base counts, base_failed, cleaned_text, kept_chars and kept. Without
    keep_text the text column is left out."""

    def make():
        def work(texts: pa.Array) -> dict:
            columns = base_counts(texts)
            cleaned = [clean(x) for x in texts.to_pylist()]
            left = np.array([c for _, c in cleaned], np.int64)
            words, repeated = columns["n_words"], columns["n_repeat_words"]
            failed = (words < MIN_WORDS) | (repeated > MAX_REPEATED * words)
            lost = left < (1 - MAX_LOST) * columns["word_chars"]
            return columns | {
                "base_failed": failed,
                "cleaned_text": pa.array([x for x, _ in cleaned], pa.string()),
                "kept_chars": left,
                "kept": ~failed & ~lost,
            }

        return work

    fields = [T.StructField(n, T.LongType()) for n in _COUNTS] + [
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("cleaned_text", T.StringType()),
        T.StructField("kept_chars", T.LongType()),
        T.StructField("kept", T.BooleanType()),
    ]
    return map_texts(docs, text_col, make, fields, keep_text)
