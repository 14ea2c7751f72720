"""Language identification by words: script ranges narrow the candidates, a Viterbi pass with
a switching penalty labels every word, and runs of one label are the spans.

Model: for each language, log probabilities of hashed letter n-grams (1 to 3, with word
edges), and the share of its letters in each script. A word's candidates are the languages
that use its script; its score for a language is the sum over its n-grams. Changing language
between two words costs SWITCH.

Training counts n-grams over a sample of labelled texts, bounded by PER_LANGUAGE texts for
each language (taken by a hash of the text, so repeatably); the counts are summed by Spark
and number at most languages x BUCKETS. Prediction is by row in Arrow batches; a batch's
texts advance together, one word per step, so a long text costs steps and not memory.

Defined cases: a text that is null, empty or without letters is `und` with score 0 and no
spans, marks alone being no letters; equal totals go to the language first in order; with
nothing to learn from every text is `und`; repeated rows are labelled alike, and copies of a
text are learnt from once; an empty table stays empty; columns of docs called lang_pred,
score or lang_spans are replaced.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import hash_share, map_texts, text_slices
from ledgerline.llm.textscan import mix

BUCKETS = 1 << 16
PER_LANGUAGE = 2000
SWITCH = 25.0
MIN_SCRIPT_SHARE = 0.01
NGRAMS = 3

# First code point of each range, and its script.
SCRIPT_RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"),
    (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"),
    (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFEFF, "other"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"),
    (0x20000, "han"), (0x323B0, "other"),
)
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_RANGE_STARTS = np.array([a for a, _ in SCRIPT_RANGES])
_RANGE_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])
_LETTER, _MARK = 1, 2
_KIND: list[np.ndarray] = []


def _kind(point: int) -> int:
    return {"L": _LETTER, "M": _MARK}.get(unicodedata.category(chr(point))[0], 0)


def _kinds(points: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter, a mark or neither."""
    if not _KIND:
        _KIND.append(np.array([_kind(i) for i in range(1 << 16)], np.int8))
    out = _KIND[0][np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        out[i] = _kind(points[i])
    return out


def _in_word(points: np.ndarray) -> np.ndarray:
    """Which code points belong to words: letters, and marks that follow a letter or another
    such mark. Marks elsewhere, as on emoji or key caps, make no word."""
    kind = _kinds(points)
    inside = kind == _LETTER
    marks = np.flatnonzero(kind == _MARK)
    if len(marks):
        # Of each run of marks, the place before its first one decides for all.
        first = np.concatenate([[True], np.diff(marks) > 1])
        before = marks[first] - 1
        decided = (before >= 0) & inside[before]
        inside[marks] = decided[np.cumsum(first) - 1]
    return inside


class Words:
    """The words (runs of letters and their marks) of a batch of texts with their hashed n-grams."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        # One more character after each text, so that no word or n-gram spans two texts.
        points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
        letter = _in_word(points)
        edge = np.zeros(len(points), bool)
        edge[1:] = letter[:-1]
        self.starts = np.flatnonzero(letter & ~edge)
        edge[:] = False
        edge[:-1] = letter[1:]
        self.ends = np.flatnonzero(letter & ~edge) + 1
        self.sizes = self.ends - self.starts
        self.word_bounds = np.searchsorted(self.starts, bounds)
        # Letters with one place before and after each word for its edges.
        place = np.repeat(np.arange(len(self.starts)), self.sizes)
        self.first = np.concatenate([[0], np.cumsum(self.sizes + 2)])
        padded = np.zeros(self.first[-1], np.uint64)
        letters = points[letter].astype(np.uint64)
        padded[np.arange(len(letters)) + 2 * place + 1] = letters
        self.padded = padded
        script = _RANGE_SCRIPT[np.searchsorted(_RANGE_STARTS, letters, "right") - 1]
        at = self.starts.size and np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.scripts = script[at] if self.starts.size else np.zeros(0, np.int64)

    def grams(self, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of the n-gram that begins at each place of padded, and whether it lies in
        one word."""
        p = self.padded
        size = len(p) - n + 1
        if size <= 0:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        code = np.full(size, np.uint64(n), np.uint64)
        for j in range(n):
            code = code * np.uint64(0x100000001B3) + p[j : j + size]
        word = np.repeat(np.arange(len(self.sizes)), self.sizes + 2)
        return (mix(code) % np.uint64(buckets)).astype(np.int64), word[:size] == word[n - 1 :]


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x languages
    scripts: np.ndarray  # scripts x languages: whether the language uses the script
    buckets: int


def train(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    buckets: int = BUCKETS,
) -> Model:
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where(
        "text is not null and lang is not null"
    )
    rows = rows.withColumn("copy", F.xxhash64("text"))
    texts = rows.select("lang", "copy").distinct()  # copies would all be in the sample, or none
    totals = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros((buckets, 0)), np.zeros((len(SCRIPTS), 0), bool), buckets)
    chosen = F.lit(False)
    for lang in languages:
        share = min(1.0, per_language / totals[lang])
        chosen = chosen | ((F.col("lang") == lang) & (hash_share(F.col("text")) <= share))
    number = F.lit(0)
    for i, lang in enumerate(languages):
        number = F.when(F.col("lang") == lang, i).otherwise(number)
    k, n_scripts = len(languages), len(SCRIPTS)

    def count(batches):
        grams = np.zeros((k, buckets), np.int64)
        scripts = np.zeros((k, n_scripts), np.int64)
        for batch in batches:
            for a, b in text_slices(batch.column(0)):
                part = batch.slice(a, b - a)
                langs = part.column(1).to_numpy()
                texts = part.column(0).to_pylist()
                for lang in np.unique(langs):
                    words = Words([t for t, x in zip(texts, langs) if x == lang])
                    scripts[lang] += np.bincount(words.scripts, words.sizes, n_scripts).astype(np.int64)
                    for n in range(1, NGRAMS + 1):
                        bucket, whole = words.grams(n, buckets)
                        grams[lang] += np.bincount(bucket[whole], minlength=buckets)
        for kind, table in (("g", grams), ("s", scripts)):
            lang, at = np.nonzero(table)
            if len(lang):
                yield pa.RecordBatch.from_pydict(
                    {"kind": [kind] * len(lang), "lang": lang.astype(np.int32), "at": at.astype(np.int32),
                     "n": table[lang, at]}
                )

    counted = (
        rows.where(chosen).dropDuplicates(["lang", "copy"]).select("text", number.alias("lang"))
        .mapInArrow(count, "kind string, lang int, at int, n long")
        .groupBy("kind", "lang", "at").agg(F.sum("n").alias("n"))
    )
    grams, scripts = np.zeros((buckets, k)), np.zeros((n_scripts, k))
    got = counted.toArrow()
    for kind, target in (("g", grams), ("s", scripts)):
        mask = np.array(got.column("kind").to_pylist()) == kind if got.num_rows else np.zeros(0, bool)
        target[got.column("at").to_numpy()[mask], got.column("lang").to_numpy()[mask]] = got.column("n").to_numpy()[mask]
    smooth = grams + 0.5
    scores = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
    used = scripts / np.maximum(scripts.sum(axis=0), 1) >= MIN_SCRIPT_SHARE
    return Model(languages, scores, used, buckets)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """words x languages; languages outside the script's candidates are far below."""
    total = np.zeros((len(words.sizes), len(model.languages)), np.float64)
    starts = words.first[:-1]
    for n in range(1, NGRAMS + 1):
        bucket, whole = words.grams(n, model.buckets)
        if not len(bucket):
            continue
        rows = np.zeros((len(words.padded) + 1, len(model.languages)), np.float32)
        rows[: len(bucket)] = model.scores[bucket]
        rows[: len(bucket)][~whole] = 0
        total += np.add.reduceat(rows, starts, axis=0)[: len(starts)]
    candidates = model.scripts[words.scripts]
    none = ~candidates.any(axis=1)
    candidates[none] = True
    total = np.where(candidates, total, total.min(axis=1, keepdims=True) - 50.0)
    total[none] = 0.0
    return total


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word. All texts take their step t together, longest first."""
    k = scores.shape[1]
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    begin = bounds[:-1][order]
    alive = np.searchsorted(-sizes[order], -np.arange(1, (sizes.max() if len(sizes) else 0) + 1), "right")
    came = np.zeros(scores.shape, np.int8 if k < 128 else np.int32)
    state = np.zeros((len(order), k))
    for t, n in enumerate(alive):
        rows = begin[:n] + t
        if t:
            best = state[:n].argmax(axis=1)
            peak = state[:n].max(axis=1, keepdims=True)
            stay = state[:n] >= peak - switch
            came[rows] = np.where(stay, np.arange(k), best[:, None])
            state[:n] = np.where(stay, state[:n] - peak, -switch)
        state[:n] += scores[rows]
    labels = np.zeros(len(scores), np.int64)
    if not len(scores):
        return labels
    last = bounds[1:][order][sizes[order] > 0] - 1
    labels[last] = state[: len(last)].argmax(axis=1)
    for t in range(len(alive) - 1, 0, -1):
        rows = begin[: alive[t]] + t
        labels[rows - 1] = came[rows, labels[rows]]
    return labels


_SPAN = T.ArrayType(
    T.StructType(
        [T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("lang", T.StringType())]
    )
)


def predict(
    docs: DataFrame,
    model: Model,
    text_col: str = "text",
    switch: float = SWITCH,
    spans: bool = True,
    keep_text: bool = True,
) -> DataFrame:
    """docs with lang_pred, score (share of the letters that carry the label) and
    lang_spans (runs of words). Without keep_text the text column is left out."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS x languages numbers

    def make():
        own = sent.value
        k = len(own.languages)

        def work(texts: pa.Array) -> dict:
            words = Words(texts.to_pylist())
            n = len(texts)
            lang, score, found = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
            if k and len(words.sizes):
                labels = viterbi(word_scores(words, own), words.word_bounds, switch)
                docs_of = np.repeat(np.arange(n), np.diff(words.word_bounds))
                letters = np.bincount(docs_of * k + labels, words.sizes, n * k).reshape(n, k)
                total = letters.sum(axis=1)
                best = letters.argmax(axis=1)
                for i in np.flatnonzero(total):
                    lang[i] = own.languages[best[i]]
                    score[i] = letters[i, best[i]] / total[i]
                if spans:
                    new = np.ones(len(labels), bool)
                    new[1:] = (labels[1:] != labels[:-1]) | (docs_of[1:] != docs_of[:-1])
                    at = np.flatnonzero(new)
                    sizes = np.diff(np.concatenate([at, [len(labels)]]))
                    for a, size in zip(at, sizes):
                        d = docs_of[a]
                        found[d].append(
                            {"first_word": int(a - words.word_bounds[d]), "n_words": int(size), "lang": own.languages[labels[a]]}
                        )
            out = {"lang_pred": pa.array(lang, pa.string()), "score": score}
            if spans:
                kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())]))
                out["lang_spans"] = pa.array(found, kind)
            return out

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if spans:
        fields.append(T.StructField("lang_spans", _SPAN))
    return map_texts(docs, text_col, make, fields, keep_text)


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with has_letters: whether a text has a word, which needs no model."""

    def work(texts: pa.Array) -> dict:
        return {"has_letters": np.diff(Words(texts.to_pylist()).word_bounds) > 0}

    return map_texts(docs, text_col, lambda: work, [T.StructField("has_letters", T.BooleanType())])


def held_out(id_col: Column, parts: int, which: int) -> Column:
    """Whether crc32 of the id as text falls in the part; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(parts)) == which, F.lit(False))
