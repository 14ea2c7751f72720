"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a logistic model on counts of the whole
text. The risk is the non-negative unbiased one: prior * R(positive as +) +
max(0, R(unlabelled as -) - prior * R(positive as -)); while the second part is below zero,
its gradient is followed the other way. The class prior is estimated first, on rows that
the helping classifier did not see: of all scores' upper tails, the smallest ratio of the
unlabelled share to the positive share, each widened by its sampling error.

Training reads at most MAX_POSITIVE positive and MAX_UNLABELLED unlabelled texts, taken by
a hash of the id; their feature rows (FEATURES numbers each) are all the driver gets.
Scoring is by row in Arrow batches; no rows move.

Defined cases: null and empty texts have all counts zero and get the score of that;
without positives every score is the prior; null ids or labels are not trained on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import hash_share, map_texts, text_slices
from ledgerline.llm.textscan import Texts, counts_per, repeats

MAX_POSITIVE = 4000
MAX_UNLABELLED = 8000

FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "shouts", "bars", "stops", "commas",
    "lines", "wide", "next_same", "repeated", "distinct", "empty", "capital_words",
)


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_SYMBOL = _class("#*$%&<>{}[]\\^~_=+@/")


def features(texts: pa.Array) -> np.ndarray:
    t = Texts(texts)
    raw, bounds = t.raw, t.bounds
    words = np.diff(t.word_bounds)
    chars = counts_per(t.inside & ((raw & 0xC0) != 0x80), bounds)
    per_char = lambda table: counts_per(table[raw], bounds) / np.maximum(chars, 1)
    per_word = lambda mask: counts_per(mask, t.word_bounds) / np.maximum(words, 1)
    hashes = t.word_hashes()
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (t.docs[1:] == t.docs[:-1])
    windows, first = t.windows(3)
    several, _ = repeats(t.docs[first], windows)
    covered = np.zeros(len(hashes) + 3, bool)
    for j in range(3):
        covered[first[several] + j] = True
    _, again = repeats(t.docs, hashes)
    capital = _UPPER[raw[t.starts]] if len(t.starts) else np.zeros(0, bool)
    closing = raw[t.ends - 1] if len(t.ends) else np.zeros(0, np.uint8)
    return np.column_stack(
        [
            np.log1p(words),
            chars / np.maximum(words, 1),
            per_char(_UPPER),
            per_char(_DIGIT),
            per_char(_SYMBOL),
            per_char(_class("!")),
            per_char(_class("|")),
            per_word((closing == ord(".")) | (closing == ord("?"))),
            per_word(closing == ord(",")),
            counts_per(raw == 10, bounds) / np.maximum(words, 1),
            counts_per(raw >= 0xC0, bounds) / np.maximum(chars, 1),
            per_word(same),
            per_word(covered[: len(hashes)]),
            1 - per_word(again),
            (words == 0).astype(float),
            per_word(capital),
        ]
    ).astype(np.float64)


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_design(x, self.centre, self.scale) @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _design(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - centre) / scale, -6, 6)
    return np.column_stack([z, np.minimum(z * z, 9.0), np.ones(len(z))])


def _descend(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam from zero; the rate falls to a tenth over the steps."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for i in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - 0.9 * i / steps) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return w


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 600, decay: float = 1e-3) -> np.ndarray:
    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        positive = -(p * (1 - sp)[:, None]).mean(axis=0) * prior  # positives as +
        from_u = (u * su[:, None]).mean(axis=0)  # unlabelled as -
        from_p = (p * sp[:, None]).mean(axis=0) * prior  # positives as -
        negative_risk = np.mean(np.logaddexp(0, u @ w)) - prior * np.mean(np.logaddexp(0, p @ w))
        g = positive + from_u - from_p if negative_risk >= 0 else from_p - from_u
        return g + decay * np.append(w[:-1], 0.0)

    return _descend(gradient, p.shape[1], steps)


def estimate_prior(p: np.ndarray, u: np.ndarray, steps: int = 300) -> float:
    """Share of positives among the unlabelled, from the tails of held-back scores."""
    half_p, half_u = len(p) // 2, len(u) // 2
    if not half_p or not half_u:
        return 0.5
    a, b = p[:half_p], u[:half_u]

    def gradient(w: np.ndarray) -> np.ndarray:
        ga = -(a * (1 - _sigmoid(a @ w))[:, None]).mean(axis=0)
        gb = (b * _sigmoid(b @ w)[:, None]).mean(axis=0)
        return ga + gb + 1e-3 * np.append(w[:-1], 0.0)

    w = _descend(gradient, p.shape[1], steps)
    sp, su = np.sort(p[half_p:] @ w), np.sort(u[half_u:] @ w)
    cuts = np.quantile(sp, np.linspace(0, 0.95, 96))
    tail_p = 1 - np.searchsorted(sp, cuts, "left") / len(sp)
    tail_u = 1 - np.searchsorted(su, cuts, "left") / len(su)
    error = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    at = np.argmin((tail_u + error) / tail_p)
    return float(np.clip(tail_u[at] / tail_p[at], 0.01, 0.99))


def _rows(df: DataFrame) -> np.ndarray:
    """Feature rows of df(text, key), in the order of key."""

    def run(batches):
        for batch in batches:
            for a, b in text_slices(batch.column(0)):
                part = batch.slice(a, b - a)
                x = features(part.column(0).fill_null(""))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))],
                    names=["key", "x"],
                )

    got = df.mapInArrow(run, "key long, x array<double>").toArrow()
    if not got.num_rows:
        return np.zeros((0, len(FEATURES)))
    x = np.array(got.column("x").to_pylist())
    return x[np.lexsort((*x.T, got.column("key").to_numpy()))]


def train(
    docs: DataFrame,
    positives: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
) -> Model:
    """docs: the unlabelled texts (id, text); positives: ids of trusted good ones."""
    ids = positives.select(F.col(f"`{id_col}`").alias("id")).where("id is not null").distinct()
    key = F.xxhash64(F.col("id"), F.lit("sample"))
    n_positive = ids.count()
    share = min(1.0, max_positive / max(n_positive, 1))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # At most about max_positive ids of 8 bytes are broadcast.
    chosen = ids.where(hash_share(F.col("id"), F.lit("p")) <= share)
    p = _rows(rows.join(F.broadcast(chosen), "id", "left_semi").select("text", key.alias("key")))
    n_rows = docs.count()
    share = min(1.0, max_unlabelled / max(n_rows, 1))
    u = _rows(rows.where(hash_share(F.col("id"), F.lit("u")) <= share).select("text", key.alias("key")))
    if not len(p) or not len(u):
        return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(2 * len(FEATURES) + 1), 0.5)
    centre, scale = u.mean(axis=0), u.std(axis=0) + 1e-6
    p, u = _design(p, centre, scale), _design(u, centre, scale)
    prior = estimate_prior(p, u)
    return Model(centre, scale, fit_nnpu(p, u, prior), prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on)."""

    def make():
        def work(texts: pa.Array) -> dict:
            s = model.score(features(texts))
            return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

        return work

    return map_texts(
        docs, text_col, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )
