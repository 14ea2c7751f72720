"""Secret scan: patterns, and sliding-window entropy of candidate strings per character class.

Three patterns give the base spans (see BASE_KINDS). Then, for each character class, every
maximal run of the class is a candidate; a window slides over it and the Shannon entropy of
its characters is kept up to date from counts: a step takes one character out of the counts
and puts one in. A run whose highest window entropy reaches the class's threshold is a
span, unless the allow-list names it or a base span overlaps it. The classes are hex digits,
letters of both cases with digits, and letters of one case with digits (base36, base32);
runs without a digit or without a letter are no candidates.

Only built-in column functions are used. A row is handled by itself, so nothing is
shuffled, and a hot source or group of copies is only more rows.

Defined cases: a null text counts as empty; null or repeated ids keep their rows; texts of
any length are scanned whole; offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import let

# Kind, pattern, group whose length counts, least length.
BASE_KINDS = (
    (
        "assign",
        r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Words of which one must occur for a pattern to be tried at all.
_ASSIGN_WORDS = r"(?i)password|passwd|secret|token|api_?key"


@dataclass(frozen=True)
class CharClass:
    """Runs of a class are candidates when `needs` matches them; a window of `window`
    characters with at least `bits` of entropy makes a span. Candidates that match `names`,
    where there is one, are clean."""

    kind: str
    run: str
    needs: str
    alphabet: str
    window: int
    bits: float
    names: str = ""


_HEX = "0123456789abcdef"
_WIDE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_LOWER = "abcdefghijklmnopqrstuvwxyz0123456789_-"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"
# In one case, words come near to keys in entropy: words and numbers that are joined are names.
# Groups repeat possessively: Java would otherwise recurse once a turn, and a long run overflow.
_NAMES = r"^[_-]*(?:[A-Za-z]+[0-9]{0,4}|[0-9]+)(?:[_-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]+))*+[_-]*$"
CLASSES = (
    CharClass("entropy_hex", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{20,}(?![A-Za-z0-9])",
              r"[0-9].*[A-Fa-f]|[A-Fa-f].*[0-9]", _HEX, 20, 3.0),
    CharClass("entropy_wide", r"[A-Za-z0-9+/_-]{20,}",
              r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", _WIDE, 20, 3.7),
    CharClass("entropy_lower", r"(?<![A-Za-z0-9])[a-z0-9_-]{20,}(?![A-Za-z0-9])",
              r"^(?=.*[0-9])(?=.*[a-z])", _LOWER, 20, 3.5, _NAMES),
    CharClass("entropy_upper", r"(?<![A-Za-z0-9])[A-Z0-9_-]{20,}(?![A-Za-z0-9])",
              r"^(?=.*[0-9])(?=.*[A-Z])", _UPPER, 20, 3.4, _NAMES),
)

#: Candidates matching one of these are never spans: UUIDs, one repeated character, runs of
#: the alphabet or digits, words of examples, paths of words.
ALLOW = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^(.)\1+$",
    r"(?i)abcdefghij|0123456789|9876543210",
    r"(?i)example|placeholder|changeme|redacted",
    r"^(?:[A-Za-z]+[0-9]{0,4}[/_-])++[A-Za-z]+[0-9]{0,4}$",
)


def _starts(steps: Column) -> Column:
    """For an array of lengths, the sum of those before each place: sums of pieces of 256
    first, so work stays near linear."""
    size = 256

    def within(chunk: Column) -> Column:
        return F.aggregate(chunk, F.lit(0).cast("long"), lambda a, x: a + x)

    count = F.size(steps)

    def build(sums: Column) -> Column:
        def chunk_of(k: Column) -> Column:
            before = F.aggregate(F.slice(sums, 1, k), F.lit(0).cast("long"), lambda a, x: a + x)

            def places(both: Column) -> Column:
                piece = both["piece"]
                return F.transform(
                    piece, lambda _, j: both["before"] + within(F.slice(piece, 1, j))
                )

            return let(
                F.struct(before.alias("before"), F.slice(steps, k * size + 1, size).alias("piece")),
                places,
            )

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(sums) - 1), chunk_of))

    sums = F.transform(
        F.sequence(F.lit(0), F.floor((count - 1) / size).cast("int")),
        lambda k: within(F.slice(steps, k * size + 1, size)),
    )
    return F.when(count > 0, let(sums, build)).otherwise(F.array().cast("array<bigint>"))


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of the leftmost matches: the text between matches and the
    matches themselves alternate, so places follow from lengths."""

    def build(both: Column) -> Column:
        steps = F.zip_with(
            both["gaps"], both["hits"],
            lambda g, h: (F.length(g) + F.coalesce(F.length(h), F.lit(0))).cast("long"),
        )
        return let(
            _starts(steps),
            lambda starts: F.transform(
                both["hits"],
                lambda h, i: F.struct(
                    (starts[i] + F.length(both["gaps"][i])).alias("start"), h.alias("value")
                ),
            ),
        )

    pieces = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
    )
    nothing = F.array().cast("array<struct<start:bigint,value:string>>")
    return F.when(F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))) > 0, let(pieces, build)).otherwise(nothing)


def window_entropy(value: Column, kind: CharClass) -> Column:
    """Highest entropy, in bits, of any window. State: counts per character of the alphabet,
    and the sum of c * log2(c); a window of w characters has log2(w) - sum / w bits."""
    symbols = kind.alphabet
    low = F.lower(value) if symbols == _HEX else value
    weights = F.array(*[F.lit(0.0), *[F.lit(c * math.log2(c)) for c in range(1, kind.window + 1)]])

    def build(chars: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            incoming = chars[i]
            outgoing = F.when(i >= kind.window, chars[i - kind.window]).otherwise(F.lit(-1))
            same = incoming == outgoing
            gained = weights_at(state["counts"][incoming] + 1) - weights_at(state["counts"][incoming])
            lost = F.when(
                outgoing >= 0,
                weights_at(F.coalesce(state["counts"][F.greatest(outgoing, F.lit(0))], F.lit(0)))
                - weights_at(F.greatest(state["counts"][F.greatest(outgoing, F.lit(0))] - 1, F.lit(0))),
            ).otherwise(F.lit(0.0))
            total = F.when(same, state["sum"]).otherwise(state["sum"] + gained - lost)
            counts = F.when(same, state["counts"]).otherwise(
                F.transform(
                    state["counts"],
                    lambda c, k: c
                    + F.when(k == incoming, F.lit(1)).when(k == outgoing, F.lit(-1)).otherwise(F.lit(0)),
                )
            )
            bits = F.when(
                i >= kind.window - 1, F.lit(math.log2(kind.window)) - total / F.lit(float(kind.window))
            ).otherwise(F.lit(0.0))
            return F.struct(
                counts.alias("counts"), total.alias("sum"), F.greatest(state["best"], bits).alias("best")
            )

        start = F.struct(
            F.array_repeat(F.lit(0), len(symbols)).alias("counts"),
            F.lit(0.0).alias("sum"),
            F.lit(0.0).alias("best"),
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step)["best"]

    def weights_at(count: Column) -> Column:
        return F.element_at(weights, (count + 1).cast("int"))

    codes = F.transform(F.split(low, ""), lambda c: (F.instr(F.lit(symbols), c) - 1).cast("int"))
    return let(codes, build)


def _allowed(value: Column) -> Column:
    test = F.lit(False)
    for pattern in ALLOW:
        test = test | value.rlike(pattern)
    return test


def _span(kind: str, order: int, start: Column, value: Column) -> Column:
    return F.struct(
        start.alias("start"),
        F.lit(order).alias("order"),
        F.lit(kind).alias("kind"),
        (start + F.length(value)).alias("end"),
        value.alias("value"),
    )


_SPANS = "array<struct<start:bigint,order:int,kind:string,end:bigint,value:string>>"


def base_spans(text: Column) -> Column:
    def one(order: int, kind: str, pattern: str, group: int, least: int) -> Column:
        def long_enough(h: Column) -> Column:
            value = F.regexp_extract(h["value"], pattern, group) if group else h["value"]
            return F.length(value) >= least

        return F.transform(
            F.filter(find_all(text, pattern), long_enough),
            lambda h: _span(kind, order, h["start"], h["value"]),
        )

    parts = []
    for order, (kind, pattern, group, least) in enumerate(BASE_KINDS):
        spans = one(order, kind, pattern, group, least)
        if kind == "assign":
            spans = F.when(text.rlike(_ASSIGN_WORDS), spans)
        elif kind == "access":
            spans = F.when(text.contains("AKIA"), spans)
        parts.append(F.coalesce(spans, F.array().cast(_SPANS)))
    return F.array_sort(F.concat(*parts))


def added_spans(text: Column, base: Column, classes: tuple[CharClass, ...] = CLASSES) -> Column:
    def one(order: int, kind: CharClass) -> Column:
        def wanted(h: Column) -> Column:
            end = h["start"] + F.length(h["value"])
            free = ~F.exists(base, lambda b: (b["start"] < end) & (h["start"] < b["end"]))
            return (
                h["value"].rlike(kind.needs)
                & ~_allowed(h["value"])
                & (~h["value"].rlike(kind.names) if kind.names else F.lit(True))
                & free
                & (window_entropy(h["value"], kind) >= kind.bits)
            )

        # Most texts have no run that could count; they skip the search for places.
        runs = F.regexp_extract_all(text, F.lit(kind.run), F.lit(0))
        return F.when(
            F.exists(runs, lambda v: v.rlike(kind.needs)),
            F.transform(
                F.filter(find_all(text, kind.run), wanted),
                lambda h: _span(kind.kind, order, h["start"], h["value"]),
            ),
        )

    parts = [
        F.coalesce(one(order, kind), F.array().cast(_SPANS))
        for order, kind in enumerate(classes, len(BASE_KINDS))
    ]

    # A run can be of several classes; the first class that reports it keeps it.
    def merge(taken: Column, more: Column) -> Column:
        return F.concat(
            taken,
            F.filter(more, lambda m: ~F.exists(taken, lambda t: (t["start"] < m["end"]) & (m["start"] < t["end"]))),
        )

    found = parts[0]
    for part in parts[1:]:
        found = let(F.struct(found.alias("a"), part.alias("b")), lambda s: merge(s["a"], s["b"]))
    return found


def scan(docs: DataFrame, text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES) -> DataFrame:
    """docs with columns base_spans and secret_spans (base and added ones, by start)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = let(
        text,
        lambda t: let(
            base_spans(t),
            lambda base: F.struct(
                base.alias("base"),
                let(added_spans(t, base, classes), lambda more: F.array_sort(F.concat(base, more))).alias("all"),
            ),
        ),
    )
    out = docs.withColumn("__found", found)
    return out.withColumns({"base_spans": out["__found.base"], "secret_spans": out["__found.all"]}).drop("__found")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with each secret replaced by the mask; overlapping spans become one. A null text
    stays null."""
    base = docs.columns
    found = scan(docs.withColumn("__text", F.col(f"`{text_col}`")), "__text")

    def build(both: Column) -> Column:
        start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

        def step(state: Column, span: Column) -> Column:
            gap = F.substring(both["text"], (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
            return F.when(
                span["start"] >= state["at"],
                F.struct(F.concat(state["done"], gap, F.lit(mask)).alias("done"), span["end"].alias("at")),
            ).otherwise(F.struct(state["done"].alias("done"), F.greatest(state["at"], span["end"]).alias("at")))

        def rest(state: Column) -> Column:
            return F.concat(
                state["done"], F.substring(both["text"], (state["at"] + 1).cast("int"), F.lit(2**31 - 1))
            )

        return F.aggregate(both["spans"], start, step, rest)

    cleaned = F.when(
        F.size("secret_spans") > 0,
        let(F.struct(F.col("__text").alias("text"), F.col("secret_spans").alias("spans")), build),
    ).otherwise(F.col("__text"))
    return found.withColumn(text_col, cleaned).select(*[F.col(f"`{c}`") for c in base])
