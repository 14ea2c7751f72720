"""Strict access to untyped JSON held as VARIANT.

``variant_get`` converts freely (the number 12 becomes the text "12"). Records must be
read by what they hold, so each accessor checks the stored type first and gives NULL
(or 0 for numbers) when it is something else. Nothing here ever fails on odd input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whatever numbers, booleans, lists and objects look like once converted to text.
_MAYBE_NO_TEXT = r"^[-0-9][-+.0-9eE]*$|^(true|false)$|^[\[{]"


def _type(v: Column, path: str) -> Column:
    return F.schema_of_variant(v if path == "$" else F.try_variant_get(v, path, "variant"))


def at(v: Column, path: str) -> Column:
    """The value at a path, untyped; NULL when any step is missing."""
    return F.try_variant_get(v, path, "variant")


def text(v: Column, path: str = "$") -> Column:
    """Only text; numbers and booleans are not turned into text."""
    return F.when(_type(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def texts(v: Column, paths: Iterable[str]) -> Column:
    """Whatever stands at the paths (``a.b``, without the ``$``), converted freely to text: a
    struct that is laid out in one walk over the object. Select it, then read it with ``told``."""
    tree: dict = {}
    for path in paths:
        *above, leaf = path.split(".")
        level = tree
        for step in above:
            level = level.setdefault(step, {})
        level[leaf] = None

    def shape(level: dict) -> str:
        return "struct<" + ", ".join(f"{k} {'string' if sub is None else shape(sub)}" for k, sub in level.items()) + ">"

    return F.try_variant_get(v, "$", shape(tree))


def told(laid_out: Column) -> Callable[..., Column]:
    """``text`` for the paths of ``texts``. The stored type is looked up only where the converted
    text could be that of a number, a boolean, a list or an object."""

    def read(v: Column, path: str) -> Column:
        freely = laid_out
        for step in path.removeprefix("$.").split("."):
            freely = freely[step]
        return F.when(freely.rlike(_MAYBE_NO_TEXT), F.when(_type(v, path) == "STRING", freely)).otherwise(freely)

    return read


def named(v: Column, path: str = "$", text: Callable[..., Column] = text) -> Column:
    """Text that is not empty."""
    return F.nullif(text(v, path), F.lit(""))


def equals(v: Column, path: str, value: str) -> Column:
    """The value is this text. Nothing but text reads as a word, so no type test is needed."""
    return F.coalesce(F.try_variant_get(v, path, "string") == F.lit(value), F.lit(False))


def _numeric(v: Column, path: str) -> Column:
    """BIGINT, DOUBLE, FLOAT and any DECIMAL(p,s)."""
    return F.left(_type(v, path), F.lit(3)).isin("BIG", "DOU", "FLO", "DEC")


def parts(v: Column, **paths: str) -> list[Column]:
    """Untyped values at several paths, as columns of their own. Reading types from these
    walks each path once instead of once per test."""
    return [at(v, path).alias(name) for name, path in paths.items()]


def number(v: Column, path: str = "$") -> Column:
    """Only real numbers, else NULL."""
    return F.when(_numeric(v, path), F.try_variant_get(v, path, "double"))


def count(v: Column, path: str = "$") -> Column:
    """A whole number, rounded half up; 0 when the value is not a number."""
    return F.coalesce(F.floor(number(v, path) + 0.5).cast("long"), F.lit(0).cast("long"))


def flag(v: Column, path: str = "$") -> Column:
    """Only booleans, else NULL."""
    return F.when(_type(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def is_true(v: Column, path: str) -> Column:
    return F.coalesce(flag(v, path), F.lit(False))


def is_object(v: Column, path: str = "$") -> Column:
    """Only objects convert to a struct; the check looks up one key and builds no schema."""
    return F.try_variant_get(v, path, "struct<type variant>").isNotNull()


def is_text(v: Column, path: str = "$") -> Column:
    return F.coalesce(_type(v, path) == "STRING", F.lit(False))


def is_array(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>").isNotNull()


def items(v: Column, path: str = "$") -> Column:
    """The elements of an array; an empty array for anything else."""
    return F.coalesce(
        F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")
    )
