"""Billing: one canonical record per response, the union of its blocks, and its price."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.fields import UNPRICED_MODELS, model_base, model_variant

RATES = ("input", "output", "cacheCreate5m", "cacheCreate1h", "cacheRead")

# Provider prefixes tried, in this order, after the plain model name.
PROVIDER_PREFIXES = ("anthropic/", "anthropic.", "us.anthropic.", "global.anthropic.")


@dataclass(frozen=True)
class PriceTable:
    """Rates per token by model key (columns ``key`` and RATES), with the version they carry."""

    entries: DataFrame
    version: str


def dedup_billed(
    records: DataFrame,
    keys: Sequence[str],
    rank: Sequence[Column],
    payload: Sequence[str],
) -> DataFrame:
    """One record per billing key: the smallest by ``rank``, compared left to right.

    An aggregate, not a window: copies of a key collapse on the map side, so a key with
    any number of copies sends one row per input partition, and file order cannot
    change the answer.
    """
    best = records.groupBy(*keys).agg(
        F.min_by(F.struct(*payload), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])).alias(
            "_best"
        )
    )
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in payload])


def structure_union(
    records: DataFrame, keys: Sequence[str], member: str, measures: Sequence[str]
) -> DataFrame:
    """Sum per-record measures over the distinct members of each key.

    Copies of one member repeat the same measures, so the maximum is any copy's value.
    """
    once = records.groupBy(*keys, member).agg(*[F.max(m).alias(m) for m in measures])
    return once.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("nMembers"), *[F.sum(m).alias(m) for m in measures]
    )


def duplicate_keys(turns: DataFrame, keys: Sequence[str]) -> DataFrame:
    return turns.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def model_candidates(model: Column) -> Column:
    """Price keys to try for a model, best first; empty for models that are never priced."""
    base, variant = model_base(model), model_variant(model)
    named = F.when(
        variant.isNotNull(),
        F.array(
            F.concat(base, F.lit("["), variant, F.lit("]")),
            F.concat(base, F.lit("-"), variant),
            base,
        ),
    ).otherwise(F.array(base))
    prefixed = F.array(*[F.concat(F.lit(p), base) for p in PROVIDER_PREFIXES])
    priceable = model.isNotNull() & ~model.isin(*UNPRICED_MODELS) & (base != "")
    return F.when(priceable, F.concat(named, prefixed)).otherwise(F.array().cast("array<string>"))


def resolve_models(models: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Rates per distinct model, from the first candidate key that has an entry.

    Works on distinct models, so the candidate expansion never touches turns.
    """
    tried = (
        models.select(F.col(model).alias("model"))
        .where("model IS NOT NULL")
        .distinct()
        .select("model", F.posexplode(model_candidates(F.col("model"))).alias("_rank", "key"))
    )
    hit = F.min_by(F.struct("key", *RATES), "_rank")
    found = tried.join(prices.select("key", *RATES), "key").groupBy("model").agg(hit.alias("_hit"))
    return found.select(
        "model",
        F.col("_hit.key").alias("pricedAs"),
        *[F.col(f"_hit.{r}").alias(f"rate_{r}") for r in RATES],
    )


def price_columns(
    input: Column,
    output: Column,
    cache5m: Column,
    cache1h: Column,
    cache_create: Column,
    cache_read: Column,
) -> dict[str, Column]:
    """Cost columns of one billable unit whose rates were joined in; NULL when unpriced.

    Cache writes use the explicit lifetimes when present, else the aggregate at the short
    rate; a missing long rate falls back to the short one.
    """

    def rate(name: str) -> Column:
        return F.coalesce(F.col(f"rate_{name}"), F.lit(0.0))

    short = rate("cacheCreate5m")
    long = F.coalesce(F.col("rate_cacheCreate1h"), short)
    priced = F.col("pricedAs").isNotNull()
    costs = {
        "costInput": input * rate("input"),
        "costOutput": output * rate("output"),
        "costCacheCreate": F.when(
            cache5m + cache1h > 0, cache5m * short + cache1h * long
        ).otherwise(cache_create * short),
        "costCacheRead": cache_read * rate("cacheRead"),
    }
    return {name: F.when(priced, cost) for name, cost in costs.items()}
