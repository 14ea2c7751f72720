"""Price tables from a JSON map of model name to rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import variant as V
from ledgerline.operators.billing import PriceTable

# Rate columns and the JSON fields they come from.
RATE_FIELDS = {
    "input": "input_cost_per_token",
    "output": "output_cost_per_token",
    "cacheCreate5m": "cache_creation_input_token_cost",
    "cacheCreate1h": "cache_creation_input_token_cost_above_1hr",
    "cacheRead": "cache_read_input_token_cost",
}


def price_entries(documents: DataFrame, column: str = "value") -> DataFrame:
    """One row per model entry that is an object; other entries are skipped."""
    entries = documents.select(
        F.explode(F.try_variant_get(F.try_parse_json(column), "$", "map<string,variant>")).alias("key", "v")
    )
    return entries.where(V.is_object(F.col("v"))).select(
        "key", *[V.number(F.col("v"), f"$.{field}").alias(rate) for rate, field in RATE_FIELDS.items()]
    )


def read_prices(spark: SparkSession, path: str, version: str) -> PriceTable:
    return PriceTable(price_entries(spark.read.text(path, wholetext=True)), version)


def prices_from_json(spark: SparkSession, text: str, version: str) -> PriceTable:
    return PriceTable(price_entries(spark.createDataFrame([(text,)], "value string")), version)
