"""Places of rows in a sorted order, without sending a group to one task.

Rows are dealt by ranges of (group, order) and sorted inside partitions, so a group may span
any number of them. What precedes a partition is known from counts per (partition, group): a
group's row in that table is as long as the partitions it spans, not as its rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import stored

#: Rows of a range partition, on average, so that a task's share stays the same at any size.
RANGE_ROWS = 1 << 18


def ranked(df: DataFrame, group: list[str], order: list[str | Column], label: str, place: str = "place") -> DataFrame:
    """df with its rows' places (from 0) in their group by `order`, nulls first; columns
    `part` and `part_row` tell where a row lies in the whole order. df is read twice, so it
    should be a stored table. Rows equal in `order` stand in any order, but in the same one
    whenever the result is read, as it is stored."""
    rows = df.count()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / RANGE_ROWS))
    keys = [F.col(c) for c in group] + [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys) if keys else df
    numbered = dealt.withColumn("__at", F.monotonically_increasing_id()).select(
        "*",
        F.shiftright("__at", 33).cast("int").alias("part"),
        F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)).alias("part_row"),
    )
    sorted_rows = stored(numbered.drop("__at"), label)
    spans = (
        sorted_rows.groupBy("part", *group)
        .agg(F.min("part_row").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .withColumn(
            "__before",
            F.coalesce(
                F.sum("__n").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
    )
    here = spans.select(
        F.col("part").alias("__part"), *[F.col(c).alias(f"__{c}") for c in group], (F.col("__before") - F.col("__first")).alias("__shift")
    )
    match = F.col("part") == F.col("__part")
    for c in group:
        match &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return (
        sorted_rows.join(here, match)
        .withColumn(place, F.col("part_row") + F.col("__shift"))
        .drop("__part", "__shift", *[f"__{c}" for c in group])
    )
