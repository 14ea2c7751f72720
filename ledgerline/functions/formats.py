"""Labels and tiers that reports derive from numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.ordered import place_in_ranges

# Absolute cost breaks in dollars, and the size of the category palette.
COST_BREAKS = (1, 10, 50, 200)
PALETTE_SIZE = 12


def _fixed(value: Column, digits: int) -> Column:
    """A fixed number of decimals, rounding the stored binary value; exact ties go up.

    A value is an exact tie when 2 ** (digits + 1) times it is an odd whole number.
    """
    x = value.cast("double")
    tie = (x * float(2 ** (digits + 1))) % 2.0 == 1.0
    lifted = F.when(tie, x + 0.2 * 10.0**-digits).otherwise(x)
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", lifted, F.lit(pattern))


def usd(amount: Column) -> Column:
    """Whole dollars from 100 up, cents from 1 up, a third decimal below."""
    return (
        F.when(amount >= 100, F.concat(F.lit("$"), _fixed(amount, 0)))
        .when(amount >= 1, F.concat(F.lit("$"), _fixed(amount, 2)))
        .otherwise(F.concat(F.lit("$"), _fixed(amount, 3)))
    )


def pct(part: Column, whole: Column) -> Column:
    """A share with one decimal, or a dash when there is nothing to share."""
    return F.when(
        whole > 0, F.concat(_fixed(part.cast("double") / whole * 100, 1), F.lit("%"))
    ).otherwise(F.lit("—"))


def share(part: Column, whole: Column) -> Column:
    """A ratio, NULL when the denominator is zero."""
    return F.when(whole > 0, part.cast("double") / whole)


def duration(ms: Column) -> Column:
    """Days, hours or whole minutes; never less than one minute."""
    minutes = F.greatest(F.lit(1), F.floor(ms / 60_000 + 0.5)).cast("long")
    return (
        F.when(ms >= 86_400_000, F.concat(_fixed(ms / 86_400_000, 1), F.lit("d")))
        .when(ms >= 3_600_000, F.concat(_fixed(ms / 3_600_000, 1), F.lit("h")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m")))
    )


def when_utc(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm")


def day_utc(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def cost_tier(cost: Column) -> Column:
    """0 below the first break, then one more at each break reached."""
    tier = F.lit(0)
    for edge in COST_BREAKS:
        tier = tier + F.when(cost >= edge, 1).otherwise(0)
    return tier


def category_index(names: DataFrame, column: str = "project", size: int = PALETTE_SIZE) -> DataFrame:
    """Stable palette slot per distinct name: alphabetical rank modulo the palette size. Ranks
    come from ranges of the names, so no task ranks all that begin alike."""
    distinct = names.select(column).where(F.col(column).isNotNull()).distinct()
    return place_in_ranges(distinct, [], [column], "_rank").select(
        column, F.pmod("_rank", F.lit(size)).cast("int").alias("slot")
    )
