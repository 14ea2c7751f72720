"""Session names: the newest and the first value of each source, and a fallback ladder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCES = ("explicit", "ai", "slug")


def session_names(records: DataFrame, session: str, order: Sequence[Column]) -> DataFrame:
    """Names per session from columns ``explicit``, ``ai`` and ``slug``, in file order.

    Naming records carry no time, so ``order`` is the position in the file. The name is
    the newest explicit one, else the newest AI title, else the slug, else the first
    eight characters of the id; the same ladder over first values never moves.
    """
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    ends = records.groupBy(session).agg(
        *[
            pick(F.col(s), F.when(F.col(s).isNotNull(), place)).alias(f"{s}_{end}")
            for s in SOURCES
            for end, pick in (("first", F.min_by), ("last", F.max_by))
        ]
    )

    def ladder(end: str) -> Column:
        return F.coalesce(*[F.col(f"{s}_{end}") for s in SOURCES], F.substring(session, 1, 8))

    def changed(source: str) -> Column:
        return F.coalesce(F.col(f"{source}_last") != F.col(f"{source}_first"), F.lit(False))

    kind = F.coalesce(
        *[F.when(F.col(f"{s}_last").isNotNull(), F.lit(s)) for s in SOURCES], F.lit("id")
    )
    return ends.select(
        session,
        F.col("slug_last").alias("slug"),
        ladder("last").alias("name"),
        kind.alias("nameKind"),
        ladder("first").alias("nameFirst"),
        (ladder("last") != ladder("first")).alias("nameChanged"),
        F.col("explicit_last").alias("customTitle"),
        F.when(changed("explicit"), F.col("explicit_first")).alias("customTitleFirst"),
        F.col("ai_last").alias("aiTitle"),
        F.when(changed("ai"), F.col("ai_first")).alias("aiTitleFirst"),
    )
