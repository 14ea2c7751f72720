"""Reading a session back: folding tool results into their calls, hours, agent tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.time import hour_ms

RESULT_FIELDS = ("text", "truncated", "fullChars", "ok", "errorKind", "exitCode", "durationMs")


def cut(text: Column, limit: int | None) -> Column:
    """Text up to a limit, whether it was cut, and its full length in characters."""
    size = F.length(text)
    if limit is None:
        return F.struct(
            text.alias("text"), F.lit(False).alias("truncated"), size.alias("fullChars")
        )
    return F.struct(
        F.substring(text, 1, limit).alias("text"),
        (size > limit).alias("truncated"),
        size.alias("fullChars"),
    )


def fold(
    blocks: DataFrame,
    keys: Sequence[str] = ("sessionId",),
    use_id: str = "toolUseId",
    fields: Sequence[str] = RESULT_FIELDS,
    order: Sequence[str] = ("seq",),
) -> DataFrame:
    """Attach each tool result to the call it answers, by id and never by adjacency.

    The last result of an id wins. Results without an id, or whose call is missing, stay
    as blocks of their own. ``failed`` marks calls whose result failed or exited non-zero,
    and kept results that failed.

    Results collapse to one per id before the join. Whether a result has a call is an
    aggregate over the ids, so the join never pairs copies of a result with copies of a
    call.
    """
    keys = list(keys)
    is_result = F.col("kind") == "tool_result"
    is_use = F.col("kind") == "tool_use"
    has_id = F.col(use_id).isNotNull()

    answered = (
        blocks.where((is_result | is_use) & has_id)
        .groupBy(*keys, use_id)
        .agg(
            F.max_by(
                F.when(is_result, F.struct(*fields)),
                F.when(is_result, F.struct(*order)),
            ).alias("result"),
            F.bool_or(is_use).alias("_called"),
        )
        .where("result IS NOT NULL")
    )
    plain = ~((is_result | is_use) & has_id)
    matched = blocks.where(~plain).join(answered, [*keys, use_id], "left")
    result = F.col("result")
    uses = matched.where(is_use).withColumn(
        "failed",
        F.coalesce(result["ok"] == F.lit(False), F.lit(False))
        | (F.coalesce(result["exitCode"], F.lit(0)) > 0),
    )
    orphan_failed = F.coalesce(is_result & (F.col("ok") == F.lit(False)), F.lit(False))
    nothing = F.lit(None).cast(answered.schema["result"].dataType)
    orphans = (
        matched.where(is_result & ~F.coalesce("_called", F.lit(False)))
        .withColumn("result", nothing)
        .withColumn("failed", orphan_failed)
    )
    rest = blocks.where(plain).withColumn("result", nothing).withColumn("failed", orphan_failed)
    columns = [*blocks.columns, "result", "failed"]
    return (
        uses.select(*columns)
        .unionByName(orphans.select(*columns))
        .unionByName(rest.select(*columns))
    )


def in_reading_order(items: DataFrame, ms: str = "ts", seq: str = "seq") -> DataFrame:
    """Time first; ``seq`` only breaks ties within a millisecond."""
    return items.orderBy(F.col(ms).asc_nulls_first(), F.col(seq).asc())


def hour_buckets(
    items: DataFrame, keys: Sequence[str] = ("sessionId",), ms: str = "ts"
) -> DataFrame:
    """Hours with anything in them: blocks, prompts, tool calls and failures."""
    return (
        items.where(F.col(ms).isNotNull() & (F.col(ms) != 0))
        .groupBy(*keys, hour_ms(F.col(ms)).alias("hour"))
        .agg(
            F.count(F.lit(1)).alias("blocks"),
            F.count_if(F.col("kind") == "prompt").alias("prompts"),
            F.count_if(F.col("kind") == "tool_use").alias("toolCalls"),
            F.count_if("failed").alias("failures"),
        )
    )


def agent_tracks(items: DataFrame, keys: Sequence[str] = ("sessionId",)) -> DataFrame:
    """Blocks per agent; the main loop is the row without an agent id."""
    return items.groupBy(*keys, "agentId").agg(
        F.min_by("context", F.struct("ts", "seq")).alias("context"),
        F.count(F.lit(1)).alias("blocks"),
    )


def tracks_in_order(tracks: DataFrame) -> DataFrame:
    return tracks.orderBy(F.col("agentId").isNotNull(), F.desc("blocks"), F.asc("agentId"))
