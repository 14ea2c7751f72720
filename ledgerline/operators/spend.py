"""Spend queries over the turns grain: summaries, daily series, attribution, sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.formats import share
from ledgerline.functions.time import day_of, ms_of
from ledgerline.operators.ordered import SLICE_MS, gap_usage

COST_COLUMNS = ("costInput", "costOutput", "costCacheCreate", "costCacheRead")

# Axis name, column, and the label of its empty bucket.
ATTRIBUTION_AXES = (
    ("agent", "agentType", "(main loop)"),
    ("skill", "attributionSkill", "(none)"),
    ("mcp", "attributionMcpServer", "(none)"),
)


def _total(column: str | Column) -> Column:
    return F.sum(column).cast("double")


def _when(turns: DataFrame, predicate: Column | None) -> DataFrame:
    return turns if predicate is None else turns.where(predicate)


def corpus_summary(
    turns: DataFrame,
    predicate: Column | None = None,
    session: str = "sessionId",
    project: str = "project",
    ts: str = "ts",
    cost: str = "costTotal",
    parts: Sequence[str] = COST_COLUMNS,
) -> DataFrame:
    """Counts, distinct sessions and projects, time extent and cost sums, in one row.

    Two exact distinct counts over raw turns would expand every row twice. Collapsing to
    (session, project) first keeps the expansion to that much smaller set.
    """
    pairs = (
        _when(turns, predicate)
        .groupBy(session, project)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(ts).alias("_t0"),
            F.max(ts).alias("_t1"),
            F.sum(cost).alias("_cost"),
            *[F.sum(p).alias(f"_{p}") for p in parts],
        )
    )
    return pairs.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("turns"),
        F.count_distinct(F.col(session)).alias("sessions"),
        F.count_distinct(F.col(project)).alias("projects"),
        ms_of(F.min("_t0")).alias("firstTs"),
        ms_of(F.max("_t1")).alias("lastTs"),
        _total("_cost").alias("totalCost"),
        *[_total(f"_{p}").alias(p) for p in parts],
    )


def selection_stats(
    turns: DataFrame,
    predicate: Column | None = None,
    session: str = "sessionId",
    agent: str = "agentId",
    cost: str = "costTotal",
) -> DataFrame:
    pairs = (
        _when(turns, predicate)
        .groupBy(session, agent)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(cost).alias("_cost"))
    )
    return pairs.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("turns"),
        F.count_distinct(F.col(session)).alias("sessions"),
        F.count_distinct(F.col(agent)).alias("agents"),
        F.coalesce(_total("_cost"), F.lit(0.0)).alias("cost"),
    )


def time_extent(turns: DataFrame, ts: str = "ts") -> DataFrame:
    return turns.agg(ms_of(F.min(ts)).alias("t0"), ms_of(F.max(ts)).alias("t1"))


def daily_spend(
    turns: DataFrame,
    predicate: Column | None = None,
    project: str | None = "project",
    ts: str = "ts",
    cost: str = "costTotal",
) -> DataFrame:
    """Cost and turns per UTC day and project; ``project=None`` gives whole-day totals."""
    keys = [day_of(ts).alias("day")] + ([F.col(project).alias("project")] if project else [])
    return (
        _when(turns, predicate)
        .groupBy(*keys)
        .agg(_total(cost).alias("cost"), F.count(F.lit(1)).alias("turns"))
    )


def daily_context(
    turns: DataFrame, predicate: Column, ts: str = "ts", cost: str = "costTotal"
) -> DataFrame:
    """Each day's whole total next to the part the filter keeps, from one scan."""
    return turns.groupBy(day_of(ts).alias("day")).agg(
        _total(cost).alias("total"),
        F.coalesce(_total(F.when(predicate, F.col(cost))), F.lit(0.0)).alias("live"),
    )


def token_classes(
    turns: DataFrame,
    predicate: Column | None = None,
    key: str = "project",
    cost: str = "costTotal",
    parts: dict[str, str] | None = None,
) -> DataFrame:
    """Cost by class per project, with each class's share of the total."""
    parts = parts or {
        "cacheRead": "costCacheRead",
        "cacheCreate": "costCacheCreate",
        "output": "costOutput",
        "input": "costInput",
    }
    grouped = (
        _when(turns, predicate)
        .groupBy(F.col(key).alias("key"))
        .agg(
            _total(cost).alias("cost"),
            F.count(F.lit(1)).alias("turns"),
            *[_total(c).alias(name) for name, c in parts.items()],
        )
    )
    for name in parts:
        grouped = grouped.withColumn(f"{name}Share", share(F.col(name), F.col("cost")))
    return grouped


def attribution(
    turns: DataFrame,
    predicate: Column | None = None,
    axes: Sequence[tuple[str, str, str]] = ATTRIBUTION_AXES,
    cost: str = "costTotal",
    context: Column | None = None,
) -> DataFrame:
    """Cost by what caused it, on several axes; empty values are a labelled bucket.

    One scan: turns collapse to combinations of the axis values first, and only those
    combinations are expanded into grouping sets. ``context`` adds the part of each
    bucket that a filter keeps, next to the whole.
    """
    slots = [f"_a{i}" for i in range(len(axes))]
    labelled = _when(turns, predicate).select(
        *[F.coalesce(F.col(c), F.lit(none)).alias(s) for s, (_, c, none) in zip(slots, axes)],
        F.col(cost).alias("_cost"),
        (F.lit(None) if context is None else context).cast("boolean").alias("_live"),
    )
    combos = labelled.groupBy(*slots).agg(
        F.sum("_cost").alias("_cost"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(F.col("_live"), F.col("_cost"))).alias("_kept"),
    )
    kind = F.coalesce(
        *[F.when(F.grouping(s) == 0, F.lit(name)) for s, (name, _, _) in zip(slots, axes)]
    )
    kept = [] if context is None else [F.coalesce(_total("_kept"), F.lit(0.0)).alias("live")]
    grouped = combos.groupingSets([[F.col(s)] for s in slots], *[F.col(s) for s in slots]).agg(
        kind.alias("kind"), _total("_cost").alias("cost"), F.sum("_n").alias("turns"), *kept
    )
    return grouped.select(
        "kind", F.coalesce(*slots).alias("key"), *[c for c in grouped.columns if c not in (*slots, "kind")]
    )


def project_totals(
    turns: DataFrame, project: str = "project", cost: str = "costTotal"
) -> DataFrame:
    return turns.groupBy(F.col(project).alias("project")).agg(
        _total(cost).alias("cost"), F.count(F.lit(1)).alias("turns")
    )


def scatter_meta(turns: DataFrame, cost: str = "costTotal") -> DataFrame:
    return turns.agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col(cost) <= 0).alias("zeroCost")
    )


def turn_scatter(
    turns: DataFrame,
    predicate: Column,
    log_axis: bool = True,
    ts: str = "ts",
    cost: str = "costTotal",
    project: str = "project",
) -> DataFrame:
    """One point per turn with a flag for those the filter keeps."""
    points = turns.where(F.col(cost) > 0) if log_axis else turns
    return points.select(
        ms_of(ts).alias("ts"),
        F.col(cost).cast("double").alias("cost"),
        F.col(project).alias("project"),
        F.coalesce(predicate, F.lit(False)).alias("live"),
    )


def class_shares(turns: DataFrame, cost: str = "costTotal", parts: Sequence[str] = COST_COLUMNS) -> DataFrame:
    """Corpus-wide cost per class and its share of the whole, one row per class."""
    sums = turns.agg(F.sum(cost).alias("_all"), *[F.sum(p).alias(p) for p in parts])
    long = sums.unpivot("_all", list(parts), "klass", "cost")
    return long.select(
        "klass",
        F.col("cost").cast("double").alias("cost"),
        share(F.col("cost").cast("double"), F.col("_all").cast("double")).alias("share"),
    )


def priciest_session(
    turns: DataFrame, session: str = "sessionId", cost: str = "costTotal"
) -> DataFrame:
    return (
        turns.groupBy(F.col(session).alias("sessionId"))
        .agg(_total(cost).alias("cost"))
        .orderBy(F.desc("cost"), F.asc("sessionId"))
        .limit(1)
    )


def session_usage(
    turns: DataFrame,
    sessions: DataFrame,
    idle_minutes: float = 30,
    predicate: Column | None = None,
    session: str = "sessionId",
    ts: str = "ts",
    cost: str = "costTotal",
    peak: str = "cacheReadTokens",
    details: Sequence[str] = ("project", "name", "nameWas", "nCompactions"),
    slice_ms: int = SLICE_MS,
) -> DataFrame:
    """Sessions with more than one turn, recomputed for a chosen idle threshold."""
    idle_ms = int(max(1, idle_minutes) * 60_000)
    rows = _when(turns, predicate).select(
        F.col(session).alias("sessionId"), ms_of(ts).alias("_t"), F.col(cost).alias("_c"), F.col(peak).alias("_p")
    )
    usage = gap_usage(
        rows, ["sessionId"], "_t", idle_ms, {"cost": "_c"}, {"peakContextTokens": "_p"}, slice_ms
    ).where("nTurns > 1")
    span = (F.col("lastMs") - F.col("firstMs")) / 1000.0
    active = F.col("activeMs") / 1000.0
    return usage.join(sessions, "sessionId", "left").select(
        "sessionId",
        *details,
        F.col("firstMs").alias("firstTs"),
        F.col("lastMs").alias("lastTs"),
        span.alias("spanSeconds"),
        active.alias("activeSeconds"),
        F.when(span > 0, active / span).otherwise(1.0).alias("dutyCycle"),
        "nTurns",
        "peakContextTokens",
        F.col("cost").cast("double").alias("cost"),
    )


def session_labels(sessions: DataFrame) -> DataFrame:
    """The session columns reports show: name, the name before a rename, project."""
    return sessions.select(
        "sessionId",
        "project",
        F.coalesce("name", F.substring("sessionId", 1, 8)).alias("name"),
        F.when(F.col("nameChanged"), F.col("nameFirst")).alias("nameWas"),
        "nCompactions",
    )


def session_table(usage: DataFrame, limit: int = 25) -> DataFrame:
    """The costliest sessions with their span relative to the longest one shown."""
    top = usage.orderBy(F.desc("cost"), F.asc("sessionId")).limit(limit)
    longest = F.max("spanSeconds").over(Window.partitionBy())
    return top.withColumns(
        {
            "spanShare": share(F.col("spanSeconds"), longest),
            "dutyShown": F.least(F.lit(1.0), F.col("dutyCycle")),
            "lowDuty": F.col("dutyCycle") < 0.15,
        }
    )


def top_per_axis(buckets: DataFrame, by: str = "total", limit: int = 8) -> DataFrame:
    """The largest buckets of each attribution axis, ranked by the unfiltered total.

    Spark keeps only ``limit`` rows per axis and input partition before the shuffle
    (a window group limit), so a crowded axis never meets in one task.
    """
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(by), F.asc("key")))
    return buckets.withColumn("rank", rank).where(F.col("rank") <= limit)


def find_sessions(
    sessions: DataFrame,
    turns: DataFrame,
    text: str,
    limit: int = 5,
    session: str = "sessionId",
    name: str = "name",
    cost: str = "costTotal",
) -> DataFrame:
    """Sessions by exact name, id prefix or part of the name, ignoring case."""
    needle = F.lit(text.lower())
    label, ident = F.lower(name), F.lower(session)
    hits = sessions.where(
        (label == needle) | F.startswith(ident, needle) | F.contains(label, needle)
    ).select(F.col(session).alias("sessionId"), F.col(name).alias("name"))
    # Only turns of the hits are summed, and only one row per session meets its name.
    paid = turns.select(F.col(session).alias("sessionId"), cost)
    spent = (
        paid.join(hits.select("sessionId"), "sessionId", "left_semi")
        .groupBy("sessionId").agg(_total(cost).alias("cost"))
    )
    return (
        hits.join(spent, "sessionId")
        .orderBy(F.desc("cost"), F.asc("sessionId"))
        .limit(limit)
    )


def distinct_images(images: DataFrame) -> DataFrame:
    """Distinct payloads per media type. Two carriers can hold one payload."""
    facts = F.struct("mediaType", "estTokens", "width", "height")
    distinct = images.groupBy("hash").agg(F.min_by(facts, F.struct("uuid", "carrier")).alias("f"))
    return distinct.groupBy(F.col("f.mediaType").alias("mediaType")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("f.estTokens").alias("estTokens"),
        (F.sum(F.col("f.width") * F.col("f.height")) / 1e6).alias("megapixels"),
    )


def project_order(spans: DataFrame, project: str = "project", t0: str = "t0") -> DataFrame:
    """Projects by first activity, then by name."""
    return (
        spans.groupBy(F.col(project).alias("project"))
        .agg(F.min(t0).alias("firstTs"))
        .orderBy(F.asc("firstTs"), F.asc("project"))
    )
