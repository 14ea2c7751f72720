"""Span, interval and replay operators bound to the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import crossfilter, intervals, naming, replay, timeline
from ledgerline.plans.registry import query, table
from ledgerline.plans.spend_queries import TURNS_SQL, WINDOW, WINDOW_SQL, event_turns

SPANS_SQL = """
    sessions AS (
      SELECT 'session' AS kind, sessionId AS id, min(project) AS project, CAST(NULL AS VARCHAR) AS "parentId",
             min(ms) AS t0, max(ms) AS t1, count(*) AS "nTurns", CAST(sum(cost) AS DOUBLE) AS cost,
             CAST(NULL AS VARCHAR) AS "agentType", 'main' AS context, bool_or(kept) AS live
      FROM kept GROUP BY 2),
    agents AS (
      SELECT 'agent' AS kind, agentId AS id, min(project) AS project, min(sessionId) AS "parentId",
             min(ms) AS t0, max(ms) AS t1, count(*) AS "nTurns", CAST(sum(cost) AS DOUBLE) AS cost,
             min(agentType) AS "agentType", min(context) AS context, bool_or(kept) AS live
      FROM kept WHERE context <> 'main' AND agentId IS NOT NULL GROUP BY 2),
    spans AS (SELECT * FROM sessions UNION ALL SELECT * FROM agents)"""
KEPT_SQL = f"{TURNS_SQL}, kept AS (SELECT *, {WINDOW_SQL} AND project IN ('click', 'error') AS kept FROM turns)"


def _kept():
    chosen = crossfilter.CrossFilter()
    chosen.brush_time(WINDOW)
    chosen.show_projects(["click", "error"])
    return chosen.predicate()


@query(
    "timeline_spans",
    f"""WITH {KEPT_SQL}, {SPANS_SQL.replace("FROM kept ", "FROM kept_only ")
        .replace("sessions AS (", "kept_only AS (SELECT * FROM kept WHERE kept), sessions AS (", 1)}
    SELECT kind, id, project, "parentId", t0, t1, "nTurns", cost, "agentType", context FROM spans""",
)
def timeline_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.timeline_spans(event_turns(spark, sf_dir), _kept())


@query("live_spans", f"WITH {KEPT_SQL}, {SPANS_SQL} SELECT * FROM spans")
def live_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.live_spans(event_turns(spark, sf_dir), _kept())


@query(
    "inferred_forks",
    f"""WITH {TURNS_SQL}, moved AS (
      SELECT *, CASE WHEN k % 10 = 0 THEN 'f' || sessionId ELSE sessionId END AS f FROM turns)
    SELECT 'fork' AS kind, f AS id, min(project) AS project, sessionId AS "parentId", max(ms) AS t0,
           max(ms) AS t1, count(*) AS "nTurns", CAST(0 AS DOUBLE) AS cost,
           CAST(NULL AS VARCHAR) AS "agentType", 'fork' AS context
    FROM moved WHERE f <> sessionId GROUP BY f, sessionId""",
)
def inferred_forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = F.col("sessionId")
    moved = F.when(F.col("cacheReadTokens") % 10 == 0, F.concat(F.lit("f"), session))
    return timeline.inferred_forks(
        event_turns(spark, sf_dir).withColumn("fileSessionId", F.coalesce(moved, session))
    )


@query(
    "group_rollup",
    f"""WITH {KEPT_SQL}, {SPANS_SQL}, launched AS (
      SELECT "parentId" AS id, count(*) AS n FROM spans WHERE kind = 'agent' GROUP BY 1)
    SELECT project, count(*) AS "nSessions", CAST(coalesce(sum(n), 0) AS BIGINT) AS "nAgents", sum(cost) AS cost
    FROM spans s LEFT JOIN launched l ON s.id = l.id WHERE kind = 'session' GROUP BY 1""",
)
def group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.group_rollup(timeline.timeline_spans(event_turns(spark, sf_dir)))


@query(
    "agents_by_session",
    f"""WITH {KEPT_SQL}, {SPANS_SQL}
    SELECT "parentId" AS "sessionId", count(*) AS "nAgents", min(t0) AS t0, max(t1) AS t1,
           CAST(sum("nTurns") AS BIGINT) AS "nTurns", sum(cost) AS cost
    FROM spans WHERE kind = 'agent' GROUP BY 1""",
)
def agents_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.agents_by_session(timeline.timeline_spans(event_turns(spark, sf_dir)))


# Spans are user-days, grouped by day.
DAYS_SQL = f"""{TURNS_SQL}, days AS (
      SELECT strftime(ts, '%Y-%m-%d') AS project, sessionId || ':' || strftime(ts, '%Y-%m-%d') AS id,
             min(ms) AS t0, greatest(max(ms), min(ms) + 1) AS t1
      FROM turns GROUP BY 1, 2)"""


def day_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    spans = (
        event_turns(spark, sf_dir)
        .groupBy(day.alias("project"), F.concat("sessionId", F.lit(":"), day).alias("id"))
        .agg(F.min("ms").alias("t0"), F.max("ms").alias("t1"))
    )
    return intervals.with_extent(spans, 1)


@query(
    "lane_count",
    f"""WITH {DAYS_SQL}, edges AS (
      SELECT project, t0 AS moment, 1 AS d FROM days UNION ALL SELECT project, t1, -1 FROM days),
    run AS (SELECT project, sum(d) OVER (PARTITION BY project ORDER BY moment, d
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM edges)
    SELECT project, CAST(max(r) AS BIGINT) AS "laneCount" FROM run GROUP BY 1""",
)
def lane_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.peak_concurrency(day_spans(spark, sf_dir))


@query("lanes")
def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-fit lanes; tests compare them with a plain loop and with lane_count."""
    return intervals.pack_lanes(day_spans(spark, sf_dir))


@query(
    "activity_bands",
    f"""WITH {TURNS_SQL}, spans AS (SELECT project, ms AS t0, ms + 60000 * (1 + k % 30) AS t1 FROM turns),
    reach AS (SELECT *, max(t1) OVER (PARTITION BY project ORDER BY t0, t1 DESC
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans),
    marked AS (SELECT *, sum(CASE WHEN r IS NULL OR t0 - r > 120000 THEN 1 ELSE 0 END)
                     OVER (PARTITION BY project ORDER BY t0, t1 DESC ROWS UNBOUNDED PRECEDING) AS band FROM reach)
    SELECT project, min(t0) AS t0, max(t1) AS t1 FROM marked GROUP BY project, band""",
)
def activity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = event_turns(spark, sf_dir).select(
        "project",
        F.col("ms").alias("t0"),
        (F.col("ms") + (F.col("cacheReadTokens") % 30 + 1) * 60_000).alias("t1"),
    )
    return intervals.activity_bands(spans, gap_ms=120_000)


@query(
    "time_ticks",
    f"""WITH {TURNS_SQL}, extent AS (SELECT sessionId, min(ms) AS t0, max(ms) AS t1 FROM turns GROUP BY 1),
    steps AS (SELECT *, coalesce(
        (SELECT min(s) FROM (VALUES (3600000), (10800000), (21600000), (43200000), (86400000), (172800000),
             (604800000), (1209600000), (2419200000)) v(s) WHERE (t1 - t0) / s <= 8), 2419200000) AS step FROM extent),
    ticks AS (SELECT sessionId, step, unnest(generate_series(
        CAST(ceil(t0 / step) AS BIGINT) * step, t1, step)) AS t FROM steps)
    SELECT sessionId AS "sessionId", CAST(t AS BIGINT) AS t, t % 86400000 = 0 AS major,
           CASE WHEN step < 86400000 AND t % 86400000 <> 0 THEN strftime(make_timestamp(t * 1000), '%H:00')
                ELSE strftime(make_timestamp(t * 1000), '%b %-d') END AS label
    FROM ticks""",
)
def time_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    extent = event_turns(spark, sf_dir).groupBy("sessionId").agg(
        F.min("ms").alias("t0"), F.max("ms").alias("t1")
    )
    return intervals.time_ticks(extent)


# --- replay over conversations ----------------------------------------------
# A user line calls, the assistant line after it answers. Every seventh id is dropped and
# every fifth answer's call is renamed away, so blocks without partners occur too.

BLOCKS_SQL = """
    blocks AS (
      SELECT CAST(conv_id AS VARCHAR) AS "sessionId", turn AS seq, conv_id * 3600000 + turn * 600000 AS ts,
             CASE role WHEN 'user' THEN 'tool_use' WHEN 'assistant' THEN 'tool_result' ELSE 'prompt' END AS kind,
             CASE WHEN (conv_id + turn) % 7 = 0 THEN NULL
                  WHEN role = 'user' AND conv_id % 5 = 0 THEN 'x' || CAST(turn AS VARCHAR)
                  WHEN role = 'user' THEN 't' || CAST(turn AS VARCHAR)
                  ELSE 't' || CAST(turn - 1 AS VARCHAR) END AS id,
             text, false AS truncated, length(text) AS full_chars,
             CASE WHEN role = 'assistant' THEN length(text) % 3 <> 0 END AS ok,
             CASE WHEN role = 'assistant' AND length(text) % 4 = 0 THEN CAST(1 AS BIGINT) END AS code,
             CASE WHEN turn % 3 = 0 THEN NULL ELSE 'a' || CAST(turn % 3 AS VARCHAR) END AS agent
      FROM conversations),
    results AS (
      SELECT "sessionId", id, arg_max(text, seq) AS text, max(seq) AS seq, arg_max(ok, seq) AS ok,
             arg_max(coalesce(code, 0), seq) AS code
      FROM blocks WHERE kind = 'tool_result' AND id IS NOT NULL GROUP BY 1, 2),
    items AS (
      SELECT b.*, r.text AS answer,
             coalesce(r.ok = false, false) OR coalesce(r.code, 0) > 0 AS failed
      FROM blocks b LEFT JOIN results r ON b."sessionId" = r."sessionId" AND b.id = r.id
      WHERE b.kind = 'tool_use' AND b.id IS NOT NULL
      UNION ALL
      SELECT b.*, NULL, coalesce(b.kind = 'tool_result' AND b.ok = false, false) FROM blocks b
      WHERE NOT (b.kind = 'tool_use' AND b.id IS NOT NULL)
        AND NOT (b.kind = 'tool_result' AND b.id IS NOT NULL AND EXISTS (
          SELECT 1 FROM blocks u WHERE u.kind = 'tool_use' AND u."sessionId" = b."sessionId" AND u.id = b.id)))"""


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    role, turn, conv = F.col("role"), F.col("turn"), F.col("conv_id")
    size = F.length("text")
    return table(spark, sf_dir, "conversations").select(
        conv.cast("string").alias("sessionId"),
        turn.alias("seq"),
        (conv * 3_600_000 + turn * 600_000).alias("ts"),
        F.when(role == "user", "tool_use")
        .when(role == "assistant", "tool_result")
        .otherwise("prompt")
        .alias("kind"),
        F.when((conv + turn) % 7 == 0, F.lit(None))
        .when((role == "user") & (conv % 5 == 0), F.concat(F.lit("x"), turn.cast("string")))
        .when(role == "user", F.concat(F.lit("t"), turn.cast("string")))
        .otherwise(F.concat(F.lit("t"), (turn - 1).cast("string")))
        .alias("toolUseId"),
        replay.cut(F.col("text"), None).alias("cut"),
        F.when(role == "assistant", size % 3 != 0).alias("ok"),
        F.lit(None).cast("string").alias("errorKind"),
        F.when((role == "assistant") & (size % 4 == 0), F.lit(1).cast("long")).alias("exitCode"),
        F.lit(None).cast("long").alias("durationMs"),
        F.when(turn % 3 != 0, F.concat(F.lit("a"), (turn % 3).cast("string"))).alias("agentId"),
        F.when(turn % 3 != 0, "subagent").otherwise("main").alias("context"),
    ).select("*", "cut.*").drop("cut")


@query(
    "replay_fold",
    f"""WITH {BLOCKS_SQL} SELECT "sessionId", seq, ts, kind, id AS "toolUseId", answer, failed FROM items""",
)
def replay_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.fold(conversation_blocks(spark, sf_dir)).select(
        "sessionId", "seq", "ts", "kind", "toolUseId", F.col("result.text").alias("answer"), "failed"
    )


@query(
    "hour_buckets",
    f"""WITH {BLOCKS_SQL} SELECT "sessionId", ts // 3600000 * 3600000 AS hour, count(*) AS blocks,
           count(*) FILTER (kind = 'prompt') AS prompts, count(*) FILTER (kind = 'tool_use') AS "toolCalls",
           count(*) FILTER (failed) AS failures
    FROM items WHERE ts <> 0 GROUP BY 1, 2""",
)
def hour_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.hour_buckets(replay.fold(conversation_blocks(spark, sf_dir)))


@query(
    "agent_tracks",
    f"""WITH {BLOCKS_SQL} SELECT "sessionId", agent AS "agentId",
           CASE WHEN agent IS NULL THEN 'main' ELSE 'subagent' END AS context, count(*) AS blocks
    FROM items GROUP BY 1, 2, 3""",
)
def agent_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.agent_tracks(replay.fold(conversation_blocks(spark, sf_dir)))


@query(
    "hour_filter",
    f"""WITH {TURNS_SQL} SELECT event_id, ms FROM turns WHERE ms >= {WINDOW[0]} AND ms < {WINDOW[0]} + 3600000""",
)
def hour_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = event_turns(spark, sf_dir)
    return turns.where(crossfilter.within_hour(WINDOW[0], F.col("ms"))).select("event_id", "ms")


@query(
    "truncate_blocks",
    """SELECT doc_id, substr(text, 1, 400) AS text, length(text) > 400 AS truncated,
           CAST(length(text) AS INT) AS "fullChars" FROM documents""",
)
def truncate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.inline(F.array(replay.cut(F.col("text"), 400)))
    )


@query(
    "names_first_last",
    """WITH s AS (
      SELECT conv_id, count(DISTINCT text) FILTER (role = 'user') AS nu,
             arg_max(text, turn) FILTER (role = 'user') AS e1,
             arg_min(text, turn) FILTER (role = 'user') AS e0,
             arg_max(text, turn) FILTER (role = 'assistant') AS a1,
             arg_min(text, turn) FILTER (role = 'assistant') AS a0
      FROM conversations GROUP BY 1),
    n AS (SELECT CAST(conv_id AS VARCHAR) AS "sessionId", CASE WHEN conv_id % 2 = 0 THEN e1 END AS e1,
                 CASE WHEN conv_id % 2 = 0 THEN e0 END AS e0, a1, a0 FROM s)
    SELECT "sessionId", coalesce(e1, a1, substr("sessionId", 1, 8)) AS name,
           CASE WHEN e1 IS NOT NULL THEN 'explicit' WHEN a1 IS NOT NULL THEN 'ai' ELSE 'id' END AS "nameKind",
           coalesce(e0, a0, substr("sessionId", 1, 8)) AS "nameFirst",
           coalesce(e1, a1, '') <> coalesce(e0, a0, '') AS "nameChanged",
           e1 AS "customTitle", CASE WHEN e1 <> e0 THEN e0 END AS "customTitleFirst",
           a1 AS "aiTitle", CASE WHEN a1 <> a0 THEN a0 END AS "aiTitleFirst"
    FROM n""",
)
def names_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User lines of even conversations name explicitly, assistant lines are AI titles."""
    even = F.col("conv_id") % 2 == 0
    records = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("sessionId"),
        F.when((F.col("role") == "user") & even, F.col("text")).alias("explicit"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("ai"),
        F.lit(None).cast("string").alias("slug"),
        F.col("turn").alias("ord"),
    )
    return naming.session_names(records, "sessionId", [F.col("ord")]).drop("slug")


@query(
    "span_names",
    f"""WITH {KEPT_SQL}, {SPANS_SQL}
    SELECT s.id, s.kind, CASE WHEN s.kind = 'session' THEN c.c_name ELSE 'w' || s.id END AS name,
           CASE WHEN s.kind = 'session' AND c.c_acctbal < 0 THEN 'old ' || c.c_name END AS "nameWas",
           CASE WHEN s.kind = 'session' THEN c.c_name END AS "displayName"
    FROM spans s LEFT JOIN customer c ON s.id = CAST(c.c_custkey AS VARCHAR)""",
)
def span_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = event_turns(spark, sf_dir)
    spans = timeline.timeline_spans(turns)
    label = F.col("c_name")
    sessions = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("sessionId"),
        label.alias("name"),
        F.lit("explicit").alias("nameKind"),
        F.when(F.col("c_acctbal") < 0, F.concat(F.lit("old "), label)).otherwise(label).alias("nameFirst"),
    )
    agents = spans.where("kind = 'agent'").select(
        F.col("id").alias("agentId"),
        F.concat(F.lit("w"), "id").alias("name"),
        F.lit("fork").alias("nameKind"),
    )
    return timeline.span_names(spans, sessions, agents).select(
        "id", "kind", "name", "nameWas", "displayName"
    )
