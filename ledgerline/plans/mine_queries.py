"""The mine job bound to events: transcripts written from events, then normalized.

Each event becomes one transcript line. Three neighbouring event ids share a message id,
so responses are spread over records and over files of different users. Errors are turns
of an agent in a file below the session's folder, views are tool results.

Rates are multiples of powers of two, so sums do not depend on their order.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.time import ms_of
from ledgerline.operators import quality
from ledgerline.plans.normalize import Normalized, normalize
from ledgerline.plans.registry import query, table
from ledgerline.plans.replay_grain import replay_rows
from ledgerline.session import settings
from ledgerline.sources.prices import prices_from_json
from ledgerline.sources.scratch import materialize
from ledgerline.sources.transcripts import FILE_COLUMNS, classify

#: Lines per stored file of text, at most on average; and files, and tasks that parse them, per core.
LINES_PER_FILE = 1 << 17
TASKS_PER_CORE = 4

RATES = {
    "alpha": {
        "input_cost_per_token": 2.0**-20,
        "output_cost_per_token": 2.0**-17,
        "cache_creation_input_token_cost": 2.0**-19,
        "cache_creation_input_token_cost_above_1hr": 2.0**-18,
        "cache_read_input_token_cost": 2.0**-23,
    },
    "us.anthropic.beta": {"input_cost_per_token": 2.0**-19, "output_cost_per_token": 2.0**-16},
    "notes": "no rates here",
}

LINES_SQL = """
    ev AS (
      SELECT event_id AS e, user_id AS u, event_type AS kind, epoch_us(ts) // 1000 AS ms, props,
             CAST(json_extract(props, '$.k') AS BIGINT) AS k,
             'm' || CAST(event_id // 3 AS VARCHAR) AS mid, CASE WHEN event_id % 11 = 0 THEN 'r' END AS rid,
             'user-' || CAST(user_id AS VARCHAR) AS s, '-s-p' || CAST(user_id % 7 AS VARCHAR) AS slug
      FROM events),
    rec AS (
      SELECT *, CASE WHEN kind = 'error' THEN 'aw-' || lower(printf('%016x', u)) END AS agent,
             '0000' || chr(1) || slug || chr(1) || s || CASE WHEN kind = 'error' THEN
               chr(1) || 'subagents' || chr(1) || 'agent-aw-' || lower(printf('%016x', u)) || '.jsonl' ELSE '.jsonl' END AS walk
      FROM ev),
    billed AS (SELECT * FROM rec WHERE kind <> 'view'),
    win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mid, rid
               ORDER BY k DESC, kind = 'error', walk, e) AS rn FROM billed) WHERE rn = 1),
    shape AS (
      SELECT mid, rid, count(*) AS nb, CAST(sum(CASE WHEN kind = 'purchase' THEN length(props) ELSE 0 END) AS BIGINT) AS nt,
             count(*) FILTER (kind = 'signup') AS nu FROM billed GROUP BY 1, 2),
    priced AS (
      SELECT w.*, sh.nb, sh.nt, sh.nu, CASE WHEN k % 4 = 1 THEN '1m' END AS variant,
             CASE k % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN '<synthetic>' ELSE 'gamma' END AS model,
             CASE k % 4 WHEN 0 THEN k * pow(2.0, -20) WHEN 1 THEN k * pow(2.0, -19) ELSE 0 END AS c_in,
             CASE k % 4 WHEN 0 THEN k * pow(2.0, -17) WHEN 1 THEN k * pow(2.0, -16) ELSE 0 END AS c_out,
             CASE WHEN k % 4 = 0 THEN CASE WHEN k % 7 + k % 3 > 0 THEN k % 7 * pow(2.0, -19) + k % 3 * pow(2.0, -18)
                  ELSE 0 END ELSE 0 END AS c_write,
             CASE WHEN k % 4 = 0 THEN 10 * k * pow(2.0, -23) ELSE 0 END AS c_read
      FROM win w JOIN shape sh ON sh.mid = w.mid AND sh.rid IS NOT DISTINCT FROM w.rid),
    turns AS (
      SELECT mid AS "messageId", rid AS "requestId", 'u' || CAST(e AS VARCHAR) AS uuid, s AS "sessionId",
             slug AS "projectSlug", 'p' || CAST(u % 7 AS VARCHAR) AS project, ms, model, variant AS "modelVariant",
             CASE WHEN kind = 'error' THEN 'subagent' ELSE 'main' END AS context, agent AS "agentId",
             k AS "inputTokens", k AS "outputTokens", k % 7 AS "cacheCreate5m", k % 3 AS "cacheCreate1h",
             10 * k AS "cacheReadTokens", nb AS "nBlocks", nt AS "nThinkingChars", nu AS "nToolUses",
             CAST(c_in AS DOUBLE) AS "costInput", CAST(c_out AS DOUBLE) AS "costOutput",
             CAST(c_write AS DOUBLE) AS "costCacheCreate", CAST(c_read AS DOUBLE) AS "costCacheRead",
             CAST(c_in + c_out + c_write + c_read AS DOUBLE) AS "costTotal", k % 4 >= 2 AS unpriced
      FROM priced)"""


def _parse_tasks(spark: SparkSession) -> int:
    return TASKS_PER_CORE * spark.sparkContext.defaultParallelism


def parse_pieces(spark: SparkSession, events: DataFrame) -> int:
    """How many tasks events are dealt to for parsing: several a core, more as they grow."""
    return max(_parse_tasks(spark), -(-events.count() // LINES_PER_FILE))


def parse_settings(spark: SparkSession) -> dict[str, str]:
    """Several parsing tasks a core, however small the stored text is."""
    return {"spark.sql.files.minPartitionNum": str(_parse_tasks(spark)), "spark.sql.files.openCostInBytes": "65536"}


def event_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(lines, files) as the transcript reader delivers them."""
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("long")
    user = F.concat(F.lit("user-"), u.cast("string"))
    slug = F.concat(F.lit("-s-p"), (u % 7).cast("string"))
    agent = F.concat(F.lit("aw-"), F.format_string("%016x", u))
    in_agent = kind == "error"
    path = F.concat_ws(
        "/", F.lit("/t"), slug,
        F.when(in_agent, F.concat(user, F.lit("/subagents/agent-"), agent, F.lit(".jsonl"))).otherwise(
            F.concat(user, F.lit(".jsonl"))
        ),
    )

    def block(**named):
        return F.struct(*[v.alias(name) for name, v in named.items()])

    text = F.lit(None).cast("string")
    content = F.array(
        block(
            type=F.when(kind == "purchase", "thinking").when(kind == "signup", "tool_use")
            .when(kind == "view", "tool_result").otherwise("text"),
            thinking=F.when(kind == "purchase", F.col("props")),
            id=F.when(kind == "signup", F.concat(F.lit("t"), (e % 500).cast("string"), F.lit("-"), e.cast("string"))),
            name=F.when(kind == "signup", F.when(k % 2 == 0, "Bash").otherwise(F.concat(F.lit("mcp__srv"), (k % 3).cast("string"), F.lit("__x")))),
            tool_use_id=F.when(kind == "view", F.concat(F.lit("t"), ((e - 1) % 500).cast("string"), F.lit("-"), (e - 1).cast("string"))),
            text=F.when(~kind.isin("purchase", "signup", "view"), F.col("props")),
        )
    )
    usage = block(
        input_tokens=k,
        output_tokens=k,
        cache_read_input_tokens=k * 10,
        cache_creation_input_tokens=k % 7 + k % 3,
        cache_creation=block(ephemeral_5m_input_tokens=k % 7, ephemeral_1h_input_tokens=k % 3),
    )
    model = F.when(k % 4 == 0, "alpha").when(k % 4 == 1, "beta[1m]").when(k % 4 == 2, "<synthetic>").otherwise("gamma")
    billed = kind != "view"
    record = block(
        type=F.when(billed, "assistant").otherwise("user"),
        uuid=F.concat(F.lit("u"), e.cast("string")),
        sessionId=user,
        timestamp=F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        cwd=F.concat(F.lit("/w/p"), (u % 7).cast("string"), F.lit("/.claude/worktrees/x")),
        isSidechain=in_agent,
        agentId=F.when(in_agent, agent),
        attributionAgent=F.when(in_agent, "worker"),
        requestId=F.when(e % 11 == 0, "r"),
        message=block(
            id=F.when(billed, F.concat(F.lit("m"), F.floor(e / 3).cast("string"))),
            model=F.when(billed, model),
            content=content,
            usage=F.when(billed, usage),
        ),
        toolUseResult=F.when(
            ~billed,
            block(
                success=k % 3 != 0,
                exitCode=F.when(k % 4 == 0, k % 5),
                stderr=F.when(k % 3 == 0, F.col("props")).otherwise(text),
            ),
        ),
    )
    events = table(spark, sf_dir, "events")
    raw = events.select(
        F.to_json(record).alias("value"),
        path.alias("path"),
        F.floor(e / 65_536).alias("splitStart"),
        e.alias("lineIdx"),
        F.length("props").cast("long").alias("bytes"),
    )
    # Stored first, as transcripts are: the normalizer reads text from files. Parsing is far dearer
    # than reading, so the files are many and small, and no core waits for another's last task.
    raw = materialize(raw.repartition(parse_pieces(spark, events), "path"), "event-lines")
    lines = classify(raw, ["/t"])
    files = classify(raw.groupBy("path").agg(F.sum("bytes").alias("bytes")), ["/t"]).select(*FILE_COLUMNS)
    return lines, files


_DONE: dict[tuple[str, str], Normalized] = {}


def normalized(spark: SparkSession, sf_dir: str) -> Normalized:
    """The grains are stored tables, so queries of one application share one run."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DONE:
        lines, files = event_lines(spark, sf_dir)
        result = normalize(lines, files, prices_from_json(spark, json.dumps(RATES), "v1"))
        with settings(spark, parse_settings(spark)):
            result.facts.isEmpty()
        _DONE[key] = result
    return _DONE[key]


@query("mine_turns", f"WITH {LINES_SQL} SELECT * FROM turns")
def mine_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir)["turns"].select(
        "messageId", "requestId", "uuid", "sessionId", "projectSlug", "project", ms_of("ts").alias("ms"),
        "model", "modelVariant", "context", "agentId", "inputTokens", "outputTokens", "cacheCreate5m",
        "cacheCreate1h", "cacheReadTokens", "nBlocks", "nThinkingChars", "nToolUses", "costInput",
        "costOutput", "costCacheCreate", "costCacheRead", "costTotal", "unpriced",
    )


@query(
    "mine_tool_calls",
    f"""WITH {LINES_SQL}, results AS (
      SELECT e - 1 AS call, k, props FROM rec WHERE kind = 'view')
    SELECT t."messageId", 't' || CAST(b.e % 500 AS VARCHAR) || '-' || CAST(b.e AS VARCHAR) AS "toolUseId",
           t."sessionId", b.ms, CASE WHEN b.k % 2 = 0 THEN 'Bash' ELSE 'mcp__srv' || CAST(b.k % 3 AS VARCHAR) || '__x' END AS "toolName",
           b.k % 2 <> 0 AS "isMcp", CASE WHEN b.k % 2 <> 0 THEN 'srv' || CAST(b.k % 3 AS VARCHAR) END AS "mcpServer",
           t.context, CASE WHEN r.k % 3 = 0 THEN false WHEN r.k IS NOT NULL THEN true END AS ok,
           CASE WHEN r.k % 3 = 0 THEN r.props END AS "errorKind", CASE WHEN r.k % 4 = 0 THEN r.k % 5 END AS "exitCode"
    FROM billed b JOIN turns t ON t."messageId" = b.mid AND t."requestId" IS NOT DISTINCT FROM b.rid
    LEFT JOIN results r ON r.call = b.e WHERE b.kind = 'signup'""",
)
def mine_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir)["toolCalls"].select(
        "messageId", "toolUseId", "sessionId", ms_of("ts").alias("ms"), "toolName", "isMcp", "mcpServer",
        "context", "ok", "errorKind", "exitCode",
    )


@query(
    "mine_sessions",
    f"""WITH {LINES_SQL}, gaps AS (
      SELECT *, ms - lag(ms) OVER (PARTITION BY "sessionId" ORDER BY ms) AS dt FROM turns),
    sums AS (
      SELECT "sessionId", count(*) AS "nTurnsNative", sum("costTotal") AS "nativeCost",
             count(*) FILTER (context <> 'main') AS "nSubagentTurns",
             CAST(max("agentId" IS NOT NULL) AS BIGINT) AS "nAgentRuns", (max(ms) - min(ms)) / 1000.0 AS "spanSeconds",
             coalesce(sum(dt) FILTER (dt > 0 AND dt < 1800000), 0) / 1000.0 AS "activeSeconds",
             coalesce(max("cacheReadTokens" + "cacheCreate5m" + "cacheCreate1h" + "inputTokens") FILTER (context = 'main'), 0) AS "peakContextTokens",
             string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM gaps GROUP BY 1),
    everyone AS (SELECT DISTINCT s AS "sessionId" FROM rec WHERE kind <> 'error' UNION SELECT "sessionId" FROM sums)
    SELECT e."sessionId", coalesce("nTurnsNative", 0) AS "nTurnsNative", coalesce("nativeCost", 0) AS "nativeCost",
           coalesce("nSubagentTurns", 0) AS "nSubagentTurns", coalesce("nAgentRuns", 0) AS "nAgentRuns",
           CAST(coalesce("spanSeconds", 0) AS DOUBLE) AS "spanSeconds", CAST(coalesce("activeSeconds", 0) AS DOUBLE) AS "activeSeconds",
           CASE WHEN "nTurnsNative" > 0 THEN CASE WHEN "spanSeconds" > 0 THEN
             CAST("activeSeconds" AS DOUBLE) / CAST("spanSeconds" AS DOUBLE) ELSE 1 END END AS "dutyCycle",
           coalesce("peakContextTokens", 0) AS "peakContextTokens", coalesce(models, '') AS models
    FROM everyone e LEFT JOIN sums USING ("sessionId")""",
)
def mine_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir)["sessions"].select(
        "sessionId", "nTurnsNative", "nativeCost", "nSubagentTurns", "nAgentRuns", "spanSeconds",
        "activeSeconds", "dutyCycle", "peakContextTokens", "models",
    )


@query(
    "mine_agent_runs",
    f"""WITH {LINES_SQL}
    SELECT "agentId", 'worker' AS "agentType", 'w' AS name, 'named' AS "nameKind", "sessionId" AS "parentSessionId",
           "sessionId" AS "lineageId", min(ms) AS t0, max(ms) AS t1, (max(ms) - min(ms)) / 1000.0 AS "spanSeconds", count(*) AS "nTurns",
           CAST(sum("nToolUses") AS BIGINT) AS "nToolUses", sum("costTotal") AS cost,
           CAST(sum("outputTokens") AS BIGINT) AS "outputTokens", string_agg(DISTINCT model, ',' ORDER BY model) AS models
    FROM turns WHERE context <> 'main' GROUP BY "agentId", "sessionId" """,
)
def mine_agent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir)["agentRuns"].select(
        "agentId", "agentType", "name", "nameKind", "parentSessionId", "lineageId", ms_of("firstTs").alias("t0"),
        ms_of("lastTs").alias("t1"), "spanSeconds", "nTurns", "nToolUses", "cost", "outputTokens", "models",
    )


@query(
    "mine_lineages",
    f"""WITH {LINES_SQL}, everyone AS (SELECT DISTINCT s FROM rec WHERE kind <> 'error' UNION SELECT "sessionId" FROM turns)
    SELECT s AS "lineageId", CAST(1 AS BIGINT) AS "nSessions", CAST(0 AS BIGINT) AS "nForks", count("messageId") AS "nTurns",
           coalesce(sum("costTotal"), 0) AS "totalCost", s AS "sessionIds"
    FROM everyone LEFT JOIN turns ON "sessionId" = s GROUP BY s""",
)
def mine_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir)["lineages"].select(
        "lineageId", "nSessions", "nForks", "nTurns", "totalCost", "sessionIds"
    )


@query(
    "mine_statistics",
    f"""WITH {LINES_SQL}, spread AS (SELECT mid, count(DISTINCT walk) AS f FROM billed GROUP BY 1),
    groups AS (SELECT mid, rid, min(k) <> max(k) AS varied FROM billed GROUP BY 1, 2)
    SELECT (SELECT count(DISTINCT walk) FROM rec) AS files, (SELECT count(*) FROM rec) AS records, CAST(0 AS BIGINT) AS "parseErrors",
           (SELECT count(*) FROM billed) AS "assistantRecords", (SELECT count(*) FROM turns) AS "dedupedTurns",
           (SELECT CAST(sum(k) AS BIGINT) FROM billed) AS "naiveOutputTokens",
           (SELECT CAST(sum("outputTokens") AS BIGINT) FROM turns) AS "dedupedOutputTokens",
           (SELECT count(*) FROM spread WHERE f > 1) AS "crossFileDuplicates",
           (SELECT count(*) FROM turns WHERE unpriced) AS "unpricedTurns",
           (SELECT count(*) FROM groups WHERE varied) AS "groupsWithVaryingOutput",
           (SELECT sum("costTotal") FROM turns) AS "totalCost" """,
)
def mine_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).stats.select(
        "files", "records", "parseErrors", "assistantRecords", "dedupedTurns", "naiveOutputTokens",
        "dedupedOutputTokens", "crossFileDuplicates", "unpricedTurns", "groupsWithVaryingOutput", "totalCost",
    )


@query(
    "quality_checks",
    """SELECT CAST(NULL AS VARCHAR) AS "check", CAST(NULL AS VARCHAR) AS problem FROM events WHERE false""",
)
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations over the grains mined from events: none is the right answer."""
    return quality.problems(normalized(spark, sf_dir))


@query(
    "quality_violations",
    f"""WITH {LINES_SQL}
    SELECT 'billing-keys' AS "check", "messageId" || ' was billed 2 times' AS problem FROM turns WHERE "agentId" IS NOT NULL
    UNION ALL
    SELECT 'agents', 'agent runs hold ' || CAST(count(*) AS VARCHAR) || ' turns of ' || CAST(2 * count(*) AS VARCHAR)
    FROM turns WHERE "agentId" IS NOT NULL HAVING count(*) > 0
    UNION ALL
    SELECT 'lineage', 'root-misplaced session=' || "sessionId" || ' depth=3 lineage=' || "sessionId"
    FROM (SELECT DISTINCT s AS "sessionId" FROM rec WHERE kind <> 'error' UNION SELECT "sessionId" FROM turns)
    WHERE "sessionId" LIKE '%7'""",
)
def quality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks on deliberately damaged grains: agent turns twice, some roots too deep."""
    good = normalized(spark, sf_dir)
    turns = good["turns"]
    doubled = turns.unionByName(turns.where("agentId IS NOT NULL"))
    deep = F.when(F.endswith("sessionId", F.lit("7")), F.lit(3).cast("long")).otherwise(F.col("depth"))
    sessions = good["sessions"].withColumn("depth", deep)
    return (
        quality.unique_billing_keys(doubled)
        .unionByName(quality.agents_cover_turns(doubled, good["agentRuns"]))
        .unionByName(quality.lineage_closes(sessions, good["forkEdges"]))
    )


@query(
    "drift_report",
    f"""WITH {LINES_SQL}, ids AS (SELECT mid, count(*) AS n, count(DISTINCT walk) AS f FROM billed GROUP BY 1),
    groups AS (SELECT mid, rid, min(k) <> max(k) AS varied FROM billed GROUP BY 1, 2)
    SELECT 'recordsPerResponse' AS detector, sum(n) / count(*) AS value FROM ids
    UNION ALL SELECT 'idsInSeveralFiles', CAST(count(*) FILTER (f > 1) AS DOUBLE) FROM ids
    UNION ALL SELECT 'groupsWithVaryingOutput', CAST(count(*) FILTER (varied) AS DOUBLE) FROM groups
    UNION ALL SELECT 'subagentShare', count(*) FILTER (kind = 'error') / count(*) FROM billed
    UNION ALL SELECT 'inheritedRecords', CAST(0 AS DOUBLE) UNION ALL SELECT 'fallbackRecords', CAST(0 AS DOUBLE)
    UNION ALL SELECT 'syntheticRecords', CAST(count(*) FILTER (k % 4 = 2) AS DOUBLE) FROM billed
    UNION ALL SELECT 'variantRecords', CAST(count(*) FILTER (k % 4 = 1) AS DOUBLE) FROM billed
    UNION ALL SELECT 'markersWithoutOverlap', CAST(0 AS DOUBLE) UNION ALL SELECT 'edgesByOverlap', CAST(0 AS DOUBLE)
    UNION ALL SELECT 'unpricedTurns', CAST(count(*) FILTER (unpriced) AS DOUBLE) FROM turns""",
)
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = normalized(spark, sf_dir)
    return quality.drift_report(done.facts, done["turns"], done["forkEdges"])


@query(
    "mine_replay",
    f"""WITH {LINES_SQL}
    SELECT s AS "sessionId", (dense_rank() OVER (PARTITION BY s ORDER BY walk, e // 65536) - 1) * 1099511627776
             + row_number() OVER (PARTITION BY s, walk, e // 65536 ORDER BY e) - 1 AS seq, ms,
           agent AS "agentId", CASE WHEN kind = 'error' THEN 'subagent' ELSE 'main' END AS context,
           'u' || CAST(e AS VARCHAR) AS uuid, CASE WHEN kind = 'view' THEN 'user' ELSE 'assistant' END AS role,
           CASE kind WHEN 'purchase' THEN 'thinking' WHEN 'signup' THEN 'tool_use' WHEN 'view' THEN 'tool_result' ELSE 'text' END AS kind,
           CASE kind WHEN 'purchase' THEN NULL WHEN 'signup' THEN '{{}}' WHEN 'view' THEN '' ELSE props END AS text,
           CASE kind WHEN 'signup' THEN 2 WHEN 'view' THEN 0 ELSE length(props) END AS "fullChars",
           CASE WHEN kind = 'view' THEN CASE WHEN k % 3 = 0 THEN false ELSE true END END AS ok
    FROM rec""",
)
def mine_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = event_lines(spark, sf_dir)
    return replay_rows(lines).select(
        "sessionId", "seq", ms_of("ts").alias("ms"), "agentId", "context", "uuid", "role", "kind", "text",
        "fullChars", "ok",
    )
