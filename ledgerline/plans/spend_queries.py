"""Spend, filter, drill-down and billing operators bound to the sample tables.

Events play the turns grain: a user is a session, the event type a project, the value a
cost in cents-exact decimals, and the number inside ``props`` a token count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import formats
from ledgerline.functions.time import ms_of
from ledgerline.operators import billing, crossfilter, detail, ordered, spend
from ledgerline.plans.registry import query, table

# 8 to 21 January 2024, in epoch milliseconds.
WINDOW = (1_704_672_000_000, 1_705_881_599_999)

TURNS_SQL = """
turns AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS sessionId, event_type AS project, ts,
         epoch_us(ts) // 1000 AS ms,
         CAST(value AS DECIMAL(18,2)) AS cost,
         CAST(value AS DECIMAL(18,2)) * 0.60 AS cRead,
         CAST(value AS DECIMAL(18,2)) * 0.25 AS cWrite,
         CAST(value AS DECIMAL(18,2)) * 0.14 AS cOut,
         CAST(value AS DECIMAL(18,2)) * 0.01 AS cIn,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         CASE WHEN event_type = 'error' THEN 'subagent' ELSE 'main' END AS context,
         CASE WHEN event_type = 'error'
              THEN 'a' || CAST(user_id AS VARCHAR) || ':' || CAST(day(ts) AS VARCHAR) END AS agentId,
         CASE WHEN event_type = 'error' THEN 'worker' END AS agentType,
         CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) >= 50
              THEN 'skill' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS VARCHAR) END AS skill,
         CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 5 = 0
              THEN 'mcp' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS VARCHAR) END AS mcp
  FROM events
)
"""
WINDOW_SQL = f"ms BETWEEN {WINDOW[0]} AND {WINDOW[1]}"


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the column names of the turns grain."""
    cost = F.col("value").cast("decimal(18,2)")
    k = F.get_json_object("props", "$.k").cast("long")
    agent = F.col("event_type") == "error"
    user = F.col("user_id").cast("string")
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id",
        user.alias("sessionId"),
        F.col("event_type").alias("project"),
        ts.alias("ts"),
        ms_of(ts).alias("ms"),
        cost.alias("costTotal"),
        (cost * F.expr("0.60BD")).alias("costCacheRead"),
        (cost * F.expr("0.25BD")).alias("costCacheCreate"),
        (cost * F.expr("0.14BD")).alias("costOutput"),
        (cost * F.expr("0.01BD")).alias("costInput"),
        k.alias("cacheReadTokens"),
        k.alias("contextTokens"),
        F.when(agent, "subagent").otherwise("main").alias("context"),
        F.when(agent, F.concat(F.lit("a"), user, F.lit(":"), F.dayofmonth(ts).cast("string"))).alias(
            "agentId"
        ),
        F.when(agent, "worker").alias("agentType"),
        F.when(k >= 50, F.concat(F.lit("skill"), (k % 4).cast("string"))).alias("attributionSkill"),
        F.when(k % 5 == 0, F.concat(F.lit("mcp"), (k % 3).cast("string"))).alias(
            "attributionMcpServer"
        ),
    )


def customer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the columns of the sessions grain that reports join in."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("sessionId"),
        F.col("c_mktsegment").alias("project"),
        F.col("c_name").alias("name"),
        (F.col("c_acctbal") < 0).alias("nameChanged"),
        F.concat(F.lit("old "), F.col("c_name")).alias("nameFirst"),
        F.col("c_nationkey").cast("long").alias("nCompactions"),
    )


@query(
    "daily_spend",
    f"""WITH {TURNS_SQL}
    SELECT CAST(ts AS DATE) AS day, project, CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS turns
    FROM turns GROUP BY 1, 2""",
)
def daily_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.daily_spend(event_turns(spark, sf_dir))


@query(
    "daily_totals",
    f"""WITH {TURNS_SQL}
    SELECT CAST(ts AS DATE) AS day, CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS turns
    FROM turns GROUP BY 1""",
)
def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.daily_spend(event_turns(spark, sf_dir), project=None)


@query(
    "daily_context",
    f"""WITH {TURNS_SQL}
    SELECT CAST(ts AS DATE) AS day, CAST(sum(cost) AS DOUBLE) AS total,
           CAST(coalesce(sum(cost) FILTER (project IN ('click', 'view')), 0) AS DOUBLE) AS live
    FROM turns GROUP BY 1""",
)
def daily_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.daily_context(event_turns(spark, sf_dir), crossfilter.members(["click", "view"]))


SUMMARY_SQL = """
    SELECT count(*) AS turns, count(DISTINCT sessionId) AS sessions,
           count(DISTINCT project) AS projects, min(ms) AS "firstTs", max(ms) AS "lastTs",
           CAST(sum(cost) AS DOUBLE) AS "totalCost", CAST(sum(cIn) AS DOUBLE) AS "costInput",
           CAST(sum(cOut) AS DOUBLE) AS "costOutput", CAST(sum(cWrite) AS DOUBLE) AS "costCacheCreate",
           CAST(sum(cRead) AS DOUBLE) AS "costCacheRead"
    FROM turns"""


@query("corpus_summary", f"WITH {TURNS_SQL} {SUMMARY_SQL}")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.corpus_summary(event_turns(spark, sf_dir))


@query("live_summary", f"WITH {TURNS_SQL} {SUMMARY_SQL} WHERE {WINDOW_SQL}")
def live_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.corpus_summary(event_turns(spark, sf_dir), crossfilter.time_range(WINDOW))


@query(
    "selection_stats",
    f"""WITH {TURNS_SQL}
    SELECT count(*) AS turns, count(DISTINCT sessionId) AS sessions,
           count(DISTINCT agentId) AS agents, CAST(sum(cost) AS DOUBLE) AS cost
    FROM turns WHERE {WINDOW_SQL} AND project IN ('click', 'error') AND cost BETWEEN 5 AND 80""",
)
def selection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = crossfilter.CrossFilter()
    chosen.show_projects(["click", "error"])
    chosen.publish("scatter", crossfilter.box(WINDOW, (5, 80)))
    return spend.selection_stats(event_turns(spark, sf_dir), chosen.predicate())


@query(
    "time_extent",
    f"WITH {TURNS_SQL} SELECT min(ms) AS t0, max(ms) AS t1 FROM turns",
)
def time_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.time_extent(event_turns(spark, sf_dir))


@query(
    "crossfilter_views",
    f"""WITH {TURNS_SQL}
    SELECT 'timeline' AS view, project, CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS turns
    FROM turns WHERE project <> 'signup' AND {WINDOW_SQL} AND cost BETWEEN 10 AND 200 GROUP BY 2
    UNION ALL
    SELECT 'project-filter', project, CAST(sum(cost) AS DOUBLE), count(*)
    FROM turns WHERE {WINDOW_SQL} AND cost BETWEEN 10 AND 200 GROUP BY 2
    UNION ALL
    SELECT 'table', project, CAST(sum(cost) AS DOUBLE), count(*)
    FROM turns WHERE project <> 'signup' AND {WINDOW_SQL} AND cost BETWEEN 10 AND 200 GROUP BY 2""",
)
def crossfilter_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view is filtered by the others' clauses; the box clause also obeys itself."""
    chosen = crossfilter.CrossFilter()
    chosen.toggle_project("signup", ["click", "error", "purchase", "signup", "view"])
    chosen.publish("timeline", crossfilter.box(WINDOW, (10, 200)), skip_self=False)
    views = ("timeline", "project-filter", "table")
    frames = chosen.views(
        event_turns(spark, sf_dir), {view: spend.project_totals for view in views}
    )
    first, *others = [
        frame.select(F.lit(view).alias("view"), "project", "cost", "turns")
        for view, frame in frames.items()
    ]
    for other in others:
        first = first.unionByName(other)
    return first


@query(
    "token_classes",
    """WITH parts AS (
      SELECT l_returnflag AS key,
             CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
             CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS discount,
             CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS tax
      FROM lineitem), sums AS (
      SELECT key, CAST(sum(price) AS DOUBLE) AS cost, count(*) AS turns,
             CAST(sum(discount) AS DOUBLE) AS discount, CAST(sum(tax) AS DOUBLE) AS tax
      FROM parts GROUP BY key)
    SELECT *, discount / cost AS "discountShare", tax / cost AS "taxShare" FROM sums""",
)
def token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        price.alias("price"),
        (price * F.col("l_discount").cast("decimal(4,2)")).alias("discount"),
        (price * F.col("l_tax").cast("decimal(4,2)")).alias("tax"),
    )
    return spend.token_classes(
        rows, None, "l_returnflag", "price", {"discount": "discount", "tax": "tax"}
    )


ATTRIBUTION_SQL = """
    SELECT 'agent' AS kind, coalesce(agentType, '(main loop)') AS key,
           CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS turns FROM turns GROUP BY 1, 2
    UNION ALL
    SELECT 'skill', coalesce(skill, '(none)'), CAST(sum(cost) AS DOUBLE), count(*)
    FROM turns GROUP BY 1, 2
    UNION ALL
    SELECT 'mcp', coalesce(mcp, '(none)'), CAST(sum(cost) AS DOUBLE), count(*)
    FROM turns GROUP BY 1, 2"""


@query("attribution", f"WITH {TURNS_SQL} {ATTRIBUTION_SQL}")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.attribution(event_turns(spark, sf_dir))


ORDER_AXES = (
    ("priority", "o_orderpriority", "(none)"),
    ("status", "o_orderstatus", "(none)"),
    ("segment", "c_mktsegment", "(none)"),
)
ORDER_ATTRIBUTION_SQL = """
    t AS (SELECT o.o_orderpriority AS p, o.o_orderstatus AS s, c.c_mktsegment AS m,
                 CAST(o_totalprice AS DECIMAL(18,2)) AS cost, o_orderdate >= TIMESTAMP '2000-01-01' AS kept
          FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
    sliced AS (
      SELECT 'priority' AS kind, coalesce(p, '(none)') AS key, cost, kept FROM t
      UNION ALL SELECT 'status', coalesce(s, '(none)'), cost, kept FROM t
      UNION ALL SELECT 'segment', coalesce(m, '(none)'), cost, kept FROM t),
    buckets AS (
      SELECT kind, key, CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS turns,
             CAST(coalesce(sum(cost) FILTER (kept), 0) AS DOUBLE) AS live
      FROM sliced GROUP BY 1, 2)"""


def order_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderpriority",
        "o_orderstatus",
        "o_orderdate",
        F.col("o_totalprice").cast("decimal(18,2)").alias("cost"),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left")
    kept = F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    return spend.attribution(joined, None, ORDER_AXES, "cost", context=kept)


@query("attribution_context", f"WITH {ORDER_ATTRIBUTION_SQL} SELECT * FROM buckets")
def attribution_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_attribution(spark, sf_dir)


@query(
    "top_per_axis",
    f"""WITH {ORDER_ATTRIBUTION_SQL},
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY cost DESC, key) AS INT) AS rank
               FROM buckets)
    SELECT * FROM ranked WHERE rank <= 3""",
)
def top_per_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.top_per_axis(order_attribution(spark, sf_dir), by="cost", limit=3)


@query(
    "project_totals",
    f"""WITH {TURNS_SQL}
    SELECT project, CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS turns FROM turns GROUP BY 1""",
)
def project_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.project_totals(event_turns(spark, sf_dir))


@query(
    "project_order",
    f"""WITH {TURNS_SQL} SELECT project, min(ms) AS "firstTs" FROM turns GROUP BY 1""",
)
def project_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.project_order(event_turns(spark, sf_dir), t0="ms")


@query(
    "scatter_meta",
    """SELECT count(*) AS turns, count(*) FILTER (c_acctbal <= 0) AS "zeroCost" FROM customer""",
)
def scatter_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.scatter_meta(table(spark, sf_dir, "customer"), cost="c_acctbal")


@query(
    "turn_scatter",
    f"""WITH {TURNS_SQL}
    SELECT ms AS ts, CAST(cost AS DOUBLE) AS cost, project,
           {WINDOW_SQL} AND cost BETWEEN 20 AND 100 AS live
    FROM turns WHERE cost > 0""",
)
def turn_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.turn_scatter(event_turns(spark, sf_dir), crossfilter.box(WINDOW, (20, 100)))


@query(
    "class_shares",
    f"""WITH {TURNS_SQL}, s AS (
      SELECT sum(cost) AS total, sum(cIn) AS i, sum(cOut) AS o, sum(cWrite) AS w, sum(cRead) AS r
      FROM turns)
    SELECT klass, CAST(c AS DOUBLE) AS cost, CAST(c AS DOUBLE) / CAST(total AS DOUBLE) AS share FROM (
      SELECT 'costInput' AS klass, i AS c, total FROM s UNION ALL SELECT 'costOutput', o, total FROM s
      UNION ALL SELECT 'costCacheCreate', w, total FROM s UNION ALL SELECT 'costCacheRead', r, total FROM s)""",
)
def class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.class_shares(event_turns(spark, sf_dir))


@query(
    "priciest_session",
    f"""WITH {TURNS_SQL}
    SELECT sessionId AS "sessionId", CAST(sum(cost) AS DOUBLE) AS cost FROM turns
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
)
def priciest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.priciest_session(event_turns(spark, sf_dir))


USAGE_SQL = f"""{TURNS_SQL},
    gaps AS (SELECT sessionId, ms, cost, k,
                    ms - lag(ms) OVER (PARTITION BY sessionId ORDER BY ms) AS dt FROM turns),
    used AS (SELECT g.sessionId AS "sessionId", min(ms) AS "firstTs", max(ms) AS "lastTs",
                    (max(ms) - min(ms)) / 1000.0 AS "spanSeconds",
                    coalesce(sum(CASE WHEN dt > 0 AND dt < 1800000 THEN dt END), 0) / 1000.0 AS "activeSeconds",
                    count(*) AS "nTurns", max(k) AS "peakContextTokens",
                    CAST(sum(cost) AS DOUBLE) AS cost
             FROM gaps g GROUP BY 1 HAVING count(*) > 1),
    usage AS (
      SELECT u."sessionId", c.c_mktsegment AS project, c.c_name AS name,
             CASE WHEN c.c_acctbal < 0 THEN 'old ' || c.c_name END AS "nameWas",
             CAST(c.c_nationkey AS BIGINT) AS "nCompactions", "firstTs", "lastTs",
             CAST("spanSeconds" AS DOUBLE) AS "spanSeconds", CAST("activeSeconds" AS DOUBLE) AS "activeSeconds",
             CASE WHEN "spanSeconds" > 0
                  THEN CAST("activeSeconds" AS DOUBLE) / CAST("spanSeconds" AS DOUBLE) ELSE 1 END AS "dutyCycle",
             "nTurns", "peakContextTokens", cost
      FROM used u LEFT JOIN customer c ON u."sessionId" = CAST(c.c_custkey AS VARCHAR))"""


def event_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spend.session_labels(customer_sessions(spark, sf_dir))
    return spend.session_usage(event_turns(spark, sf_dir), labels, idle_minutes=30)


@query("session_usage", f"WITH {USAGE_SQL} SELECT * FROM usage")
def session_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_usage(spark, sf_dir)


@query(
    "session_table",
    f"""WITH {USAGE_SQL}, top AS (SELECT * FROM usage ORDER BY cost DESC, "sessionId" LIMIT 25)
    SELECT *, "spanSeconds" / max("spanSeconds") OVER () AS "spanShare",
           least(1.0, "dutyCycle") AS "dutyShown", "dutyCycle" < 0.15 AS "lowDuty" FROM top""",
)
def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.session_table(event_usage(spark, sf_dir))


@query(
    "session_lookup",
    f"""WITH {TURNS_SQL}
    SELECT t.sessionId AS "sessionId", c.c_name AS name, CAST(sum(t.cost) AS DOUBLE) AS cost
    FROM customer c JOIN turns t ON t.sessionId = CAST(c.c_custkey AS VARCHAR)
    WHERE lower(c.c_name) = '12' OR starts_with(lower(t.sessionId), '12') OR contains(lower(c.c_name), '12')
    GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 5""",
)
def session_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.find_sessions(
        customer_sessions(spark, sf_dir), event_turns(spark, sf_dir), "12"
    )


@query(
    "idle_gaps",
    f"""WITH {TURNS_SQL}, seq AS (
      SELECT sessionId, ms, row_number() OVER w - 1 AS i, lag(ms) OVER w AS prev FROM turns
      WINDOW w AS (PARTITION BY sessionId ORDER BY ms, event_id))
    SELECT sessionId AS "sessionId", i - 1 AS i, ms - prev AS ms FROM seq WHERE ms - prev >= 43200000""",
)
def idle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.idle_gaps(
        event_turns(spark, sf_dir), ["sessionId"], "ms", 12 * 3_600_000, ["event_id"]
    )


BUCKETS_SQL = f"""{TURNS_SQL}, seq AS (
      SELECT *, row_number() OVER (PARTITION BY sessionId ORDER BY ms, event_id) - 1 AS i,
             count(*) OVER (PARTITION BY sessionId) AS n FROM turns),
    buckets AS (
      SELECT sessionId AS "sessionId", i // greatest(1, CAST(ceil(n / 10.0) AS BIGINT)) AS bucket,
             min(i) AS "from", max(i) AS "to", count(*) AS turns, min(ms) AS t0, max(ms) AS t1,
             CAST(sum(cRead) AS DOUBLE) AS "costCacheRead", CAST(sum(cWrite) AS DOUBLE) AS "costCacheCreate",
             CAST(sum(cOut) AS DOUBLE) AS "costOutput", CAST(sum(cIn) AS DOUBLE) AS "costInput",
             CAST(sum(cost) AS DOUBLE) AS "costTotal", CAST(max(cost) AS DOUBLE) AS "maxTurnCost"
      FROM seq GROUP BY 1, 2)"""


def event_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail.bucket_turns(event_turns(spark, sf_dir), 10, ms="ms", ties=["event_id"])


@query("turn_buckets", f"WITH {BUCKETS_SQL} SELECT * FROM buckets")
def turn_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_buckets(spark, sf_dir)


@query(
    "cost_stack",
    f"""WITH {BUCKETS_SQL}, layers AS (
      SELECT "sessionId", "from", "to", 0 AS layer, 'cache read' AS klass, "costCacheRead" AS cost FROM buckets
      UNION ALL SELECT "sessionId", "from", "to", 1, 'cache creation', "costCacheCreate" FROM buckets
      UNION ALL SELECT "sessionId", "from", "to", 2, 'output', "costOutput" FROM buckets
      UNION ALL SELECT "sessionId", "from", "to", 3, 'fresh input', "costInput" FROM buckets)
    SELECT * FROM layers WHERE cost > 0""",
)
def cost_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail.cost_stack(event_buckets(spark, sf_dir))


@query(
    "growth_fifths",
    f"""WITH {TURNS_SQL}, seq AS (
      SELECT *, row_number() OVER (PARTITION BY sessionId, context ORDER BY ms, event_id) - 1 AS i,
             count(*) OVER (PARTITION BY sessionId, context) AS n FROM turns),
    fifths AS (
      SELECT *, context = 'main' AND i < greatest(1, n // 5) AS head,
             context = 'main' AND i >= n - greatest(1, n // 5) AS tail FROM seq),
    means AS (
      SELECT sessionId AS "sessionId", count(*) AS turns, CAST(sum(cost) AS DOUBLE) AS cost,
             coalesce(CAST(sum(cost) FILTER (head) AS DOUBLE) / nullif(count(*) FILTER (head), 0), 0) AS "firstFifthMean",
             coalesce(CAST(sum(cost) FILTER (tail) AS DOUBLE) / nullif(count(*) FILTER (tail), 0), 0) AS "lastFifthMean",
             coalesce(max(k) FILTER (context = 'main'), 0) AS "peakContextTokens",
             count(*) FILTER (context <> 'main') AS "subagentTurns"
      FROM fifths GROUP BY 1)
    SELECT *, CASE WHEN "firstFifthMean" > 0 THEN "lastFifthMean" / "firstFifthMean" END AS "growthRatio"
    FROM means""",
)
def growth_fifths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail.growth(event_turns(spark, sf_dir), ms="ms", ties=["event_id"])


@query(
    "compaction_asof",
    f"""WITH {TURNS_SQL}
    SELECT m.sessionId AS "sessionId", m.ms, m.event_id, m.k AS "preTokens",
           (SELECT count(*) FROM turns t WHERE t.project <> 'error' AND t.sessionId = m.sessionId
            AND t.ms <= m.ms) - 1 AS i
    FROM turns m WHERE m.project = 'error'""",
)
def compaction_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = event_turns(spark, sf_dir)
    marks = turns.where("project = 'error'").select(
        "sessionId", "ms", "event_id", F.col("cacheReadTokens").alias("preTokens")
    )
    return detail.compaction_marks(turns.where("project <> 'error'"), marks, ms="ms")


@query(
    "compaction_payload",
    """SELECT CAST(user_id AS VARCHAR) AS "sessionId", epoch_us(ts) // 1000 AS ts,
           1000 * CAST(json_extract(props, '$.k') AS BIGINT) AS "preTokens",
           CAST(json_extract(props, '$.k') AS BIGINT) AS "postTokens",
           CASE WHEN value > 20 THEN 'auto' ELSE 'manual' END AS trigger
    FROM events WHERE event_type = 'error'""",
)
def compaction_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    payload = F.to_json(
        F.struct(
            F.when(F.col("value") > 20, "auto").otherwise("manual").alias("trigger"),
            (k * 1000).alias("preTokens"),
            k.alias("postTokens"),
        )
    )
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("sessionId"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", "compaction").otherwise("fallback").alias("kind"),
        payload.alias("payload"),
    )
    return detail.session_compactions(events)


def _printed(x: str, digits: int) -> str:
    """SQL for a fixed number of decimals with exact ties going up."""
    lifted = f"CASE WHEN ({x}) * {2 ** (digits + 1)} % 2 = 1 THEN ({x}) + {0.2 * 10**-digits:.5f} ELSE {x} END"
    return f"printf('%.{digits}f', CAST({lifted} AS DOUBLE))"


@query(
    "report_formats",
    f"""WITH {TURNS_SQL}, s AS (
      SELECT sessionId, CAST(sum(cost) AS DOUBLE) AS c, max(ms) - min(ms) AS span, max(ms) AS last,
             CAST(sum(CASE WHEN project = 'click' THEN cost ELSE 0 END) AS DOUBLE) AS part
      FROM turns GROUP BY 1)
    SELECT sessionId AS "sessionId",
           CASE WHEN c >= 100 THEN '$' || {_printed("c", 0)} WHEN c >= 1 THEN '$' || {_printed("c", 2)}
                ELSE '$' || {_printed("c", 3)} END AS usd,
           CASE WHEN c > 0 THEN {_printed("part / c * 100", 1)} || '%' ELSE '—' END AS pct,
           CASE WHEN span >= 86400000 THEN {_printed("span / 86400000", 1)} || 'd'
                WHEN span >= 3600000 THEN {_printed("span / 3600000", 1)} || 'h'
                ELSE CAST(greatest(1, CAST(floor(span / 60000 + 0.5) AS BIGINT)) AS VARCHAR) || 'm' END AS dur,
           strftime(make_timestamp(last * 1000), '%Y-%m-%d %H:%M') AS "when",
           strftime(make_timestamp(last * 1000), '%Y-%m-%d') AS "day",
           CAST((c >= 1) AS INT) + CAST((c >= 10) AS INT) + CAST((c >= 50) AS INT) + CAST((c >= 200) AS INT) AS tier
    FROM s""",
)
def report_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = event_turns(spark, sf_dir).groupBy("sessionId").agg(
        F.sum("costTotal").cast("double").alias("c"),
        (F.max("ms") - F.min("ms")).alias("span"),
        F.max("ms").alias("last"),
        F.sum(F.when(F.col("project") == "click", F.col("costTotal")).otherwise(F.lit(0)))
        .cast("double")
        .alias("part"),
    )
    return sums.select(
        "sessionId",
        formats.usd(F.col("c")).alias("usd"),
        formats.pct(F.col("part"), F.col("c")).alias("pct"),
        formats.duration(F.col("span")).alias("dur"),
        formats.when_utc(F.col("last")).alias("when"),
        formats.day_utc(F.col("last")).alias("day"),
        formats.cost_tier(F.col("c")).alias("tier"),
    )


@query(
    "category_index",
    """SELECT p_brand AS project, CAST((dense_rank() OVER (ORDER BY p_brand) - 1) % 12 AS INT) AS slot
    FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL)""",
)
def category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.category_index(
        table(spark, sf_dir, "part").select(F.col("p_brand").alias("project"))
    )


@query(
    "billing_dedup",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
               ORDER BY l_quantity DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1""",
)
def billing_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.dedup_billed(
        table(spark, sf_dir, "lineitem"),
        ["l_orderkey", "l_linenumber"],
        [-F.col("l_quantity"), -F.col("l_partkey"), -F.col("l_suppkey")],
        ["l_quantity", "l_partkey", "l_suppkey", "l_extendedprice"],
    )


@query(
    "structure_union",
    """SELECT l_orderkey, l_linenumber, count(*) AS "nMembers", sum(l_quantity) AS l_quantity FROM (
      SELECT l_orderkey, l_linenumber, l_partkey, max(l_quantity) AS l_quantity
      FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def structure_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.structure_union(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey", ["l_quantity"]
    )


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


PRICE_SQL = """
    brands AS (SELECT p_type, p_brand, CAST(substr(p_brand, 7) AS INT) AS b,
                      CAST(avg(CAST(p_size AS DOUBLE)) AS DOUBLE) AS rate
               FROM part GROUP BY 1, 2, 3),
    bases AS (SELECT p_type, max(p_size) AS rate FROM part GROUP BY 1),
    prices AS (
      SELECT p_type || '[' || p_brand || ']' AS key, rate FROM brands WHERE b % 3 = 0
      UNION ALL SELECT p_type || '-' || p_brand, rate + 1 FROM brands WHERE b % 2 = 0
      UNION ALL SELECT p_type, CAST(rate AS DOUBLE) FROM bases WHERE p_type < 'N'
      UNION ALL SELECT 'us.anthropic.' || p_type, CAST(rate + 100 AS DOUBLE) FROM bases WHERE p_type > 'R')"""


@query(
    "price_lookup",
    f"""WITH {PRICE_SQL}, models AS (
      SELECT p_partkey, p_size, p_type AS base, p_brand AS variant, p_type || '[' || p_brand || ']' AS model FROM part),
    hits AS (
      SELECT m.*, coalesce(a.key, b.key, c.key, d.key) AS "pricedAs", coalesce(a.rate, b.rate, c.rate, d.rate) AS rate
      FROM models m LEFT JOIN prices a ON a.key = m.model
      LEFT JOIN prices b ON b.key = m.base || '-' || m.variant
      LEFT JOIN prices c ON c.key = m.base
      LEFT JOIN prices d ON d.key = 'us.anthropic.' || m.base)
    SELECT p_partkey, model, "pricedAs", CAST(p_size * rate AS DOUBLE) AS "costInput",
           CAST(0 * rate AS DOUBLE) AS "costOutput",
           CAST(CASE WHEN p_size % 2 = 0 THEN p_size * rate * 2 ELSE p_size * rate END AS DOUBLE) AS "costCacheCreate",
           CAST(0 * rate AS DOUBLE) AS "costCacheRead"
    FROM hits""",
)
def price_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    brand = F.substring("p_brand", 7, 10).cast("int")
    bracketed = F.concat("p_type", F.lit("["), "p_brand", F.lit("]"))
    by_brand = part.groupBy("p_type", "p_brand").agg(F.avg(F.col("p_size").cast("double")).alias("r"))
    by_type = part.groupBy("p_type").agg(F.max("p_size").cast("double").alias("r"))
    entries = (
        by_brand.where(brand % 3 == 0).select(bracketed.alias("key"), "r")
        .unionByName(
            by_brand.where(brand % 2 == 0).select(
                F.concat("p_type", F.lit("-"), "p_brand").alias("key"), (F.col("r") + 1).alias("r")
            )
        )
        .unionByName(by_type.where("p_type < 'N'").select(F.col("p_type").alias("key"), "r"))
        .unionByName(
            by_type.where("p_type > 'R'").select(
                F.concat(F.lit("us.anthropic."), "p_type").alias("key"), (F.col("r") + 100).alias("r")
            )
        )
    )
    # Long-lived cache writes cost twice the short rate.
    prices = entries.select(
        "key",
        F.col("r").alias("input"),
        F.lit(0.0).alias("output"),
        F.col("r").alias("cacheCreate5m"),
        (F.col("r") * 2).alias("cacheCreate1h"),
        F.lit(None).cast("double").alias("cacheRead"),
    )
    units = part.select("p_partkey", bracketed.alias("model"), F.col("p_size").cast("long").alias("n"))
    rates = billing.resolve_models(units, prices)
    even = F.col("n") % 2 == 0
    zero = F.lit(0).cast("long")
    costs = billing.price_columns(
        input=F.col("n"),
        output=F.col("n"),
        cache5m=zero,
        cache1h=F.when(even, F.col("n")).otherwise(zero),
        cache_create=F.col("n"),
        cache_read=F.col("n"),
    )
    return units.join(rates, "model", "left").select(
        "p_partkey", "model", "pricedAs", *[c.alias(name) for name, c in costs.items()]
    )


@query(
    "distinct_images",
    """WITH d AS (SELECT md5(text) AS hash, min(lang) AS lang, min(length(text)) AS w FROM documents GROUP BY 1)
    SELECT lang AS "mediaType", count(*) AS n, CAST(sum(floor(w * 10 / 750.0 + 0.5)) AS BIGINT) AS "estTokens",
           sum(w * 10) / 1e6 AS megapixels FROM d GROUP BY 1""",
)
def distinct_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand in for image payloads; exact copies share a hash."""
    width = F.length("text").cast("long")
    images = table(spark, sf_dir, "documents").select(
        F.md5("text").alias("hash"),
        F.col("lang").alias("mediaType"),
        width.alias("width"),
        F.lit(10).cast("long").alias("height"),
        F.floor(width * 10 / 750.0 + 0.5).cast("long").alias("estTokens"),
        F.col("lang").alias("uuid"),
        F.lit("content").alias("carrier"),
    )
    return spend.distinct_images(images)
