"""Record accessors, images, files and the partitioned corpus bound to the sample tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import fields as R
from ledgerline.functions import images as I
from ledgerline.functions import variant as V
from ledgerline.functions.time import ms_of
from ledgerline.operators.replay import cut
from ledgerline.plans.registry import query, table
from ledgerline.plans.spend_queries import TURNS_SQL, event_turns
from ledgerline.schemas import GRAINS, Grain
from ledgerline.session import ensure_checkpoint_dir
from ledgerline.sources import corpus, sinks
from ledgerline.sources.transcripts import classify, parse_records


@query(
    "json_records",
    """SELECT event_id, event_id % 10 = 0 AS bad,
           CASE WHEN event_id % 10 NOT IN (0, 4) THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS k,
           CASE WHEN event_id % 10 = 4 THEN json_extract_string(props, '$.k') END AS "kText",
           CASE WHEN event_id % 10 <> 0 THEN coalesce(event_type = 'click', false) ELSE false END AS flag,
           CASE WHEN event_id % 10 <> 0 THEN event_type END AS kind
    FROM events WHERE event_id % 10 NOT IN (1, 2)""",
)
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Props as JSON lines, some broken, some blank, some not objects, some holding text
    where a number belongs."""
    part = F.col("event_id") % 10
    whole = F.to_json(
        F.struct(
            F.when(part != 4, F.get_json_object("props", "$.k").cast("long")).alias("n"),
            F.when(part == 4, F.get_json_object("props", "$.k")).alias("t"),
            F.struct(F.col("event_type").alias("kind"), (F.col("event_type") == "click").alias("flag")).alias("in"),
        )
    )
    # The last key of a repeated name wins.
    doubled = F.concat(F.lit('{"k": null, "k": '), F.coalesce(F.get_json_object(whole, "$.n"), F.concat(F.lit('"'), F.get_json_object(whole, "$.t"), F.lit('"'))), F.lit(', "in": '), F.get_json_object(whole, "$.in"), F.lit("}"))
    lines = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(part == 0, '{"broken').when(part == 1, "[1, 2]").when(part == 2, " \t ").otherwise(doubled).alias("value"),
    )
    rec = F.col("rec")
    return parse_records(lines).select(
        "event_id",
        "bad",
        V.number(rec, "$.k").alias("k"),
        V.text(rec, "$.k").alias("kText"),
        V.is_true(rec, "$.in.flag").alias("flag"),
        V.text(rec, "$.in.kind").alias("kind"),
    )


@query(
    "path_facts",
    """WITH f AS (
      SELECT page_id, page_id % 5 AS k, 's' || CAST(page_id AS VARCHAR) AS s, 'p' || CAST(page_id % 9 AS VARCHAR) AS slug FROM pages)
    SELECT page_id, slug AS "projectSlug", CASE WHEN k = 4 THEN 'agent-' || s ELSE s END AS "fileSessionId",
           CASE k WHEN 0 THEN 'session' WHEN 1 THEN 'subagent' WHEN 2 THEN 'workflow-agent' WHEN 3 THEN 'workflow-journal' ELSE 'session' END AS "fileKind",
           CASE WHEN k IN (1, 2) THEN 'a' || s WHEN k = 4 THEN s END AS "fileAgentId",
           CASE WHEN k IN (2, 3) THEN 'wf_' || s END AS "workflowId",
           '0001' || chr(1) || slug || chr(1) || CASE k WHEN 0 THEN s || '.jsonl' WHEN 4 THEN 'agent-' || s || '.jsonl'
             WHEN 1 THEN s || chr(1) || 'subagents' || chr(1) || 'agent-a' || s || '.jsonl'
             WHEN 2 THEN s || chr(1) || 'subagents' || chr(1) || 'workflows' || chr(1) || 'wf_' || s || chr(1) || 'agent-a' || s || '.jsonl'
             ELSE s || chr(1) || 'subagents' || chr(1) || 'workflows' || chr(1) || 'wf_' || s || chr(1) || 'journal.jsonl' END AS walk
    FROM f""",
)
def path_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of every kind below the second of two roots, with their place in the walk."""
    k = F.col("page_id") % 5
    s = F.concat(F.lit("s"), F.col("page_id").cast("string"))
    tail = (
        F.when(k == 0, F.concat(s, F.lit(".jsonl")))
        .when(k == 1, F.concat(s, F.lit("/subagents/agent-a"), s, F.lit(".jsonl")))
        .when(k == 2, F.concat(s, F.lit("/subagents/workflows/wf_"), s, F.lit("/agent-a"), s, F.lit(".jsonl")))
        .when(k == 3, F.concat(s, F.lit("/subagents/workflows/wf_"), s, F.lit("/journal.jsonl")))
        .otherwise(F.concat(F.lit("agent-"), s, F.lit(".jsonl")))
    )
    paths = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("/r/p"), (F.col("page_id") % 9).cast("string"), F.lit("/"), tail).alias("path")
    )
    facts = classify(paths, ["/none", "/r"])
    return facts.select(
        "page_id", "projectSlug", "fileSessionId", "fileKind", "fileAgentId", "workflowId", "walk"
    )


@query(
    "dimension_values",
    """WITH c AS (SELECT *, CASE role WHEN 'system' THEN 'system' WHEN 'user' THEN 'user' ELSE 'assistant' END AS kind FROM conversations),
    d AS (
      SELECT 'model' AS dimension, CASE WHEN kind = 'assistant' THEN 'm' || CAST(turn AS VARCHAR) END AS value FROM c
      UNION ALL SELECT 'permissionMode', CASE WHEN kind = 'user' THEN 'mode' || CAST(conv_id % 3 AS VARCHAR) END FROM c
      UNION ALL SELECT 'originKind', CASE WHEN kind = 'user' THEN 'o' || CAST(conv_id % 2 AS VARCHAR) END FROM c
      UNION ALL SELECT 'level', CASE WHEN kind = 'system' THEN 'info' END FROM c
      UNION ALL SELECT 'compactTrigger', CASE WHEN kind = 'system' THEN 'auto' END FROM c
      UNION ALL SELECT 'isSidechain', CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END FROM c
      UNION ALL SELECT 'version', CAST(conv_id % 4 AS VARCHAR) FROM c)
    SELECT dimension, value, count(*) AS records FROM d WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def dimension_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("role")
    kind = F.when(role.isin("system", "user"), role).otherwise("assistant")
    record = F.struct(
        kind.alias("type"),
        (F.col("turn") % 2 == 0).alias("isSidechain"),
        (F.col("conv_id") % 4).cast("string").alias("version"),
        F.concat(F.lit("mode"), (F.col("conv_id") % 3).cast("string")).alias("permissionMode"),
        F.lit("info").alias("level"),
        F.struct(F.concat(F.lit("o"), (F.col("conv_id") % 2).cast("string")).alias("kind")).alias("origin"),
        F.struct(F.lit("auto").alias("trigger")).alias("compactMetadata"),
        F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("model")).alias("message"),
        F.lit(5).alias("effort"),
    )
    records = table(spark, sf_dir, "conversations").select(F.try_parse_json(F.to_json(record)).alias("rec"))
    found = R.dimensions(F.col("rec"))
    pairs = F.array(
        *[F.struct(F.lit(name).alias("dimension"), c.alias("value")) for name, c in found.items()]
    )
    return (
        records.select(F.inline(pairs))
        .where("value IS NOT NULL")
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("records"))
    )


@query(
    "tool_summaries",
    """SELECT doc_id,
           CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN source WHEN 2 THEN NULL
                ELSE CASE WHEN length(text) >= length(source) THEN text ELSE source END END AS summary
    FROM documents""",
)
def tool_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known tools with and without their field, and an unknown tool's longest text."""
    part = F.col("doc_id") % 4
    name = F.when(part == 0, "Bash").when(part == 1, "Task").when(part == 2, "Read").otherwise("mcp__x__y")
    given = F.struct(
        F.when(part != 1, F.col("text")).alias("command"),
        F.when(part == 1, F.lit(7)).alias("name"),
        F.col("source").alias("description"),
        F.col("n_chars").alias("size"),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", R.tool_summary(name, F.try_parse_json(F.to_json(given))).alias("summary")
    )


@query(
    "result_texts",
    """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || '[image]' || chr(10) || role ELSE '' END AS text
    FROM conversations""",
)
def result_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("turn") % 3
    text = F.lit(None).cast("string")

    def piece(kind: str, body):
        return F.struct(F.lit(kind).alias("type"), body.alias("text"))

    listed = F.array(piece("text", F.col("text")), piece("image", text), piece("other", text), piece("text", F.col("role")))
    block = (
        F.when(part == 0, F.to_json(F.struct(F.col("text").alias("content"))))
        .when(part == 1, F.to_json(F.struct(listed.alias("content"))))
        .otherwise('{"content": 12}')
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", R.result_text(F.try_parse_json(block)).alias("text")
    )


@query(
    "project_labels",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'repo' || CAST(page_id % 11 AS VARCHAR)
           WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN 'wt' ELSE 'deep' END ELSE 'lamp' END AS project
    FROM pages""",
)
def project_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    repo = F.concat(F.lit("/home/n/src/repo"), (n % 11).cast("string"))
    cwd = F.when(n % 3 == 0, F.concat(repo, F.lit("/.claude/worktrees/agent-"), n.cast("string"))).when(
        n % 3 == 1, F.when(n % 2 == 0, "/srv/wt/").otherwise("/srv/wt/deep")
    )
    return table(spark, sf_dir, "pages").select(
        "page_id", R.project_label(F.lit("-home-n-src-lamp"), cwd).alias("project")
    )


@query(
    "agent_names",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN lower(c_mktsegment) END AS name,
           CASE c_custkey % 3 WHEN 0 THEN 'anonymous' WHEN 1 THEN 'named' ELSE 'fork' END AS "nameKind"
    FROM customer""",
)
def agent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    hexed = F.format_string("%016x", n)
    ident = F.when(n % 3 == 0, F.concat(F.lit("a"), hexed)).otherwise(
        F.concat(F.lit("a"), F.lower("c_mktsegment"), F.lit("-"), hexed)
    )
    kind = F.when(n % 3 == 2, "fork")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", R.agent_name(ident).alias("name"), R.agent_name_kind(ident, kind).alias("nameKind")
    )


@query(
    "image_headers",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'image/png' WHEN doc_id % 3 = 1 THEN 'image/jpeg' END AS "mediaType",
           CASE WHEN doc_id % 6 <> 5 THEN n_chars % 60000 + 1 END AS width, CASE WHEN doc_id % 6 <> 5 THEN CAST(doc_id % 500 + 1 AS BIGINT) END AS height,
           CASE WHEN doc_id % 6 <> 5 THEN CAST(floor((n_chars % 60000 + 1) * (doc_id % 500 + 1) / 750.0 + 0.5) AS BIGINT) END AS "estTokens"
    FROM documents""",
)
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG and JPEG payloads built from document sizes, sized from their headers alone."""
    w, h = F.col("n_chars") % 60_000 + 1, F.col("doc_id") % 500 + 1
    part = F.col("doc_id") % 6
    tail = F.lit("00" * 16)
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.format_string("%08X%08X", w, h), tail)
    jpeg = F.concat(
        F.lit("FFD8FFE000104A46494600010100000100010000FFC2001108"),
        F.format_string("%04X%04X", h, w), F.lit("03"), tail,
    )
    header = F.when(part % 3 == 0, png).when(part == 2, png).when(part % 3 == 1, jpeg).otherwise("DEADBEEF")
    source = F.struct(
        F.when(part % 3 == 0, "image/png").when(part % 3 == 1, "image/jpeg").alias("media_type"),
        F.base64(F.unhex(header)).alias("data"),
    )
    record = F.struct(F.struct(F.array(F.struct(F.lit("image").alias("type"), source.alias("source"))).alias("content")).alias("message"))
    rec = F.try_parse_json(F.to_json(record))
    refs = table(spark, sf_dir, "documents").select("doc_id", rec.alias("rec"))
    found = refs.select("doc_id", I.image_refs(F.col("rec"), R.content_blocks(F.col("rec"))).alias("images"))
    sized = I.measured(found).select("doc_id", F.inline("images"))
    return sized.select("doc_id", "mediaType", "width", "height", "estTokens")


@query(
    "text_cuts",
    """SELECT conv_id, turn, substr(text, 1, 800) AS text, length(text) > 800 AS truncated, CAST(length(text) AS INT) AS "fullChars" FROM conversations""",
)
def text_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.inline(F.array(cut(F.col("text"), 800)))
    )


def _exported(spark: SparkSession, sf_dir: str, months: int | None = None) -> tuple[str, Grain]:
    """Two users' turns written as a partitioned corpus below the shared folder."""
    prefix = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    grain = Grain("turns", "ts", by_month=True)
    turns = event_turns(spark, sf_dir).drop("ms")
    for user, keep in (("even", 0), ("odd", 1)):
        share = turns.where(F.col("event_id") % 2 == keep)
        sinks.export_grain(share, grain, prefix, user, "1e5", months)
    # A second export of one share replaces it.
    sinks.export_grain(turns.where("event_id % 2 = 0"), grain, prefix, "even", "1e5", months)
    return prefix, grain


@query(
    "export_roundtrip",
    f"""WITH {TURNS_SQL}
    SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS username, '1e5' AS host,
           strftime(ts, '%Y-%m') AS month, project, count(*) AS turns, CAST(sum(cost) AS DOUBLE) AS cost
    FROM turns GROUP BY 1, 3, 4""",
)
def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix, _ = _exported(spark, sf_dir)
    back = corpus.read_grain(spark, prefix, "turns")
    return back.groupBy("username", "host", "month", "project").agg(
        F.count(F.lit(1)).alias("turns"), F.sum("costTotal").cast("double").alias("cost")
    )


@query(
    "one_user",
    f"""WITH {TURNS_SQL}
    SELECT sessionId AS "sessionId", count(*) AS turns FROM turns WHERE event_id % 2 = 1 GROUP BY 1""",
)
def one_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user's share of a shared corpus, by pruning folders."""
    prefix, _ = _exported(spark, sf_dir)
    mine = corpus.read_grain(spark, prefix, "turns").where("username = 'odd'")
    return mine.groupBy("sessionId").agg(F.count(F.lit(1)).alias("turns"))


@query(
    "shard_totals",
    f"""WITH {TURNS_SQL}
    SELECT 'turns' AS grain, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS username, '1e5' AS host,
           strftime(ts, '%Y-%m') AS month, true AS sized, count(*) AS rows FROM turns GROUP BY 2, 4""",
)
def shard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard index of a written corpus, its row counts summed per partition."""
    prefix, _ = _exported(spark, sf_dir)
    shards = sinks.shard_index(spark, prefix, ["turns"])
    return shards.groupBy("grain", "username", "host", "month").agg(
        F.bool_and(F.col("bytes") > 0).alias("sized"), F.sum("rows").alias("rows")
    )


@query(
    "trailing_window",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
    WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 18 MONTH""",
)
def trailing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    return sinks.recent_months(orders, "ts", 18).select("o_orderkey", F.col("ts").cast("date").alias("day"))


@query(
    "shard_selection",
    f"""WITH RECURSIVE {TURNS_SQL},
    shards AS (SELECT project AS grain, CASE WHEN project <> 'signup' THEN strftime(ts, '%Y-%m-%d') END AS month,
                      project || '/' || strftime(ts, '%Y-%m-%d') AS path, CAST(sum(k) AS BIGINT) AS bytes FROM turns GROUP BY ALL),
    total AS (SELECT sum(bytes) // 3 AS budget FROM shards),
    ranked AS (SELECT *, row_number() OVER (ORDER BY month IS NOT NULL, month DESC, path) AS r FROM shards),
    pick(r, used, path, taken) AS (
      SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', false
      UNION ALL
      SELECT s.r, CASE WHEN p.used + s.bytes <= budget THEN p.used + s.bytes ELSE p.used END, s.path, p.used + s.bytes <= budget
      FROM pick p JOIN ranked s ON s.r = p.r + 1, total)
    SELECT s.grain, s.month, s.path, s.bytes FROM pick p JOIN shards s ON s.path = p.path WHERE taken""",
)
def shard_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    shards = (
        event_turns(spark, sf_dir)
        .groupBy(F.col("project").alias("grain"), day.alias("day"))
        .agg(F.sum("cacheReadTokens").alias("bytes"))
        .select(
            "grain",
            F.when(F.col("grain") != "signup", F.col("day")).alias("month"),
            F.concat("grain", F.lit("/"), "day").alias("path"),
            "bytes",
        )
    )
    budget = shards.agg(F.floor(F.sum("bytes") / 3)).first()[0]
    return sinks.select_shards(shards, budget)


@query(
    "replay_index",
    """SELECT CAST(conv_id AS VARCHAR) AS "sessionId", count(*) AS rows, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
           min(conv_id * 3600000 + turn * 600000) FILTER (conv_id + turn > 0) AS t0,
           max(conv_id * 3600000 + turn * 600000) FILTER (conv_id + turn > 0) AS t1
    FROM conversations GROUP BY 1""",
)
def replay_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("conv_id") * 3_600_000 + F.col("turn") * 600_000
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("sessionId"), F.timestamp_millis(ms).alias("ts"), "text"
    )
    return sinks.replay_index(rows)


@query(
    "free_sql",
    f"""WITH {TURNS_SQL}
    SELECT project, count(*) AS n, max(ms) AS last FROM turns GROUP BY 1""",
)
def free_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    event_turns(spark, sf_dir).createOrReplaceTempView("turns")
    return corpus.ask(
        spark, "SELECT project, count(*) AS n, max(unix_millis(ts)) AS last FROM turns GROUP BY project"
    )


@query(
    "one_session",
    f"""WITH {TURNS_SQL} SELECT event_id, ms FROM turns WHERE sessionId = '7'""",
)
def one_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    event_turns(spark, sf_dir).createOrReplaceTempView("turns")
    return corpus.one_session(spark, "turns", "7").select("event_id", ms_of("ts").alias("ms"))


def _shared(spark: SparkSession, sf_dir: str) -> str:
    """A corpus that two hosts of one user and another user have written, each with its index and
    manifest; one of them twice, the second time less."""
    prefix = f"{ensure_checkpoint_dir(spark)}/shared-{uuid.uuid4().hex}"
    turns = event_turns(spark, sf_dir)
    stats = spark.range(1).select(F.lit("v1").alias("pricingVersion"))
    grains = {g.name: g for g in GRAINS}
    for user, host, keep in (("a", "one", "event_id % 3 = 0"), ("a", "two", "event_id % 3 = 1"), ("b", "one", "true"), ("b", "one", "event_id % 3 = 2")):
        share = turns.where(keep).withColumn("costTotal", F.col("costTotal").cast("double"))
        contract = corpus.SCHEMAS["turns"].fields
        rows = share.select(*[(F.col(f.name) if f.name in share.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in contract])
        sinks.export_grain(rows, grains["turns"], prefix, user, host)
        written = sinks.write_index(spark, prefix, user, host)
        sinks.write_manifest(spark, prefix, user, host, {"roots": [f"/{host}"]}, stats, [], written)
    return prefix


_SHARE_SQL = f"""{TURNS_SQL}, shares AS (
      SELECT *, CASE WHEN event_id % 3 = 2 THEN 'b' ELSE 'a' END AS username, CASE WHEN event_id % 3 = 1 THEN 'two' ELSE 'one' END AS host FROM turns)"""


@query(
    "shared_manifest",
    f"""WITH {_SHARE_SQL}
    SELECT username, host, 'turns' AS grain, count(*) AS rows, true AS sized, '/' || host AS root FROM shares GROUP BY 1, 2""",
)
def shared_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of all shares read as one table."""
    prefix = _shared(spark, sf_dir)
    roots = corpus.read_manifests(spark, prefix).select(
        "username", "host", F.variant_get("document", "$.source.roots[0]", "string").alias("root")
    )
    held = corpus.manifest_tables(spark, prefix).where("rows > 0")
    return held.join(roots, ["username", "host"]).select(
        "username", "host", "grain", "rows", (F.col("bytes") > 0).alias("sized"), "root"
    )


@query(
    "shard_index_roundtrip",
    f"""WITH {_SHARE_SQL}
    SELECT username, host, 'turns' AS grain, strftime(ts, '%Y-%m') AS month, count(*) AS rows, true AS found FROM shares GROUP BY 1, 2, 4""",
)
def shard_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indexes of all shares, and that the files they name are those of the corpus."""
    prefix = _shared(spark, sf_dir)
    lines = corpus.read_index(spark, prefix)
    there = sinks.shard_index(spark, prefix, ["turns"]).select("path", F.col("bytes").alias("size"))
    return (
        lines.join(there, "path", "full")
        .groupBy("username", "host", "grain", "month")
        .agg(F.sum("rows").alias("rows"), F.bool_and(F.col("bytes").eqNullSafe(F.col("size"))).alias("found"))
    )


@query(
    "listed_shards",
    f"""WITH {_SHARE_SQL}, newest AS (SELECT max(strftime(ts, '%Y-%m')) AS month FROM turns)
    SELECT username, host, strftime(ts, '%Y-%m') AS month, count(*) AS turns, CAST(sum(k) AS BIGINT) AS tokens
    FROM shares, newest WHERE strftime(ts, '%Y-%m') = newest.month AND username = 'a' GROUP BY 1, 2, 3""",
)
def listed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the shards that the index lists for one user's newest month."""
    prefix = _shared(spark, sf_dir)
    lines = corpus.read_index(spark, prefix)
    newest = lines.agg(F.max("month")).first()[0]
    paths = [r["path"] for r in lines.where((F.col("month") == newest) & (F.col("username") == "a")).select("path").collect()]
    return corpus.read_shards(spark, prefix, paths).groupBy("username", "host", "month").agg(
        F.count(F.lit(1)).alias("turns"), F.sum("cacheReadTokens").alias("tokens")
    )


@query(
    "evolved_shards",
    f"""WITH {TURNS_SQL}
    SELECT CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END AS username, sessionId AS "sessionId",
           CAST(CASE WHEN event_id % 2 = 1 THEN project END AS VARCHAR) AS project, ms, k AS "cacheReadTokens",
           CAST(NULL AS VARCHAR) AS model, CAST(cost AS DOUBLE) AS "costTotal"
    FROM turns""",
)
def evolved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of two versions: the old ones lack columns, order them otherwise and hold narrower
    numbers, the new ones have a column that no contract knows."""
    prefix = f"{ensure_checkpoint_dir(spark)}/evolved-{uuid.uuid4().hex}"
    turns = event_turns(spark, sf_dir).withColumn("costTotal", F.col("costTotal").cast("double"))
    grain = Grain("turns", "ts", by_month=True)
    old = turns.where("event_id % 2 = 0").select("costTotal", F.col("cacheReadTokens").cast("int"), "ts", "sessionId")
    new = turns.where("event_id % 2 = 1").select("sessionId", "ts", "project", "cacheReadTokens", "costTotal", F.lit(1).alias("later"))
    sinks.export_grain(old, grain, prefix, "old", "h")
    sinks.export_grain(new, grain, prefix, "new", "h")
    back = corpus.read_conformed(spark, prefix, "turns")
    return back.select("username", "sessionId", "project", ms_of("ts").alias("ms"), "cacheReadTokens", "model", "costTotal")


@query(
    "replay_roundtrip",
    """SELECT CAST(conv_id AS VARCHAR) AS "sessionId", turn AS seq, text FROM conversations
    WHERE conv_id = (SELECT max(conv_id) FROM conversations)""",
)
def replay_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay of all conversations written in buckets; one session read back by pruning."""
    prefix = f"{ensure_checkpoint_dir(spark)}/replays-{uuid.uuid4().hex}"
    said = table(spark, sf_dir, "conversations")
    rows = said.select(
        F.col("conv_id").cast("string").alias("sessionId"), F.col("turn").alias("seq"),
        F.timestamp_millis(F.col("conv_id") * 3_600_000 + F.col("turn") * 600_000).alias("ts"), "text",
    )
    sinks.write_replay(rows, prefix, "u", "h")
    last = said.agg(F.max("conv_id").cast("string")).first()[0]
    return corpus.read_replay(spark, prefix, last).select("sessionId", "seq", "text")
