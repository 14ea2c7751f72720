"""From transcript lines to grains.

Lines are parsed once into a narrow typed table (``record_facts``), written to the shared
checkpoint folder because many branches read it. Payload text never enters a shuffle.
Everything after that is aggregation and equi-joins on billing keys, uuids and sessions.

Each grain and each table between is made and stored when it is first asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import fields as R
from ledgerline.functions import images as I
from ledgerline.functions import variant as V
from ledgerline.functions.time import ts_of
from ledgerline.operators import billing, lineage, naming
from ledgerline.operators.billing import PriceTable
from ledgerline.operators.ordered import gap_usage, place_in_ranges
from ledgerline.operators.quality import side_by_side
from ledgerline.schemas import conform
from ledgerline.sources.scratch import materialize
from ledgerline.sources.transcripts import CHUNK, ORDER, parse_records

KEY = ["messageId", "requestKey"]
COSTS = ("costInput", "costOutput", "costCacheCreate", "costCacheRead")
IDLE_SECONDS = 1800
ERROR_CHARS = 200

# Record text that turns carry over unchanged: column and path.
TURN_TEXT = {
    "cwd": "cwd",
    "gitBranch": "gitBranch",
    "effort": "effort",
    "stopReason": "message.stop_reason",
    "serviceTier": "message.usage.service_tier",
    "speed": "message.usage.speed",
    "entrypoint": "entrypoint",
    "sessionKind": "sessionKind",
    "ccVersion": "version",
    "attributionSkill": "attributionSkill",
    "attributionPlugin": "attributionPlugin",
    "attributionMcpServer": "attributionMcpServer",
    "attributionMcpTool": "attributionMcpTool",
    "agentType": "attributionAgent",
}


# The texts that ``record_facts`` reads from every record.
RECORD_TEXTS = (
    "type", "uuid", "session_id", "sessionId", "timestamp", "agentId", "message.id", "message.model", "requestId",
    "slug", *TURN_TEXT.values(), "apiRefusalCategory", "originalModel", "fallbackModel", "customTitle", "agentName",
    "aiTitle",
)


class Grains(Mapping):
    """The grains by name, each conformed to its contract when it is taken."""

    def __init__(self, work: Work):
        self._makers = {
            "turns": lambda: work.turns.drop("requestKey", "originSession"),
            "toolCalls": lambda: _tool_calls(work.facts, work.turns, work.error_chars),
            "events": lambda: work.events,
            "sessions": lambda: work.sessions,
            "images": lambda: _attributed_images(work.images, work.digest, work.forest),
            "forkEdges": lambda: work.fork_edges,
            "agentRuns": lambda: work.agent_runs,
            "lineages": lambda: work.lineages,
        }
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = conform(self._makers[name](), name)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


@dataclass
class Normalized:
    """The grains, and what the quality checks need besides them."""

    grains: Mapping[str, DataFrame]
    work: Work

    def __getitem__(self, grain: str) -> DataFrame:
        return self.grains[grain]

    @property
    def stats(self) -> DataFrame:
        return self.work.stats

    @property
    def unresolved(self) -> DataFrame:
        return self.work.forest.unresolved

    @property
    def facts(self) -> DataFrame:
        return self.work.facts


def record_facts(records: DataFrame) -> DataFrame:
    """One narrow row per record: identity, place, tokens, structure counts, references."""
    raw = F.col("rec")
    kept = [
        *ORDER, "projectSlug", "fileSessionId", "fileKind", "fileAgentId", "workflowId", "bad",
    ]
    # Paths several columns read are walked once, here, and so is the record for its texts.
    said = V.told(F.col("_texts"))
    opened = records.select(*kept, "rec", V.texts(raw, RECORD_TEXTS).alias("_texts")).select(
        *kept,
        "rec",
        "_texts",
        R.record_type(raw, said).alias("type"),
        R.content_blocks(raw).alias("_blocks"),
        said(raw, "$.message.model").alias("modelName"),
        *[c.alias(name) for name, c in R.usage_parts(raw).items()],
        *[c.alias(name) for name, c in R.outcome_parts(raw).items()],
    )
    v, blocks = F.col("rec"), F.col("_blocks")
    assistant, user = F.col("type") == "assistant", F.col("type") == "user"
    none = F.lit(0).cast("long")
    with_parts = opened.select(
        *kept,
        "type",
        "modelName",
        said(v, "$.uuid").alias("uuid"),
        said(v, "$.session_id").alias("originSession"),
        R.is_inherited(v, said).alias("inherited"),
        R.timestamp_ms(v, said).alias("ts"),
        R.is_sidechain(v).alias("sidechain"),
        said(v, "$.agentId").alias("agentId"),
        F.when(assistant, R.message_id(v, said)).alias("messageId"),
        said(v, "$.requestId").alias("requestId"),
        said(v, "$.slug").alias("slug"),
        *[said(v, f"$.{path}").alias(name) for name, path in TURN_TEXT.items()],
        R.is_wasted(v).alias("aborted"),
        F.when(
            assistant, R.billable_units(F.col("_usage"), F.col("_usageFields"), F.col("modelName"))
        ).alias("units"),
        F.when(assistant, F.size(blocks).cast("long")).otherwise(none).alias("nBlocks"),
        F.when(assistant, R.thinking_chars(blocks)).otherwise(none).alias("nThinkingChars"),
        F.when(assistant, R.tool_uses(blocks)).alias("toolUses"),
        F.when(user, R.tool_result_ids(blocks)).alias("toolResults"),
        R.tool_outcome(F.col("_result"), F.col("_resultFields")).alias("outcome"),
        R.compaction(v).alias("compaction"),
        R.fallback_event(v, said).alias("fallback"),
        said(v, "$.apiRefusalCategory").alias("refusal"),
        R.fork_context(v, said).alias("forkContext"),
        R.explicit_name(v, said).alias("explicit"),
        R.ai_name(v, said).alias("ai"),
        I.image_refs(v, blocks).alias("images"),
    )
    # A record without uuid counts as its own member of a response.
    place = F.concat_ws("\x01", *[F.col(c).cast("string") for c in ORDER])
    return I.measured(with_parts).withColumns(
        {
            "requestKey": F.coalesce("requestId", F.lit("")),
            "member": F.coalesce("uuid", place),
            "outTotal": F.when(F.col("units").isNotNull(), R.units_sum(F.col("units"), "output")),
            "nToolUses": F.coalesce(F.size("toolUses"), F.lit(0)).cast("long"),
        }
    )


def _order(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c) for c in ORDER])


def _billed(facts: DataFrame) -> DataFrame:
    return facts.where("messageId IS NOT NULL")


def _winners(facts: DataFrame) -> DataFrame:
    """The canonical record of each response: most output, then not a sidechain copy, then
    first in walk order."""
    payload = [
        "uuid", "requestId", "fileSessionId", "fileKind", "fileAgentId", "workflowId", "projectSlug",
        "originSession", "ts", "agentId", "modelName", *TURN_TEXT, "aborted", "units",
    ]
    rank = [-F.coalesce("outTotal", F.lit(0)), F.col("sidechain"), *[F.col(c) for c in ORDER]]
    return billing.dedup_billed(_billed(facts), KEY, rank, payload)


def _structure(facts: DataFrame, images: DataFrame) -> DataFrame:
    """Blocks of all distinct records of a response. Images count where they ride on it."""
    billed = _billed(facts).select(
        *KEY, "member", "nBlocks", "nThinkingChars", "nToolUses",
        F.size(F.filter("images", lambda i: i["carrier"] == "content")).cast("long").alias("nImages"),
    )
    counts = billing.structure_union(
        billed, KEY, "member", ["nBlocks", "nThinkingChars", "nToolUses", "nImages"]
    )
    tokens = (
        images.where("messageId IS NOT NULL AND carrier = 'content'")
        .groupBy(*KEY)
        .agg(F.sum("estTokens").alias("estImageTokens"))
    )
    return counts.join(tokens, KEY, "left").withColumn(
        "estImageTokens", F.coalesce("estImageTokens", F.lit(0))
    )


def _costs(winners: DataFrame, facts: DataFrame, prices: PriceTable) -> DataFrame:
    """Tokens and cost per response: every unit at its own model's rates, summed."""
    models = _billed(facts).select(F.explode("units.model").alias("model"))
    rates = materialize(billing.resolve_models(models, prices.entries), "rates")
    units = winners.select(*KEY, F.inline("units"))
    priced = units.join(rates, "model", "left").withColumns(
        billing.price_columns(
            F.col("input"), F.col("output"), F.col("cache5m"), F.col("cache1h"),
            F.col("cacheCreate"), F.col("cacheRead"),
        )
    )
    split = F.col("cache5m") + F.col("cache1h") > 0
    return priced.groupBy(*KEY).agg(
        F.sum("input").alias("inputTokens"),
        F.sum("output").alias("outputTokens"),
        F.sum(F.when(split, F.col("cache5m")).otherwise(F.col("cacheCreate"))).alias("cacheCreate5m"),
        F.sum(F.when(split, F.col("cache1h")).otherwise(0)).alias("cacheCreate1h"),
        F.sum("cacheRead").alias("cacheReadTokens"),
        F.sum("webSearches").alias("webSearches"),
        F.sum("webFetches").alias("webFetches"),
        *[F.sum(c).alias(c) for c in COSTS],
        F.bool_or(F.col("pricedAs").isNotNull()).alias("priced"),
    )


def _image_rows(facts: DataFrame) -> DataFrame:
    """Images of distinct records. A fork's copy of a record adds none."""
    return (
        facts.where(F.size("images") > 0)
        .groupBy("member")
        .agg(
            F.min_by(
                F.struct("uuid", "fileSessionId", "ts", "images", *KEY), _order()
            ).alias("r")
        )
        .select("r.uuid", "r.fileSessionId", "r.ts", *[f"r.{k}" for k in KEY], F.inline("r.images"))
    )


def _session_files(files: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per session file: place, creation, the session its last marked record names."""
    known = files.where("fileKind = 'session'").groupBy("fileSessionId").agg(
        F.min("walk").alias("walk"),
        F.min("createdMs").alias("createdMs"),
        F.min_by("projectSlug", "walk").alias("projectSlug"),
    )
    own = facts.where("fileKind = 'session'").groupBy("fileSessionId").agg(
        F.max_by("originSession", F.when(F.col("inherited"), _order())).alias("marker"),
        F.bool_or(F.col("originSession").isNotNull()).alias("marked"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), _order())).alias("cwd"),
    )
    return known.join(own, "fileSessionId", "left").withColumnRenamed("fileSessionId", "session")


class Work:
    """The tables that grains are made of."""

    def __init__(self, lines, files, prices: PriceTable, idle_seconds: float, host_id: str, error_chars: int | None):
        self.lines, self.files, self.prices = lines, files, prices
        self.idle_seconds, self.host_id, self.error_chars = idle_seconds, host_id, error_chars

    @cached_property
    def facts(self) -> DataFrame:
        return materialize(record_facts(parse_records(self.lines)), "facts")

    @cached_property
    def session_files(self) -> DataFrame:
        return materialize(_session_files(self.files, self.facts), "session-files")

    @cached_property
    def images(self) -> DataFrame:
        return materialize(_image_rows(self.facts), "images")

    @cached_property
    def digest(self) -> DataFrame:
        places = self.facts.where("fileKind = 'session'").select("fileSessionId", "uuid", "ts", *ORDER)
        return materialize(lineage.session_digest(places, "fileSessionId", ORDER, CHUNK), "session-digest")

    @cached_property
    def forest(self) -> lineage.Lineage:
        return lineage.resolve_lineage(self.digest, self.session_files)

    @cached_property
    def edges(self) -> DataFrame:
        return materialize(self.forest.edges, "edges")

    @cached_property
    def families(self) -> DataFrame:
        return materialize(self.forest.families, "families")

    @cached_property
    def turns(self) -> DataFrame:
        made = _turns(self.facts, self.images, self.digest, self.forest, self.families, self.prices, self.host_id)
        return materialize(made, "turns")

    @cached_property
    def events(self) -> DataFrame:
        return materialize(_events(self.facts, self.digest, self.forest), "events")

    @cached_property
    def agent_runs(self) -> DataFrame:
        return materialize(_agent_runs(self.turns, self.facts), "agent-runs")

    @cached_property
    def inherited(self) -> DataFrame:
        return materialize(_inherited(self.facts, self.turns), "inherited")

    @cached_property
    def sessions(self) -> DataFrame:
        made = _sessions(
            self.facts, self.session_files, self.digest, self.turns, self.events, self.agent_runs,
            self.inherited, self.edges, self.families, self.idle_seconds, self.host_id,
        )
        return materialize(made, "sessions")

    @cached_property
    def fork_edges(self) -> DataFrame:
        return materialize(_fork_edges(self.edges, self.sessions, self.digest, self.forest, self.turns), "fork-edges")

    @cached_property
    def members(self) -> DataFrame:
        return materialize(family_members(self.sessions, self.session_files), "members")

    @cached_property
    def lineages(self) -> DataFrame:
        return materialize(_lineages(self.members), "lineages")

    @cached_property
    def stats(self) -> DataFrame:
        return _stats(
            self.files, self.facts, self.turns, self.inherited, self.session_files, self.fork_edges,
            self.lineages, self.agent_runs, self.forest.unresolved, self.prices.version,
        )


def normalize(
    lines: DataFrame,
    files: DataFrame,
    prices: PriceTable,
    idle_seconds: float = IDLE_SECONDS,
    host_id: str = "",
    error_chars: int | None = ERROR_CHARS,
) -> Normalized:
    """All grains from classified lines and the list of transcript files. ``error_chars`` is how
    much of a tool's error text is kept; None keeps the whole."""
    work = Work(lines, files, prices, idle_seconds, host_id, error_chars)
    return Normalized(Grains(work), work)


def _turns(facts, images, digest, forest, families, prices, host_id) -> DataFrame:
    winners = materialize(_winners(facts), "winners")
    owned = lineage.origin_of(winners, digest, forest)
    whole = (
        owned.join(_costs(winners, facts, prices), KEY, "left")
        .join(_structure(facts, images), KEY)
        .join(families.select(F.col("session").alias("origin"), "lineageId"), "origin", "left")
    )
    zero = F.lit(0).cast("long")
    tokens = (
        "inputTokens", "outputTokens", "cacheCreate5m", "cacheCreate1h", "cacheReadTokens",
        "webSearches", "webFetches",
    )
    costs = {c: F.coalesce(c, F.lit(0.0)) for c in COSTS}
    return whole.select(
        F.lit(host_id).alias("hostId"),
        "messageId",
        "requestKey",
        "requestId",
        "uuid",
        F.col("origin").alias("sessionId"),
        F.coalesce("lineageId", "origin").alias("lineageId"),
        "fileSessionId",
        "originSession",
        "projectSlug",
        R.project_label(F.col("projectSlug"), F.col("cwd")).alias("project"),
        ts_of(F.col("ts")).alias("ts"),
        R.model_base(F.col("modelName")).alias("model"),
        R.model_variant(F.col("modelName")).alias("modelVariant"),
        F.when(F.col("fileKind") == "session", "main").otherwise(F.col("fileKind")).alias("context"),
        F.coalesce("fileAgentId", "agentId").alias("agentId"),
        "workflowId",
        *TURN_TEXT,
        *[F.coalesce(t, zero).alias(t) for t in tokens],
        R.had_fallback(F.col("units")).alias("hadFallback"),
        R.wasted_output(F.col("units")).alias("wastedOutputTokens"),
        "nBlocks", "nThinkingChars", "nToolUses", "nImages", "estImageTokens",
        "aborted",
        *[c.alias(name) for name, c in costs.items()],
        sum(costs.values(), F.lit(0.0)).alias("costTotal"),
        F.lit(prices.version).alias("pricingVersion"),
        (~F.coalesce("priced", F.lit(False))).alias("unpriced"),
    )


def outcome_flags(is_error: Column, outcome: Column) -> Column:
    """False when any signal reports failure, true when the tool says so, else NULL."""
    failed = (
        F.coalesce(is_error, F.lit(False))
        | F.coalesce(outcome["ok"] == F.lit(False), F.lit(False))
        | F.coalesce(outcome["interrupted"], F.lit(False))
    )
    return F.when(failed, F.lit(False)).when(outcome["ok"], F.lit(True))


def kept_text(text: Column, chars: int | None) -> Column:
    """The first characters of a text, or all of it."""
    return text if chars is None else F.substring(text, 1, chars)


def _tool_calls(facts: DataFrame, turns: DataFrame, error_chars: int | None) -> DataFrame:
    """One row per call, with the outcome of the result that names it, wherever that is."""
    calls = (
        _billed(facts)
        .where("nToolUses > 0")
        .groupBy(*KEY, "member")
        .agg(F.min_by(F.struct("ts", "toolUses"), _order()).alias("r"))
        .select(*KEY, F.col("r.ts").alias("ts"), F.inline("r.toolUses"))
    )
    results = (
        facts.where(F.size("toolResults") > 0)
        .select(*ORDER, "outcome", F.inline("toolResults"))
        .where("id IS NOT NULL")
        .groupBy("id")
        .agg(F.min_by(F.struct("outcome", "isError"), _order()).alias("r"))
    )
    server = F.nullif(F.regexp_extract("name", R.MCP_TOOL, 1), F.lit(""))
    outcome = F.col("r.outcome")
    return (
        calls.join(turns.select(*KEY, "sessionId", "context"), KEY)
        .join(results, "id", "left")
        .select(
            "messageId",
            F.col("id").alias("toolUseId"),
            "sessionId",
            ts_of(F.col("ts")).alias("ts"),
            F.coalesce("name", F.lit("")).alias("toolName"),
            server.isNotNull().alias("isMcp"),
            server.alias("mcpServer"),
            "context",
            outcome_flags(F.col("r.isError"), outcome).alias("ok"),
            outcome["interrupted"].alias("interrupted"),
            kept_text(outcome["error"], error_chars).alias("errorKind"),
            F.floor(outcome["exitCode"] + 0.5).alias("exitCode"),
            F.floor(outcome["durationMs"] + 0.5).alias("durationMs"),
        )
    )


def _events(facts: DataFrame, digest: DataFrame, forest: lineage.Lineage) -> DataFrame:
    """Compactions, fallbacks and refusals, each record once, credited to its producer."""
    kinds = F.array_compact(
        F.array(
            F.when(
                F.col("compaction").isNotNull(),
                F.struct(F.lit("compaction").alias("kind"), F.to_json("compaction").alias("payload")),
            ),
            F.when(
                F.col("fallback").isNotNull(),
                F.struct(F.lit("fallback").alias("kind"), F.to_json("fallback").alias("payload")),
            ),
            F.when(
                F.col("refusal").isNotNull(),
                F.struct(
                    F.lit("refusal").alias("kind"),
                    F.to_json(F.struct(F.col("refusal").alias("category"))).alias("payload"),
                ),
            ),
        )
    )
    once = (
        facts.where("compaction IS NOT NULL OR fallback IS NOT NULL OR refusal IS NOT NULL")
        .groupBy("member")
        .agg(
            F.min_by(
                F.struct("uuid", "fileSessionId", "projectSlug", "ts", kinds.alias("kinds")), _order()
            ).alias("r")
        )
        .select("r.*")
    )
    return lineage.origin_of(once, digest, forest).select(
        ts_of(F.col("ts")).alias("ts"),
        F.col("origin").alias("sessionId"),
        "projectSlug",
        F.inline("kinds"),
    )


def _attributed_images(images: DataFrame, digest: DataFrame, forest: lineage.Lineage) -> DataFrame:
    return lineage.origin_of(images.drop(*KEY), digest, forest).select(
        F.coalesce("uuid", F.lit("")).alias("uuid"),
        F.col("origin").alias("sessionId"),
        ts_of(F.col("ts")).alias("ts"),
        "carrier", "mediaType", "width", "height", "bytesBase64",
        F.coalesce("estTokens", F.lit(0)).alias("estTokens"),
        "hash",
    )


def _joined_names(column: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def _agent_runs(turns: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per agent instance and the session that paid for it."""
    # A context counts for the agent's run in the session that its file lies under, and for runs
    # in other sessions (a fork's copy of the agent) where they have none of their own.
    declared = facts.where("forkContext IS NOT NULL").select(
        F.coalesce("forkContext.agentId", "fileAgentId").alias("agentId"), "fileSessionId", "forkContext", _order().alias("_at")
    )
    own = declared.groupBy("agentId", F.col("fileSessionId").alias("sessionId")).agg(F.min_by("forkContext", "_at").alias("_own"))
    any_of = declared.groupBy("agentId").agg(F.min_by("forkContext", "_at").alias("_any"))
    runs = (
        turns.where("context <> 'main' AND agentId IS NOT NULL")
        .groupBy("agentId", "sessionId")
        .agg(
            F.max("agentType").alias("agentType"),
            F.min("lineageId").alias("lineageId"),
            F.min_by(F.struct("projectSlug", "project", "context"), F.struct("ts", "messageId")).alias("p"),
            F.max("workflowId").alias("workflowId"),
            F.min("ts").alias("firstTs"),
            F.max("ts").alias("lastTs"),
            F.count(F.lit(1)).alias("nTurns"),
            F.sum("nToolUses").alias("nToolUses"),
            F.sum("costTotal").alias("cost"),
            F.sum("inputTokens").alias("inputTokens"),
            F.sum("outputTokens").alias("outputTokens"),
            F.sum("cacheReadTokens").alias("cacheReadTokens"),
            _joined_names("model").alias("models"),
        )
    )
    ident, kind = F.col("agentId"), F.col("agentType")
    span = F.unix_millis("lastTs") - F.unix_millis("firstTs")
    context = F.coalesce("_own", "_any")
    return runs.join(own, ["agentId", "sessionId"], "left").join(any_of, "agentId", "left").select(
        "*",
        context["contextLength"].alias("inheritedContextLength"),
        context["parentLastUuid"].alias("parentLastUuid"),
        F.col("sessionId").alias("parentSessionId"),
        R.agent_name(ident).alias("name"),
        R.agent_name_kind(ident, kind).alias("nameKind"),
        F.coalesce(span / 1000.0, F.lit(0.0)).alias("spanSeconds"),
        "p.projectSlug", "p.project", "p.context",
    )


def _inherited(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """Responses a session file carries a copy of while another session owns them."""
    carried = _billed(facts).where("fileKind = 'session'").select("fileSessionId", *KEY).distinct()
    owners = turns.select(*KEY, F.col("sessionId").alias("owner"), "costTotal")
    return (
        carried.join(owners, KEY)
        .where("owner <> fileSessionId")
        .groupBy(F.col("fileSessionId").alias("sessionId"))
        .agg(F.count(F.lit(1)).alias("nTurnsInherited"), F.sum("costTotal").alias("inheritedCost"))
    )


def _sessions(
    facts, session_files, digest, turns, events, agent_runs, inherited, edges, families,
    idle_seconds, host_id,
) -> DataFrame:
    main = F.col("context") == "main"
    context = (
        F.col("cacheReadTokens") + F.col("cacheCreate5m") + F.col("cacheCreate1h") + F.col("inputTokens")
    )
    volume = turns.groupBy("sessionId").agg(
        F.count(F.lit(1)).alias("nTurnsNative"),
        F.sum("costTotal").alias("nativeCost"),
        F.count_if(~main).alias("nSubagentTurns"),
        F.max(F.when(main, context)).alias("peakTurn"),
        _joined_names("model").alias("models"),
        _joined_names("ccVersion").alias("ccVersions"),
        F.min_by(F.struct("projectSlug", "cwd"), F.struct("ts", "messageId")).alias("t"),
        F.min("lineageId").alias("turnLineage"),
    )
    timed = turns.where("ts IS NOT NULL").select("sessionId", F.unix_millis("ts").alias("_t"))
    times = gap_usage(timed, ["sessionId"], "_t", int(idle_seconds * 1000)).select(
        "sessionId", "firstMs", "lastMs", "activeMs"
    )
    compacted = events.where("kind = 'compaction'").groupBy("sessionId").agg(
        F.count(F.lit(1)).alias("nCompactions"),
        F.max(F.get_json_object("payload", "$.preTokens").cast("long")).alias("peakCompaction"),
    )
    agents = agent_runs.groupBy("sessionId").agg(F.count(F.lit(1)).alias("nAgentRuns"))
    named = naming.session_names(
        facts.where("fileKind = 'session'").select(
            F.col("fileSessionId").alias("sessionId"), "explicit", "ai",
            F.nullif("slug", F.lit("")).alias("slug"), *ORDER,
        ),
        "sessionId",
        [F.col(c) for c in ORDER],
    )
    link = edges.select(
        F.col("childSessionId").alias("sessionId"), "parentSessionId", "forkPointMs",
        F.col("source").alias("parentSource"), F.col("kind").alias("parentKind"),
        F.col("ambiguous").alias("parentAmbiguous"), "nRecordsInherited",
        F.col("childFirstNativeMs").alias("ownMs"),
    )
    ends = digest.groupBy(F.col("session").alias("sessionId")).agg(
        F.min_by("ts", "pos").alias("headMs"), F.max_by("ts", "pos").alias("endMs")
    )
    placed = session_files.select(
        F.col("session").alias("sessionId"), "createdMs", "cwd", F.col("projectSlug").alias("fileSlug")
    )
    everyone = placed.select("sessionId").unionByName(turns.select("sessionId")).distinct()
    out = everyone
    for side in (placed, volume, times, compacted, agents, named, link, ends, inherited):
        out = out.join(side, "sessionId", "left")
    out = out.join(
        families.select(F.col("session").alias("sessionId"), F.col("lineageId").alias("family"), "depth"),
        "sessionId",
        "left",
    )
    slug = F.coalesce("fileSlug", "t.projectSlug")
    cwd = F.coalesce("cwd", "t.cwd")
    span = F.coalesce((F.col("lastMs") - F.col("firstMs")) / 1000.0, F.lit(0.0))
    active = F.coalesce(F.col("activeMs") / 1000.0, F.lit(0.0))
    zero = F.lit(0).cast("long")
    fallback_name = F.substring("sessionId", 1, 8)
    return out.select(
        F.lit(host_id).alias("hostId"),
        "sessionId",
        slug.alias("projectSlug"),
        R.project_label(slug, cwd).alias("project"),
        cwd.alias("cwd"),
        "slug",
        F.coalesce("name", fallback_name).alias("name"),
        F.coalesce("nameKind", F.lit("id")).alias("nameKind"),
        F.coalesce("nameFirst", fallback_name).alias("nameFirst"),
        F.coalesce("nameChanged", F.lit(False)).alias("nameChanged"),
        "customTitle", "customTitleFirst", "aiTitle", "aiTitleFirst",
        "parentSessionId",
        F.coalesce("family", "turnLineage", "sessionId").alias("lineageId"),
        F.coalesce("depth", zero).alias("depth"),
        ts_of(F.col("forkPointMs")).alias("forkPointTs"),
        "parentSource", "parentKind",
        F.coalesce("parentAmbiguous", F.lit(False)).alias("parentAmbiguous"),
        F.coalesce("nRecordsInherited", zero).alias("nRecordsInherited"),
        F.coalesce("nTurnsInherited", zero).alias("nTurnsInherited"),
        F.coalesce("inheritedCost", F.lit(0.0)).alias("inheritedCost"),
        ts_of(F.col("createdMs")).alias("createdTs"),
        ts_of(F.when(F.col("parentSessionId").isNull(), F.col("headMs")).otherwise(F.col("ownMs"))).alias(
            "firstNativeTs"
        ),
        ts_of(F.col("endMs")).alias("lastNativeTs"),
        ts_of(F.col("firstMs")).alias("firstTs"),
        ts_of(F.col("lastMs")).alias("lastTs"),
        span.alias("spanSeconds"),
        active.alias("activeSeconds"),
        F.when(F.col("nTurnsNative") > 0, F.when(span > 0, active / span).otherwise(1.0)).alias("dutyCycle"),
        F.coalesce("nTurnsNative", zero).alias("nTurnsNative"),
        F.coalesce("nSubagentTurns", zero).alias("nSubagentTurns"),
        F.coalesce("nAgentRuns", zero).alias("nAgentRuns"),
        F.coalesce("nCompactions", zero).alias("nCompactions"),
        F.coalesce(F.greatest("peakTurn", "peakCompaction"), zero).alias("peakContextTokens"),
        F.coalesce("nativeCost", F.lit(0.0)).alias("nativeCost"),
        F.coalesce("models", F.lit("")).alias("models"),
        F.coalesce("ccVersions", F.lit("")).alias("ccVersions"),
    )


def _fork_edges(edges, sessions, digest, forest, turns) -> DataFrame:
    billed = turns.select(F.col("sessionId").alias("session")).distinct()
    anchors = lineage.billed_anchors(edges, forest, digest, billed)
    child = sessions.select(
        F.col("sessionId").alias("childSessionId"), "lineageId", "depth", "projectSlug", "project",
        "nTurnsInherited", "inheritedCost", (F.col("nTurnsNative") > 0).alias("childHasTurns"),
    )
    parent = sessions.select(
        F.col("sessionId").alias("parentSessionId"), (F.col("nTurnsNative") > 0).alias("parentTurns")
    )
    started = F.coalesce("childFirstNativeMs", "childCreatedMs")
    lag = (started - F.col("forkPointMs")) / 1000.0
    return (
        edges.join(child, "childSessionId")
        .join(parent, "parentSessionId", "left")
        .join(anchors, "childSessionId", "left")
        .select(
            "*",
            ts_of(F.col("forkPointMs")).alias("forkPointTs"),
            ts_of(F.col("childCreatedMs")).alias("childCreatedTs"),
            ts_of(F.col("childFirstNativeMs")).alias("childFirstNativeTs"),
            F.coalesce(lag, F.lit(0.0)).alias("lagSeconds"),
            F.coalesce("parentTurns", F.lit(False)).alias("parentHasTurns"),
            ts_of(F.col("billedAncestorForkPointMs")).alias("billedAncestorForkPointTs"),
        )
    )


def family_members(sessions: DataFrame, session_files: DataFrame) -> DataFrame:
    """Every session with its family and its place there, root first: by depth, then in walk
    order. Places come from ranges of the whole order, so no task holds a family."""
    walked = sessions.join(session_files.select(F.col("session").alias("sessionId"), "walk"), "sessionId", "left")
    return place_in_ranges(walked, ["lineageId"], ["depth", "walk", "sessionId"], "ordinal")


def _lineages(members: DataFrame) -> DataFrame:
    """One row per fork family. Its sessions are listed as one text, as the grain's contract
    has it; the table of members says the same without one."""
    root = F.struct("ordinal")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "sessionId"))), lambda r: r["sessionId"])
    return members.groupBy("lineageId").agg(
        F.col("lineageId").alias("rootSessionId"),
        F.min_by("projectSlug", root).alias("projectSlug"),
        F.min_by("project", root).alias("project"),
        F.count(F.lit(1)).alias("nSessions"),
        F.count_if(F.col("parentSessionId").isNotNull()).alias("nForks"),
        F.max("depth").alias("maxDepth"),
        F.min("firstTs").alias("firstTs"),
        F.max("lastTs").alias("lastTs"),
        F.sum("nTurnsNative").alias("nTurns"),
        F.sum("nativeCost").alias("totalCost"),
        F.array_join(listed, ",").alias("sessionIds"),
    )


def _stats(
    files, facts, turns, inherited, session_files, fork_edges, lineages, agent_runs, unresolved,
    version,
) -> DataFrame:
    """One row of counters about the corpus and what normalizing it found."""
    groups = _billed(facts).groupBy(*KEY).agg(
        F.min(F.coalesce("outTotal", F.lit(0))).alias("lo"), F.max(F.coalesce("outTotal", F.lit(0))).alias("hi")
    )
    # A message id is a cross-file duplicate when its first and last file differ.
    spread = _billed(facts).groupBy("messageId").agg(F.min("walk").alias("a"), F.max("walk").alias("b"))
    moved = (F.col("sessionId") != F.col("fileSessionId")) & (
        F.coalesce("originSession", F.lit("")) != F.col("sessionId")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    parts = [
        files.agg(F.count(F.lit(1)).alias("files"), total("bytes").alias("bytes")),
        facts.agg(
            F.count_if(~F.col("bad")).alias("records"),
            F.count_if("bad").alias("parseErrors"),
            F.count_if(F.col("type") == "assistant").alias("assistantRecords"),
            total("outTotal").alias("naiveOutputTokens"),
        ),
        turns.agg(
            F.count(F.lit(1)).alias("dedupedTurns"),
            total("outputTokens").alias("dedupedOutputTokens"),
            F.count_if("unpriced").alias("unpricedTurns"),
            F.count_if(F.col("ts").isNull()).alias("turnsWithoutTimestamp"),
            F.count_if(moved).alias("reattributedTurns"),
            F.coalesce(F.sum("costTotal"), F.lit(0.0)).alias("totalCost"),
        ),
        inherited.agg(total("nTurnsInherited").alias("inheritedTurnsSeen")),
        spread.agg(F.count_if(F.col("a") != F.col("b")).alias("crossFileDuplicates")),
        groups.agg(F.count_if(F.col("lo") != F.col("hi")).alias("groupsWithVaryingOutput")),
        session_files.agg(
            F.count(F.lit(1)).alias("sessionFiles"),
            F.count_if(~F.coalesce("marked", F.lit(False))).alias("sessionFilesWithoutMarker"),
        ),
        fork_edges.agg(
            F.count(F.lit(1)).alias("forkEdges"),
            F.count_if(F.col("source") == "marker").alias("forkEdgesFromMarker"),
            F.count_if("ambiguous").alias("forkEdgesAmbiguous"),
        ),
        lineages.agg(
            F.count(F.lit(1)).alias("lineages"), F.coalesce(F.max("maxDepth"), F.lit(0)).alias("maxForkDepth")
        ),
        unresolved.agg(F.count(F.lit(1)).alias("unresolvedForks")),
        agent_runs.agg(F.count(F.lit(1)).alias("agentRuns")),
    ]
    return side_by_side(parts).withColumn("pricingVersion", F.lit(version))
