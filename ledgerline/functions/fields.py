"""What a transcript record says, as column expressions over its VARIANT value.

Missing or malformed parts give NULL, 0 or an empty array; nothing fails a job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions import variant as V

#: How the text at a path is read: ``V.text``, or ``V.told`` of paths that were laid out before.
Text = Callable[..., Column]

# Models that are placeholders and never billed.
UNPRICED_MODELS = ("<synthetic>",)

# The three record types that name a session.
NAME_RECORD_TYPES = ("ai-title", "custom-title", "agent-name")

# Record types holding editor state, left out of a replay.
EDITOR_STATE_TYPES = ("file-history-snapshot", "file-history-delta", "attachment")

# The input fields that summarise a call, per tool, first match wins.
TOOL_SUMMARY_KEYS = {
    "Bash": ("command",),
    "Edit": ("file_path",),
    "Read": ("file_path",),
    "Write": ("file_path",),
    "Glob": ("pattern",),
    "Grep": ("pattern",),
    "WebFetch": ("url",),
    "WebSearch": ("query",),
    "ToolSearch": ("query",),
    "Task": ("name", "description"),
    "Agent": ("name", "description"),
    "TaskCreate": ("subject", "description"),
    "TaskUpdate": ("status", "taskId"),
    "SendMessage": ("to", "summary"),
}

# Categorical dimensions as (name, path, record types it appears on).
DIMENSIONS = (
    ("model", "message.model", "assistant"),
    ("stopReason", "message.stop_reason", "assistant"),
    ("serviceTier", "message.usage.service_tier", "assistant"),
    ("speed", "message.usage.speed", "assistant"),
    ("effort", "effort", "assistant"),
    ("entrypoint", "entrypoint", "any"),
    ("sessionKind", "sessionKind", "any"),
    ("userType", "userType", "any"),
    ("isSidechain", "isSidechain", "any"),
    ("attributionSkill", "attributionSkill", "assistant"),
    ("attributionPlugin", "attributionPlugin", "assistant"),
    ("attributionMcpServer", "attributionMcpServer", "assistant"),
    ("attributionMcpTool", "attributionMcpTool", "assistant"),
    ("attributionAgent", "attributionAgent", "assistant"),
    ("cwd", "cwd", "any"),
    ("gitBranch", "gitBranch", "any"),
    ("version", "version", "any"),
    ("permissionMode", "permissionMode", "user"),
    ("promptSource", "promptSource", "user"),
    ("originKind", "origin.kind", "user"),
    ("toolDenialKind", "toolDenialKind", "user"),
    ("level", "level", "system"),
    ("compactTrigger", "compactMetadata.trigger", "system"),
    ("apiRefusalCategory", "apiRefusalCategory", "system"),
)

# MCP tools are recognised by this name shape; the group is the server.
MCP_TOOL = r"^mcp__(.+?)__"


# --- identity ---------------------------------------------------------------


def record_type(v: Column, text: Text = V.text) -> Column:
    return F.coalesce(text(v, "$.type"), F.lit("<missing>"))


def is_sidechain(v: Column) -> Column:
    return V.is_true(v, "$.isSidechain")


def message_id(v: Column, text: Text = V.text) -> Column:
    """The id of the billed response; NULL when absent or empty."""
    return V.named(v, "$.message.id", text)


def origin_session(v: Column) -> Column:
    return F.coalesce(V.text(v, "$.session_id"), V.text(v, "$.sessionId"))


def is_inherited(v: Column, text: Text = V.text) -> Column:
    """The record names a session other than the one holding it. A link, not proof of a copy."""
    origin, holder = V.named(v, "$.session_id", text), V.named(v, "$.sessionId", text)
    return F.coalesce(origin != holder, F.lit(False))


def timestamp_ms(v: Column, text: Text = V.text) -> Column:
    """Epoch milliseconds of an ISO timestamp; NULL when unknown."""
    moment = F.try_to_timestamp(text(v, "$.timestamp"))
    return F.nullif(F.unix_millis(moment), F.lit(0).cast("long"))


def model_base(model: Column) -> Column:
    base = F.regexp_extract(model, r"^(.*?)\[([^\]]+)\]$", 1)
    return F.when(model.rlike(r"^(.*?)\[([^\]]+)\]$"), base).otherwise(model)


def model_variant(model: Column) -> Column:
    return F.nullif(F.regexp_extract(model, r"^(.*?)\[([^\]]+)\]$", 2), F.lit(""))


# --- names and places -------------------------------------------------------


def agent_name(agent_id: Column) -> Column:
    """The label inside ids shaped a<label>-<16 hex digits>; NULL for other ids."""
    return F.nullif(F.regexp_extract(agent_id, r"^a(.+)-[0-9a-f]{16}$", 1), F.lit(""))


def agent_name_kind(agent_id: Column, agent_type: Column) -> Column:
    return (
        F.when(agent_name(agent_id).isNull(), "anonymous")
        .when(agent_type == "fork", "fork")
        .otherwise("named")
    )


def explicit_name(v: Column, text: Text = V.text) -> Column:
    kind = record_type(v, text)
    return F.when(kind == "custom-title", V.named(v, "$.customTitle", text)).when(
        kind == "agent-name", V.named(v, "$.agentName", text)
    )


def ai_name(v: Column, text: Text = V.text) -> Column:
    return F.when(record_type(v, text) == "ai-title", V.named(v, "$.aiTitle", text))


def project_label(slug: Column, cwd: Column) -> Column:
    """Last segment of the repository a directory belongs to; worktrees fold into it."""
    root = F.substring_index(
        F.coalesce(cwd, F.translate(slug, "-", "/")), "/.claude/", 1
    )
    parts = F.filter(F.split(root, "/"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), slug)


# --- usage ------------------------------------------------------------------

# The fields of a usage object, taken in one step and typed afterwards.
_USAGE = (
    "struct<model variant, type variant, input_tokens variant, output_tokens variant, "
    "cache_creation_input_tokens variant, cache_read_input_tokens variant, "
    "cache_creation variant, server_tool_use variant, iterations variant>"
)


def _unit(usage: Column, model: Column) -> Column:
    return F.struct(
        F.coalesce(V.text(usage["model"]), model).alias("model"),
        V.text(usage["type"]).alias("kind"),
        V.count(usage["input_tokens"]).alias("input"),
        V.count(usage["output_tokens"]).alias("output"),
        V.count(usage["cache_creation_input_tokens"]).alias("cacheCreate"),
        V.count(usage["cache_read_input_tokens"]).alias("cacheRead"),
        V.count(usage["cache_creation"], "$.ephemeral_5m_input_tokens").alias("cache5m"),
        V.count(usage["cache_creation"], "$.ephemeral_1h_input_tokens").alias("cache1h"),
        V.count(usage["server_tool_use"], "$.web_search_requests").alias("webSearches"),
        V.count(usage["server_tool_use"], "$.web_fetch_requests").alias("webFetches"),
    )


def _void(v: Column, fields: Column) -> Column:
    """Missing, null, false, zero or empty text. Objects are told apart first, cheaply."""
    empty = F.coalesce(v.cast("string"), F.lit("")).isin("", "0", "false")
    return F.when(fields.isNotNull(), False).otherwise(v.isNull() | F.is_variant_null(v) | empty)


def usage_parts(v: Column) -> dict[str, Column]:
    """What ``billable_units`` reads, as columns to select before calling it."""
    return {
        "_usage": V.at(v, "$.message.usage"),
        "_usageFields": F.try_variant_get(v, "$.message.usage", _USAGE),
    }


def billable_units(usage: Column, fields: Column, model: Column) -> Column:
    """Attempts billed for one record: the iteration ledger, else the top-level usage.

    On a fallback the ledger holds the discarded attempt too, which top-level usage omits.
    ``usage`` and ``fields`` are the columns of ``usage_parts``.
    """
    ledger = V.items(fields["iterations"])
    nothing = F.lit(None).cast("variant")
    whole = fields.withField("model", nothing).withField("type", nothing)
    per_attempt = F.transform(
        F.transform(ledger, lambda it: F.try_variant_get(it, "$", _USAGE)),
        lambda u: _unit(u, model),
    )
    # Most records have no ledger, and their single unit is built without a lambda.
    single = F.array(_unit(whole, model))
    return (
        F.when(_void(usage, fields), F.slice(single, 1, 0))
        .when(F.size(ledger) > 0, per_attempt)
        .otherwise(single)
    )


def units_sum(units: Column, field: str) -> Column:
    return F.aggregate(units, F.lit(0).cast("long"), lambda acc, u: acc + u[field])


def had_fallback(units: Column) -> Column:
    return F.exists(units, lambda u: F.coalesce(u["kind"] == "fallback_message", F.lit(False)))


def wasted_output(units: Column) -> Column:
    """Output of every attempt but the last, when a fallback happened."""
    discarded = F.slice(units, F.lit(1), F.greatest(F.size(units) - 1, F.lit(0)))
    return F.when(had_fallback(units), units_sum(discarded, "output")).otherwise(
        F.lit(0).cast("long")
    )


def is_wasted(v: Column) -> Column:
    return V.is_true(v, "$.isAbortedMidStream") | V.is_true(v, "$.isApiErrorMessage")


# --- content ----------------------------------------------------------------


def content_blocks(v: Column) -> Column:
    return V.items(v, "$.message.content")


def block_types(v: Column) -> Column:
    return F.transform(content_blocks(v), lambda b: V.text(b, "$.type"))


def thinking_chars(blocks: Column) -> Column:
    return F.aggregate(
        blocks,
        F.lit(0).cast("long"),
        lambda n, b: n
        + F.when(
            V.equals(b, "$.type", "thinking"),
            F.coalesce(F.length(V.text(b, "$.thinking")), F.lit(0)),
        )
        .otherwise(0)
        .cast("long"),
    )


def tool_uses(blocks: Column) -> Column:
    """Id and name of each call; the input stays in the block."""
    calls = F.filter(blocks, lambda b: V.equals(b, "$.type", "tool_use"))
    return F.transform(
        calls,
        lambda b: F.struct(V.text(b, "$.id").alias("id"), V.text(b, "$.name").alias("name")),
    )


def tool_result_ids(blocks: Column) -> Column:
    results = F.filter(blocks, lambda b: V.equals(b, "$.type", "tool_result"))
    return F.transform(
        results,
        lambda b: F.struct(
            V.text(b, "$.tool_use_id").alias("id"), V.is_true(b, "$.is_error").alias("isError")
        ),
    )


def tool_summary(name: Column, tool_input: Column) -> Column:
    """The one line that says what a call did; NULL when the input holds no such text.

    Known tools read their listed fields. Others take their longest text field, and of
    equally long ones the first by field name.
    """
    fields = F.try_variant_get(tool_input, "$", "map<string,variant>")
    known = F.create_map(
        *[x for tool, keys in TOOL_SUMMARY_KEYS.items() for x in (F.lit(tool), F.lit("\n".join(keys)))]
    )
    listed = F.split(F.try_element_at(known, name), "\n")
    chosen = F.transform(listed, lambda k: V.named(F.try_element_at(fields, k), "$"))
    texts = F.transform(
        F.map_entries(fields),
        lambda e: F.struct(e["key"].alias("field"), V.named(e["value"], "$").alias("text")),
    )
    ranked = F.array_sort(
        F.transform(
            F.filter(texts, lambda t: t["text"].isNotNull()),
            lambda t: F.struct((-F.length(t["text"])).alias("rank"), t["field"], t["text"]),
        )
    )
    return F.when(
        listed.isNotNull(), F.try_element_at(F.array_compact(chosen), F.lit(1))
    ).otherwise(F.try_element_at(ranked, F.lit(1))["text"])


_OUTCOME = (
    "struct<success variant, interrupted variant, error variant, stderr variant, "
    "exitCode variant, durationMs variant>"
)


def outcome_parts(v: Column) -> dict[str, Column]:
    """What ``tool_outcome`` reads, as columns to select before calling it."""
    return {
        "_result": V.at(v, "$.toolUseResult"),
        "_resultFields": F.try_variant_get(v, "$.toolUseResult", _OUTCOME),
    }


def tool_outcome(result: Column, body: Column) -> Column:
    """What a tool reported about itself, from the record carrying its result.

    The report may be an object, a list or plain text; ``result`` and ``body`` are the
    columns of ``outcome_parts``.
    """
    def report(shape: str, size: Column, **told: Column) -> Column:
        kinds = {
            "ok": "boolean", "interrupted": "boolean", "error": "string", "exitCode": "double",
            "durationMs": "double",
        }
        return F.struct(
            F.lit(shape).alias("shape"),
            *[told.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()],
            size.cast("int").alias("size"),
        )

    from_object = report(
        "object",
        F.lit(0),
        ok=V.flag(body["success"]),
        interrupted=V.is_true(body["interrupted"], "$"),
        error=F.coalesce(V.named(body["error"]), V.named(body["stderr"])),
        exitCode=V.number(body["exitCode"]),
        durationMs=V.number(body["durationMs"]),
    )
    return F.when(
        result.isNotNull(),
        F.when(body.isNotNull(), from_object)
        .when(V.is_array(result), report("array", F.size(V.items(result))))
        .when(V.is_text(result), report("string", F.length(V.text(result)))),
    )


def result_text(block: Column) -> Column:
    """A tool result as text: its string, or its text parts and image markers joined by lines."""
    parts = F.transform(
        V.items(block, "$.content"),
        lambda b: F.coalesce(
            V.named(b, "$.text"), F.when(V.equals(b, "$.type", "image"), F.lit("[image]"))
        ),
    )
    return F.coalesce(V.text(block, "$.content"), F.array_join(F.array_compact(parts), "\n"))


# --- events -----------------------------------------------------------------


def compaction(v: Column) -> Column:
    path = "$.compactMetadata"
    return F.when(
        V.is_object(v, path),
        F.struct(
            V.text(v, f"{path}.trigger").alias("trigger"),
            V.count(v, f"{path}.preTokens").alias("preTokens"),
            V.count(v, f"{path}.postTokens").alias("postTokens"),
            V.count(v, f"{path}.cumulativeDroppedTokens").alias("droppedCumulative"),
            V.count(v, f"{path}.durationMs").alias("durationMs"),
            F.size(V.items(v, f"{path}.preservedMessages.uuids")).alias("preservedCount"),
            F.size(V.items(v, f"{path}.preCompactDiscoveredTools")).alias("toolsDiscovered"),
        ),
    )


def fallback_event(v: Column, text: Text = V.text) -> Column:
    before, after = text(v, "$.originalModel"), text(v, "$.fallbackModel")
    named = V.named(v, "$.originalModel", text).isNotNull() | V.named(v, "$.fallbackModel", text).isNotNull()
    return F.when(named, F.struct(before.alias("from"), after.alias("to")))


def fork_context(v: Column, text: Text = V.text) -> Column:
    """How an agent declares the context it inherited from its launcher."""
    return F.when(
        record_type(v, text) == "fork-context-ref",
        F.struct(
            V.text(v, "$.agentId").alias("agentId"),
            V.text(v, "$.parentSessionId").alias("parentSessionId"),
            V.text(v, "$.parentLastUuid").alias("parentLastUuid"),
            V.count(v, "$.contextLength").alias("contextLength"),
        ),
    )


def dimensions(v: Column) -> dict[str, Column]:
    """Every registered dimension as text, NULL on record types that do not carry it."""
    kind = record_type(v)

    def one(path: str, grain: str) -> Column:
        where = f"$.{path}"
        held = F.coalesce(V.text(v, where), V.flag(v, where).cast("string"))
        return held if grain == "any" else F.when(kind == grain, held)

    return {name: one(path, grain) for name, path, grain in DIMENSIONS}


