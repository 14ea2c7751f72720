"""Column contracts of the grains, in order, and how each grain is exported."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DDL = {
    "turns": """
        hostId string, messageId string, requestId string, uuid string, sessionId string,
        lineageId string, fileSessionId string, projectSlug string, project string, cwd string,
        gitBranch string, ts timestamp, model string, modelVariant string, effort string,
        stopReason string, serviceTier string, speed string, context string, agentId string,
        agentType string, workflowId string, entrypoint string, sessionKind string,
        ccVersion string, attributionSkill string, attributionPlugin string,
        attributionMcpServer string, attributionMcpTool string, inputTokens long,
        outputTokens long, cacheCreate5m long, cacheCreate1h long, cacheReadTokens long,
        webSearches long, webFetches long, hadFallback boolean, wastedOutputTokens long,
        nBlocks long, nThinkingChars long, nToolUses long, nImages long, estImageTokens long,
        aborted boolean, costInput double, costOutput double, costCacheCreate double,
        costCacheRead double, costTotal double, pricingVersion string, unpriced boolean""",
    "toolCalls": """
        messageId string, toolUseId string, sessionId string, ts timestamp, toolName string,
        isMcp boolean, mcpServer string, context string, ok boolean, interrupted boolean,
        errorKind string, exitCode long, durationMs long""",
    "events": "ts timestamp, sessionId string, projectSlug string, kind string, payload string",
    "sessions": """
        hostId string, sessionId string, projectSlug string, project string, cwd string,
        slug string, name string, nameKind string, nameFirst string, nameChanged boolean,
        customTitle string, customTitleFirst string, aiTitle string, aiTitleFirst string,
        parentSessionId string, lineageId string, depth long, forkPointTs timestamp,
        parentSource string, parentKind string, parentAmbiguous boolean,
        nRecordsInherited long, nTurnsInherited long, inheritedCost double,
        createdTs timestamp, firstNativeTs timestamp, lastNativeTs timestamp,
        firstTs timestamp, lastTs timestamp, spanSeconds double, activeSeconds double,
        dutyCycle double, nTurnsNative long, nSubagentTurns long, nAgentRuns long,
        nCompactions long, peakContextTokens long, nativeCost double, models string,
        ccVersions string""",
    "forkEdges": """
        childSessionId string, parentSessionId string, lineageId string, depth long,
        projectSlug string, project string, kind string, forkPointTs timestamp,
        childCreatedTs timestamp, childFirstNativeTs timestamp, lagSeconds double,
        nRecordsInherited long, nTurnsInherited long, inheritedCost double, source string,
        ambiguous boolean, parentMissing boolean, parentHasTurns boolean,
        childHasTurns boolean, billedAncestorSessionId string,
        billedAncestorForkPointTs timestamp""",
    "lineages": """
        lineageId string, rootSessionId string, projectSlug string, project string,
        nSessions long, nForks long, maxDepth long, firstTs timestamp, lastTs timestamp,
        nTurns long, totalCost double, sessionIds string""",
    "agentRuns": """
        agentId string, agentType string, name string, nameKind string,
        parentSessionId string, lineageId string, projectSlug string, project string,
        context string, workflowId string, firstTs timestamp, lastTs timestamp,
        spanSeconds double, nTurns long, nToolUses long, cost double, inputTokens long,
        outputTokens long, cacheReadTokens long, models string,
        inheritedContextLength long, parentLastUuid string""",
    "images": """
        uuid string, sessionId string, ts timestamp, carrier string, mediaType string,
        width long, height long, bytesBase64 long, estTokens long, hash string""",
    "replay": """
        sessionId string, seq long, ts timestamp, agentId string, context string,
        uuid string, parentUuid string, role string, kind string, text string,
        truncated boolean, fullChars long, toolName string, toolUseId string, ok boolean,
        errorKind string, exitCode long, durationMs long, model string""",
}

_TYPES = {
    "string": T.StringType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def _schema(columns: str) -> T.StructType:
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SCHEMAS: dict[str, T.StructType] = {name: _schema(columns) for name, columns in _DDL.items()}


@dataclass(frozen=True)
class Grain:
    name: str
    time_column: str
    by_month: bool = False
    required: bool = True


GRAINS = (
    Grain("turns", "ts", by_month=True),
    Grain("toolCalls", "ts", by_month=True),
    Grain("events", "ts"),
    Grain("sessions", "firstTs"),
    Grain("images", "ts"),
    Grain("forkEdges", "forkPointTs", required=False),
    Grain("agentRuns", "firstTs", required=False),
    Grain("lineages", "firstTs", required=False),
)


def conform(df: DataFrame, grain: str) -> DataFrame:
    """Exactly the contract's columns, in order, with its types."""
    return df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[grain].fields]
    )
