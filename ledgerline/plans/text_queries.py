"""The mine job bound to events through text: transcripts written as files, read by splits.

Users are ranked by id from 0 (events without a user come last); u is a rank, i the place of an
event among its user's. Below one root, in the folder of u modulo 7, lie for each user

* s: all events, as responses or, at fixed places, compactions, refusals, fallbacks, images
  and responses with an iteration ledger;
* f, where 3 divides u: a fork that copies the first 3 + u % 4 records of s and adds two; its
  records carry markers where 2 divides u, else only creation times tell copy from original;
* d, where 6 divides u: a fork of f after the first record of its own;
* k, where u % 3 is 1: a continuation of s, sharing no record with it;
* g, where u % 3 is 2: a continuation of a session whose file is gone;
* x and y, where u % 5 is 4: two that name each other, a ring;
* z, where 7 divides u: a title and a line that is no JSON, no turn.

Splits are held so small that most files of any size are read in several, so their
order decides positions. Rates are powers of two, so sums do not depend on their order.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.time import ms_of
from ledgerline.operators import detail, quality, timeline
from ledgerline.operators.ordered import with_sequence
from ledgerline.plans.fork_queries import ranked_users
from ledgerline.plans.mine_queries import RATES, parse_pieces
from ledgerline.plans.normalize import Normalized, normalize
from ledgerline.plans.registry import query, table
from ledgerline.session import ensure_checkpoint_dir, settings
from ledgerline.sources.prices import prices_from_json
from ledgerline.sources.scratch import materialize
from ledgerline.sources.transcripts import existing_roots, read_lines, transcript_files, write_lines

#: Small splits; small files share one.
SPLITS = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "512"}
#: Text that one task reads, split by split; small corpora get two tasks a core.
TASK_BYTES = 32 << 20


def split_settings(spark: SparkSession, text_bytes: int) -> dict[str, str]:
    """Small splits dealt to few tasks: their number follows the text by ``TASK_BYTES``, and with
    it the number of files that parsed records are stored in, not the number of splits."""
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-text_bytes // TASK_BYTES))
    return {**SPLITS, "spark.sql.files.maxPartitionNum": str(tasks)}

TEXT_SQL = """
    users AS (SELECT user_id, row_number() OVER (ORDER BY user_id NULLS LAST) - 1 AS u FROM (SELECT DISTINCT user_id FROM events)),
    ev AS (
      SELECT u, event_id AS e, epoch_us(ts) // 1000 AS ms, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
             row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY u) AS n
      FROM events JOIN users ON users.user_id IS NOT DISTINCT FROM events.user_id
      WINDOW w AS (PARTITION BY u ORDER BY epoch_us(ts) // 1000, event_id)),
    moments AS (
      SELECT u, max(least(3 + u % 4, n)) AS c, max(ms) FILTER (i = 0) AS t0, max(ms) FILTER (i = n - 1) AS t1,
             max(ms) FILTER (i = least(3 + u % 4, n) - 1) AS cut FROM ev GROUP BY u),
    s AS (
      SELECT u, i AS pos, 'e' || e AS uuid, ms, k, CASE WHEN i % 5 = 1 AND u % 2 = 0 THEN 'compaction'
               WHEN i % 5 = 2 AND u % 3 = 0 THEN 'refusal' WHEN i % 5 = 3 AND u % 4 = 0 THEN 'fallback'
               WHEN i % 5 = 0 AND u % 3 = 1 THEN 'image' WHEN i % 5 = 4 THEN 'ledger' ELSE 'reply' END AS body FROM ev),
    j AS (SELECT unnest([0, 1]) AS j),
    rec AS (
      SELECT 's' AS letter, u, pos, uuid, ms, k, body, CAST(NULL AS VARCHAR) AS origin FROM s
      UNION ALL SELECT 'f', u, pos, uuid, ms, k, body, CASE WHEN u % 2 = 0 THEN 's' || u END FROM s JOIN moments USING (u) WHERE u % 3 = 0 AND pos < c
      UNION ALL SELECT 'f', u, c + j, 'fo' || u || '-' || j, cut + 1000 * (j + 1), 8, 'reply', CASE WHEN u % 2 = 0 THEN 'f' || u END FROM moments, j WHERE u % 3 = 0
      UNION ALL SELECT 'd', u, pos, uuid, ms, k, body, 's' || u FROM s JOIN moments USING (u) WHERE u % 6 = 0 AND pos < c
      UNION ALL SELECT 'd', u, c, 'fo' || u || '-0', cut + 1000, 8, 'reply', 'f' || u FROM moments WHERE u % 6 = 0
      UNION ALL SELECT 'd', u, c + 1, 'do' || u, cut + 5000, 8, 'reply', 'd' || u FROM moments WHERE u % 6 = 0
      UNION ALL SELECT 'k', u, j, 'ko' || u || '-' || j, t1 + 1000 * (j + 1), 8, 'reply', 's' || u FROM moments, j WHERE u % 3 = 1
      UNION ALL SELECT 'g', u, j, 'go' || u || '-' || j, t1 + 1000 * (j + 1), 8, 'reply', 'gone' || u FROM moments, j WHERE u % 3 = 2
      UNION ALL SELECT 'x', u, 0, 'xo' || u, t1 + 7000, 8, 'reply', 'y' || u FROM moments WHERE u % 5 = 4
      UNION ALL SELECT 'y', u, 0, 'yo' || u, t1 + 8000, 8, 'reply', 'x' || u FROM moments WHERE u % 5 = 4),
    copies AS (SELECT *, letter || u AS session, min(letter) OVER (PARTITION BY uuid) AS first FROM rec),
    once AS (
      SELECT *, CASE WHEN uuid LIKE 'e%' THEN 's' || u WHEN uuid LIKE 'fo%' THEN 'f' || u ELSE session END AS owner
      FROM copies WHERE letter = first),
    turns AS (
      SELECT *, CASE WHEN body = 'ledger' THEN 2 * k ELSE k END AS input, CASE WHEN body = 'ledger' THEN k + 3 ELSE k + 1 END AS output,
             CAST(CASE WHEN body = 'ledger' THEN k * pow(2.0, -20) + k * pow(2.0, -17) + k * pow(2.0, -19) + 3 * pow(2.0, -16)
                  ELSE k * pow(2.0, -20) + (k + 1) * pow(2.0, -17) END AS DOUBLE) AS cost
      FROM once WHERE body IN ('reply', 'ledger')),
    edges AS (
      SELECT 'f' || u AS child, 's' || u AS parent, 's' || u AS family, 1 AS depth, CASE WHEN u % 2 = 0 THEN 'marker' ELSE 'uuid-overlap' END AS source,
             'copy' AS kind, u % 2 = 1 AS ambiguous, false AS missing, cut AS fork, cut + 500 AS created, cut + 1000 AS own, c AS carried, u FROM moments WHERE u % 3 = 0
      UNION ALL SELECT 'd' || u, 'f' || u, 's' || u, 2, 'marker', 'copy', false, false, cut + 1000, cut + 1500, cut + 5000, c + 1, u FROM moments WHERE u % 6 = 0
      UNION ALL SELECT 'k' || u, 's' || u, 's' || u, 1, 'marker', 'continuation', false, false, t1, t1 + 500, t1 + 1000, 0, u FROM moments WHERE u % 3 = 1
      UNION ALL SELECT 'g' || u, 'gone' || u, 'gone' || u, 1, 'marker', 'continuation', false, true, NULL, t1 + 500, t1 + 1000, 0, u FROM moments WHERE u % 3 = 2
      UNION ALL SELECT 'y' || u, 'x' || u, 'x' || u, 1, 'marker', 'continuation', false, false, t1 + 7000, t1 + 6500, t1 + 8000, 0, u FROM moments WHERE u % 5 = 4),
    carried AS (
      SELECT r.session, count(*) AS n, sum(t.cost) AS cost FROM copies r JOIN turns t USING (uuid) WHERE r.session <> t.owner GROUP BY 1),
    owners AS (SELECT DISTINCT owner FROM turns)"""


def _name(letter: str) -> Column:
    return F.concat(F.lit(letter), F.col("u").cast("string"))


def _sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(records, moments): one row per line of the sessions above, and times per user."""
    raw = table(spark, sf_dir, "events")
    users = materialize(ranked_users(raw.select(F.col("user_id").alias("user"))), "text-users")
    # Dealt before the JSON is parsed, as few row groups would make few tasks, and stored, as the
    # sequence reads its rows more than once.
    events = raw.select("user_id", "event_id", "ts", "props").repartition(parse_pieces(spark, raw), "event_id", "ts").select(
        F.col("user_id").alias("user"), F.col("event_id").alias("e"), ms_of("ts").alias("ms"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    ranked = materialize(
        events.join(users, events["user"].eqNullSafe(users["user"])).select("u", "e", "ms", "k"), "text-ranked"
    )
    ev = materialize(with_sequence(ranked, ["u"], "ms", ["e"], "i", "n"), "text-events")
    c = F.least(3 + F.col("u") % 4, F.col("n"))
    at = ev.withColumn("c", c).groupBy("u").agg(
        F.max("c").alias("c"),
        F.max(F.when(F.col("i") == 0, F.col("ms"))).alias("t0"),
        F.max(F.when(F.col("i") == F.col("n") - 1, F.col("ms"))).alias("t1"),
        F.max(F.when(F.col("i") == F.col("c") - 1, F.col("ms"))).alias("cut"),
    )
    at = materialize(at, "text-moments")
    i, u = F.col("i"), F.col("u")
    body = (
        F.when((i % 5 == 1) & (u % 2 == 0), "compaction").when((i % 5 == 2) & (u % 3 == 0), "refusal")
        .when((i % 5 == 3) & (u % 4 == 0), "fallback").when((i % 5 == 0) & (u % 3 == 1), "image")
        .when(i % 5 == 4, "ledger").otherwise("reply")
    )
    uuid_of = F.concat(F.lit("e"), F.col("e").cast("string"))
    s = ev.select("u", i.alias("pos"), uuid_of.alias("uuid"), "ms", "k", body.alias("body"))
    copied = s.join(at.select("u", "c"), "u").where("pos < c").drop("c")
    none = F.lit(None).cast("string")
    twice = at.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))

    def own(rows: DataFrame, letter: str, where: str, pos: Column, ident: Column, ms: Column, origin: Column) -> DataFrame:
        return rows.where(where).select(
            F.lit(letter).alias("letter"), "u", pos.cast("long").alias("pos"), ident.alias("uuid"), ms.alias("ms"),
            F.lit(8).cast("long").alias("k"), F.lit("reply").alias("body"), origin.alias("origin"),
        )

    def copy(rows: DataFrame, letter: str, where: str, origin: Column) -> DataFrame:
        return rows.where(where).select(F.lit(letter).alias("letter"), "*", origin.alias("origin"))

    numbered = lambda p: F.concat(_name(p), F.lit("-"), F.col("j").cast("string"))
    cut, end, j = F.col("cut"), F.col("t1"), F.col("j")
    even = lambda c: F.when(u % 2 == 0, c)
    parts = [
        copy(s, "s", "true", none),
        copy(copied, "f", "u % 3 = 0", even(_name("s"))),
        own(twice, "f", "u % 3 = 0", F.col("c") + j, numbered("fo"), cut + 1000 * (j + 1), even(_name("f"))),
        copy(copied, "d", "u % 6 = 0", _name("s")),
        own(at, "d", "u % 6 = 0", F.col("c"), F.concat(_name("fo"), F.lit("-0")), cut + 1000, _name("f")),
        own(at, "d", "u % 6 = 0", F.col("c") + 1, _name("do"), cut + 5000, _name("d")),
        own(twice, "k", "u % 3 = 1", j, numbered("ko"), end + 1000 * (j + 1), _name("s")),
        own(twice, "g", "u % 3 = 2", j, numbered("go"), end + 1000 * (j + 1), _name("gone")),
        own(at, "x", "u % 5 = 4", F.lit(0), _name("xo"), end + 7000, _name("y")),
        own(at, "y", "u % 5 = 4", F.lit(0), _name("yo"), end + 8000, _name("x")),
    ]
    records = parts[0]
    for part in parts[1:]:
        records = records.unionByName(part)
    return records, at


def _json(records: DataFrame) -> DataFrame:
    """(path, pos, value): the records as lines of their files."""
    k, body = F.col("k"), F.col("body")
    session = F.concat("letter", F.col("u").cast("string"))

    def obj(**named: Column) -> Column:
        return F.struct(*[v.alias(name) for name, v in named.items()])

    def usage(input: Column, output: Column, kind: Column, model: Column, ledger: Column | None = None) -> Column:
        parts = dict(type=kind, model=model, input_tokens=input, output_tokens=output)
        return obj(**parts, **({} if ledger is None else {"iterations": ledger}))

    none = F.lit(None).cast("string")
    first = usage(k, k, F.lit("message"), F.lit("alpha"))
    second = usage(k, F.lit(3).cast("long"), F.lit("fallback_message"), F.lit("beta"))
    ledger = F.when(body == "ledger", F.array(first, second))
    billed = body.isin("reply", "ledger")
    # A PNG, and a JPEG that states its size behind a segment of metadata; some users' has 60 kB.
    w, h = k % 1000 + 1, k % 700 + 1
    tail = F.lit("00" * 16)
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.format_string("%08X%08X", w, h), tail)
    filler = F.when(F.col("u") % 150 == 1, 60_000).otherwise(20)
    jpeg = F.concat(
        F.lit("FFD8FFE1"), F.format_string("%04X", filler + 2), F.repeat(F.lit("00"), filler),
        F.lit("FFC2001108"), F.format_string("%04X%04X", h, w), F.lit("03"), tail,
    )

    def image(kind: str, digits: Column) -> Column:
        return obj(type=F.lit("image"), source=obj(media_type=F.lit(kind), data=F.translate(F.base64(F.unhex(digits)), "\r\n", "")))

    shown = body == "image"
    picture = image("image/jpeg", jpeg)
    source = F.lit(None).cast("struct<media_type:string,data:string>")
    pictures = F.lit(None).cast("array<struct<type:string,source:struct<media_type:string,data:string>>>")
    seen = F.array(
        obj(type=F.lit("image"), text=none, source=image("image/png", png)["source"], content=pictures),
        obj(type=F.lit("tool_result"), text=none, source=source, content=F.array(picture)),
    )
    said = F.array(obj(type=F.lit("text"), text=F.lit("said"), source=source, content=pictures))
    blocks = F.when(shown, seen).otherwise(said)
    record = obj(
        type=F.when(billed, "assistant").when(shown, "user").otherwise("system"),
        uuid=F.col("uuid"),
        sessionId=session,
        session_id=F.col("origin"),
        timestamp=F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        cwd=F.concat(F.lit("/w/p"), (F.col("u") % 7).cast("string")),
        version=F.concat(F.lit("2.1."), (F.col("u") % 3).cast("string")),
        message=F.when(
            billed | shown,
            obj(
                id=F.when(billed, F.concat(F.lit("m"), F.col("uuid"))),
                model=F.when(billed, "alpha"),
                content=blocks,
                usage=F.when(billed, usage(k, k + 1, none, none, ledger)),
            ),
        ),
        toolUseResult=F.when(shown, F.array(picture)),
        compactMetadata=F.when(body == "compaction", obj(trigger=F.lit("manual"), preTokens=k + 1000, postTokens=k)),
        apiRefusalCategory=F.when(body == "refusal", F.concat(F.lit("c"), (k % 3).cast("string"))),
        originalModel=F.when(body == "fallback", "alpha"),
        fallbackModel=F.when(body == "fallback", "beta"),
    )
    return records.select(_path(F.col("letter")).alias("path"), "pos", F.to_json(record).alias("value"))


def _path(letter: Column) -> Column:
    slug = F.concat(F.lit("-w-p"), (F.col("u") % 7).cast("string"))
    return F.concat(slug, F.lit("/"), letter, F.col("u").cast("string"), F.lit(".jsonl"))


def write_transcripts(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The folder of the transcripts, and when each file was created: (path, created_ms)."""
    folder = f"{ensure_checkpoint_dir(spark)}/transcripts-{uuid.uuid4().hex}"
    records, at = _sessions(spark, sf_dir)
    title = F.to_json(F.struct(F.lit("custom-title").alias("type"), _name("z").alias("sessionId"), _name("title ").alias("customTitle")))
    extra = at.where("u % 7 = 0").select(
        _path(F.lit("z")).alias("path"), F.posexplode(F.array(title, F.lit("{ this is no JSON"))).alias("pos", "value")
    )
    write_lines(_json(records).unionByName(extra.select("path", F.col("pos").cast("long").alias("pos"), "value")), folder, ["pos"])
    (root,) = existing_roots(spark, [folder])
    born = None
    for letter, where, created in (
        ("s", "true", F.col("t0")), ("f", "u % 3 = 0", F.col("cut") + 500), ("d", "u % 6 = 0", F.col("cut") + 1500),
        ("k", "u % 3 = 1", F.col("t1") + 500), ("g", "u % 3 = 2", F.col("t1") + 500), ("x", "u % 5 = 4", F.col("t1") + 6000),
        ("y", "u % 5 = 4", F.col("t1") + 6500), ("z", "u % 7 = 0", F.col("t0") + 1),
    ):
        part = at.where(where).select(F.concat(F.lit(root + "/"), _path(F.lit(letter))).alias("path"), created.alias("created_ms"))
        born = part if born is None else born.unionByName(part)
    return folder, materialize(born, "created")


_DONE: dict[tuple[str, str], Normalized] = {}


def mined(spark: SparkSession, sf_dir: str) -> Normalized:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DONE:
        folder, created = write_transcripts(spark, sf_dir)
        # The list is read by several tables, and no file is opened for it: few tasks, once.
        with settings(spark, split_settings(spark, 0)):
            files = materialize(transcript_files(spark, [folder], created), "files")
        # Creation times belong to files: joined to lines, they could shuffle the text.
        result = normalize(read_lines(spark, [folder]), files, prices_from_json(spark, json.dumps(RATES), "v1"))
        with settings(spark, split_settings(spark, files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])):
            result.facts.isEmpty()  # parsed and stored here, from small splits
        _DONE[key] = result
    return _DONE[key]


@query(
    "mine_fork_edges",
    f"""WITH {TEXT_SQL}
    SELECT child AS "childSessionId", parent AS "parentSessionId", family AS "lineageId", CAST(depth AS BIGINT) AS depth,
           '-w-p' || (e.u % 7) AS "projectSlug", 'p' || (e.u % 7) AS project, source, kind, ambiguous, missing AS "parentMissing",
           fork AS "forkPointMs", created AS "childCreatedMs", own AS "childFirstNativeMs",
           CAST(coalesce((own - fork) / 1000.0, 0) AS DOUBLE) AS "lagSeconds", CAST(e.carried AS BIGINT) AS "nRecordsInherited",
           coalesce(c.n, 0) AS "nTurnsInherited", coalesce(c.cost, 0) AS "inheritedCost", true AS "childHasTurns",
           EXISTS (SELECT 1 FROM owners WHERE owner = parent) AS "parentHasTurns",
           CASE WHEN EXISTS (SELECT 1 FROM owners WHERE owner = parent) THEN parent END AS "billedAncestorSessionId",
           CASE WHEN EXISTS (SELECT 1 FROM owners WHERE owner = parent) THEN fork END AS "billedAncestorForkPointMs"
    FROM edges e LEFT JOIN carried c ON c.session = child""",
)
def mine_fork_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forks, continuations, absent parents and opened rings, every column of the grain."""
    return mined(spark, sf_dir)["forkEdges"].select(
        "childSessionId", "parentSessionId", "lineageId", "depth", "projectSlug", "project", "source", "kind",
        "ambiguous", "parentMissing", ms_of("forkPointTs").alias("forkPointMs"),
        ms_of("childCreatedTs").alias("childCreatedMs"), ms_of("childFirstNativeTs").alias("childFirstNativeMs"),
        "lagSeconds", "nRecordsInherited", "nTurnsInherited", "inheritedCost", "childHasTurns", "parentHasTurns",
        "billedAncestorSessionId", ms_of("billedAncestorForkPointTs").alias("billedAncestorForkPointMs"),
    )


@query(
    "mine_unresolved",
    f"""WITH {TEXT_SQL}
    SELECT 'x' || u AS session, 'cycle parent=y' || u AS reason FROM moments WHERE u % 5 = 4
    UNION ALL SELECT 'x' || u, 'marker-not-ancestor marker=y' || u FROM moments WHERE u % 5 = 4""",
)
def mine_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What content and markers leave open: the links that closed rings."""
    return mined(spark, sf_dir).unresolved


@query(
    "mine_origins",
    f"""WITH {TEXT_SQL}
    SELECT 'm' || uuid AS "messageId", uuid, owner AS "sessionId", session AS "fileSessionId",
           CASE left(owner, 1) WHEN 'f' THEN 's' || u WHEN 'd' THEN 's' || u WHEN 'k' THEN 's' || u WHEN 'g' THEN 'gone' || u
                WHEN 'y' THEN 'x' || u ELSE owner END AS "lineageId", ms, '2.1.' || (u % 3) AS "ccVersion" FROM turns""",
)
def mine_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response once, credited to the session that produced it, whichever copy is read first."""
    return mined(spark, sf_dir)["turns"].select(
        "messageId", "uuid", "sessionId", "fileSessionId", "lineageId", ms_of("ts").alias("ms"), "ccVersion"
    )


@query(
    "mine_ledgers",
    f"""WITH {TEXT_SQL}
    SELECT 'm' || uuid AS "messageId", owner AS "sessionId", body = 'ledger' AS "hadFallback",
           CASE WHEN body = 'ledger' THEN k ELSE 0 END AS "wastedOutputTokens", input AS "inputTokens", output AS "outputTokens",
           cost AS "costTotal", false AS unpriced FROM turns""",
)
def mine_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with attempts that were discarded: each attempt at its own model's rates."""
    return mined(spark, sf_dir)["turns"].select(
        "messageId", "sessionId", "hadFallback", "wastedOutputTokens", "inputTokens", "outputTokens", "costTotal", "unpriced"
    )


@query(
    "mine_events",
    f"""WITH {TEXT_SQL}
    SELECT owner AS "sessionId", '-w-p' || (u % 7) AS "projectSlug", ms, body AS kind,
           CASE WHEN body = 'compaction' THEN k + 1000 END AS "preTokens", CASE WHEN body = 'refusal' THEN 'c' || (k % 3) END AS category,
           CASE WHEN body = 'fallback' THEN 'alpha>beta' END AS models
    FROM once WHERE body IN ('compaction', 'refusal', 'fallback')""",
)
def mine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compactions, refusals and fallbacks, once each however many forks carry them."""
    said = lambda name: F.get_json_object("payload", f"$.{name}")
    return mined(spark, sf_dir)["events"].select(
        "sessionId", "projectSlug", ms_of("ts").alias("ms"), "kind", said("preTokens").cast("long").alias("preTokens"),
        said("category").alias("category"), (F.concat(said("from"), F.lit(">"), said("to"))).alias("models"),
    )


@query(
    "mine_images",
    f"""WITH {TEXT_SQL}, shown AS (SELECT uuid, owner, ms, k, u, k % 1000 + 1 AS w, k % 700 + 1 AS h FROM once WHERE body = 'image'),
    kinds AS (SELECT unnest(['content', 'tool_result', 'toolUseResult']) AS carrier)
    SELECT uuid, owner AS "sessionId", ms, carrier, CASE WHEN carrier = 'content' THEN 'image/png' ELSE 'image/jpeg' END AS "mediaType",
           w AS width, h AS height, CAST(floor(w * h / 750.0 + 0.5) AS BIGINT) AS "estTokens",
           CAST(4 * ceil((CASE WHEN carrier = 'content' THEN 40 WHEN u % 150 = 1 THEN 60032 ELSE 52 END) / 3.0) AS BIGINT) AS "bytesBase64"
    FROM shown, kinds""",
)
def mine_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images on all three carriers, sized from their headers, some behind 60 kB of metadata."""
    return mined(spark, sf_dir)["images"].select(
        "uuid", "sessionId", ms_of("ts").alias("ms"), "carrier", "mediaType", "width", "height", "estTokens", "bytesBase64"
    )


@query(
    "mine_families",
    f"""WITH {TEXT_SQL}, everyone AS (
      SELECT DISTINCT session, u FROM copies UNION SELECT 'z' || u, u FROM moments WHERE u % 7 = 0),
    placed AS (
      SELECT e.session, coalesce(d.family, e.session) AS family, coalesce(d.depth, 0) AS depth, e.u FROM everyone e LEFT JOIN edges d ON d.child = e.session)
    SELECT family AS "lineageId", session AS "sessionId", CAST(depth AS BIGINT) AS depth,
           row_number() OVER (PARTITION BY family ORDER BY depth, u % 7, session) - 1 AS ordinal FROM placed""",
)
def mine_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session with its family and its place in it."""
    return mined(spark, sf_dir).work.members.select("lineageId", "sessionId", "depth", "ordinal")


@query(
    "mine_text_statistics",
    f"""WITH {TEXT_SQL}, files AS (SELECT DISTINCT session FROM copies UNION SELECT 'z' || u FROM moments WHERE u % 7 = 0),
    z AS (SELECT count(*) AS n FROM moments WHERE u % 7 = 0),
    billed AS (SELECT * FROM copies WHERE body IN ('reply', 'ledger')),
    spread AS (SELECT uuid FROM billed GROUP BY uuid HAVING count(*) > 1)
    SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM files) AS "sessionFiles",
           (SELECT count(*) FROM rec) + z.n AS records, z.n AS "parseErrors", (SELECT count(*) FROM billed) AS "assistantRecords",
           (SELECT count(*) FROM turns) AS "dedupedTurns", (SELECT CAST(sum(output) AS BIGINT) FROM turns) AS "dedupedOutputTokens",
           (SELECT CAST(sum(CASE WHEN body = 'ledger' THEN k + 3 ELSE k + 1 END) AS BIGINT) FROM billed) AS "naiveOutputTokens",
           (SELECT count(*) FROM spread) AS "crossFileDuplicates", CAST(0 AS BIGINT) AS "groupsWithVaryingOutput",
           CAST(0 AS BIGINT) AS "unpricedTurns", CAST(0 AS BIGINT) AS "turnsWithoutTimestamp",
           (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM carried) AS "inheritedTurnsSeen",
           (SELECT count(*) FROM files WHERE left(session, 1) IN ('s', 'z') OR (left(session, 1) = 'f' AND CAST(substr(session, 2) AS BIGINT) % 2 = 1)) AS "sessionFilesWithoutMarker",
           (SELECT count(*) FROM edges) AS "forkEdges", (SELECT count(*) FROM edges WHERE source = 'marker') AS "forkEdgesFromMarker",
           (SELECT count(*) FROM edges WHERE ambiguous) AS "forkEdgesAmbiguous",
           (SELECT count(*) FROM files WHERE left(session, 1) IN ('s', 'z', 'x', 'g')) AS lineages,
           (SELECT CAST(max(depth) AS BIGINT) FROM edges) AS "maxForkDepth", 2 * (SELECT count(*) FROM moments WHERE u % 5 = 4) AS "unresolvedForks",
           CAST(0 AS BIGINT) AS "agentRuns", (SELECT sum(cost) FROM turns) AS "totalCost", 'v1' AS "pricingVersion"
    FROM z""",
)
def mine_text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark, sf_dir).stats.select(
        "files", "sessionFiles", "records", "parseErrors", "assistantRecords", "dedupedTurns", "dedupedOutputTokens",
        "naiveOutputTokens", "crossFileDuplicates", "groupsWithVaryingOutput", "unpricedTurns", "turnsWithoutTimestamp",
        "inheritedTurnsSeen", "sessionFilesWithoutMarker", "forkEdges", "forkEdgesFromMarker", "forkEdgesAmbiguous",
        "lineages", "maxForkDepth", "unresolvedForks", "agentRuns", "totalCost", "pricingVersion",
    )


@query(
    "quality_each_broken",
    f"""WITH {TEXT_SQL}, ko AS (SELECT * FROM turns WHERE uuid LIKE 'ko%')
    SELECT 'totals' AS "check", 'sessions' AS problem FROM turns HAVING count(*) > 0
    UNION ALL SELECT 'billing-keys', 'm' || uuid || ' was billed 2 times' FROM ko
    UNION ALL SELECT 'dedup', 'dedup-adds-output kept=' || CAST(sum(output) AS BIGINT) || ' naive=0' FROM turns HAVING count(*) > 0
    UNION ALL SELECT 'lineage', 'root-misplaced session=s' || u || ' depth=2 lineage=s' || u FROM moments WHERE u % 3 = 2
    UNION ALL SELECT 'lineage', 'depth-step session=d' || u || ' depth=5 parent-depth=1' FROM moments WHERE u % 6 = 0
    UNION ALL SELECT 'lineage', 'lineage-differs session=k' || u || ' lineage=other parent-lineage=s' || u FROM moments WHERE u % 3 = 1
    UNION ALL SELECT 'lineage', 'start-before-fork session=y' || u FROM moments WHERE u % 5 = 4
    UNION ALL SELECT 'lineage', 'parent-unknown session=g' || u || ' parent=gone' || u FROM moments WHERE u % 3 = 2
    UNION ALL SELECT 'edges', 'edge-count edges=' || count(*) FILTER (left(child, 1) <> 'f') || ' children=' || count(*) FROM edges HAVING count(*) FILTER (left(child, 1) = 'f') > 0
    UNION ALL SELECT 'agents', 'agent runs hold 0 turns of ' || count(*) FROM ko HAVING count(*) > 0""",
)
def quality_each_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each invariant over grains that are damaged so that it must fail, and how."""
    good = mined(spark, sf_dir)
    turns, sessions, edges = good["turns"], good["sessions"], good["forkEdges"]
    own = F.col("messageId").startswith("mko")
    letter, u = F.substring("sessionId", 1, 1), F.substring("sessionId", 2, 20).cast("long")
    costly = sessions.withColumn("nativeCost", F.col("nativeCost") + 1)
    misplaced = sessions.withColumns(
        {
            "depth": F.when((letter == "s") & (u % 3 == 2), F.lit(2).cast("long")).when(letter == "d", F.lit(5).cast("long")).otherwise(F.col("depth")),
            "lineageId": F.when(letter == "k", "other").otherwise(F.col("lineageId")),
            "firstNativeTs": F.when(letter == "y", F.timestamp_seconds(F.lit(0))).otherwise(F.col("firstNativeTs")),
        }
    )
    present = edges.withColumn("parentMissing", F.lit(False))
    agents = turns.withColumn("context", F.when(own, "subagent").otherwise(F.col("context"))).withColumn("agentId", F.when(own, "a"))
    totals = quality.totals_agree(turns, costly, good["lineages"])
    return (
        totals.select("check", F.regexp_extract("problem", "^cost of ([a-z]+) is", 1).alias("problem"))
        .unionByName(quality.unique_billing_keys(turns.unionByName(turns.where(own))))
        .unionByName(quality.dedup_only_removes(good.stats.withColumn("naiveOutputTokens", F.lit(0).cast("long"))))
        .unionByName(quality.lineage_closes(misplaced, present))
        .unionByName(quality.edges_match_parents(sessions, edges.where(~F.col("childSessionId").startswith("f"))))
        .unionByName(quality.agents_cover_turns(agents, good["agentRuns"]))
    )


@query("quality_text_corpus", f"""WITH {TEXT_SQL} SELECT 'none' AS verdict, count(*) AS turns FROM turns""")
def quality_text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No invariant fails over a corpus with forks of every kind: the verdict beside what it is about."""
    good = mined(spark, sf_dir)
    found = quality.problems(good).agg(F.coalesce(F.min("problem"), F.lit("none")).alias("verdict"))
    return quality.side_by_side([found, good["turns"].agg(F.count(F.lit(1)).alias("turns"))])


@query(
    "session_drilldown",
    f"""WITH {TEXT_SQL}
    SELECT owner AS "sessionId", ms AS ts, CAST(k * pow(2.0, -20) + CASE WHEN body = 'ledger' THEN k * pow(2.0, -19) ELSE 0 END AS DOUBLE) AS "costInput",
           CAST(CASE WHEN body = 'ledger' THEN k * pow(2.0, -17) + 3 * pow(2.0, -16) ELSE (k + 1) * pow(2.0, -17) END AS DOUBLE) AS "costOutput",
           cost AS "costTotal", input AS "contextTokens", output AS "outputTokens", 'alpha' AS model, 'main' AS context, body = 'ledger' AS "hadFallback"
    FROM turns""",
)
def session_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of every session as its own page shows them."""
    return detail.session_turns(mined(spark, sf_dir)["turns"]).select(
        "sessionId", "ts", "costInput", "costOutput", "costTotal", "contextTokens", "outputTokens", "model", "context", "hadFallback"
    )


@query(
    "mine_text_sessions",
    f"""WITH {TEXT_SQL}, everyone AS (
      SELECT DISTINCT letter, session, u FROM copies UNION SELECT 'z', 'z' || u, u FROM moments WHERE u % 7 = 0),
    gaps AS (SELECT *, ms - lag(ms) OVER (PARTITION BY owner ORDER BY ms) AS dt FROM turns),
    sums AS (
      SELECT owner, count(*) AS n, sum(cost) AS cost, min(ms) AS first, max(ms) AS last, max(input) AS peak,
             coalesce(sum(dt) FILTER (dt > 0 AND dt < 1800000), 0) / 1000.0 AS active FROM gaps GROUP BY 1),
    ends AS (SELECT session, arg_max(ms, pos) AS last FROM copies GROUP BY 1),
    compacted AS (SELECT owner, count(*) AS n, max(k + 1000) AS peak FROM once WHERE body = 'compaction' GROUP BY 1)
    SELECT e.session AS "sessionId", '-w-p' || (e.u % 7) AS "projectSlug", CASE WHEN e.letter = 'z' THEN 'p' || (e.u % 7) ELSE 'p' || (e.u % 7) END AS project,
           CASE WHEN e.letter <> 'z' THEN '/w/p' || (e.u % 7) END AS cwd, CASE WHEN e.letter = 'z' THEN 'title ' || e.u ELSE left(e.session, 8) END AS name,
           CASE WHEN e.letter = 'z' THEN 'title ' || e.u END AS "customTitle", d.parent AS "parentSessionId",
           coalesce(d.family, e.session) AS "lineageId", CAST(coalesce(d.depth, 0) AS BIGINT) AS depth, d.source AS "parentSource", d.kind AS "parentKind",
           coalesce(d.ambiguous, false) AS "parentAmbiguous", CAST(coalesce(d.carried, 0) AS BIGINT) AS "nRecordsInherited", coalesce(c.n, 0) AS "nTurnsInherited",
           coalesce(c.cost, 0) AS "inheritedCost", CASE e.letter WHEN 's' THEN a.t0 WHEN 'x' THEN a.t1 + 6000 WHEN 'z' THEN a.t0 + 1 ELSE d.created END AS "createdMs",
           CASE WHEN e.letter = 's' THEN a.t0 WHEN e.letter = 'x' THEN a.t1 + 7000 ELSE d.own END AS "firstNativeMs", n.last AS "lastNativeMs",
           s.first AS "firstMs", s.last AS "lastMs", CAST(coalesce((s.last - s.first) / 1000.0, 0) AS DOUBLE) AS "spanSeconds",
           CAST(coalesce(s.active, 0) AS DOUBLE) AS "activeSeconds", coalesce(s.n, 0) AS "nTurnsNative", coalesce(s.cost, 0) AS "nativeCost",
           coalesce(m.n, 0) AS "nCompactions", CAST(coalesce(greatest(s.peak, m.peak), 0) AS BIGINT) AS "peakContextTokens",
           CASE WHEN s.n > 0 THEN 'alpha' ELSE '' END AS models, CASE WHEN s.n > 0 THEN '2.1.' || (e.u % 3) ELSE '' END AS "ccVersions"
    FROM everyone e JOIN moments a USING (u) LEFT JOIN edges d ON d.child = e.session LEFT JOIN carried c ON c.session = e.session
    LEFT JOIN sums s ON s.owner = e.session LEFT JOIN ends n ON n.session = e.session LEFT JOIN compacted m ON m.owner = e.session""",
)
def mine_text_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of every kind, those without a turn among them, in nearly every column."""
    return mined(spark, sf_dir)["sessions"].select(
        "sessionId", "projectSlug", "project", "cwd", "name", "customTitle", "parentSessionId", "lineageId", "depth",
        "parentSource", "parentKind", "parentAmbiguous", "nRecordsInherited", "nTurnsInherited", "inheritedCost",
        ms_of("createdTs").alias("createdMs"), ms_of("firstNativeTs").alias("firstNativeMs"), ms_of("lastNativeTs").alias("lastNativeMs"),
        ms_of("firstTs").alias("firstMs"), ms_of("lastTs").alias("lastMs"), "spanSeconds", "activeSeconds", "nTurnsNative",
        "nativeCost", "nCompactions", "peakContextTokens", "models", "ccVersions",
    )


@query(
    "text_drawable_edges",
    f"""WITH {TEXT_SQL}
    SELECT child AS "childId", parent AS "parentId", coalesce(fork, own) AS "forkTs", kind, ambiguous FROM edges
    WHERE NOT missing AND u % 7 <> 3 AND parent IN (SELECT owner FROM owners) AND child IN (SELECT owner FROM owners)""",
)
def text_drawable_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fork edges between what is drawn once a project is filtered out: edges to absent sessions
    and of sessions that the filter leaves without a turn go."""
    done = mined(spark, sf_dir)
    spans = timeline.timeline_spans(done["turns"], F.col("projectSlug") != "-w-p3")
    return timeline.drawable_edges(timeline.fork_times(done["forkEdges"]), spans)


@query(
    "text_group_rollup",
    f"""WITH {TEXT_SQL}
    SELECT 'p' || (u % 7) AS project, count(DISTINCT owner) AS "nSessions", CAST(0 AS BIGINT) AS "nAgents", sum(cost) AS cost FROM turns GROUP BY 1""",
)
def text_group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and cost of every project."""
    return timeline.group_rollup(timeline.timeline_spans(mined(spark, sf_dir)["turns"]))
