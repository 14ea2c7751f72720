"""The whole job on files: mine, export, read back, replay, index."""

import json
import os

import pytest
from corpus import PRICES, copied, plain, reply
from pyspark.sql import functions as F

from ledgerline.schemas import GRAINS, conform
from ledgerline.sources.paths import holds_parquet
from ledgerline.operators import replay
from ledgerline.plans.mine import mine
from ledgerline.schemas import GRAINS, SCHEMAS
from ledgerline.sources import corpus, sinks, transcripts

S1 = "11111111-1111-4111-8111-111111111111"
S2 = "22222222-2222-4222-8222-222222222222"


def write(path, *records):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        for r in records:
            f.write((r if isinstance(r, str) else json.dumps(r)) + "\n")


def block(id, uuid, session, content, ts):
    return reply(id, uuid, session, block=content, ts=ts)


@pytest.fixture(scope="module")
def mined(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("mine")
    root = str(base / "projects with space+")
    slug = "-home-x-proj"
    first = [
        plain("user", "u0", S1, "2026-05-01T10:00:00Z", message={"content": "  do it  "}),
        block("m1", "u1", S1, {"type": "thinking", "thinking": ""}, "2026-05-01T10:00:01Z"),
        block("m1", "u2", S1, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "c" * 500}}, "2026-05-01T10:00:02Z"),
        plain(
            "user", "u3", S1, "2026-05-01T10:00:03Z",
            message={"content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "r" * 900}, {"type": "image"}]}]},
            toolUseResult={"success": False, "error": "boom", "exitCode": 2},
        ),
        block("m2", "u4", S1, {"type": "text", "text": "done"}, "2026-06-02T10:00:00Z"),
        plain("system", "u5", S1, "2026-06-02T10:01:00Z", compactMetadata={"preTokens": 9, "postTokens": 4}),
        plain("attachment", "u6", S1, "2026-06-02T10:01:01Z", message={"content": "skipped"}),
        "{not json",
    ]
    write(f"{root}/{slug}/{S1}.jsonl", *first)
    write(
        f"{root}/{slug}/{S2}.jsonl",
        *copied(first[:3], S2, True),
        block("m9", "u9", S2, {"type": "text", "text": "own"}, "2026-07-03T10:00:00Z"),
    )
    write(
        f"{root}/{slug}/{S1}/subagents/agent-ab-0123456789abcdef.jsonl",
        reply("ma", "ua", S1, ts="2026-05-01T10:00:30Z", isSidechain=True, block={"type": "odd", "x": 1}),
    )
    write(f"{root}/{slug}/{S1}/subagents/workflows/wf_1/journal.jsonl", {"type": "note"})
    write(f"{root}/stray.jsonl", reply("mx", "ux", "stray"))
    prices = str(base / "prices.json")
    with open(prices, "w") as f:
        json.dump(PRICES, f)
    out = str(base / "corpus")
    result = mine(
        spark, [root, str(base / "nowhere"), root], prices, "v1", out, "first.last", "host-1", replay=True
    )
    return {"root": root, "out": out, "result": result, "base": str(base)}


def test_paths_are_classified(spark, mined):
    rows = {
        os.path.basename(r["path"]): r
        for r in transcripts.transcript_files(spark, [mined["root"]]).collect()
    }
    assert len(rows) == 4 and "stray.jsonl" not in rows
    agent = rows["agent-ab-0123456789abcdef.jsonl"]
    assert (agent["fileKind"], agent["fileSessionId"], agent["fileAgentId"]) == (
        "subagent", S1, "ab-0123456789abcdef",
    )
    journal = rows["journal.jsonl"]
    assert (journal["fileKind"], journal["workflowId"]) == ("workflow-journal", "wf_1")
    order = [r["fileKind"] for r in sorted(rows.values(), key=lambda r: r["walk"])]
    # A session's folder is walked before the session file beside it.
    assert order == ["subagent", "workflow-journal", "session", "session"]
    assert rows[f"{S1}.jsonl"]["projectSlug"] == "-home-x-proj" and rows[f"{S1}.jsonl"]["bytes"] > 0


def test_nested_and_missing_roots(spark, mined):
    inner = f"{mined['root']}/-home-x-proj"
    both = transcripts.read_lines(spark, [mined["root"], inner, f"{mined['root']}/none"])
    assert both.count() == transcripts.read_lines(spark, [mined["root"]]).count()
    assert transcripts.read_lines(spark, ["/no/such/root"]).count() == 0


def test_corpus_reads_back(spark, mined):
    data = corpus.open_corpus(spark, mined["out"])
    assert set(data.missing) <= {"forkEdges", "agentRuns", "lineages"}
    turns = data["turns"]
    assert turns.count() == 4
    assert sorted(r[0] for r in turns.select("month").distinct().collect()) == ["2026-05", "2026-06", "2026-07"]
    assert turns.select("username", "host").distinct().collect() == [("first.last", "host-1")]
    assert [f.name for f in SCHEMAS["turns"].fields] == [
        c for c in turns.columns if c not in ("username", "host", "month")
    ]
    assert {r["sessionId"]: r["nTurnsNative"] for r in data["sessions"].collect()} == {S1: 3, S2: 1}
    assert corpus.open_corpus(spark, mined["out"], username="nobody")["turns"].count() == 0
    plan = corpus.open_corpus(spark, mined["out"], host="host-1")["turns"]._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(host" in plan


def test_views_and_free_sql(spark, mined):
    data = corpus.open_corpus(spark, mined["out"])
    data.register()
    assert corpus.ask(spark, "SELECT sessionId, count(*) AS n FROM turns GROUP BY 1").count() == 2
    assert corpus.one_session(spark, "turns", "x' OR '1'='1").count() == 0
    assert corpus.one_session(spark, "turns", S2).count() == 1
    with pytest.raises(ValueError):
        corpus.ask(spark, "  ")
    with pytest.raises(Exception):
        corpus.ask(spark, "DROP VIEW turns")
    assert corpus.ask(spark, "SELECT id FROM range(1000)").count() == 200


def test_missing_grains(spark, tmp_path):
    with pytest.raises(corpus.CorpusError, match="no grains"):
        corpus.open_corpus(spark, str(tmp_path))
    sinks.export_grain(corpus.empty_grain(spark, "turns").limit(0), GRAINS[0], str(tmp_path), "u", "h")
    with pytest.raises(corpus.CorpusError, match="required|no grains"):
        corpus.open_corpus(spark, str(tmp_path))


def test_reexport_replaces(spark, mined, tmp_path):
    turns = mined["result"]["turns"]
    for _ in range(2):
        sinks.export_grain(turns, GRAINS[0], str(tmp_path), "u", "h")
    assert corpus.read_grain(spark, str(tmp_path), "turns").count() == 4
    sinks.export_grain(turns, GRAINS[0], str(tmp_path), "other", "1e5")
    both = corpus.read_grain(spark, str(tmp_path), "turns")
    assert both.count() == 8
    assert {r[0] for r in both.select("host").distinct().collect()} == {"h", "1e5"}


def test_trailing_window(spark, mined):
    turns = mined["result"]["turns"]
    assert sinks.recent_months(turns, "ts", 1).count() == 1
    assert sinks.recent_months(turns, "ts", 2).count() == 2
    assert sinks.recent_months(turns, "ts", None).count() == 4


def test_key_safety(spark):
    for bad in ("a/b", "..", ".", "a b", "", "x/../y", "..."):
        with pytest.raises(ValueError):
            sinks.assert_key_safe("username", bad)
    for good in ("first.last", "me@host-1", "a_b", "A..b", "a.."):
        sinks.assert_key_safe("username", good)
    df = spark.createDataFrame([("ok",), ("not/ok",)], "u string")
    with pytest.raises(Exception, match="unsafe partition key"):
        df.select(sinks.checked_key("u")).collect()


def test_staging_roundtrip(spark, mined, tmp_path):
    grains = {k: v for k, v in mined["result"].grains.items() if k != "images"}
    sinks.write_flat(grains, str(tmp_path))
    found, absent = sinks.staged_grains(spark, str(tmp_path))
    assert absent == ["images"] and set(found) == set(grains)
    assert found["events"].count() == 1 and found["events"].schema == SCHEMAS["events"]


def test_index_and_manifest(spark, mined):
    shards = sinks.shard_index(spark, mined["out"], ["turns", "sessions"])
    rows = shards.collect()
    assert sum(r["rows"] for r in rows if r["grain"] == "turns") == 4
    for r in rows:
        assert (r["username"], r["host"]) == ("first.last", "host-1")
        assert r["bytes"] == os.path.getsize(f"{mined['out']}/{r['path']}")
        assert (r["month"] is not None) == (r["grain"] == "turns")
    index = corpus.read_index(spark, mined["out"]).collect()
    assert {r["path"] for r in rows} < {r["path"] for r in index} and sum(r["rows"] for r in index) >= 6
    manifest = corpus.read_sidecar(spark, sinks.share_folder(f"{mined['out']}/manifest", "first.last", "host-1"))
    assert manifest["grains"]["turns"] == {"partitionedByMonth": True, "timeColumn": "ts"}
    assert manifest["invariants"] == {"ok": True, "problems": []}
    assert manifest["stats"]["parseErrors"] == 1 and manifest["tables"]["turns"]["rows"] == 4
    assert manifest["tables"]["turns"]["bytes"] == sum(r["bytes"] for r in rows if r["grain"] == "turns")
    assert manifest["tables"]["images"] == {"rows": 0, "bytes": None}
    assert corpus.read_sidecar(spark, f"{mined['out']}/none") is None
    one = [r["path"] for r in rows if r["month"] == "2026-06"]
    assert corpus.read_shards(spark, mined["out"], one).count() == 1


def shard_frame(spark, *rows):
    return spark.createDataFrame(
        [(g, m, f"p/{m or 'flat'}-{g}", b) for g, m, b in rows],
        "grain string, month string, path string, bytes long",
    )


@pytest.mark.parametrize(
    "rows,budget,want",
    [
        ([("turns", "2026-07", 10**6), ("sessions", None, 30_000), ("turns", "2026-06", 10**6)], 50_000, ["p/flat-sessions"]),
        ([("turns", "2026-05", 10**6), ("turns", "2026-07", 10**6), ("turns", "2026-06", 10**6)], 2_500_000, ["p/2026-06-turns", "p/2026-07-turns"]),
        ([("turns", "2026-07", 99 * 10**6), ("turns", "2026-06", 10**6)], 2 * 10**6, ["p/2026-06-turns"]),
        ([("turns", "2026-07", None), ("turns", "2026-06", 5)], 0, ["p/2026-07-turns"]),
    ],
)
def test_shard_selection(spark, rows, budget, want):
    chosen = sinks.select_shards(shard_frame(spark, *rows), budget)
    assert sorted(r["path"] for r in chosen.collect()) == want


def test_replay(spark, mined):
    rows = replay.in_reading_order(
        corpus.read_replay(spark, mined["out"], S1).withColumn("ms", F.unix_millis("ts")), "ms"
    ).collect()
    assert [(r["kind"], r["role"], r["context"]) for r in rows] == [
        ("prompt", "user", "main"),
        ("thinking", "assistant", "main"),
        ("tool_use", "assistant", "main"),
        ("tool_result", "user", "main"),
        ("odd", "assistant", "subagent"),
        ("text", "assistant", "main"),
        ("compaction", "system", "main"),
    ]
    prompt, thought, use, answer, odd, text, mark = rows
    assert (prompt["text"], prompt["fullChars"], prompt["truncated"]) == ("do it", 5, False)
    assert thought["text"] is None
    assert (len(use["text"]), use["truncated"], use["fullChars"], use["toolName"]) == (400, True, 500, "Bash")
    assert (len(answer["text"]), answer["truncated"], answer["fullChars"]) == (800, True, 908)
    assert (answer["ok"], answer["errorKind"], answer["exitCode"]) == (False, "boom", 2)
    assert odd["text"] == '{"type":"odd","x":1}' and odd["agentId"] == "ab-0123456789abcdef"
    assert mark["text"] == "compaction auto, before=9, after=4"
    assert text["text"] == "done"
    # A fork replays its inherited prefix as its own.
    assert corpus.read_replay(spark, mined["out"], S2).count() == 4

    plan = corpus.read_replay(spark, mined["out"], S1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(sessionId)" in plan
    assert corpus.read_replay(spark, mined["out"], "../etc").count() == 0
    assert corpus.read_replay(spark, mined["base"], S1) is None
    index = {r["sessionId"]: r for r in spark.read.json(f"{mined['out']}/replay-index").collect()}
    assert index[S1]["rows"] == 7 and index[S1]["t0"] < index[S1]["t1"]


def test_two_hosts_mine_into_one_prefix(spark, mined):
    """Each keeps its index and manifest, and a trimmed export is counted as it lies there."""
    prices = f"{mined['base']}/prices.json"
    mine(spark, [mined["root"]], prices, "v1", mined["out"], "first.last", "host-2", months=1)
    tables = {(r["host"], r["grain"]): r["rows"] for r in corpus.manifest_tables(spark, mined["out"]).collect()}
    assert tables["host-1", "turns"] == 4 and tables["host-2", "turns"] < 4
    index = corpus.read_index(spark, mined["out"])
    by_host = {r["host"]: r["n"] for r in index.where("grain = 'turns'").groupBy("host").agg(F.sum("rows").alias("n")).collect()}
    assert by_host == {h: n for (h, g), n in tables.items() if g == "turns"}
    held = corpus.open_corpus(spark, mined["out"], host="host-2")["turns"]
    assert held.count() == by_host["host-2"]


def test_shards_of_an_older_schema(spark, tmp_path):
    turns = next(g for g in GRAINS if g.name == "turns")
    old = spark.createDataFrame([("s", 5)], "sessionId string, nBlocks int").withColumn("ts", F.timestamp_seconds(F.lit(1)))
    sinks.export_grain(old, turns, f"file://{tmp_path}", "u", "h")
    (row,) = corpus.read_conformed(spark, f"file://{tmp_path}", "turns").collect()
    assert (row["sessionId"], row["nBlocks"], row["model"], row["username"], row["month"]) == ("s", 5, None, "u", "1970-01")
    with pytest.raises(corpus.CorpusError, match="required grains missing"):
        corpus.open_corpus(spark, f"file://{tmp_path}")


def test_profile_settings(spark):
    found = corpus.profile_settings("team.dev", "data")
    assert found["fs.s3a.bucket.data.auth.profile.name"] == "team.dev"
    providers = found["fs.s3a.bucket.data.aws.credentials.provider"].split(",")
    assert ["Environment" in providers[0], "Profile" in providers[1]] == [True, True]
    corpus.use_profile(spark, "team.dev")
    assert spark._jsc.hadoopConfiguration().get("fs.s3a.auth.profile.name") == "team.dev"
    for name in ("", "a b", "../x"):
        with pytest.raises(ValueError):
            corpus.profile_settings(name)


def test_hosts_share_a_corpus(spark, mined, tmp_path):
    rows = corpus.read_replay(spark, mined["out"], S1).drop("bucket")
    out = f"file://{tmp_path}/shared"
    sinks.write_replay(rows, out, "u", "one")
    other = rows.withColumn("sessionId", F.lit(None).cast("string"))
    sinks.write_replay(other, out, "u", "two")
    sinks.write_replay(other, out, "u", "two")
    assert spark.read.parquet(f"{out}/replay").groupBy("host").count().collect() and {
        r["host"]: r["count"] for r in spark.read.parquet(f"{out}/replay").groupBy("host").count().collect()
    } == {"one": 7, "two": 7}


def test_an_emptied_grain_keeps_no_rows(spark, mined, tmp_path):
    grain = next(g for g in GRAINS if g.name == "turns")
    out = f"file://{tmp_path}/emptied"
    rows = conform(spark.read.parquet(f"{mined['out']}/turns"), "turns")
    sinks.export_grain(rows, grain, out, "u", "h")
    assert holds_parquet(spark, f"{out}/turns")
    sinks.export_grain(rows.where(F.lit(False)), grain, out, "u", "h")
    assert not holds_parquet(spark, f"{out}/turns")
