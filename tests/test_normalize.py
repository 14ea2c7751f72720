"""Miniature corpora of real failure shapes, normalized together in one run.

Every scenario uses its own prefix for session, message and record ids, so one pass over
the merged corpus answers for all of them.
"""

import base64
import struct

import pytest
from corpus import Corpus, T0, collect_grains, copied, ms, plain, prices, reply, usage

from ledgerline.operators import quality
from ledgerline.plans.normalize import normalize

DAY = "2026-07-01T"


def at(clock):
    return f"{DAY}{clock}.000Z"


def png(width, height):
    head = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", width, height)
    return base64.b64encode(head + b"\x00" * 9).decode()


def jpeg(width, height):
    app0 = b"\xff\xe0" + struct.pack(">H", 16) + b"\x00" * 14
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width, 3) + b"\x00" * 20
    return base64.b64encode(b"\xff\xd8" + app0 + frame).decode()


def image(kind, data):
    return {"type": "image", "source": {"type": "base64", "media_type": kind, "data": data}}


def call(id, name="Bash", **input):
    return {"type": "tool_use", "id": id, "name": name, "input": input}


def result(uuid, session, use, ts, outcome=None, is_error=False, **more):
    block = {"type": "tool_result", "tool_use_id": use, "content": "out", "is_error": is_error}
    record = plain("user", uuid, session, ts, message={"role": "user", "content": [block]}, **more)
    if outcome is not None:
        record["toolUseResult"] = outcome
    return record


def per_block():
    s = "blk-s"
    return Corpus().session(
        s,
        reply("blk-1", "blk-u1", s, block={"type": "thinking", "thinking": "abcd"}),
        reply("blk-1", "blk-u2", s, block={"type": "text", "text": "hello"}),
        reply("blk-1", "blk-u3", s, block=call("blk-t1")),
        result("blk-u4", s, "blk-t1", at("00:00:05"), {"success": True, "exitCode": 0, "durationMs": 12.6}),
    )


def placeholder_output():
    s = "ph-s"
    tokens = lambda out: {"input_tokens": 3, "output_tokens": out, "cache_read_input_tokens": 156614}
    return Corpus().add(
        f"{s}/subagents/agent-ph.jsonl",
        reply("ph-1", "ph-u1", s, block={"type": "thinking", "thinking": "x"}, tokens=tokens(5)),
        reply("ph-1", "ph-u2", s, block={"type": "text", "text": "y"}, tokens=tokens(5)),
        reply("ph-1", "ph-u3", s, block=call("ph-t1"), tokens=tokens(48469)),
    )


def sidechain_tie():
    return (
        Corpus()
        .session("tie-s1", reply("tie-1", "tie-u1", "tie-s1", origin="tie-s1"))
        .add(
            "tie-s0/subagents/agent-x.jsonl",
            reply("tie-1", "tie-u1", "tie-s0", origin="tie-s1", isSidechain=True),
        )
    )


def two_files():
    return (
        Corpus()
        .session("two-s1", reply("two-1", "two-u1", "two-s1", origin="two-s1", block=call("two-t1")))
        .session(
            "two-s2",
            reply("two-1", "two-u1", "two-s2", origin="two-s1", block=call("two-t1")),
            reply("two-2", "two-u2", "two-s2", origin="two-s2"),
        )
    )


def fallback():
    ledger = [
        {"type": "message", "model": "model-a", "input_tokens": 10, "output_tokens": 250},
        {"type": "fallback_message", "model": "model-b", "input_tokens": 10, "output_tokens": 5000},
    ]
    return Corpus().session(
        "fb-s",
        reply("fb-1", "fb-u1", "fb-s", model="model-b", tokens=usage(output=5000, iterations=ledger)),
        plain("system", "fb-u2", "fb-s", at("00:00:01"), originalModel="model-a", fallbackModel="model-b"),
    )


def pricing():
    s = "pr-s"
    return Corpus().session(
        s,
        reply("pr-5m", "pr-u1", s, tokens=usage(0, 0, c5=1000)),
        reply("pr-1h", "pr-u2", s, tokens=usage(0, 0, c1=1000)),
        reply("pr-old", "pr-u3", s, tokens={"output_tokens": 0, "cache_creation_input_tokens": 500}),
        reply("pr-syn", "pr-u4", s, model="<synthetic>"),
        reply("pr-var", "pr-u5", s, model="model-a[1m]"),
        reply("pr-unk", "pr-u6", s, model="nobody"),
        reply("pr-req", "pr-u7", s, req="r1"),
        reply("pr-req", "pr-u8", s, req="r2"),
    )


def malformed():
    s = "odd-s"
    return Corpus().session(
        s,
        {},
        {"type": "assistant"},
        {"type": "assistant", "message": None},
        {"type": "assistant", "message": {"id": "odd-9", "usage": "oops"}},
        {"type": "assistant", "message": {"id": "odd-8"}},
        {"type": "user", "toolUseResult": "plain words"},
        {"type": "user", "message": {"content": "words"}},
        {"type": "system", "compactMetadata": 42},
        {"type": "record-type-of-the-future", "wat": True},
        "[1, 2, 3]",
        "",
        "   ",
        "{broken",
        '{"type": "user", "type": "system"}',
    )


def active_time():
    s = "act-s"
    return Corpus().session(
        s,
        reply("act-1", "act-u1", s, ts=at("00:00:00")),
        reply("act-2", "act-u2", s, ts=at("00:01:00")),
        reply("act-3", "act-u3", s, ts=at("05:01:00")),
    )


def title(kind, value, session):
    key = {"ai-title": "aiTitle", "custom-title": "customTitle", "agent-name": "agentName"}[kind]
    return {"type": kind, key: value, "sessionId": session}


def names():
    c = Corpus()
    c.session(
        "nm-ren", reply("nm-1", "nm-u1", "nm-ren"),
        *[title("custom-title", v, "nm-ren") for v in ("alpha plan", "alpha plan", "beta plan")],
    )
    c.session(
        "nm-same", reply("nm-2", "nm-u2", "nm-same"),
        *[title("custom-title", "sketch", "nm-same")] * 2,
    )
    c.session(
        "nm-ai", reply("nm-3", "nm-u3", "nm-ai", slug="green-lamp"), title("ai-title", "Review", "nm-ai")
    )
    c.session(
        "nm-both", reply("nm-4", "nm-u4", "nm-both"),
        title("ai-title", "Review", "nm-both"), title("custom-title", "sketch", "nm-both"),
    )
    c.session("nm-agent", reply("nm-5", "nm-u5", "nm-agent"), title("agent-name", "publish", "nm-agent"))
    c.session("nm-slug", reply("nm-6", "nm-u6", "nm-slug", slug="quiet-hop"))
    c.session("nmabcdef12-3456-7890", reply("nm-7", "nm-u7", "nmabcdef12-3456-7890"))
    return c


def marked_fork():
    recs = [reply(f"mf-{i}", f"mf-u{i}", "mf-p", ts=at(f"00:{5 * i:02d}:00")) for i in range(3)]
    return (
        Corpus()
        .session("mf-p", *recs, created=at("00:00:00"))
        .session(
            "mf-c", *copied(recs[:2], "mf-c", True),
            reply("mf-9", "mf-u9", "mf-c", origin="mf-c", ts="2026-07-04T09:00:10.000Z"),
            created="2026-07-04T09:00:00.000Z",
        )
    )


def overlap_fork():
    head = plain("user", "ov-h", "ov-p", at("00:00:00"))
    dropped = plain("user", "ov-x", "ov-p", at("00:01:00"))
    kept = reply("ov-1", "ov-u1", "ov-p", ts=at("00:02:00"))
    return (
        Corpus()
        .session("ov-c", *copied([head, kept], "ov-c", False), reply("ov-3", "ov-u3", "ov-c", ts=at("01:00:00")))
        .session("ov-p", head, dropped, kept, reply("ov-2", "ov-u2", "ov-p", ts=at("00:03:00")))
    )


def symmetric(prefix, dated):
    p, c = f"{prefix}-p", f"{prefix}-c"
    shared = [
        plain("user", f"{prefix}-h", p, at("00:00:00")),
        reply(f"{prefix}-1", f"{prefix}-u1", p, ts=at("00:01:00")),
    ]
    return (
        Corpus()
        .session(
            p, *shared, reply(f"{prefix}-2", f"{prefix}-u2", p, ts=at("00:09:00")),
            created=at("00:00:00") if dated else None,
        )
        .session(
            c, *copied(shared, c, False), reply(f"{prefix}-3", f"{prefix}-u3", c, ts=at("00:06:00")),
            created=at("00:05:00") if dated else None,
        )
    )


def three_deep(prefix, marked):
    gp, mid, kid = f"{prefix}-gp", f"{prefix}-mid", f"{prefix}-kid"
    own = {"origin": gp} if marked else {}
    base = [
        plain("user", f"{prefix}-h", gp, at("00:00:00"), **own),
        reply(f"{prefix}-1", f"{prefix}-u1", gp, ts=at("00:01:00"), **own),
    ]
    extra = plain("system", f"{prefix}-s1", mid, at("01:00:05"))
    kept = copied(base, kid, marked) + copied([extra], kid, False)
    return (
        Corpus()
        .session(gp, *base, created=at("00:00:00"))
        .session(mid, *copied(base, mid, marked), extra, created=at("01:00:00"))
        .session(
            kid, *kept,
            reply(f"{prefix}-2", f"{prefix}-u2", kid, ts=at("02:00:10"), **({"origin": kid} if marked else {})),
            created=at("02:00:00"),
        )
    )


def continuation():
    return (
        Corpus()
        .session(
            "co-p",
            reply("co-1", "co-u1", "co-p", origin="co-p", ts=at("00:00:00")),
            reply("co-2", "co-u2", "co-p", origin="co-p", ts=at("01:00:00")),
            created=at("00:00:00"),
        )
        .session("co-c", reply("co-3", "co-u3", "co-c", origin="co-p", ts=at("01:06:00")), created=at("01:06:00"))
        .session("co-lost", reply("co-4", "co-u4", "co-lost", origin="co-gone", ts=at("01:08:00")))
    )


def empty_fork():
    recs = [reply("em-1", "em-u1", "em-p", origin="em-p")]
    return (
        Corpus()
        .session("em-p", *recs, created=at("00:00:00"))
        .session("em-c", *copied(recs, "em-c", True), created=at("02:00:00"))
        .session("em-void")
    )


def compacted():
    first = reply("cp-1", "cp-u1", "cp-p", origin="cp-p", ts=at("00:01:00"))
    mark = plain(
        "system", "cp-sys", "cp-p", at("00:02:00"), origin="cp-p",
        compactMetadata={"trigger": "auto", "preTokens": 120000, "postTokens": 20000},
    )
    return (
        Corpus()
        .session("cp-p", first, mark, created=at("00:00:00"))
        .session("cp-c", *copied([first, mark], "cp-c", True), created=at("00:03:00"))
    )


def agents():
    s = "ag-s1"
    agent = dict(isSidechain=True, agentId="ascout-7", attributionAgent="Explore")
    return (
        Corpus()
        .session(s, reply("ag-0", "ag-u0", s), created=at("00:00:00"))
        .add(
            f"{s}/subagents/agent-ascout-7.jsonl",
            {
                "type": "fork-context-ref", "agentId": "ascout-7", "parentSessionId": s,
                "parentLastUuid": "ag-u0", "contextLength": 191,
            },
            *[
                reply(f"ag-a{i}", f"ag-au{i}", s, ts=at(clock), **agent)
                for i, clock in enumerate(("00:01:00", "00:02:00", "00:04:00"))
            ],
        )
        .add(
            f"{s}/subagents/workflows/wf_77/agent-a1.jsonl",
            reply("ag-w1", "ag-wu1", s, isSidechain=True, agentId="a1"),
        )
    )


def pictures():
    s = "im-s"
    shot, photo = png(2000, 966), jpeg(640, 480)
    nested = {"type": "tool_result", "tool_use_id": "im-t", "content": [image("image/png", shot)]}
    return Corpus().session(
        s,
        plain("user", "im-u1", s, T0, message={"content": [image("image/jpeg", photo)]}),
        plain(
            "user", "im-u2", s, T0, message={"content": [nested]}, toolUseResult=[image("image/png", shot)]
        ),
        plain("user", "im-u3", s, T0, message={"content": [image("image/webp", "AAAA"), image("image/gif", "")]}),
    )


def tools():
    s = "to-s"
    return Corpus().session(
        s,
        reply("to-1", "to-u1", s, block=call("to-ok", "mcp__maps__find")),
        reply("to-2", "to-u2", s, block=call("to-bad")),
        reply("to-3", "to-u3", s, block=call("to-err")),
        reply("to-4", "to-u4", s, block=call("to-none")),
        result("to-u5", s, "to-ok", T0, {"success": True}),
        result("to-u6", s, "to-bad", T0, {"stderr": "x" * 300, "exitCode": 2, "interrupted": True}),
        result("to-u7", s, "to-err", T0, "text only", is_error=True),
    )


SCENARIOS = [
    per_block(), placeholder_output(), sidechain_tie(), two_files(), fallback(), pricing(), malformed(),
    active_time(), names(), marked_fork(), overlap_fork(), symmetric("sym", True), symmetric("und", False),
    three_deep("nr", True), three_deep("an", False), continuation(), empty_fork(), compacted(), agents(),
    pictures(), tools(),
]


@pytest.fixture(scope="module")
def result_set(spark):
    whole = Corpus()
    for c in SCENARIOS:
        whole.merge(c)
    lines, files = whole.frames(spark)
    return normalize(lines, files, prices(spark), host_id="h1")


@pytest.fixture(scope="module")
def grains(result_set):
    return collect_grains(result_set)


@pytest.fixture(scope="module")
def stats(result_set):
    return result_set.stats.collect()[0].asDict()


def only(rows, **match):
    found = [r for r in rows if all(r[k] == v for k, v in match.items())]
    assert len(found) == 1, (match, len(found))
    return found[0]


def turn(grains, id, **more):
    return only(grains["turns"], messageId=id, **more)


def session(grains, id):
    return only(grains["sessions"], sessionId=id)


def edge(grains, child):
    return only(grains["forkEdges"], childSessionId=child)


def test_one_response_in_three_records(grains):
    t = turn(grains, "blk-1")
    assert (t["outputTokens"], t["nBlocks"], t["nThinkingChars"], t["nToolUses"]) == (100, 3, 4, 1)
    c = only(grains["toolCalls"], messageId="blk-1")
    assert (c["toolName"], c["ok"], c["exitCode"], c["durationMs"]) == ("Bash", True, 0, 13)
    assert (t["hostId"], t["project"], t["context"]) == ("h1", "proj", "main")


def test_placeholder_output_loses(grains, stats):
    t = turn(grains, "ph-1")
    assert (t["outputTokens"], t["cacheReadTokens"], t["nBlocks"]) == (48469, 156614, 3)
    assert t["context"] == "subagent"
    assert stats["groupsWithVaryingOutput"] == 1


def test_tie_prefers_the_main_copy(grains):
    assert turn(grains, "tie-1")["sessionId"] == "tie-s1"


def test_turn_in_two_files_counts_once(grains):
    assert turn(grains, "two-1")["sessionId"] == "two-s1"
    assert turn(grains, "two-1")["nToolUses"] == 1
    only(grains["toolCalls"], toolUseId="two-t1")
    assert session(grains, "two-s1")["nTurnsNative"] == 1
    assert session(grains, "two-s2")["nTurnsNative"] == 1
    assert session(grains, "two-s2")["nTurnsInherited"] == 1


def test_fallback_prices_the_discarded_attempt(grains):
    t = turn(grains, "fb-1")
    assert (t["outputTokens"], t["hadFallback"], t["wastedOutputTokens"]) == (5250, True, 250)
    assert t["costOutput"] == pytest.approx(250 * 10e-6 + 5000 * 50e-6)
    event = only(grains["events"], sessionId="fb-s")
    assert event["kind"] == "fallback" and '"to":"model-b"' in event["payload"]


def test_prices(grains, stats):
    assert turn(grains, "pr-5m")["costCacheCreate"] == pytest.approx(0.002)
    assert turn(grains, "pr-1h")["costCacheCreate"] == pytest.approx(0.0032)
    old = turn(grains, "pr-old")
    assert old["cacheCreate5m"] == 500 and old["costCacheCreate"] == pytest.approx(0.001)
    for id in ("pr-syn", "pr-unk"):
        t = turn(grains, id)
        assert t["unpriced"] and t["costTotal"] == 0
    variant = turn(grains, "pr-var")
    assert (variant["model"], variant["modelVariant"], variant["unpriced"]) == ("model-a", "1m", False)
    turn(grains, "pr-req", requestId="r1")
    turn(grains, "pr-req", requestId="r2")
    assert {t["pricingVersion"] for t in grains["turns"]} == {"test"}


def test_malformed_records_survive(grains, stats):
    t = turn(grains, "odd-9")
    assert t["outputTokens"] == 0 and t["ts"] is None and t["unpriced"]
    assert turn(grains, "odd-8")["nBlocks"] == 0
    assert stats["parseErrors"] == 1
    assert stats["turnsWithoutTimestamp"] == 2
    assert session(grains, "odd-s")["firstTs"] is None


def test_span_and_active_time(grains):
    s = session(grains, "act-s")
    assert (s["spanSeconds"], s["activeSeconds"]) == (18060, 60)
    assert s["dutyCycle"] < 0.01


def test_names(grains):
    s = session(grains, "nm-ren")
    assert (s["name"], s["nameFirst"], s["nameChanged"]) == ("beta plan", "alpha plan", True)
    assert s["customTitleFirst"] == "alpha plan"
    s = session(grains, "nm-same")
    assert (s["name"], s["nameChanged"], s["customTitleFirst"]) == ("sketch", False, None)
    assert session(grains, "nm-ai")["name"] == "Review"
    s = session(grains, "nm-both")
    assert (s["name"], s["nameKind"], s["aiTitle"]) == ("sketch", "explicit", "Review")
    s = session(grains, "nm-agent")
    assert (s["name"], s["nameKind"]) == ("publish", "explicit")
    s = session(grains, "nm-slug")
    assert (s["name"], s["nameKind"], s["slug"]) == ("quiet-hop", "slug", "quiet-hop")
    s = session(grains, "nmabcdef12-3456-7890")
    assert (s["name"], s["nameKind"], s["nameChanged"]) == ("nmabcdef", "id", False)


def test_marked_fork(grains):
    e = edge(grains, "mf-c")
    assert (e["parentSessionId"], e["kind"], e["source"], e["ambiguous"]) == ("mf-p", "copy", "marker", False)
    assert (e["nRecordsInherited"], e["nTurnsInherited"]) == (2, 2)
    assert e["forkPointTs"] == ms(at("00:05:00"))
    assert e["childFirstNativeTs"] == ms("2026-07-04T09:00:10.000Z")
    assert e["lagSeconds"] == 3 * 86400 + 9 * 3600 + 10 - 5 * 60
    assert session(grains, "mf-p")["nTurnsNative"] == 3
    c = session(grains, "mf-c")
    assert (c["nTurnsNative"], c["depth"], c["lineageId"]) == (1, 1, "mf-p")
    family = only(grains["lineages"], lineageId="mf-p")
    assert (family["nSessions"], family["nForks"], family["sessionIds"]) == (2, 1, "mf-p,mf-c")


def test_fork_found_by_overlap(grains):
    e = edge(grains, "ov-c")
    assert (e["parentSessionId"], e["source"], e["ambiguous"], e["kind"]) == ("ov-p", "uuid-overlap", False, "copy")
    assert session(grains, "ov-p")["nTurnsNative"] == 2
    c = session(grains, "ov-c")
    assert (c["nTurnsNative"], c["nTurnsInherited"]) == (1, 1)
    assert c["firstNativeTs"] == ms(at("01:00:00"))
    assert turn(grains, "ov-1")["fileSessionId"] == "ov-c"
    assert turn(grains, "ov-1")["sessionId"] == "ov-p"


def test_symmetric_prefix(grains, result_set):
    e = edge(grains, "sym-c")
    assert (e["parentSessionId"], e["ambiguous"]) == ("sym-p", True)
    assert not [r for r in grains["forkEdges"] if r["childSessionId"].startswith("und-")]
    assert session(grains, "und-c")["parentSessionId"] is None
    open_cases = [r["session"] for r in result_set.unresolved.collect()]
    assert "und-c" in open_cases and "und-p" in open_cases and "sym-c" not in open_cases


def test_content_names_the_nearer_parent(grains):
    assert edge(grains, "nr-mid")["parentSessionId"] == "nr-gp"
    assert edge(grains, "nr-kid")["parentSessionId"] == "nr-mid"
    assert session(grains, "nr-kid")["depth"] == 2
    assert session(grains, "nr-kid")["lineageId"] == "nr-gp"


def test_anchor_skips_a_session_without_turns(grains):
    mid, kid = edge(grains, "an-mid"), edge(grains, "an-kid")
    assert (mid["parentHasTurns"], mid["childHasTurns"]) == (True, False)
    assert (kid["parentSessionId"], kid["parentHasTurns"]) == ("an-mid", False)
    assert kid["billedAncestorSessionId"] == "an-gp"
    assert kid["billedAncestorForkPointTs"] == ms(at("00:01:00"))
    assert mid["billedAncestorSessionId"] == "an-gp"
    assert mid["billedAncestorForkPointTs"] == mid["forkPointTs"]


def test_continuation(grains):
    e = edge(grains, "co-c")
    assert (e["parentSessionId"], e["kind"], e["nRecordsInherited"], e["nTurnsInherited"]) == (
        "co-p", "continuation", 0, 0,
    )
    assert e["forkPointTs"] == ms(at("01:00:00"))
    assert session(grains, "co-c")["nTurnsNative"] == 1
    assert session(grains, "co-p")["nTurnsNative"] == 2
    lost = edge(grains, "co-lost")
    assert (lost["parentMissing"], lost["forkPointTs"], lost["lineageId"]) == (True, None, "co-gone")


def test_fork_without_turns_has_a_row(grains):
    c = session(grains, "em-c")
    assert (c["nTurnsNative"], c["nativeCost"], c["createdTs"]) == (0, 0, ms(at("02:00:00")))
    assert c["firstTs"] is None and c["dutyCycle"] is None
    assert session(grains, "em-void")["nTurnsNative"] == 0


def test_compaction_counts_once(grains):
    events = [e for e in grains["events"] if e["sessionId"].startswith("cp-")]
    assert [(e["kind"], e["sessionId"]) for e in events] == [("compaction", "cp-p")]
    assert session(grains, "cp-p")["nCompactions"] == 1
    assert session(grains, "cp-c")["nCompactions"] == 0
    assert session(grains, "cp-p")["peakContextTokens"] == 120000


def test_agent_runs(grains):
    a = only(grains["agentRuns"], agentId="ascout-7")
    assert (a["agentType"], a["parentSessionId"], a["context"]) == ("Explore", "ag-s1", "subagent")
    assert (a["nTurns"], a["spanSeconds"]) == (3, 180)
    assert (a["inheritedContextLength"], a["parentLastUuid"]) == (191, "ag-u0")
    assert a["cost"] == pytest.approx(3 * (10 * 1e-6 + 100 * 10e-6))
    w = only(grains["agentRuns"], agentId="a1")
    assert (w["workflowId"], w["context"]) == ("wf_77", "workflow-agent")
    assert turn(grains, "ag-w1")["workflowId"] == "wf_77"
    assert session(grains, "ag-s1")["nAgentRuns"] == 2
    assert session(grains, "ag-s1")["nSubagentTurns"] == 4


def test_images(grains):
    rows = [r for r in grains["images"] if r["sessionId"] == "im-s"]
    assert sorted((r["carrier"], r["width"], r["height"], r["estTokens"]) for r in rows if r["width"]) == [
        ("content", 640, 480, 410), ("toolUseResult", 2000, 966, 2576), ("tool_result", 2000, 966, 2576),
    ]
    assert len({r["hash"] for r in rows}) == 3 and len(rows) == 4


def test_tool_outcomes(grains):
    by = {r["toolUseId"]: r for r in grains["toolCalls"] if r["sessionId"] == "to-s"}
    assert (by["to-ok"]["ok"], by["to-ok"]["isMcp"], by["to-ok"]["mcpServer"]) == (True, True, "maps")
    bad = by["to-bad"]
    assert (bad["ok"], bad["interrupted"], bad["exitCode"], len(bad["errorKind"])) == (False, True, 2, 200)
    assert by["to-err"]["ok"] is False
    assert by["to-none"]["ok"] is None and by["to-none"]["isMcp"] is False


def test_statistics(grains, stats):
    assert stats["files"] == sum(len(c.files) for c in SCENARIOS)
    assert stats["dedupedTurns"] == len(grains["turns"])
    assert stats["forkEdges"] == len(grains["forkEdges"]) == 12
    assert stats["forkEdgesAmbiguous"] == 1 + sum(
        e["ambiguous"] for e in grains["forkEdges"] if e["childSessionId"] != "sym-c"
    )
    assert stats["maxForkDepth"] == 2
    assert stats["dedupedOutputTokens"] <= stats["naiveOutputTokens"]
    assert stats["reattributedTurns"] >= 1
    assert stats["unresolvedForks"] >= 2
    assert stats["agentRuns"] == len(grains["agentRuns"])


def test_invariants_hold(result_set):
    assert [r["problem"] for r in quality.problems(result_set).collect()] == []


def test_broken_lineage_is_named(spark, result_set):
    from dataclasses import replace

    from pyspark.sql import functions as F

    sessions = result_set["sessions"].where("sessionId = 'act-s'")
    sessions = sessions.withColumns(
        {"parentSessionId": F.lit("ghost"), "depth": F.lit(1).cast("long"), "lineageId": F.lit("ghost")}
    )
    broken = replace(
        result_set,
        grains={**result_set.grains, "sessions": sessions, "forkEdges": result_set["forkEdges"].where("false")},
    )
    found = " ".join(r["problem"] for r in quality.problems(broken).collect())
    assert "ghost" in found
    with pytest.raises(quality.InvariantError, match="ghost"):
        quality.require_sound(broken)
