"""Operators on small inputs, most of them against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import fields as R
from ledgerline.functions import formats
from ledgerline.functions import images as I
from ledgerline.functions import variant as V
from ledgerline.operators import billing, detail, intervals, ordered, replay, spend, timeline
from ledgerline.operators.crossfilter import CrossFilter, box, brush_bounds, members, time_range

COSTS = ["costCacheRead", "costCacheCreate", "costOutput", "costInput"]


def turn_frame(spark, rows):
    """Rows of (session, ts, cost, context, tokens)."""
    df = spark.createDataFrame(rows, "sessionId string, ts long, costTotal double, context string, contextTokens long")
    return df.withColumns({"costOutput": F.col("costTotal"), **{c: F.lit(0.0) for c in COSTS if c != "costOutput"}})


def many(n, cost=1.0, session="s"):
    return [(session, i * 1000, cost, "main", 0) for i in range(n)]


def buckets(spark, rows, bars):
    return sorted(
        (r.asDict() for r in detail.bucket_turns(turn_frame(spark, rows), bars, slice_ms=700).collect()),
        key=lambda r: r["from"],
    )


def test_short_session_keeps_one_bar_per_turn(spark):
    b = buckets(spark, many(10), 180)
    assert [x["from"] for x in b] == list(range(10)) and all(x["turns"] == 1 for x in b)


def test_long_session_is_grouped(spark):
    b = buckets(spark, many(2183), 180)
    assert len(b) <= 180 and b[0]["turns"] == 13 and b[-1]["to"] == 2182
    assert sum(x["turns"] for x in b) == 2183
    assert all(b[i]["from"] == b[i - 1]["to"] + 1 for i in range(1, len(b)))


def test_bars_sum_costs(spark):
    rows = [("s", 0, 0.1, "main", 0)] * 11 + [("s", 1, 12.66, "main", 0)]
    (b,) = buckets(spark, rows, 1)
    assert b["costTotal"] == pytest.approx(13.76) and b["maxTurnCost"] == 12.66
    (b,) = buckets(spark, many(5), 1)
    assert (b["t0"], b["t1"]) == (0, 4000)
    assert buckets(spark, [], 10) == []


def test_stack_drops_zero_layers(spark):
    rows = spark.createDataFrame(
        [("s", 0, 0, 0.4, 0.0, 0.1, 0.0), ("s", 1, 1, 0.0, 0.0, 0.0, 0.0)],
        "sessionId string, from long, to long, costCacheRead double, costCacheCreate double, costOutput double, costInput double",
    )
    got = detail.cost_stack(rows).orderBy("from", "layer").collect()
    assert [(r["from"], r["klass"]) for r in got] == [(0, "cache read"), (0, "output")]


def marks(spark, turns, at, **kw):
    rows = spark.createDataFrame([("s", t) for t in turns], "sessionId string, ts long")
    found = spark.createDataFrame([("s", t, t * 10) for t in at], "sessionId string, ts long, preTokens long")
    return [
        (r["ts"], r["i"]) for r in detail.compaction_marks(rows, found, slice_ms=120, **kw).orderBy("ts").collect()
    ]


def test_compactions_are_placed(spark):
    assert marks(spark, [100, 200, 300], [50, 250, 300, 9999]) == [(50, -1), (250, 1), (300, 2), (9999, 2)]
    assert marks(spark, [], [100]) == [(100, -1)]
    assert marks(spark, [100], [50, 150], drop_before_start=True) == [(150, 0)]


def test_idle_gaps(spark):
    def gaps(times, threshold):
        df = spark.createDataFrame([("s", t) for t in times], "sessionId string, ts long")
        return [(r["i"], r["ms"]) for r in ordered.idle_gaps(df, ["sessionId"], "ts", threshold, slice_ms=5_000).collect()]

    assert gaps([0, 1000, 100_000], 10_000) == [(1, 99_000)]
    assert gaps([0, 500_000], 500_000) == [(0, 500_000)]
    assert gaps([0], 1) == []


def test_growth(spark):
    rows = [("a", i, 1.0, "main", 0) for i in range(5)] + [("a", 5 + i, 3.0, "main", 0) for i in range(5)]
    rows += [("b", 1, 1.0, "main", 500_000), ("b", 2, 99.0, "subagent", 9_000_000), ("b", 3, 1.0, "main", 600_000)]
    rows += [("c", 1, 5.0, "subagent", 7)]
    got = {r["sessionId"]: r.asDict() for r in detail.growth(turn_frame(spark, rows), slice_ms=2).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["turns"], a["cost"], a["firstFifthMean"], a["lastFifthMean"], a["growthRatio"]) == (10, 20, 1, 3, 3)
    assert (b["subagentTurns"], b["peakContextTokens"], b["cost"]) == (1, 600_000, 101)
    assert (b["firstFifthMean"], b["lastFifthMean"]) == (1, 1)
    assert (c["firstFifthMean"], c["lastFifthMean"], c["peakContextTokens"], c["cost"], c["growthRatio"]) == (0, 0, 0, 5, None)


@pytest.mark.parametrize("width", [1, 37, 600_000])
def test_slices_never_change_results(spark, width):
    rng = random.Random(5)
    times = {s: sorted(rng.randrange(2_000) for _ in range(n)) for s, n in (("hot", 300), ("b", 7), ("c", 1))}
    rows = [(s, t, i) for s, ts in times.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "s string, ms long, k long")
    seq = ordered.with_sequence(df, ["s"], "ms", ["k"], "i", "n", "prev", width).collect()
    for r in seq:
        ts = times[r["s"]]
        assert r["i"] == r["k"] and r["n"] == len(ts)
        assert r["prev"] == (ts[r["k"] - 1] if r["k"] else None)
    used = {r["s"]: r for r in ordered.gap_usage(df, ["s"], "ms", 9, {"k": "k"}, {"top": "k"}, width).collect()}
    for s, ts in times.items():
        gaps = [b - a for a, b in zip(ts, ts[1:])]
        assert used[s]["activeMs"] == sum(g for g in gaps if 0 < g < 9)
        assert (used[s]["firstMs"], used[s]["lastMs"], used[s]["nTurns"]) == (ts[0], ts[-1], len(ts))
        assert (used[s]["k"], used[s]["top"]) == (sum(range(len(ts))), len(ts) - 1)


def test_a_burst_is_cut_into_pieces(spark):
    """A third of all rows at one millisecond, and a third without a time, spread over many pieces
    with the same results."""
    rng = random.Random(6)
    rows = [("a", 5_000, f"k{rng.random()}", rng.randrange(9)) for _ in range(900)]
    rows += [("a", None, f"k{rng.random()}", rng.randrange(9)) for _ in range(900)]
    rows += [(rng.choice("ab"), rng.randrange(20_000), f"k{rng.random()}", rng.randrange(9)) for _ in range(900)]
    df = spark.createDataFrame(rows, "s string, ms long, k string, v long")
    pieces = ordered.cut_in_slices(df, ["s"], "ms", ["ms", "k"], 600_000, 40)
    sizes = [r["count"] for r in pieces.where("ms IS NULL OR ms = 5000").groupBy("_slice").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 500
    one = dict(slice_ms=600_000, piece_rows=1 << 40)
    many = dict(slice_ms=600_000, piece_rows=40)

    def both(f):
        assert sorted(map(str, f(**one).collect())) == sorted(map(str, f(**many).collect()))

    both(lambda **w: ordered.with_sequence(df, ["s"], "ms", ["k"], "i", "n", "prev", **w))
    both(lambda **w: ordered.gap_usage(df, ["s"], "ms", 9, {"v": "v"}, {"top": "v"}, **w))
    both(lambda **w: ordered.idle_gaps(df, ["s"], "ms", 30, ["k"], **w))
    both(lambda **w: ordered.running_max(df, ["s"], "ms", ["ms", "k"], F.col("v"), "top", **w))
    marks = df.where("v = 3").select("s", "ms", F.col("k").alias("mark"))
    both(lambda **w: ordered.place_marks(df, marks, ["s"], "ms", **w))


def test_rows_without_a_time_are_kept_last(spark):
    df = spark.createDataFrame([("s", 5), ("s", None), ("s", 900), ("s", None)], "s string, ms long")
    seq = ordered.with_sequence(df, ["s"], "ms", (), "i", "n", "prev", 10).orderBy("i").collect()
    assert [(r["i"], r["ms"], r["n"]) for r in seq] == [(0, 5, 4), (1, 900, 4), (2, None, 4), (3, None, 4)]
    (used,) = ordered.gap_usage(df, ["s"], "ms", 1_000, slice_ms=10).collect()
    assert (used["firstMs"], used["lastMs"], used["nTurns"], used["activeMs"]) == (5, 900, 4, 895)


def first_fit(spans, gap):
    free, lanes = [], {}
    for id, t0, t1 in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        i = 0
        while i < len(free) and free[i] + gap > t0:
            i += 1
        free[i : i + 1] = [t1]
        lanes[id] = i
    return lanes


def merged(spans, gap):
    out = []
    for _, t0, t1 in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if out and t0 - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], t1)
        else:
            out.append([t0, t1])
    return [tuple(b) for b in out]


@pytest.mark.parametrize("gap,width", [(0, 50), (4, 13), (0, 600_000)])
def test_intervals_match_plain_loops(spark, gap, width):
    rng = random.Random(gap + width)
    groups = {}
    for g, n, reach in (("dense", 120, 60), ("sparse", 60, 5), ("one", 1, 9)):
        starts = [rng.randrange(1_000) for _ in range(n)]
        groups[g] = [(f"{g}{i:03d}", t, t + rng.randrange(1, reach)) for i, t in enumerate(starts)]
    rows = [(g, *s) for g, spans in groups.items() for s in spans]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "project string, id string, t0 long, t1 long")

    lanes = {r["id"]: r["lane"] for r in intervals.pack_lanes(df, gap_ms=gap, slice_ms=width).collect()}
    peak = {r["project"]: r["laneCount"] for r in intervals.peak_concurrency(df, gap_ms=gap, slice_ms=width).collect()}
    bands: dict = {}
    for r in intervals.activity_bands(df, gap_ms=gap, slice_ms=width).collect():
        bands.setdefault(r["project"], []).append((r["t0"], r["t1"]))
    for g, spans in groups.items():
        want = first_fit(spans, gap)
        assert {id: lanes[id] for id in want} == want
        assert peak[g] == max(want.values()) + 1
        assert sorted(bands[g]) == merged(spans, gap)


def test_coincident_points_conflict(spark):
    df = spark.createDataFrame([("p", "a", 5, 5), ("p", "b", 5, 5)], "project string, id string, t0 long, t1 long")
    assert intervals.peak_concurrency(intervals.with_extent(df)).collect()[0]["laneCount"] == 2
    abutting = spark.createDataFrame([("p", "a", 0, 5), ("p", "b", 5, 9)], "project string, id string, t0 long, t1 long")
    assert {r["lane"] for r in intervals.pack_lanes(abutting).collect()} == {0}


def block(seq, kind, id=None, ts=None, ok=None, code=None, agent=None):
    return ("s", seq, ts if ts is not None else seq, kind, id, f"t{seq}", False, 2, ok, None, code, None, agent, "main")


def replay_frame(spark, rows):
    return spark.createDataFrame(
        rows,
        "sessionId string, seq long, ts long, kind string, toolUseId string, text string, truncated boolean, "
        "fullChars int, ok boolean, errorKind string, exitCode long, durationMs long, agentId string, context string",
    )


def test_fold(spark):
    rows = [
        block(0, "prompt"), block(1, "tool_use", "a"), block(2, "tool_use", "b"), block(3, "tool_result", "b", ok=False),
        block(4, "tool_result", "a", code=0), block(5, "tool_result", "a", code=3), block(6, "tool_result", "gone", ok=False),
        block(7, "tool_result", "gone"), block(8, "tool_result", ok=False), block(9, "tool_use", "never"), block(10, "tool_use"),
    ]
    got = {r["seq"]: r for r in replay.fold(replay_frame(spark, rows)).collect()}
    assert set(got) == {0, 1, 2, 6, 7, 8, 9, 10}
    assert got[1]["result"]["exitCode"] == 3 and got[1]["failed"]
    assert got[2]["result"]["text"] == "t3" and got[2]["failed"]
    assert [got[i]["failed"] for i in (0, 6, 7, 8, 9, 10)] == [False, True, False, True, False, False]
    assert all(got[i]["result"] is None for i in (0, 6, 7, 8, 9, 10))
    hours = replay.hour_buckets(replay.fold(replay_frame(spark, [block(1, "prompt", ts=0), block(2, "tool_use", "a", ts=3_600_001)])))
    assert [(r["hour"], r["blocks"], r["prompts"], r["toolCalls"]) for r in hours.collect()] == [(3_600_000, 1, 0, 1)]
    tracks = replay.tracks_in_order(
        replay.agent_tracks(replay_frame(spark, [block(0, "x", agent="b"), block(1, "x"), block(2, "x", agent="a"), block(3, "x", agent="a")]))
    )
    assert [(r["agentId"], r["blocks"]) for r in tracks.collect()] == [(None, 1), ("a", 2), ("b", 1)]
    late = replay.in_reading_order(replay_frame(spark, [block(0, "x", ts=9), block(2, "y", ts=1), block(1, "z", ts=1)]))
    assert [r["seq"] for r in late.collect()] == [1, 2, 0]


def test_crossfilter(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (timestamp_millis(1000), 'a', 1.0), (timestamp_millis(2000), 'b', 5.0), "
        "(timestamp_millis(3000), 'c', 9.0) AS t(ts, project, costTotal)"
    )

    def kept(predicate):
        return sorted(r["project"] for r in df.where(predicate).collect())

    f = CrossFilter()
    assert not f.active and kept(f.predicate()) == ["a", "b", "c"]
    f.brush_time((2000, 1000))
    assert f.active and kept(f.predicate()) == ["a", "b"]
    assert kept(f.predicate(exclude="timeline")) == ["a", "b", "c"]
    f.toggle_project("a", "abc")
    assert kept(f.predicate()) == ["b"] and kept(f.predicate(exclude="timeline")) == ["b", "c"]
    f.toggle_project("a", "abc")
    assert f.visible is None and kept(f.predicate()) == ["a", "b"]
    f.publish("scatter", box((0, 9000), (4, 6)), skip_self=False)
    assert kept(f.predicate(exclude="scatter")) == ["b"]
    f.clear()
    assert not f.active and f.brush is None
    assert members(None) is None and time_range(None) is None and box(None, (1, 2)) is None
    assert brush_bounds("2026-07-02T00:00:00Z", 0) == (0, 1782950400000)
    assert brush_bounds("", 5) is None and brush_bounds("nonsense", 5) is None


def test_filter_reaches_the_parquet_reader(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT timestamp_millis(id) AS ts, 'p' AS project, 1.0D AS costTotal, id AS other FROM range(100)").write.parquet(path)
    turns = spark.read.parquet(path)
    plan = spend.daily_spend(turns, time_range((5, 9)))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "other" not in plan.split("ReadSchema:")[-1]


def test_price_resolution(spark):
    entries = spark.createDataFrame(
        [(k, float(i), 0.0, 1.0, None, 0.0) for i, k in enumerate(["m[1m]", "m-1m", "m", "us.anthropic.n", "anthropic/n", "<synthetic>"])],
        "key string, input double, output double, cacheCreate5m double, cacheCreate1h double, cacheRead double",
    )
    models = spark.createDataFrame([(m,) for m in ["m[1m]", "m[2m]", "m", "n[1m]", "<synthetic>", "zzz", None, ""]], "model string")
    hits = {r["model"]: r["pricedAs"] for r in billing.resolve_models(models, entries).collect()}
    assert hits == {"m[1m]": "m[1m]", "m[2m]": "m", "m": "m", "n[1m]": "anthropic/n"}


def test_strict_variant_access(spark):
    v = F.col("v")
    row = (
        spark.sql("""SELECT parse_json('{"n":12,"s":"12","b":true,"bs":"true","o":{},"a":[1],"z":null,"d":1.5}') AS v""")
        .select(
            V.text(v, "$.n").alias("text_of_number"), V.number(v, "$.s").alias("number_of_text"),
            V.flag(v, "$.bs").alias("flag_of_text"), V.is_true(v, "$.b").alias("flag"),
            V.count(v, "$.d").alias("rounded"), V.count(v, "$.s").alias("zero"), V.is_object(v, "$.o").alias("obj"),
            V.is_object(v, "$.a").alias("arr_is_obj"), V.is_array(v, "$.a").alias("arr"), V.is_array(v, "$.s").alias("text_is_arr"),
            F.size(V.items(v, "$.o")).alias("none"), V.text(v, "$.z").alias("null_text"), V.text(v, "$.s.x.y").alias("deep"),
        )
        .collect()[0]
    )
    assert tuple(row) == (None, None, None, True, 2, 0, True, False, True, False, 0, None, None)


def test_names_and_labels(spark):
    ids = ["anight-owl-00112233445566aa", "amake-it-so-ffeeddccbbaa9988", "a00ff11ee22dd33cc", None]
    df = spark.createDataFrame(list(zip(ids, [None, "fork", None, None])), "id string, type string")
    got = df.select(R.agent_name(F.col("id")), R.agent_name_kind(F.col("id"), F.col("type"))).collect()
    assert [tuple(r) for r in got] == [("night-owl", "named"), ("make-it-so", "fork"), (None, "anonymous"), (None, "anonymous")]
    places = [("x", "/u/src/kite/.claude/worktrees/a-1"), ("x", "/u/src/lamp"), ("-u-src-lamp", None), ("-", None)]
    labels = spark.createDataFrame(places, "slug string, cwd string").select(R.project_label(F.col("slug"), F.col("cwd")))
    assert [r[0] for r in labels.collect()] == ["kite", "lamp", "lamp", "-"]


def test_formats(spark):
    df = spark.createDataFrame([(0.1234, 29_000), (1.5, 3_600_000), (99.999, 90_000_000), (100.4, 90_000)], "c double, ms long")
    got = df.select(formats.usd(F.col("c")), formats.duration(F.col("ms")), formats.cost_tier(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("$0.123", "1m", 0), ("$1.50", "1.0h", 1), ("$100.00", "1.0d", 3), ("$100", "2m", 3)]
    # The stored value decides (1.005 lies below its digits); exact ties go up.
    odd = spark.createDataFrame([(1.005,), (1.125,), (100.5,), (2.675,), (1234567.5,)], "c double")
    assert [r[0] for r in odd.select(formats.usd(F.col("c"))).collect()] == [
        "$1.00", "$1.13", "$101", "$2.67", "$1234568",
    ]
    assert spark.range(1).select(formats.pct(F.lit(1), F.lit(0))).collect()[0][0] == "—"


def test_image_headers(spark):
    assert I._frame_size(b"\x00\x01\x02") == (None, None)
    assert I._frame_size(b"\xff\xd8\xff") == (None, None)
    metadata = b"\xff\xe1\xff\xff" + bytes(0xFFFD)
    frame = b"\xff\xff\xc9\x00\x0b\x08" + (480).to_bytes(2, "big") + (640).to_bytes(2, "big") + bytes(4)
    assert I._frame_size(b"\xff\xd8" + 3 * metadata + frame) == (640, 480)
    assert I._frame_size(b"\xff\xd8" + b"\xff\xc4\x00\x04\x01\x02" + b"\xff\xda\x00\x02") == (None, None)
    assert spark.range(1).select(I.png_dims(F.lit(b"\x01\x02\x03"))).collect()[0][0] is None


def test_ghosts_and_edges(spark):
    spans = spark.createDataFrame([("session", "r1"), ("session", "r2"), ("agent", "a1")], "kind string, id string")
    ghosts = spark.createDataFrame([("session", g) for g in ("g1", "g2", "g3")], "kind string, id string")
    edges = spark.createDataFrame(
        [("g1", "r1"), ("r2", "g2"), ("g3", "g1"), ("r2", "r1"), ("r1", "x")], "childId string, parentId string"
    )
    assert sorted(r["id"] for r in timeline.connected_ghosts(ghosts, spans, edges).collect()) == ["g1", "g2"]
    kept = timeline.drawable_edges(edges, spans).collect()
    assert [(r["childId"], r["parentId"]) for r in kept] == [("r2", "r1")]


def test_dedup_ignores_order(spark):
    rows = [("k", 5, True, "b"), ("k", 9, True, "c"), ("k", 9, False, "z"), ("k", 9, False, "y"), ("j", 1, True, "a")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "key string, out long, side boolean, walk string").repartition(3)
        got = billing.dedup_billed(df, ["key"], [-F.col("out"), F.col("side"), F.col("walk")], ["out", "walk"])
        assert sorted(tuple(r) for r in got.collect()) == [("j", 1, "a"), ("k", 9, "y")]
