"""Texts of a record laid out at once, and records parsed by enough tasks."""

import json

from pyspark.sql import functions as F

from ledgerline.functions import variant as V
from ledgerline.plans import mine_queries, text_queries
from ledgerline.session import settings


ODD = [
    "word", "", " ", "12", "-1.5", "1E3", "2.1.0", "12\n", "true", "false", "trueish", "[1]", "{}", "null", "\u00e9", "-",
    12, -1.5, 1e300, 12345678901234567890, True, False, None, [], ["a"], {}, {"a": "b"}, "2024-01-01T00:00:00.000Z",
]


def test_texts_laid_out_read_as_texts_looked_up(spark):
    paths = ["a", "b.c", "b.d.e", "none.such"]
    lines = [json.dumps({"a": x, "b": {"c": x, "d": {"e": x}}}) for x in ODD] + [json.dumps({"a": "x", "b": x}) for x in ODD]
    lines += ["{}", "[]", "12", "no json", '{"a": "first", "a": 2}', '{"a": 1, "a": "second"}']
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    rec = rows.select("i", F.try_parse_json("value").alias("rec"))
    v, said = F.col("rec"), V.told(F.col("_texts"))
    both = rec.withColumn("_texts", V.texts(v, paths)).select(
        "i", *[said(v, f"$.{p}").alias(f"new_{n}") for n, p in enumerate(paths)],
        *[V.text(v, f"$.{p}").alias(f"old_{n}") for n, p in enumerate(paths)],
    )
    got = both.collect()
    assert len(got) == len(lines)
    for row in got:
        for n in range(len(paths)):
            assert row[f"new_{n}"] == row[f"old_{n}"], lines[row["i"]]
    by = {r["i"]: r["new_0"] for r in got}
    assert [by[i] for i in range(len(ODD))] == [x if isinstance(x, str) else None for x in ODD]


def test_events_are_parsed_by_several_tasks_a_core(spark, tmp_path):
    rows = spark.range(4000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"),
        (F.col("id") % 500).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"),
        F.lit('{"k": 5}').alias("props"),
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    lines, _ = mine_queries.event_lines(spark, str(tmp_path))
    with settings(spark, mine_queries.parse_settings(spark)):
        assert lines.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert lines.count() == 4000


def test_text_is_not_joined_to_creation_times(spark, tmp_path, monkeypatch):
    seen = []
    whole = text_queries.normalize
    monkeypatch.setattr(text_queries, "normalize", lambda lines, *rest: seen.append(lines) or whole(lines, *rest))
    rows = spark.range(40).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"),
        (F.col("id") % 4).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"),
        F.lit('{"k": 5}').alias("props"),
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    done = text_queries.mined(spark, str(tmp_path))
    (lines,) = seen
    assert "Join" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert done["sessions"].where("createdTs IS NOT NULL").count() == done["sessions"].count()
