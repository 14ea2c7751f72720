"""Mining text without doing the same work twice."""

import base64
import json

from pyspark.sql import functions as F

from ledgerline.functions import images as I
from ledgerline.plans import text_queries


def _records(spark, *records):
    rows = spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
    return rows.select(F.parse_json("value").alias("rec"))


def _refs():
    blocks = F.try_variant_get("rec", "$.message.content", "array<variant>")
    return I.image_refs(F.col("rec"), F.coalesce(blocks, F.array().cast("array<variant>"))).alias("images")


def test_a_payload_is_read_once(spark):
    """Once for its type and once for its text, on each of the three carriers."""
    asked = _records(spark, {}).select(_refs())
    plan = asked._jdf.queryExecution().analyzed().toString()
    assert plan.count("$.source.data") == 2 * 3
    assert plan.count("xxhash64") == 3


def test_images_of_odd_payloads(spark):
    """Only text that is not empty is a payload; one that is no base64 has no size."""

    def block(data):
        return {"type": "image", "source": {"media_type": "image/jpeg", "data": data}}

    jpeg = bytes.fromhex("FFD8FFC2001108") + (30).to_bytes(2, "big") + (20).to_bytes(2, "big") + b"\x03" + b"\x00" * 16
    shown = base64.b64encode(jpeg).decode()
    content = [block(shown), block(""), block(7), block(None), block("***"), {"type": "image"}, {"type": "text", "text": "x"}]
    got = I.measured(_records(spark, {"message": {"content": content}}).select(_refs())).select(F.inline("images")).collect()
    assert [(r["carrier"], r["bytesBase64"], r["width"], r["height"]) for r in got] == [
        ("content", len(shown), 20, 30), ("content", 3, None, None),
    ]
    assert [r["hash"].rpartition("-")[2] for r in got] == [str(len(shown)), "3"]


def test_the_list_of_files_is_stored_by_few_tasks(spark, tmp_path, monkeypatch):
    """One small file a user: the list is read by several tables, so it is a stored table, of few files."""
    spark.range(400).select(
        (F.col("id") % 130).alias("user_id"), F.col("id").alias("event_id"),
        F.timestamp_millis(F.col("id") * 1000).alias("ts"), F.lit('{"k": 3}').alias("props"),
    ).write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    kept = text_queries.materialize
    monkeypatch.setattr(text_queries, "materialize", lambda df, label: seen.append((label, kept(df, label))) or seen[-1][1])
    done = text_queries.mined(spark, str(tmp_path))
    stored = dict(seen)
    assert stored["files"].count() == done.work.files.count() > 130
    assert len(stored["files"].inputFiles()) <= 2 * spark.sparkContext.defaultParallelism + 1
    assert stored["text-ranked"].count() == 400
