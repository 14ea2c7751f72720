"""Reading in small splits without a task for each of them."""

from pyspark.sql import functions as F

from ledgerline.plans import text_queries
from ledgerline.sources import transcripts


def test_small_splits_are_dealt_to_few_tasks(spark, tmp_path):
    """Files stay cut at every 16 kB, so order across splits still counts, but the number of tasks
    (and of stored files) follows the bytes a task reads, not the number of splits."""
    rows = spark.range(40_000).select(
        F.concat(F.lit("-p/s"), (F.col("id") % 40).cast("string"), F.lit(".jsonl")).alias("path"),
        (F.col("id") / 40).cast("long").alias("pos"),
        F.concat(F.lit('{"n": '), F.floor(F.col("id") / 40).cast("string"), F.lit(', "fill": "'), F.lit("x" * 80), F.lit('"}')).alias("value"),
    )
    folder = f"{tmp_path}/lines"
    transcripts.write_lines(rows, folder, ["pos"])
    files = transcripts.transcript_files(spark, [folder])
    size = files.agg(F.sum("bytes")).first()[0]
    small = text_queries.split_settings(spark, size)
    before = {name: spark.conf.get(name, None) for name in small}
    try:
        for name, value in small.items():
            spark.conf.set(name, value)
        lines = transcripts.read_lines(spark, [folder])
        splits = lines.select("walk", "splitStart").distinct().count()
        tasks = lines.rdd.getNumPartitions()
        got = lines.select("walk", "splitStart", "lineIdx", F.get_json_object("value", "$.n").cast("long").alias("n")).collect()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert splits >= 40 * 5
    assert tasks <= 2 * spark.sparkContext.defaultParallelism + 1
    found: dict = {}
    for r in sorted(got, key=lambda r: (r["walk"], r["splitStart"], r["lineIdx"])):
        found.setdefault(r["walk"], []).append(r["n"])
    assert len(found) == 40 and all(v == list(range(1000)) for v in found.values())


def test_tasks_grow_with_the_text(spark):
    few = 2 * spark.sparkContext.defaultParallelism
    tasks = lambda n: int(text_queries.split_settings(spark, n)["spark.sql.files.maxPartitionNum"])
    assert tasks(0) == few
    assert tasks(1000 * text_queries.TASK_BYTES) == 1000
