"""Transcript files: one JSON object per line, under <root>/<project slug>/…

Lines are read with the splittable text source, so one large file feeds many tasks. A
line's place is (``walk``, ``splitStart``, ``lineIdx``): the file's place in the walk,
the start of its input split, and an increasing number within the split.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["walk", "splitStart", "lineIdx"]
CHUNK = ["walk", "splitStart"]

FILE_COLUMNS = (
    "path", "walk", "projectSlug", "fileSessionId", "fileKind", "fileAgentId", "workflowId",
    "bytes", "createdMs",
)


def _plain(path: Column) -> Column:
    """Undo URI escapes and the local scheme, so paths compare with the roots as given."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/*", "/")


def existing_roots(spark: SparkSession, roots: Sequence[str]) -> list[str]:
    """Roots that exist, fully qualified, without repeats, in the order given."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: list[str] = []
    for root in roots:
        if not root.strip():
            continue
        path = jvm.org.apache.hadoop.fs.Path(root.strip())
        store = path.getFileSystem(conf)
        if not store.exists(path):
            continue
        full = store.makeQualified(path).toString().rstrip("/")
        if full.startswith("file:"):
            full = "/" + full[len("file:") :].lstrip("/")
        if full not in found:
            found.append(full)
    return found


def file_facts(path: Column, roots: Sequence[str]) -> dict[str, Column]:
    """What a transcript's path says. A file under several roots belongs to the first.

    ``walk`` sorts as a depth-first walk by name does: path segments are joined by a
    character below all others, so a folder's files come before a file whose name
    extends the folder's.
    """
    rel = F.coalesce(
        *[F.when(F.startswith(path, F.lit(r + "/")), F.substring(path, len(r) + 2, 1 << 20)) for r in roots]
    )
    turn = F.coalesce(
        *[F.when(F.startswith(path, F.lit(r + "/")), F.lit(f"{i:04d}")) for i, r in enumerate(roots)]
    )
    parts = F.split(rel, "/")
    size = F.size(parts)
    name = F.element_at(parts, -1)
    inner = F.slice(parts, F.lit(2), F.greatest(size - 2, F.lit(0)))
    stem = F.regexp_replace(name, r"\.jsonl$", "")
    flow = F.array_position(inner, "workflows")
    return {
        "walk": F.concat_ws("\x01", turn, parts),
        "projectSlug": parts[0],
        "fileSessionId": F.when(F.size(inner) == 0, stem).otherwise(F.try_element_at(inner, F.lit(1))),
        "fileKind": F.when(F.size(inner) == 0, "session")
        .when(name == "journal.jsonl", "workflow-journal")
        .when(flow > 0, "workflow-agent")
        .otherwise("subagent"),
        "fileAgentId": F.when(F.startswith(name, F.lit("agent-")), F.substring(stem, 7, 1 << 20)),
        "workflowId": F.when(flow > 0, F.try_element_at(inner, (flow + 1).cast("int"))),
        "_depth": size,
    }


def classify(lines: DataFrame, roots: Sequence[str], created: DataFrame | None = None) -> DataFrame:
    """Attach path facts to lines having ``path``; ``created`` optionally gives
    (path, created_ms). Files directly in a root are not transcripts."""
    facts = file_facts(F.col("path"), roots)
    out = lines.withColumns(facts).where("_depth >= 2").drop("_depth")
    if created is None:
        return out.withColumn("createdMs", F.lit(None).cast("long"))
    times = created.select(
        "path", F.nullif(F.floor("created_ms").cast("long"), F.lit(0).cast("long")).alias("createdMs")
    )
    return out.join(times, "path", "left")


def _roots_to_read(roots: Sequence[str]) -> list[str]:
    """Roots that are not inside another root, so no file is listed twice."""
    return [r for r in roots if not any(r != o and r.startswith(o + "/") for o in roots)]


def read_lines(
    spark: SparkSession, roots: Sequence[str], created: DataFrame | None = None
) -> DataFrame:
    """Every line of every transcript below the roots, with its place and path facts.

    Spark exposes modification times only, and those change with activity, so creation
    times come from ``created`` or stay unknown.
    """
    roots = existing_roots(spark, roots)
    if not roots:
        empty = spark.createDataFrame([], "value string, path string, splitStart long, lineIdx long, bytes long")
        return classify(empty, ["/"], created)
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.jsonl")
        .text(_roots_to_read(roots))
    )
    lines = raw.select(
        "value",
        _plain(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("splitStart"),
        F.monotonically_increasing_id().alias("lineIdx"),
        F.col("_metadata.file_size").alias("bytes"),
    )
    return classify(lines, roots, created)


def parse_records(lines: DataFrame) -> DataFrame:
    """Parse lines leniently into ``rec``; ``bad`` marks text that is not JSON.

    Blank lines are dropped, and so is JSON that is not an object.
    """
    text = F.trim("value", F.lit(" \t\r\n\f"))
    parsed = lines.where(text != "").withColumn("rec", F.try_parse_json("value"))
    bad = F.col("rec").isNull()
    # The filter moves below the parse; testing the first character first means that only
    # lines that cannot be objects are parsed a second time.
    return parsed.withColumn("bad", bad).where(F.startswith(text, F.lit("{")) | bad).drop("value")


def transcript_files(spark: SparkSession, roots: Sequence[str], created: DataFrame | None = None) -> DataFrame:
    """One row per transcript file, including empty ones, from the listing alone."""
    roots = existing_roots(spark, roots)
    if not roots:
        empty = spark.createDataFrame([], "path string, bytes long")
        return classify(empty, ["/"], created).select(*FILE_COLUMNS)
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.jsonl")
        .load(_roots_to_read(roots))
    )
    files = listed.select(_plain(F.col("path")).alias("path"), F.col("length").alias("bytes"))
    return classify(files, roots, created).select(*FILE_COLUMNS)


def write_lines(lines: DataFrame, folder: str, order: Sequence[str]) -> None:
    """Write ``value`` of every row to the file ``path`` (relative) below folder, in the given order.

    A file is written by one task, line by line as they come sorted, under a name that no
    reader takes for a transcript, and gets its own when it is whole."""
    columns = ["path", *order]

    def write(batches):
        store, base = fs.FileSystem.from_uri(folder)
        current, out, draft, written = None, None, None, 0

        def close():
            if out is not None:
                out.close()
                store.move(f"{base}/{draft}", f"{base}/{current}")

        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if path != current:
                    close()
                    current, draft = path, f"{path}.{uuid.uuid4().hex}.part"
                    store.create_dir(f"{base}/{path.rpartition('/')[0]}")
                    out = store.open_output_stream(f"{base}/{draft}")
                    written += 1
                out.write(value.encode() + b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    sorted_lines = lines.repartition("path").sortWithinPartitions(*columns)
    sorted_lines.select("path", "value").mapInArrow(write, "files long").agg(F.sum("files")).collect()
