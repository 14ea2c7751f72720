"""Writing grains: flat staging, partitioned export, replay, index and manifest."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.time import month_of, ms_of
from ledgerline.schemas import GRAINS, Grain, conform
from ledgerline.sources.paths import holds_parquet, path_exists

SHARE_KEYS = ("username", "host")
LAYOUT = "/".join(["{grain}", *(f"{k}={{{k}}}" for k in SHARE_KEYS), "month={month} where the grain has a time", "part files"])
REPLAY_BUCKETS = 256
# A key is one path segment: letters, digits and . _ @ - with something that is not a dot.
_KEY = r"^[A-Za-z0-9._@-]*[A-Za-z0-9_@-][A-Za-z0-9._@-]*$"


def assert_key_safe(kind: str, value: str) -> None:
    """Fail on a value that cannot be one path segment."""
    if not re.fullmatch(_KEY[1:-1], value):
        raise ValueError(f"{kind} {value!r} is not safe as a partition key")


def checked_key(column: str) -> Column:
    """The same rule for values that come from data: the job fails on an unsafe one."""
    value = F.col(column)
    return F.when(value.rlike(_KEY), value).otherwise(
        F.raise_error(F.concat(F.lit(f"unsafe partition key in {column}: "), F.coalesce(value, F.lit("null"))))
    )


def write_flat(grains: Mapping[str, DataFrame], folder: str) -> None:
    """One Parquet table per grain; an empty grain still carries its schema."""
    for name, df in grains.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def recent_months(df: DataFrame, time_column: str, months: int | None) -> DataFrame:
    """Rows within ``months`` calendar months of the newest one. Unknown times drop out."""
    if not months or months <= 0:
        return df
    newest = df.agg(F.max(time_column)).scalar()
    return df.where(F.col(time_column) >= newest - F.make_ym_interval(F.lit(0), F.lit(int(months))))


def share_folder(folder: str, username: str, host: str) -> str:
    """The folder that holds what one user mined on one host; its names are partition values."""
    assert_key_safe("username", username)
    assert_key_safe("host", host)
    return f"{folder}/username={username}/host={host}"


def export_grain(
    df: DataFrame,
    grain: Grain,
    prefix: str,
    username: str,
    host: str,
    months: int | None = None,
) -> None:
    """Write one grain into the partitioned corpus, replacing all of the user's share on this
    host: months that went away, or a grain that became empty, leave no old rows.

    Rebalancing gives files of the advisory size: small months share nothing and become
    one file, a large month is split. Sorting by time inside files lets readers skip row
    groups. ``prefix`` may be any Hadoop path, an object store included.
    """
    out, keys = recent_months(df, grain.time_column, months), []
    if grain.by_month:
        out, keys = out.withColumn("month", month_of(grain.time_column)), ["month"]
    balanced = out.hint("rebalance", *[F.col(k) for k in keys])
    (
        balanced.sortWithinPartitions(*keys, grain.time_column)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .option("compression", "zstd")
        .partitionBy(*keys)
        .parquet(share_folder(f"{prefix}/{grain.name}", username, host))
    )


def export_corpus(
    grains: Mapping[str, DataFrame],
    prefix: str,
    username: str,
    host: str,
    months: int | None = None,
) -> list[str]:
    """Export every grain present; returns the names of those that were not."""
    for grain in GRAINS:
        if grain.name in grains:
            export_grain(grains[grain.name], grain, prefix, username, host, months)
    return [g.name for g in GRAINS if g.name not in grains]


def staged_grains(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], list[str]]:
    """Flat grains to export, and the names of those not staged."""
    found, absent = {}, []
    for grain in GRAINS:
        path = f"{folder}/{grain.name}.parquet"
        if path_exists(spark, path):
            found[grain.name] = conform(spark.read.parquet(path), grain.name)
        else:
            absent.append(grain.name)
    return found, absent


def replay_bucket(session: Column) -> Column:
    """Folder of a session; a session without an id has one too."""
    return F.format_string("%02x", F.pmod(F.xxhash64(session), F.lit(REPLAY_BUCKETS)))


def write_replay(rows: DataFrame, prefix: str, username: str, host: str) -> DataFrame:
    """Write the replay grain so that one session is found without a folder per session. Only
    the user's share on this host is replaced; other hosts' replays stay.

    Sessions hash into a fixed number of folders and lie sorted inside them, so reading
    one session prunes to a folder and then to the row groups that hold it. Range
    partitioning splits a session of any size over several files. Returns the index.
    """
    placed = rows.withColumn("bucket", replay_bucket(F.col("sessionId")))
    (
        placed.repartitionByRange("bucket", "sessionId", "seq")
        .sortWithinPartitions("bucket", "sessionId", "seq")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .option("compression", "zstd")
        .partitionBy("bucket")
        .parquet(share_folder(f"{prefix}/replay", username, host))
    )
    index = replay_index(rows)
    index.write.mode("overwrite").json(share_folder(f"{prefix}/replay-index", username, host))
    return index


def replay_index(rows: DataFrame) -> DataFrame:
    """Rows, bytes of text and known time extent per session."""
    known = F.when(ms_of("ts") > 0, ms_of("ts"))
    return rows.groupBy("sessionId").agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"),
        F.min(known).alias("t0"),
        F.max(known).alias("t1"),
    )


def _path_key(name: str) -> Column:
    value = F.regexp_extract("path", f"/{name}=([^/]+)/", 1)
    return F.when((value != "") & (value != "__HIVE_DEFAULT_PARTITION__"), value)


def shard_index(spark: SparkSession, prefix: str, grains: Sequence[str], share: str = "") -> DataFrame:
    """One row per file of the corpus, or of one share (its folder's name below the grain):
    grain, keys, path below the prefix, bytes, rows.

    Counting rows touches no column, so only file footers are read.
    """
    shards = spark.createDataFrame([], "grain string, path string, bytes long, rows long")
    for grain in grains:
        files = (
            spark.read.parquet(f"{prefix}/{grain}{share}")
            .select("_metadata.file_path", "_metadata.file_size")
            .groupBy("file_path", "file_size")
            .agg(F.count(F.lit(1)).alias("rows"))
            .select(
                F.lit(grain).alias("grain"),
                F.regexp_extract("file_path", f"({grain}/username=.*)$", 1).alias("path"),
                F.col("file_size").alias("bytes"),
                "rows",
            )
        )
        shards = shards.unionByName(files)
    return shards.select(
        "grain",
        _path_key("username").alias("username"),
        _path_key("host").alias("host"),
        _path_key("month").alias("month"),
        "path",
        "bytes",
        "rows",
    )


def index_totals(shards: DataFrame) -> DataFrame:
    return shards.groupBy("grain").agg(
        F.count(F.lit(1)).alias("shards"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.sum("rows").alias("rows"),
    )


def select_shards(shards: DataFrame, budget: int) -> DataFrame:
    """Choose shards for a byte budget: undated first, then newest months, then by path.

    A shard that does not fit is skipped and later ones are still tried, so each decision
    depends on the ones before; the fold runs over the file index, never over data.
    Unknown sizes count as nothing.
    """
    size = F.coalesce("bytes", F.lit(0)).cast("long")
    entry = F.struct(
        F.col("month").isNotNull().alias("dated"),
        (-F.coalesce(F.regexp_replace("month", "-", "").cast("long"), F.lit(0))).alias("newest"),
        F.col("path").alias("path"),
        size.alias("size"),
    )
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("paths"))

    def take(state: Column, shard: Column) -> Column:
        fits = state["used"] + shard["size"] <= F.lit(budget)
        return F.when(
            fits,
            F.struct(
                (state["used"] + shard["size"]).alias("used"),
                F.concat(state["paths"], F.array(shard["path"])).alias("paths"),
            ),
        ).otherwise(state)

    chosen = shards.agg(F.aggregate(F.array_sort(F.collect_list(entry)), start, take).alias("s"))
    return shards.join(chosen.select(F.explode("s.paths").alias("path")), "path", "left_semi")


def write_json(spark: SparkSession, path: str, document: Mapping) -> None:
    """One JSON document as a text sidecar beside the data."""
    frame = spark.createDataFrame([(json.dumps(document, default=str),)], T.StructType([T.StructField("value", T.StringType())]))
    frame.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").text(path)


def write_index(spark: SparkSession, prefix: str, username: str, host: str) -> DataFrame:
    """Index of one share: a line per file of its grains, replaced as a whole. Other shares keep
    theirs, so hosts write side by side. Returns rows and bytes per grain."""
    share = share_folder("", username, host)
    present = [g.name for g in GRAINS if holds_parquet(spark, f"{prefix}/{g.name}{share}")]
    folder = share_folder(f"{prefix}/index-shards", username, host)
    lines = shard_index(spark, prefix, present, share).drop("username", "host")
    lines.write.mode("overwrite").option("partitionOverwriteMode", "static").json(folder)
    return spark.read.schema(INDEX_LINES).json(folder).groupBy("grain").agg(
        F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")
    )


#: Columns of a line of the index; its keys are in the path.
INDEX_LINES = "grain string, month string, path string, bytes long, rows long"


def write_manifest(
    spark: SparkSession,
    prefix: str,
    username: str,
    host: str,
    source: Mapping,
    stats: DataFrame,
    problems: Sequence[str],
    written: DataFrame | None = None,
) -> None:
    """The share's manifest: where its grains came from, what was written of each, the statistics
    and the invariants' verdict. It is written last, so a share that has one is whole.

    ``written`` has rows and bytes by grain, as they lie in the corpus (trimmed to recent
    months, say); None when nothing was exported. Every grain is named, empty or not.
    """
    sizes = {r["grain"]: r for r in written.collect()} if written is not None else {}
    tables = {}
    for g in GRAINS if written is not None else ():
        own = sizes.get(g.name)
        tables[g.name] = {"rows": own["rows"], "bytes": own["bytes"]} if own else {"rows": 0, "bytes": None}
    write_json(
        spark,
        share_folder(f"{prefix}/manifest", username, host),
        {
            "version": 1,
            "layout": LAYOUT,
            "source": dict(source),
            "grains": {g.name: {"partitionedByMonth": g.by_month, "timeColumn": g.time_column} for g in GRAINS},
            "tables": tables,
            "stats": stats.collect()[0].asDict(),
            "invariants": {"ok": not problems, "problems": list(problems)},
        },
    )
