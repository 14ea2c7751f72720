"""Reading a partitioned corpus back: grains, shards, sidecars, one session's replay."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.schemas import GRAINS, SCHEMAS
from ledgerline.sources.paths import holds_parquet, path_exists
from ledgerline.sources.sinks import INDEX_LINES, SHARE_KEYS, assert_key_safe, replay_bucket

ROW_LIMIT = 200
_BY_NAME = {g.name: g for g in GRAINS}


class CorpusError(RuntimeError):
    """The corpus is unusable as given."""


@dataclass(frozen=True)
class Corpus:
    grains: dict[str, DataFrame]
    missing: tuple[str, ...]

    def __getitem__(self, grain: str) -> DataFrame:
        return self.grains[grain]

    def register(self) -> None:
        """Make each grain a temporary view, so SQL can name it."""
        for name, df in self.grains.items():
            df.createOrReplaceTempView(name)


def empty_grain(spark: SparkSession, grain: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[grain])


def read_grain(spark: SparkSession, prefix: str, grain: str) -> DataFrame:
    """All shards of one grain, columns matched by name; keys come from the path as text."""
    return spark.read.option("mergeSchema", True).parquet(f"{prefix}/{grain}")


def read_conformed(spark: SparkSession, prefix: str, grain: str) -> DataFrame:
    """All shards of one grain as its contract has it, with the keys of their paths.

    The contract is the schema that is read: shards may order columns as they like, hold narrower
    numbers, have columns beyond it, or lack some, which are then NULL. No footer is read to
    plan the scan, however many shards there are."""
    keys = [*SHARE_KEYS, *(["month"] if _BY_NAME[grain].by_month else [])]
    fields = [*SCHEMAS[grain].fields, *[T.StructField(k, T.StringType()) for k in keys]]
    return spark.read.schema(T.StructType(fields)).parquet(f"{prefix}/{grain}")


def read_shards(spark: SparkSession, prefix: str, paths: Sequence[str]) -> DataFrame:
    """Only the listed shards, their keys still read from the path."""
    roots = {p.split("/", 1)[0] for p in paths}
    if len(roots) != 1:
        raise CorpusError(f"shards of one grain expected, got {sorted(roots)}")
    return (
        spark.read.option("basePath", f"{prefix}/{roots.pop()}")
        .option("mergeSchema", True)
        .parquet(*[f"{prefix}/{p}" for p in paths])
    )


def open_corpus(
    spark: SparkSession,
    prefix: str,
    username: str | None = None,
    host: str | None = None,
) -> Corpus:
    """Every grain below a prefix, optionally one user's or one host's share.

    The share is a filter on path keys, so other folders are never listed for reading. A
    missing optional grain is an empty frame and is reported; a missing required one, or
    a prefix without any grain, is an error.
    """
    grains: dict[str, DataFrame] = {}
    missing = []
    for grain in GRAINS:
        if holds_parquet(spark, f"{prefix}/{grain.name}"):
            df = read_conformed(spark, prefix, grain.name)
            for key, wanted in (("username", username), ("host", host)):
                df = df if wanted is None else df.where(F.col(key) == wanted)
            grains[grain.name] = df
        else:
            if not path_exists(spark, f"{prefix}/{grain.name}"):
                missing.append(grain.name)
            grains[grain.name] = empty_grain(spark, grain.name)
    if len(missing) == len(GRAINS):
        raise CorpusError(f"no grains found at {prefix}")
    needed = [name for name in missing if _BY_NAME[name].required]
    if needed:
        raise CorpusError(f"required grains missing at {prefix}: {', '.join(needed)}")
    return Corpus(grains, tuple(missing))


def read_sidecar(spark: SparkSession, path: str) -> dict | None:
    """A JSON document stored beside the data; None when it is not there. A sidecar of lines,
    or of several shares, is a table: see `read_lines_sidecar` and `read_manifests`."""
    if not path_exists(spark, path):
        return None
    rows = spark.read.text(path, wholetext=True).where("value <> ''").take(2)
    if len(rows) > 1:
        raise CorpusError(f"{path} holds more than one document")
    return json.loads(rows[0]["value"]) if rows else None


def read_lines_sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A sidecar of JSON lines in any number of files and shares; keys of shares come from the
    path as text. Empty when it is not there."""
    keyed = f"{schema}, username string, host string"
    if not path_exists(spark, path):
        return spark.createDataFrame([], keyed)
    return spark.read.schema(keyed).json(path)


def read_index(spark: SparkSession, prefix: str) -> DataFrame:
    """Every file of a shared corpus, from the indexes of all shares."""
    return read_lines_sidecar(spark, f"{prefix}/index-shards", INDEX_LINES)


def read_manifests(spark: SparkSession, prefix: str) -> DataFrame:
    """One row per share that was written whole: username, host, document (VARIANT)."""
    if not path_exists(spark, f"{prefix}/manifest"):
        return spark.createDataFrame([], "username string, host string, document string").select(
            "username", "host", F.parse_json("document").alias("document")
        )
    texts = spark.read.schema("value string, username string, host string").option("wholetext", True).text(f"{prefix}/manifest")
    return texts.where("value <> ''").select("username", "host", F.parse_json("value").alias("document"))


def manifest_tables(spark: SparkSession, prefix: str) -> DataFrame:
    """What the shares hold: username, host, grain, rows, bytes."""
    held = F.variant_get("document", "$.tables", "map<string,struct<rows:bigint,bytes:bigint>>")
    return read_manifests(spark, prefix).select("username", "host", F.explode(held).alias("grain", "t")).select(
        "username", "host", "grain", "t.rows", "t.bytes"
    )


def read_replay(spark: SparkSession, prefix: str, session_id: str) -> DataFrame | None:
    """One session's replay, read by pruning; None when replays were not written."""
    if not path_exists(spark, f"{prefix}/replay"):
        return None
    wanted = F.lit(session_id)
    return (
        spark.read.parquet(f"{prefix}/replay")
        .where((F.col("bucket") == replay_bucket(wanted)) & (F.col("sessionId") == wanted))
        .drop("bucket", "username", "host")
    )


def one_session(spark: SparkSession, view: str, session_id: str) -> DataFrame:
    """Rows of one session from a registered grain; the id is a parameter, never text in SQL."""
    if view not in SCHEMAS:
        raise ValueError(f"unknown grain: {view}")
    return spark.sql(f"SELECT * FROM {view} WHERE sessionId = :id", args={"id": session_id})


def ask(spark: SparkSession, sql: str, limit: int | None = ROW_LIMIT) -> DataFrame:
    """A free SELECT over the registered grains, at most ``limit`` rows (None: all).

    The text runs as a subquery, so it can only read.
    """
    if not sql.strip():
        raise ValueError("no sql provided")
    rows = spark.sql(f"SELECT * FROM (\n{sql}\n)")
    return rows if limit is None else rows.limit(int(limit))


#: Where Hadoop takes credentials from, in this order: the environment, then a
#: named profile with its single sign-on or its keys.
_PROVIDERS = (
    "software.amazon.awssdk.auth.credentials.EnvironmentVariableCredentialsProvider",
    "org.apache.hadoop.fs.s3a.auth.ProfileAWSCredentialsProvider",
)


def profile_settings(profile: str, bucket: str | None = None) -> dict[str, str]:
    """Hadoop settings by which an object store is opened with a named profile's credentials:
    environment first, then what the profile's entry says, single sign-on included. With a
    bucket, only that one's."""
    assert_key_safe("profile", profile)
    start = f"fs.s3a.bucket.{bucket}" if bucket else "fs.s3a"
    return {
        f"{start}.aws.credentials.provider": ",".join(_PROVIDERS),
        f"{start}.auth.profile.name": profile,
    }


def use_profile(spark: SparkSession, profile: str, bucket: str | None = None) -> None:
    """Apply a profile's settings to the session, for reads and writes that follow."""
    conf = spark._jsc.hadoopConfiguration()
    for key, value in profile_settings(profile, bucket).items():
        conf.set(key, value)
