"""The mine job: transcripts in, grains and a partitioned corpus out.

    spark-submit --py-files ledgerline.zip ledgerline/plans/mine.py \\
        --root /data/transcripts --prices prices.json --price-version 2026-07 \\
        --out s3a://bucket/corpus --username me --host host-1 [--months 6] [--replay]
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from ledgerline.operators import quality
from ledgerline.plans.normalize import IDLE_SECONDS, Normalized, normalize
from ledgerline.plans.replay_grain import replay_rows
from ledgerline.session import configure
from ledgerline.sources import sinks
from ledgerline.sources.corpus import use_profile
from ledgerline.sources.prices import read_prices
from ledgerline.sources.scratch import release
from ledgerline.sources.transcripts import existing_roots, read_lines, transcript_files


def mine(
    spark: SparkSession,
    roots: list[str],
    prices_path: str,
    price_version: str,
    out: str,
    username: str,
    host: str,
    months: int | None = None,
    replay: bool = False,
    idle_seconds: float = IDLE_SECONDS,
    created_path: str | None = None,
    profile: str | None = None,
) -> Normalized:
    """Normalize, check, export. Nothing is exported when an invariant is violated."""
    configure(spark)
    if profile:
        use_profile(spark, profile)
    sinks.assert_key_safe("username", username)
    sinks.assert_key_safe("host", host)
    created = spark.read.parquet(created_path) if created_path else None
    lines = read_lines(spark, roots, created)
    result = normalize(
        lines,
        transcript_files(spark, roots, created),
        read_prices(spark, prices_path, price_version),
        idle_seconds,
        host,
    )
    found = quality.store_problems(result, sinks.share_folder(f"{out}/problems", username, host))
    source = {
        "roots": existing_roots(spark, roots),
        "pricing": price_version,
        "generatedAt": datetime.now(timezone.utc).isoformat(),
    }
    if found:
        sinks.write_manifest(spark, out, username, host, source, result.stats, found)
        raise quality.InvariantError("; ".join(found))
    sinks.export_corpus(result.grains, out, username, host, months)
    if replay:
        sinks.write_replay(replay_rows(lines, result.facts), out, username, host)
    written = sinks.write_index(spark, out, username, host)
    sinks.write_manifest(spark, out, username, host, source, result.stats, found, written)
    return result


def main(argv: list[str] | None = None) -> int:
    cli = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    cli.add_argument("--root", action="append", required=True)
    cli.add_argument("--prices", required=True)
    cli.add_argument("--price-version", required=True)
    cli.add_argument("--out", required=True)
    cli.add_argument("--username", required=True)
    cli.add_argument("--host", required=True)
    cli.add_argument("--months", type=int)
    cli.add_argument("--replay", action="store_true")
    cli.add_argument("--idle-seconds", type=float, default=IDLE_SECONDS)
    cli.add_argument("--created", help="Parquet of (path, created_ms), where creation times are known")
    cli.add_argument("--profile", help="named credentials for the object store")
    args = cli.parse_args(argv)
    spark = SparkSession.builder.appName("ledgerline-mine").getOrCreate()
    try:
        mine(
            spark, args.root, args.prices, args.price_version, args.out, args.username, args.host,
            args.months, args.replay, args.idle_seconds, args.created, args.profile,
        ).stats.show(vertical=True, truncate=False)
    except quality.InvariantError as e:
        print(f"invariants violated: {e}", file=sys.stderr)
        return 1
    finally:
        release(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
