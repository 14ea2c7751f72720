"""Interval operators: lanes, peak concurrency, activity bands, ticks.

Intervals are half-open in epoch milliseconds. Groups (projects) may be arbitrarily
large, so ordering work is cut into time slices (see ``ordered``) and lane packing is
cut at idle moments, where every lane is free and packing starts afresh.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.time import DAY_MS, HOUR_MS
from ledgerline.operators.ordered import SLICE_MS, cut_in_slices, running_max
from ledgerline.sources.scratch import materialize

# Candidate spacings of a time axis, in milliseconds.
TICK_STEPS = tuple(
    [h * HOUR_MS for h in (1, 3, 6, 12)] + [d * DAY_MS for d in (1, 2, 7, 14, 28)]
)


def with_extent(spans: DataFrame, min_ms: int = 1, t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Give every span a positive length, so coincident points conflict."""
    return spans.withColumn(t1, F.greatest(F.col(t1), F.col(t0) + min_ms))


def peak_concurrency(
    spans: DataFrame,
    keys: Sequence[str] = ("project",),
    gap_ms: int = 0,
    t0: str = "t0",
    t1: str = "t1",
    slice_ms: int = SLICE_MS,
) -> DataFrame:
    """Most spans alive at once per group, which is also the number of lanes needed.

    Each slice reports its net change and its highest running value; the peak is the
    largest of (what earlier slices left running + that slice's highest value).
    """
    keys = list(keys)
    moments = spans.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col(t0).alias("_at"), F.lit(1).alias("_d")),
                F.struct((F.col(t1) + gap_ms).alias("_at"), F.lit(-1).alias("_d")),
            )
        ),
    )
    edges = cut_in_slices(moments, keys, "_at", ["_at", "_d"], slice_ms)
    upto = (
        Window.partitionBy(*keys, "_slice")
        .orderBy("_at", "_d", "_row_hash")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    parts = (
        edges.withColumn("_run", F.sum("_d").over(upto))
        .groupBy(*keys, "_slice")
        .agg(F.sum("_d").alias("_net"), F.max("_run").alias("_top"))
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.sum("_net").over(before), F.lit(0))
    return (
        parts.withColumn("_peak", carried + F.col("_top"))
        .groupBy(*keys)
        .agg(F.max("_peak").alias("laneCount"))
    )


def islands(
    spans: DataFrame,
    keys: Sequence[str],
    gap_ms: int,
    touching_fuse: bool,
    t0: str = "t0",
    t1: str = "t1",
    slice_ms: int = SLICE_MS,
) -> DataFrame:
    """Tag every span with the start of the unbroken stretch it belongs to (``island``).

    A stretch breaks where a span starts later than everything before it has ended by
    more than ``gap_ms``; with ``touching_fuse`` off, by exactly ``gap_ms`` as well.
    """
    # Stored, as each running maximum reads its rows several times.
    reach = materialize(running_max(spans, keys, t0, [t0], F.col(t1), "_reach", False, slice_ms), "reach")
    distance = F.col(t0) - F.col("_reach")
    far = distance > gap_ms if touching_fuse else distance >= gap_ms
    starts = reach.withColumn("_start", F.when(F.col("_reach").isNull() | far, F.col(t0)))
    # A break is decided by earlier starts only, so rows tied on t0 agree once the
    # running start is taken over the whole tie.
    order = [t0, F.col("_start").isNull(), "_start"]
    return running_max(
        starts, keys, t0, order, F.col("_start"), "island", True, slice_ms
    ).drop("_reach", "_start")


def activity_bands(
    spans: DataFrame,
    keys: Sequence[str] = ("project",),
    gap_ms: int = 0,
    t0: str = "t0",
    t1: str = "t1",
    slice_ms: int = SLICE_MS,
) -> DataFrame:
    """Union of a group's spans, fusing those at most ``gap_ms`` apart."""
    tagged = islands(spans.select(*keys, t0, t1), keys, gap_ms, True, t0, t1, slice_ms)
    return (
        tagged.groupBy(*keys, "island")
        .agg(F.max(t1).alias("t1"))
        .select(*keys, F.col("island").alias("t0"), "t1")
    )


def _first_fit(batches: Iterator[pd.DataFrame], key_count: int, gap_ms: int):
    """Assign the lowest free lane to spans arriving in packing order.

    Holds only the lanes of the stretch being read, never the stretch itself.
    """
    current = None
    busy: list[tuple[int, int]] = []
    free: list[int] = []
    lanes = 0
    for batch in batches:
        keys = list(zip(*[batch.iloc[:, i] for i in range(key_count)]))
        out = []
        for key, start, end in zip(keys, batch["_t0"], batch["_t1"]):
            if key != current:
                current, busy, free, lanes = key, [], [], 0
            while busy and busy[0][0] + gap_ms <= start:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                lane = heapq.heappop(free)
            else:
                lane, lanes = lanes, lanes + 1
            heapq.heappush(busy, (end, lane))
            out.append(lane)
        yield batch.assign(lane=out)


def pack_lanes(
    spans: DataFrame,
    keys: Sequence[str] = ("project",),
    ident: str = "id",
    gap_ms: int = 0,
    t0: str = "t0",
    t1: str = "t1",
    slice_ms: int = SLICE_MS,
) -> DataFrame:
    """First-fit lanes: earliest start first, then the longer span, then the id.

    First-fit looks at earlier spans, so it is sequential while spans keep overlapping,
    but a moment with nothing running frees every lane. Work is therefore distributed by
    (group, unbroken stretch) and streamed through each task in packing order.
    """
    keys = list(keys)
    names = [f"_k{i}" for i in range(len(keys))]
    tagged = islands(
        spans.select(*keys, ident, t0, t1), keys, gap_ms, False, t0, t1, slice_ms
    ).select(
        *[F.col(k).cast("string").alias(n) for k, n in zip(keys, names)],
        F.col("island").alias("_island"),
        F.col(ident).alias("_id"),
        F.col(t0).alias("_t0"),
        F.col(t1).alias("_t1"),
        *keys,
    )
    ordered = tagged.repartition(*names, "_island").sortWithinPartitions(
        *names, "_island", "_t0", F.desc("_t1"), "_id"
    )
    width = len(names) + 1
    packed = ordered.mapInPandas(
        lambda batches: _first_fit(batches, width, gap_ms),
        T.StructType([*ordered.schema.fields, T.StructField("lane", T.IntegerType())]),
    )
    return packed.select(
        *keys,
        F.col("_id").alias(ident),
        F.col("_t0").alias(t0),
        F.col("_t1").alias(t1),
        "lane",
    )


def tick_step(t0: Column, t1: Column, target: int = 8) -> Column:
    """The smallest spacing that gives at most ``target`` steps over the extent."""
    span = t1 - t0
    choice = F.lit(TICK_STEPS[-1])
    for step in reversed(TICK_STEPS):
        choice = F.when(span / step <= target, F.lit(step)).otherwise(choice)
    return choice.cast("long")


def time_ticks(extent: DataFrame, target: int = 8, t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Axis ticks for each extent row: the moment, whether it is midnight, and a label."""
    step = tick_step(F.col(t0), F.col(t1), target)
    stepped = extent.withColumn("_step", step).withColumn(
        "_first", (F.ceil(F.col(t0) / F.col("_step")) * F.col("_step")).cast("long")
    )
    ticks = stepped.where(F.col("_first") <= F.col(t1)).withColumn(
        "t", F.explode(F.sequence("_first", F.col(t1).cast("long"), "_step"))
    )
    midnight = F.col("t") % DAY_MS == 0
    moment = F.timestamp_millis("t")
    return ticks.select(
        *[c for c in extent.columns if c not in (t0, t1)],
        "t",
        midnight.alias("major"),
        F.when((F.col("_step") < DAY_MS) & ~midnight, F.date_format(moment, "HH:00"))
        .otherwise(F.date_format(moment, "MMM d"))
        .alias("label"),
    )
