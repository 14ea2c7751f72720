"""Order-dependent operators that never put one whole key into one task.

A window partitioned by session alone sends every turn of a session to a single task,
and one session may hold a large share of all turns. Here each key's timeline is cut
into fixed slices of ``slice_ms`` (default ten minutes). Rows are shuffled once by
(key, slice); what has to cross a slice border (a count, a last timestamp, a running
maximum) is carried by a per-slice summary whose size per key is bounded by the time
extent, not by the number of rows.

A burst of rows at one moment, or many rows without a time, would still meet in one slice. So
slices are cut again, at the places of one row in ``PIECE_ROWS`` that a hash of the row picks: a
slice of few rows has no cut as a rule, one of n rows about n / PIECE_ROWS. Rows, summaries and
carried values then go by piece. Results are exact for every slice width and every cut.

Keys must not be NULL: label unknown ones first. Times may be; such rows come last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.scratch import materialize

SLICE_MS = 600_000
#: Rows of a slice per piece, on average.
PIECE_ROWS = 1 << 20
_SLICE = "_slice"
#: Last in every order: tells rows apart that share all that orders them.
_ROW = "_row_hash"


def slice_of(ms: Column | str, slice_ms: int = SLICE_MS) -> Column:
    """The slice of a time; rows without a time form one last slice of their own."""
    at = F.floor((F.col(ms) if isinstance(ms, str) else ms) / F.lit(slice_ms))
    return F.coalesce(at, F.lit(2**62))


def cut_in_slices(
    df: DataFrame, keys: Sequence[str], ms: str, order: Sequence[Column | str], slice_ms: int, piece_rows: int | None = None
) -> DataFrame:
    """Add ``_slice``, a time slice and the piece of it, and ``_row_hash``, the last of the columns
    that order rows. ``order`` is ascending, nulls first, and begins with the time."""
    hashed = [F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    rows = df.withColumn("_time", slice_of(ms, slice_ms)).withColumn(_ROW, F.xxhash64(*hashed))
    columns = [F.col(c) if isinstance(c, str) else c for c in [*order, _ROW]]
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(columns)])
    picked = rows.where(F.pmod(F.xxhash64(_ROW), F.lit(piece_rows or PIECE_ROWS)) == 0)
    if not picked.agg(F.count(F.lit(1))).first()[0]:  # no place to cut at: every slice is one piece
        return rows.withColumn(_SLICE, F.struct("_time", F.lit(0).alias("piece"))).drop("_time")
    cuts = picked.groupBy(*keys, "_time").agg(F.collect_set(place).alias("_cuts"))
    piece = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= place)), F.lit(0))
    return rows.join(cuts, [*keys, "_time"], "left").withColumn(_SLICE, F.struct("_time", piece.alias("piece"))).drop("_time", "_cuts")


def _before(keys: Sequence[str]):
    """All earlier slices of the same key."""
    return (
        Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )


def with_sequence(
    df: DataFrame,
    keys: Sequence[str],
    ms: str,
    ties: Sequence[str] = (),
    ordinal: str = "i",
    total: str | None = "n",
    previous: str | None = None,
    slice_ms: int = SLICE_MS,
    piece_rows: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row within its key, in time order.

    ``total`` adds the number of rows of the key, ``previous`` the time of the row
    before (NULL on the first). ``ties`` order rows that share a timestamp.
    """
    keys = list(keys)
    sliced = cut_in_slices(df, keys, ms, [ms, *ties], slice_ms, piece_rows)
    whole = Window.partitionBy(*keys)
    summary = sliced.groupBy(*keys, _SLICE).agg(
        F.count(F.lit(1)).alias("_rows"), F.max(ms).alias("_last")
    )
    carried = summary.select(
        *keys,
        _SLICE,
        F.coalesce(F.sum("_rows").over(_before(keys)), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(whole).alias("_total"),
        F.lag("_last").over(whole.orderBy(_SLICE)).alias("_carry"),
    )
    inside = Window.partitionBy(*keys, _SLICE).orderBy(ms, *ties, _ROW)
    out = sliced.join(carried, [*keys, _SLICE]).withColumn(
        ordinal, F.col("_offset") + F.row_number().over(inside) - 1
    )
    if previous:
        first = F.row_number().over(inside) == 1
        out = out.withColumn(previous, F.when(first, F.col("_carry")).otherwise(F.lag(ms).over(inside)))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop(_SLICE, _ROW, "_offset", "_total", "_carry")


def place_in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str) -> DataFrame:
    """Number the rows of each key from 0 by ``order`` (ascending, nulls first).

    Rows are dealt by ranges of (key, order) and stored sorted; a key may span any number of
    ranges, and what stands before a range is known from one count per key and range."""
    keys = list(keys)
    by = [F.col(c) if isinstance(c, str) else c for c in [*keys, *order]]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    rows = materialize(dealt, "ranges").withColumns(
        {"_range": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    known = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_of"), shift.alias("_shift"))
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(known, same).withColumn(out, F.col("_at") + F.col("_shift")).select(*df.columns, out)


def number_in_chunks(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Sequence[str],
    order: Sequence[str],
    out: str,
) -> DataFrame:
    """Number the rows of each key from 0 by ``order``, whose leading columns ``chunk`` cut
    the key into bounded pieces (a file's input splits). Pieces are numbered apart and
    shifted by the sizes of the pieces before."""
    keys, chunk = list(keys), list(chunk)
    before = Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, *chunk)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, *chunk, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    )
    inside = Window.partitionBy(*keys, *chunk).orderBy(*order)
    return (
        df.join(offsets, [*keys, *chunk])
        .withColumn(out, F.col("_o") + F.row_number().over(inside) - 1)
        .drop("_o")
    )


# Rows of a piece of a file are numbered below this, more than an input split has bytes;
# a session has room for 2^23 pieces.
CHUNK_SPAN = 1 << 40


def order_in_chunks(
    df: DataFrame,
    chunks: DataFrame,
    keys: Sequence[str],
    chunk: Sequence[str],
    order: Sequence[str],
    out: str,
) -> DataFrame:
    """Like ``number_in_chunks`` but with gaps, from a list of pieces instead of their sizes.

    Listing pieces is cheap where counting their rows would compute the rows twice.
    """
    keys, chunk = list(keys), list(chunk)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*chunk)) - 1
    ranked = chunks.select(*keys, *chunk).distinct().select(*keys, *chunk, rank.alias("_piece"))
    inside = Window.partitionBy(*keys, *chunk).orderBy(*order)
    number = F.col("_piece").cast("long") * CHUNK_SPAN + F.row_number().over(inside) - 1
    return df.join(ranked, [*keys, *chunk]).withColumn(out, number).drop("_piece")


def gap_usage(
    df: DataFrame,
    keys: Sequence[str],
    ms: str,
    idle_ms: int,
    sums: dict[str, str] | None = None,
    maxima: dict[str, str] | None = None,
    slice_ms: int = SLICE_MS,
    piece_rows: int | None = None,
) -> DataFrame:
    """Per key: first and last time, row count, and the time spent in gaps shorter than
    ``idle_ms`` (strictly between zero and the threshold), plus requested sums and maxima.

    One pass: gaps inside a slice are summed there, and the gap between two slices is
    the distance from one slice's last row to the next slice's first.
    """
    keys = list(keys)
    sums, maxima = sums or {}, maxima or {}

    def worked(gap: Column) -> Column:
        return F.when((gap > 0) & (gap < F.lit(idle_ms)), gap).otherwise(F.lit(0))

    wanted = list(dict.fromkeys([*sums.values(), *maxima.values()]))
    inside = Window.partitionBy(*keys, _SLICE).orderBy(ms, _ROW)
    rows = df.select(*keys, ms, *[c for c in wanted if c not in keys and c != ms])
    rows = cut_in_slices(rows, keys, ms, [ms], slice_ms, piece_rows).withColumn(
        "_gap", F.col(ms) - F.lag(ms).over(inside)
    )
    parts = rows.groupBy(*keys, _SLICE).agg(
        F.min(ms).alias("_t0"),
        F.max(ms).alias("_t1"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(worked(F.col("_gap"))).alias("_work"),
        *[F.sum(c).alias(f"_s_{name}") for name, c in sums.items()],
        *[F.max(c).alias(f"_m_{name}") for name, c in maxima.items()],
    )
    border = F.col("_t0") - F.lag("_t1").over(Window.partitionBy(*keys).orderBy(_SLICE))
    parts = parts.withColumn("_border", border).withColumn(
        "_work", F.col("_work") + worked(F.col("_border"))
    )
    return parts.groupBy(*keys).agg(
        F.min("_t0").alias("firstMs"),
        F.max("_t1").alias("lastMs"),
        F.sum("_n").alias("nTurns"),
        F.sum("_work").alias("activeMs"),
        *[F.sum(f"_s_{name}").alias(name) for name in sums],
        *[F.max(f"_m_{name}").alias(name) for name in maxima],
    )


def idle_gaps(
    df: DataFrame,
    keys: Sequence[str],
    ms: str,
    threshold_ms: int,
    ties: Sequence[str] = (),
    slice_ms: int = SLICE_MS,
    piece_rows: int | None = None,
) -> DataFrame:
    """Pauses of at least ``threshold_ms``, each with the position of the row before it."""
    rows = df.select(*keys, ms, *[t for t in ties if t not in keys and t != ms])
    seq = with_sequence(rows, keys, ms, ties, "_i", None, "_prev", slice_ms, piece_rows)
    gap = F.col(ms) - F.col("_prev")
    return seq.where(gap >= F.lit(threshold_ms)).select(
        *keys, (F.col("_i") - 1).alias("i"), gap.alias("ms")
    )


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    ms: str,
    order: Sequence[Column | str],
    value: Column,
    out: str,
    inclusive: bool = False,
    slice_ms: int = SLICE_MS,
    piece_rows: int | None = None,
) -> DataFrame:
    """Largest ``value`` among the rows before this one (or up to it) within the key.

    ``order`` is ascending, nulls first, and begins with ``ms``, so that slices and rows agree on it.
    """
    keys = list(keys)
    sliced = cut_in_slices(df, keys, ms, order, slice_ms, piece_rows).withColumn("_v", value)
    carried = (
        sliced.groupBy(*keys, _SLICE)
        .agg(F.max("_v").alias("_m"))
        .select(*keys, _SLICE, F.max("_m").over(_before(keys)).alias("_carry"))
    )
    inside = (
        Window.partitionBy(*keys, _SLICE)
        .orderBy(*order, _ROW)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    return (
        sliced.join(carried, [*keys, _SLICE])
        .withColumn(out, F.greatest(F.max("_v").over(inside), F.col("_carry")))
        .drop(_SLICE, _ROW, "_v", "_carry")
    )


def place_marks(
    rows: DataFrame,
    marks: DataFrame,
    keys: Sequence[str],
    ms: str,
    ordinal: str = "i",
    slice_ms: int = SLICE_MS,
    piece_rows: int | None = None,
) -> DataFrame:
    """Backward inclusive as-of: position of the last row at or before each mark, else -1.

    That position is the number of rows up to the mark minus one, so a running count
    over rows and marks together answers it without pairing any mark with any row.
    """
    keys = list(keys)
    payload = [c for c in marks.columns if c not in keys and c != ms]
    carry_cols = F.struct(*[F.col(c) for c in payload]) if payload else F.lit(None)
    tagged_marks = marks.select(*keys, ms, F.lit(0).alias("_row"), carry_cols.alias("_p"))
    tagged_rows = rows.select(
        *keys,
        ms,
        F.lit(1).alias("_row"),
        F.lit(None).cast(tagged_marks.schema["_p"].dataType).alias("_p"),
    )
    order = [ms, -F.col("_row")]
    both = cut_in_slices(tagged_rows.unionByName(tagged_marks), keys, ms, order, slice_ms, piece_rows)
    carried = (
        both.groupBy(*keys, _SLICE)
        .agg(F.sum("_row").alias("_rows"))
        .select(
            *keys,
            _SLICE,
            F.coalesce(F.sum("_rows").over(_before(keys)), F.lit(0)).alias("_offset"),
        )
    )
    upto = (
        Window.partitionBy(*keys, _SLICE)
        .orderBy(*order, _ROW)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = both.join(carried, [*keys, _SLICE]).withColumn(
        ordinal, F.col("_offset") + F.sum("_row").over(upto) - 1
    )
    return placed.where("_row = 0").select(
        *keys, ms, *[F.col(f"_p.{c}").alias(c) for c in payload], ordinal
    )
