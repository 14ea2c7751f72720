"""Helpers several operators share: tables, stored steps, and texts in bounded batches."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text worked on at once inside a task; a longer text forms a batch of its own.
BATCH_BYTES = 1 << 20

#: Whether Spark removes a query's shuffle files when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can reach. Sessions that
    name none (tests) get the library's default."""
    from ledgerline.session import ensure_checkpoint_dir

    named = spark.conf.get("spark.checkpoint.dir", None)
    base = named or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost
    executor costs no recomputation of what is before. Shuffle files go when the table is
    there, since nothing else reads them."""
    spark = df.sparkSession
    folder = shared_folder(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(folder)
    _FOLDERS[table] = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(table))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once per row; expressions inside lambdas would
    otherwise be computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most BATCH_BYTES of text, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > BATCH_BYTES:
            yield begin, i
            begin, total = i, 0
        total += int(size)
    if len(sizes) > begin:
        yield begin, len(sizes)


def map_texts(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[pa.Array], dict]],
    fields: list[T.StructField],
    keep_text: bool = True,
) -> DataFrame:
    """df with columns computed from a text column, Arrow batch by Arrow batch.

    make runs once per task and returns a function from texts (null: empty) to a dict of
    columns. A column of df with the name of a computed one is replaced. Without keep_text the
    text does not come back from Python. No rows move.
    """
    names = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name not in names or f.name == text_col]
    if text_col in names:
        raise ValueError(f"{text_col} is the input")
    sent = [f.name for f in kept]
    kept = [f for f in kept if keep_text or f.name != text_col]
    out = T.StructType([*kept, *fields])
    keep_names = [f.name for f in kept]

    def run(batches):
        work = make()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for a, b in text_slices(texts):
                columns = work(pc.fill_null(texts.slice(a, b - a), ""))
                part = batch.slice(a, b - a)
                arrays = [part.column(part.schema.get_field_index(n)) for n in keep_names]
                arrays += [
                    x if isinstance(x := columns[n], pa.Array) else pa.array(x) for n in names
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep_names, *names])

    return df.select(*[F.col(f"`{n}`") for n in sent]).mapInArrow(run, out)


def hash_share(*columns: Column) -> Column:
    """A number from 0 to 1 that depends on the values only, to take a repeatable share."""
    return F.pmod(F.xxhash64(*columns), F.lit(1_000_003)) / F.lit(1_000_003.0)
