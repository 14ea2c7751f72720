"""Token ids in flat binary files, written and read by Spark tasks.

Each partition of documents in ascending id order becomes three files:

- part-NNNNN.bin: the ids one after another, unsigned little-endian, 16 bits wide if the
  vocabulary fits and 32 otherwise;
- part-NNNNN.off: 64-bit unsigned number of ids before each document in this part, and the
  part's total at the end;
- part-NNNNN.doc: per document its 64-bit id and one byte that is 0 if the id is null.

The ids before a part (its base) are the prefix sum of the totals of the parts before; the
index of parts, one row each, is the only thing the driver holds. Readers map files on a
local file system into memory and fetch others whole.

A task writes under a name of its own and renames at the end, so a repeated task leaves the
same files. The folder must be on a file system that all executors reach and pyarrow can
write to. Defined cases: a null text has only the end id; a null id sorts first; rows with
the same id follow each other by a hash of their text.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import word_tokens

_DOC = np.dtype([("id", "<i8"), ("known", "u1")])
PART = "part long, n_docs long, n_ids long, width int"


def write(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
) -> list[dict]:
    """Write the files; the parts in order, each with the base of its ids."""

    def run(batches):
        tokens = word_tokens.load(vocabulary)
        part = TaskContext.get().partitionId()
        width = 2 if max(tokens.size() - 1, end_id) < 1 << 16 else 4
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, own = f"{path}/part-{part:05d}", f"{path}/.{uuid.uuid4().hex}"
        kind = np.dtype(f"<u{width}")
        end = np.array([end_id], kind)
        n_docs = n_ids = 0
        with (
            store.open_output_stream(f"{own}.bin") as ids_out,
            store.open_output_stream(f"{own}.off") as off_out,
            store.open_output_stream(f"{own}.doc") as doc_out,
        ):
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = tokens.encode(text.as_py() or "")
                    ids_out.write(ids.astype(kind).tobytes())
                    ids_out.write(end.tobytes())
                    off_out.write(np.uint64(n_ids).tobytes())
                    doc_out.write(np.array([(doc_id or 0, doc_id is not None)], _DOC).tobytes())
                    n_docs += 1
                    n_ids += len(ids) + 1
            off_out.write(np.uint64(n_ids).tobytes())
        for suffix in ("bin", "off", "doc"):
            store.move(f"{own}.{suffix}", f"{name}.{suffix}")
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "n_docs": [n_docs], "n_ids": [n_ids], "width": pa.array([width], pa.int32())}
        )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    order = [F.col("id"), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = sorted((r.asDict() for r in ranged.mapInArrow(run, PART).collect()), key=lambda r: r["part"])
    base = 0
    for p in parts:
        p["base"] = base
        base += p["n_ids"]
    return parts


def _file(store: fs.FileSystem, path: str, kind: np.dtype, count: int) -> np.ndarray:
    if count == 0:
        return np.zeros(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r", shape=(count,))
    with store.open_input_stream(path) as f:
        return np.frombuffer(f.read(), kind, count)


def read(spark: SparkSession, folder: str, parts: list[dict], batch_docs: int = 2000) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for p in batch.to_pylist():
                name = f"{path}/part-{p['part']:05d}"
                ids = _file(store, f"{name}.bin", np.dtype(f"<u{p['width']}"), p["n_ids"])
                offsets = _file(store, f"{name}.off", np.dtype("<u8"), p["n_docs"] + 1)
                docs = _file(store, f"{name}.doc", _DOC, p["n_docs"])
                for a in range(0, p["n_docs"], batch_docs):
                    b = min(a + batch_docs, p["n_docs"])
                    bounds = offsets[a : b + 1].astype(np.int64)
                    crc = [
                        zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(bounds[:-1], bounds[1:])
                    ]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(docs["id"][a:b].astype(np.int64), mask=docs["known"][a:b] == 0),
                            "start": bounds[:-1] + p["base"],
                            "n_tokens": np.diff(bounds),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )

    listed = spark.createDataFrame(
        [(p["part"], p["n_docs"], p["n_ids"], p["width"], p["base"]) for p in parts], PART + ", base long"
    )
    spread = listed.repartition(max(1, len(parts)), "part")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
