"""Order-preserving packing of token streams into windows, by dynamic programming.

Documents follow each other as they come; a cut may fall after a document (free), after a
sentence (SENTENCE_CUT) or, in long sentences, at most every MAX_GAP ids (WORD_CUT). The cost
of a window is its padding, the cost of a cut its penalty:

    cost(j) = min over i with place(j) - place(i) <= SIZE of cost(i) + SIZE - (place(j) - place(i)) + penalty(j)

The minimum of cost(i) + place(i) over the sliding range comes from a monotone queue, so each
possible cut is handled once. A partition is packed in blocks of BLOCK ids; the best cut
within the last window ends a block and what follows it starts the next. The last ids of a
partition are cut into windows whose lengths are powers of two, which take no padding.

No rows move: a partition packs its own documents. Sequence ids are the partition's number
times 2^33 plus a count. Defined cases: a null text is empty and still has its end id;
rows with null or repeated ids are packed like others; a partition without rows has no
sequence.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import word_tokens

SIZE = 2048
SENTENCE_CUT = 4.0
WORD_CUT = 24.0
MAX_GAP = 64
BLOCK = 128 * SIZE


def cut_places(ids: np.ndarray, document_ends: np.ndarray, sentence_end: np.ndarray, max_gap: int = MAX_GAP) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts (number of ids before each) and their penalties; 0 and the end are in."""
    kind = np.full(len(ids) + 1, WORD_CUT)
    free = np.zeros(len(ids) + 1, bool)
    free[1:] = sentence_end[ids]
    kind[free] = SENTENCE_CUT
    free[document_ends] = True
    kind[document_ends] = 0.0
    free[0] = free[-1] = True
    kind[0] = 0.0
    places = np.flatnonzero(free)
    gaps = np.diff(places)
    if (gaps > max_gap).any():
        steps = np.maximum(1, -(-gaps // max_gap))
        begin = np.repeat(places[:-1], steps)
        inner = np.arange(len(begin)) - np.repeat(np.cumsum(steps) - steps, steps)
        places = np.append(begin + inner * max_gap, places[-1])
    return places, kind[places]


def best_cuts(places: np.ndarray, penalties: np.ndarray, size: int = SIZE, to_end: bool = True) -> list[int]:
    """Places at which to cut, the first 0. to_end: the last is the end; else it is the
    cheapest place within the last window."""
    at, pen = places.tolist(), penalties.tolist()
    n = len(at)
    cost, back = [0.0] * n, [0] * n
    queue, keys = deque([0]), [0.0] * n
    keys[0] = float(at[0])
    for j in range(1, n):
        low = at[j] - size
        while at[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        back[j] = i
        cost[j] = keys[i] + size - at[j] + pen[j]
        key = keys[j] = cost[j] + at[j]
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    j = n - 1
    if not to_end:
        last = int(np.searchsorted(places, places[-1] - size, "right"))
        j = last + int(np.argmin(cost[last:]))
    out = [at[j]]
    while j:
        j = back[j]
        out.append(at[j])
    return out[::-1]


def powers_of_two(length: int, size: int = SIZE) -> list[int]:
    """Window lengths for the last ids: full ones, then powers of two, largest first."""
    out = [size] * (length // size)
    rest = length % size
    return out + [1 << b for b in range(size.bit_length(), -1, -1) if rest >> b & 1]


class _Stream:
    """Ids of documents that are not packed yet, and rows of pieces that are."""

    def __init__(self, first_sequence: int, sentence_end: np.ndarray, size: int):
        self.docs: deque[list] = deque()  # [id, all ids, ids already packed]
        self.waiting = 0
        self.sequence = first_sequence
        self.sentence_end = sentence_end
        self.size = size
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append([doc_id, ids, 0])
        self.waiting += len(ids)

    def _take(self, length: int) -> None:
        offset = 0
        while offset < length:
            doc = self.docs[0]
            piece = doc[1][doc[2] : doc[2] + length - offset]
            crc = zlib.crc32(piece.astype("<u4").tobytes())
            self.rows.append((doc[0], doc[2], len(piece), crc, len(doc[1]), self.sequence, offset))
            doc[2] += len(piece)
            offset += len(piece)
            if doc[2] == len(doc[1]):
                self.docs.popleft()
        self.sequence += 1
        self.waiting -= length

    def pack(self, final: bool) -> None:
        if not self.waiting:
            return
        parts = [d[1][d[2] :] for d in self.docs]
        ends = np.cumsum([len(p) for p in parts])
        places, penalties = cut_places(np.concatenate(parts), ends, self.sentence_end)
        cuts = best_cuts(places, penalties, self.size, to_end=False)
        for length in np.diff(cuts).tolist():
            self._take(length)
        if final:
            for length in powers_of_two(self.waiting, self.size):
                self._take(length)


_ROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
PIECES = T.StructType([T.StructField(n, T.LongType()) for n in _ROW.names])


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    end_id: int = 1,
    block: int = BLOCK,
) -> DataFrame:
    """One row per piece: whose ids, from where, how many, in which sequence and where."""

    def run(batches):
        tokens = word_tokens.load(vocabulary)
        stream = _Stream(TaskContext.get().partitionId() << 33, tokens.sentence_ends(), size)
        end = np.array([end_id], np.uint32)

        def flush():
            rows, stream.rows = stream.rows, []
            for a in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows[a : a + 20_000])], schema=_ROW
                )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                stream.add(doc_id, np.concatenate([tokens.encode(text.as_py() or ""), end]))
                if stream.waiting >= block:
                    stream.pack(final=False)
                    yield from flush()
        stream.pack(final=True)
        yield from flush()

    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return chosen.mapInArrow(run, PIECES)
