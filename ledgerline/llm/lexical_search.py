"""Exact ranked lexical search: sparse ball trees over documents, searched best-first.

The score of a document is an inner product: the query's term counts times the document's
entries, weight times saturated frequency. Only terms that some query of the block holds
matter, so these are what a document's vector has.

1. One pass over the texts finds each document's length and the counts of query terms; a
   second, over these, how many documents hold each term.
2. Documents are dealt by ranges of their heaviest terms, so that neighbours resemble each
   other, and cut into tiles of at most TILE_ROWS rows and TILE_CELLS cells.
3. A tile becomes a tree of balls: the documents far apart in a node attract the others,
   down to LEAF_ROWS rows. A node has a centre and, per group of terms, a radius: no member
   lies further from the centre in those terms. Rare terms form one group per query that
   brought them, any other term is a group of its own.
4. A node's bound for a query is query times centre plus, by Cauchy and Schwarz, the sum over
   groups of the query's norm times the radius. It is computed in doubles and raised by more
   than their rounding can take away, so a bound below a score is a proof.
5. Nodes are opened best-first, for all queries that may still gain from them; whatever is below
   the k-th score that a query has so far goes with its whole subtree. Leaves are scored in
   64-bit integers.
6. A sixteenth of the documents is searched first. Its k-th scores are where the search of the
   others begins, in every task.

Queries come in blocks of at most QUERY_ROWS rows and QUERY_CELLS cells (rows times terms), each a
search of its own over all documents: what a task holds does not grow with either table.

Terms are compared by 64-bit hashes.

Defined cases: null and empty texts, and those without a term, are found by nothing and count
nowhere; queries without terms find nothing; repeated rows are found each, one beside the
other; rows without an id come after others of the same score; queries with the same id, or
none, are queries of their own; empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import discard, map_texts, stored
from ledgerline.llm.textscan import Texts, arrow_bytes

TOP = 20
TILE_ROWS, TILE_CELLS = 1024, 1 << 22
LEAF_ROWS = 8
QUERY_ROWS, QUERY_CELLS = 256, 1 << 22
#: Terms that fewer than one in so many documents hold share a group with others of their query.
RARE = 200
#: One in so many documents is searched first.
FIRST_SHARE = 16
#: What a bound is raised by; sums of 2^20 doubles lose less than a part of it.
SLACK = 1e-9

_INSIDE = np.zeros(256, bool)
_INSIDE[128:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _INSIDE[ord(_a) : ord(_b) + 1] = True


class Terms(Texts):
    """A batch of texts with its terms: runs of ASCII letters and digits and of anything
    beyond ASCII, where only A to Z are the same as a to z."""

    def __init__(self, texts: pa.Array):
        self.raw, self.bounds = arrow_bytes(texts)
        self.size = len(texts)
        self._prefix, self._lower = None, True
        self.inside = _INSIDE[self.raw]
        edge = np.zeros(len(self.raw) + 1, bool)
        edge[self.bounds] = True
        before = np.concatenate([[False], self.inside[:-1]]) if len(self.raw) else self.inside
        after = np.concatenate([self.inside[1:], [False]]) if len(self.raw) else self.inside
        self.starts = np.flatnonzero(self.inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(self.inside & (~after | edge[1:])) + 1
        self.word_bounds = np.searchsorted(self.starts, self.bounds)
        self.docs = np.repeat(np.arange(self.size), np.diff(self.word_bounds))


def _counted(docs: np.ndarray, terms: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term) in order, and how often each occurs."""
    keys, counts = np.unique(docs.astype(np.int64) * max(width, 1) + terms, return_counts=True)
    return keys // max(width, 1), keys % max(width, 1), counts


def _lists(values: np.ndarray, docs: np.ndarray, size: int) -> pa.Array:
    bounds = np.searchsorted(docs, np.arange(size + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.astype(np.int32)))


class QueryBlock:
    """The counts of a block's queries over its own vocabulary."""

    def __init__(self, texts: list[str | None]):
        found = Terms(pa.array([t or "" for t in texts], pa.large_string()))
        hashes = found.word_hashes()
        self.vocabulary, of = np.unique(hashes, return_inverse=True)
        rows, terms, counts = _counted(found.docs, of, len(self.vocabulary))
        self.counts = np.zeros((len(texts), len(self.vocabulary)), np.int64)
        self.counts[rows, terms] = counts
        self.sizes = np.bincount(rows, minlength=len(texts))


def query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, QueryBlock]]:
    """The queries in blocks, read one by one; a block has at most QUERY_CELLS cells, or one row."""
    ids, texts, terms = [], [], set()
    for row in queries.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).toLocalIterator():
        own = set(Terms(pa.array([row[1] or ""], pa.large_string())).word_hashes().tolist())
        if ids and (len(ids) == QUERY_ROWS or (len(ids) + 1) * len(terms | own) > QUERY_CELLS):
            yield ids, QueryBlock(texts)
            ids, texts, terms = [], [], set()
        ids.append(row[0])
        texts.append(row[1])
        terms |= own
    if ids:
        yield ids, QueryBlock(texts)


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """docs (id, text) with n (terms), terms (places in the vocabulary) and counts."""

    def make():
        def work(texts: pa.Array) -> dict:
            found = Terms(texts)
            hashes = found.word_hashes()
            at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
            hit = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
            rows, terms, counts = _counted(found.docs[hit], at[hit], len(vocabulary))
            return {
                "n": np.diff(found.word_bounds).astype(np.int64),
                "terms": _lists(terms, rows, found.size),
                "counts": _lists(counts, rows, found.size),
            }

        return work

    fields = [
        T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())),
        T.StructField("counts", T.ArrayType(T.IntegerType())),
    ]
    return map_texts(docs, "text", make, fields).drop("text")


class Scorer:
    """Weights and entries: all that follows from the counts over the whole table."""

    def __init__(self, block: QueryBlock, documents: int, length: int, frequencies: np.ndarray):
        self.documents, self.length = documents, length
        self.weights = np.array(
            [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(f) + 1))) for f in frequencies], np.int64
        )
        self.counts = block.counts
        own = len(block.counts) + np.arange(len(self.weights))
        first = np.argmax(block.counts > 0, axis=0) if len(block.counts) else own
        self.groups = np.where(frequencies * RARE < documents, first, own)

    def entries(self, n: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """n per entry; the document's length."""
        m = 100 - 25 + (25 * n * self.documents) // self.length
        return self.weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 12 * m))


class _Flat:
    """A list column as values and bounds."""

    def __init__(self, column: pa.Array):
        self.bounds = column.offsets.to_numpy().astype(np.int64)
        self.values = column.values.to_numpy().astype(np.int64)[self.bounds[0] : self.bounds[-1]]
        self.bounds = self.bounds - self.bounds[0]


def _batch_entries(batch: pa.RecordBatch, scorer: Scorer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, terms, entries) of a batch's documents."""
    terms = _Flat(batch.column(batch.schema.get_field_index("terms")))
    counts = _Flat(batch.column(batch.schema.get_field_index("counts")))
    n = batch.column(batch.schema.get_field_index("n")).to_numpy()
    return terms.bounds, terms.values, scorer.entries(np.repeat(n, np.diff(terms.bounds)), terms.values, counts.values)


def _neighbours(vectors: DataFrame, scorer: Scorer) -> DataFrame:
    """The documents, sorted by their three heaviest terms."""
    schema = T.StructType([*vectors.schema.fields, *[T.StructField(f"heavy{j}", T.IntegerType()) for j in range(3)]])

    def run(batches):
        for batch in batches:
            bounds, terms, entries = _batch_entries(batch, scorer)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            order = np.lexsort((terms, -entries, rows))
            heavy = np.full((3, batch.num_rows), -1, np.int32)
            for j in range(3):
                there = np.diff(bounds) > j
                heavy[j, there] = terms[order[bounds[:-1][there] + j]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(h) for h in heavy]], schema=pa.schema([*batch.schema, *[pa.field(f"heavy{j}", pa.int32()) for j in range(3)]]))

    keys = ["heavy0", "heavy1", "heavy2", F.xxhash64("id", "n")]
    return vectors.mapInArrow(run, schema).repartitionByRange(*keys).sortWithinPartitions(*keys)


class Tile:
    """Documents of one tile as a ball tree."""

    def __init__(self, scorer: Scorer, bounds: np.ndarray, terms: np.ndarray, entries: np.ndarray):
        size = len(bounds) - 1
        self.local, columns = np.unique(terms, return_inverse=True)
        order = np.argsort(scorer.groups[self.local], kind="stable")
        self.local = self.local[order]
        columns = np.argsort(order)[columns]
        groups = scorer.groups[self.local]
        self.cuts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        rows = np.repeat(np.arange(size), np.diff(bounds))
        dense = np.zeros((size, len(self.local)))
        dense[rows, columns] = entries
        self.order = np.arange(size)
        self.nodes: list[tuple[int, int, int, int]] = []  # begin, end, left, right
        rough = dense.astype(np.float32)
        self._split(rough, (rough * rough).sum(1), 0, size)
        del rough
        dense = dense[self.order]
        lows, highs = [None] * len(self.nodes), [None] * len(self.nodes)
        self.centres = np.empty((len(self.nodes), len(self.local)))
        self.radii = np.empty((len(self.nodes), len(self.cuts)))
        for i in range(len(self.nodes) - 1, -1, -1):  # children come after their parent
            begin, end, left, right = self.nodes[i]
            if left < 0:
                lows[i], highs[i] = dense[begin:end].min(0), dense[begin:end].max(0)
            else:
                lows[i], highs[i] = np.minimum(lows[left], lows[right]), np.maximum(highs[left], highs[right])
                lows[left] = lows[right] = highs[left] = highs[right] = None
            self.centres[i] = (lows[i] + highs[i]) / 2
            if left < 0:
                away = np.square(dense[begin:end] - self.centres[i])
                far = np.add.reduceat(away, self.cuts, axis=1).max(0)
            else:
                far = np.add.reduceat(np.square((highs[i] - lows[i]) / 2), self.cuts)
            self.radii[i] = np.sqrt(far)
        sizes = np.diff(bounds)[self.order]
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(bounds[:-1][self.order] - self.bounds[:-1], sizes) + np.arange(self.bounds[-1])
        self.columns, self.entries = columns[take], entries[take]

    def _split(self, rough: np.ndarray, norms: np.ndarray, begin: int, end: int) -> int:
        """Order the documents from begin to end so that nodes are stretches of them."""
        at = len(self.nodes)
        self.nodes.append((begin, end, -1, -1))
        if end - begin <= LEAF_ROWS:
            return at
        here = self.order[begin:end]
        members, own = rough[here], norms[here]
        one = members[np.argmax(own - 2 * (members @ members.mean(0)))]
        other = members[np.argmax(own - 2 * (members @ one))]
        towards = members @ (other - one) - (other @ other - one @ one) / 2
        del members
        ranks = np.argsort(towards, kind="stable")
        middle = int((towards < 0).sum())
        if min(middle, len(here) - middle) * 8 < len(here):
            middle = len(here) // 2
        self.order[begin:end] = here[ranks]
        left = self._split(rough, norms, begin, begin + middle)
        right = self._split(rough, norms, begin + middle, end)
        self.nodes[at] = (begin, end, left, right)
        return at


class _Best:
    """The best documents of every query so far, and the score that others must reach."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.found: list[list[tuple]] = [[] for _ in range(queries)]

    def add(self, query: int, scores: np.ndarray, ids: list) -> None:
        mine = self.found[query]
        mine += [(-s, i is None, i) for s, i in zip(scores.tolist(), ids, strict=True)]
        if len(mine) >= 4 * self.k:
            self.cut(query)

    def cut(self, query: int) -> None:
        mine = self.found[query]
        mine.sort(key=lambda x: x[:2] if x[1] else x)
        del mine[self.k :]
        if len(mine) == self.k:
            self.least[query] = max(self.least[query], -mine[-1][0])


def search_tile(tile: Tile, scorer: Scorer, ids: list, best: _Best) -> int:
    """Open the tile's nodes best-first; how many (document, query) pairs were scored."""
    local = scorer.counts[:, tile.local]
    wide = local.astype(np.float64)
    norms = np.sqrt(np.add.reduceat(np.square(wide), tile.cuts, axis=1))

    def bounds(node: int, queries: np.ndarray) -> np.ndarray:
        return (wide[queries] @ tile.centres[node] + norms[queries] @ tile.radii[node]) * (1 + SLACK) + 1

    everyone = np.flatnonzero(wide.any(1))
    heap, scored = [], 0

    def push(node: int, queries: np.ndarray) -> None:
        if len(queries):
            reach = bounds(node, queries)
            alive = reach >= best.least[queries]
            if alive.any():
                reach, queries = reach[alive], queries[alive]
                heapq.heappush(heap, (-float((reach / best.least[queries]).max()), node, queries, reach))

    push(0, everyone)
    while heap:
        _, node, queries, reach = heapq.heappop(heap)
        queries = queries[reach >= best.least[queries]]
        if not len(queries):
            continue
        begin, end, left, right = tile.nodes[node]
        if left >= 0:
            push(left, queries)
            push(right, queries)
            continue
        a, b = tile.bounds[begin], tile.bounds[end]
        products = local[queries][:, tile.columns[a:b]] * tile.entries[a:b]
        scores = np.add.reduceat(products, tile.bounds[begin:end] - a, axis=1)
        scored += scores.size
        for i in np.flatnonzero((scores >= best.least[queries, None]).any(1)):
            query = queries[i]
            good = np.flatnonzero(scores[i] >= best.least[query])
            best.add(query, scores[i, good], [ids[tile.order[begin + j]] for j in good])
    return scored


def _tiles(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[tuple[Tile, list]]:
    for batch in batches:
        bounds, terms, entries = _batch_entries(batch, scorer)
        ids = batch.column(batch.schema.get_field_index("id")).to_pylist()
        waiting = [(a, min(a + TILE_ROWS, len(ids))) for a in range(0, len(ids), TILE_ROWS)][::-1]
        while waiting:
            a, b = waiting.pop()
            mine = terms[bounds[a] : bounds[b]]
            if b - a > 1 and (b - a) * len(np.unique(mine)) > TILE_CELLS:
                middle = (a + b) // 2
                waiting += [(middle, b), (a, middle)]
                continue
            yield Tile(scorer, bounds[a : b + 1] - bounds[a], mine, entries[bounds[a] : bounds[b]]), ids[a:b]


def _found(vectors: DataFrame, scorer: Scorer, k: int, least: np.ndarray) -> DataFrame:
    """Per task, the best k documents of each query that reach its least score."""
    id_type = vectors.schema["id"].dataType
    out = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("id", id_type), T.StructField("score", T.LongType())])

    def run(batches):
        best = _Best(len(scorer.counts), k, least)
        for tile, ids in _tiles(batches, scorer):
            search_tile(tile, scorer, ids, best)
        for query in range(len(scorer.counts)):
            best.cut(query)
            rows = best.found[query]
            if rows:
                yield pa.RecordBatch.from_pylist([{"query": query, "id": i, "score": -s} for s, _, i in rows], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    return _neighbours(vectors, scorer).mapInArrow(run, out)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, block: QueryBlock, k: int) -> DataFrame:
    vectors = stored(term_counts(docs, block.vocabulary).where("n > 0"), "terms")
    totals = vectors.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    frequencies = np.zeros(len(block.vocabulary), np.int64)
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        frequencies[row[0]] = row[1]
    scorer = Scorer(block, totals["documents"], totals["length"] or 1, frequencies)
    held = vectors.where(F.size("terms") > 0)
    first = F.pmod(F.xxhash64("id", "n", F.lit("first")), F.lit(FIRST_SHARE)) == 0
    least = np.ones(len(block.counts), np.int64)
    some = stored(_found(held.where(first), scorer, k, least), "found")
    for row in _ranked(some, k).where(F.col("rank") == k).select("query", "score").collect():
        least[row["query"]] = row["score"]
    rest = stored(_found(held.where(~first), scorer, k, least), "found")
    result = stored(_ranked(some.unionByName(rest), k), "ranked")
    discard(vectors, some, rest)
    return result


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id_col: str = "item_id",
    query_text_col: str = "text",
) -> DataFrame:
    """(query_id_col, rank, id_col, score): the k best documents of each query, best first."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_field, query_field = docs.schema[id_col], queries.schema[query_id_col]
    of = T.StructType([T.StructField("of", T.IntegerType()), T.StructField("query_id", query_field.dataType)])
    parts = []
    for ids, block in query_blocks(queries, query_id_col, query_text_col):
        names = spark.createDataFrame(list(enumerate(ids)), of)
        found = _search_block(narrow, block, k)
        parts.append(found.join(names, F.col("query") == F.col("of")).select("query_id", "rank", "id", "score"))
    if not parts:
        parts.append(spark.createDataFrame([], T.StructType([T.StructField("query_id", query_field.dataType), T.StructField("rank", T.IntegerType()), T.StructField("id", id_field.dataType), T.StructField("score", T.LongType())])))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select(
        F.col("query_id").alias(query_id_col), "rank", F.col("id").alias(id_col), "score"
    )
