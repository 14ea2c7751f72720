"""Merkle manifest of a dataset, with proofs expanded from one multiproof per leaf partition.

Each group's leaves, in key order, are the bottom of a tree whose nodes take FAN consecutive
ones; a run at the end has fewer. The groups' roots, in group order, form one more tree, whose
root stands for the dataset.

A leaf partition is a stretch of at most CHUNK_ROWS leaves in (group, key) order; it may end one
group, hold others whole and begin the next. Octopus multiproof: level by level, the
coordinates known to the partition lead to those of their parents; children of these that it
does not know are missing, and nothing else. The union of what all its leaves miss is
fetched in one join, at most 2 (FAN - 1) nodes a level and group it cuts, shared interior nodes are derived
once, and each leaf's own proof is read off them from the top down.

Nodes are made in the same stretches: a partition derives every node all of whose leaves it
holds and hands on those whose parent it cannot make. Nodes over several partitions follow
in rounds of ROUND_LEVELS levels, so that a round's group has at most FAN ** ROUND_LEVELS nodes.

Defined cases: nulls have digests of their own; rows with the same key stand in order of their
digests, repeated rows next to each other, each a leaf; a null key comes first, a null group is
the first group; an empty table gives no rows and no root; a table of one row has that leaf as
its root and an empty proof. Texts of any length cost one digest. Other columns of the table play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import discard, stored
from ledgerline.llm.ranks import ranked

FAN = 3
CHUNK_ROWS = 1 << 14
ROUND_LEVELS = 8
#: Number of the tree over the groups' roots.
TOP = -1

_NODES = "tree long, level int, at long, digest binary"
_FOUND = f"chunk long, missing boolean, {_NODES}"


def digest_of(*values: Column) -> Column:
    """Lowercase hex digest of a row: each value as byte count, colon and text; null as a dash."""
    texts = [v.cast("string") for v in values]
    return F.sha2(
        F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256
    )


def parent_digest(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def level_sizes(leaves: int) -> list[int]:
    """How many nodes each level of a tree has, from the leaves to the root."""
    sizes = [int(leaves)]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


def missing_nodes(known: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(level, coordinates) of the fewest nodes that, with the leaves at the known places,
    give the root: per level, the children of known parents that are not known themselves."""
    for level, size in enumerate(sizes[:-1]):
        parents = np.unique(known // FAN)
        children = (parents[:, None] * FAN + np.arange(FAN)).ravel()
        yield level, np.setdiff1d(children[children < size], known, assume_unique=True)
        known = parents


def _whole_nodes(first: int, digests: list[bytes], sizes: list[int], every: bool) -> Iterator[tuple[int, int, bytes]]:
    """(level, place, digest) of nodes made of consecutive leaves only: those whose parent
    is not such a node, or all of them."""
    for level, size in enumerate(sizes):
        end = first + len(digests)
        low = -(-first // FAN)
        high = -(-size // FAN) if end == size else end // FAN
        top = level == len(sizes) - 1
        if top or low >= high:
            yield from ((level, first + i, d) for i, d in enumerate(digests))
            return
        for i, d in enumerate(digests):
            if every or not low <= (first + i) // FAN < high:
                yield level, first + i, d
        digests = [parent_digest(digests[p * FAN - first : (p + 1) * FAN - first]) for p in range(low, high)]
        first = low


def _runs(table: pa.Table) -> tuple[pa.Table, list[tuple[int, int, int, int, int]]]:
    """The rows in order, and (tree, leaves of the tree, first place, begin, end) of each run."""
    table = table.sort_by([("tree", "ascending"), ("place", "ascending")]).combine_chunks()
    trees = table.column("tree").to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], trees[1:] != trees[:-1]]))
    ends = np.append(begins[1:], len(trees))
    places, leaves = table.column("place").to_numpy(), table.column("leaves").to_numpy()
    return table, [(int(trees[a]), int(leaves[a]), int(places[a]), int(a), int(b)) for a, b in zip(begins, ends, strict=True)]


def _partition_nodes(leaves: DataFrame, every: bool) -> DataFrame:
    """Per leaf partition, the nodes it hands on and the coordinates it misses.

    leaves: chunk, tree, leaves (of the tree), trees (of the table), place, leaf."""

    def work(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        trees = table.column("trees")[0].as_py()
        table, runs = _runs(table)
        digests = table.column("leaf").to_pylist()
        out = []
        for tree, size, first, a, b in runs:
            sizes = level_sizes(size)
            out += [(False, tree, *node) for node in _whole_nodes(first, digests[a:b], sizes, every)]
            for level, places in missing_nodes(np.arange(first, first + b - a), sizes):
                out += [(True, tree, level, int(p), None) for p in places]
        if runs[0][0] != TOP:
            held = np.arange(runs[0][0], runs[-1][0] + 1)
            for level, places in missing_nodes(held, level_sizes(trees)):
                out += [(True, TOP, level, int(p), None) for p in places]
        missing, tree, level, at, digest = zip(*out, strict=True) if out else [()] * 5
        return pa.table(
            {
                "chunk": pa.array([chunk] * len(out), pa.int64()), "missing": pa.array(missing, pa.bool_()),
                "tree": pa.array(tree, pa.int64()), "level": pa.array(level, pa.int32()),
                "at": pa.array(at, pa.int64()), "digest": pa.array(digest, pa.binary()),
            }
        )

    return leaves.groupBy("chunk").applyInArrow(work, _FOUND)


def _round(nodes: DataFrame, floor: int) -> DataFrame:
    """Nodes up to level floor + ROUND_LEVELS that nodes below it make."""
    top = floor + ROUND_LEVELS

    def work(table: pa.Table) -> pa.Table:
        tree, leaves = table.column("tree")[0].as_py(), table.column("leaves")[0].as_py()
        sizes = level_sizes(leaves)
        known: dict[int, dict[int, bytes]] = {}
        rows = zip(table.column("level").to_pylist(), table.column("at").to_pylist(), table.column("digest").to_pylist(), strict=True)
        for level, at, digest in rows:
            known.setdefault(level, {})[at] = digest
        made = []
        for level in range(floor, min(top, len(sizes) - 1)):
            here = known.get(level, {})
            for parent in sorted({at // FAN for at in here}):
                children = range(parent * FAN, min((parent + 1) * FAN, sizes[level]))
                digest = parent_digest([here[c] for c in children])
                known.setdefault(level + 1, {})[parent] = digest
                made.append((level + 1, parent, digest))
        level, at, digest = zip(*made, strict=True) if made else [()] * 3
        return pa.table(
            {
                "tree": pa.array([tree] * len(made), pa.int64()), "level": pa.array(level, pa.int32()),
                "at": pa.array(at, pa.int64()), "digest": pa.array(digest, pa.binary()),
            }
        )

    above = F.expr(f"at div cast(pow({FAN}, {top} - level) as bigint)")
    return nodes.groupBy("tree", above.alias("above")).applyInArrow(work, _NODES)


def _joined_nodes(found: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """All nodes that lie over several leaf partitions, beside those handed on."""
    whole = found.where("not missing").select("tree", "level", "at", "digest")
    nodes, fresh = whole, None
    for floor in range(0, max(len(level_sizes(most)) - 1, 0), ROUND_LEVELS):
        part = F.col("level").between(floor, floor + ROUND_LEVELS - 1)
        below = whole.where(part)
        if fresh is not None:
            below = below.unionByName(fresh.where(part))
        of = sizes.select(F.col("tree").alias("of"), "leaves")
        fresh = stored(_round(below.join(of, F.col("tree") == F.col("of")).drop("of"), floor), "nodes")
        nodes = nodes.unionByName(fresh)
    return nodes


def fold(leaf: bytes, steps: str, proof: str) -> bytes:
    """The root that a leaf and its proof give."""
    node, at = leaf.hex(), 0
    for step in steps.split():
        place, run = map(int, step.split("/"))
        before = at + 64 * place
        at_end = at + 64 * (run - 1)
        node = hashlib.sha256((proof[at:before] + node + proof[before:at_end]).encode()).hexdigest()
        at = at_end
    return bytes.fromhex(node)


class _Multiproof:
    """A tree's nodes as far as one partition needs them, and the proofs read off them."""

    def __init__(self, sizes: list[int], first: int, digests: list[bytes], fetched: dict[tuple[int, int], bytes]):
        self.sizes, self.levels = sizes, [{first + i: d.hex() for i, d in enumerate(digests)}]
        for level, size in enumerate(sizes[:-1]):
            here = self.levels[level]
            above = {}
            for parent in {at // FAN for at in here}:
                run = range(parent * FAN, min((parent + 1) * FAN, size))
                for at in run:
                    if at not in here:
                        here[at] = fetched[level, at].hex()
                above[parent] = hashlib.sha256("".join([here[at] for at in run]).encode()).hexdigest()
            self.levels.append(above)
        self.root = bytes.fromhex(self.levels[-1][0])
        self._known: dict[tuple[int, int], tuple[str, str]] = {}

    def proof(self, at: int, level: int = 0) -> tuple[str, str]:
        """(steps, siblings) from a node to the root; those of inner nodes are kept."""
        if level == len(self.sizes) - 1:
            return "", ""
        found = self._known.get((level, at))
        if found is None:
            parent = at // FAN
            run = range(parent * FAN, min((parent + 1) * FAN, self.sizes[level]))
            siblings = "".join([self.levels[level][i] for i in run if i != at])
            steps, rest = self.proof(parent, level + 1)
            found = (f"{at - run[0]}/{len(run)} {steps}", siblings + rest)
            if level:
                self._known[level, at] = found
        return found


def _expanded(leaves: DataFrame, fetched: DataFrame, key_type: str) -> DataFrame:
    """Proof, roots and folded root of every leaf."""
    out = f"key {key_type}, leaf binary, subroot binary, root binary, steps string, proof string, folded_root binary"

    def work(table: pa.Table, nodes: pa.Table) -> pa.Table:
        have: dict[int, dict[tuple[int, int], bytes]] = {}
        columns = [nodes.column(c).to_pylist() for c in ("tree", "level", "at", "digest")]
        for tree, level, at, digest in zip(*columns, strict=True):
            have.setdefault(tree, {})[level, at] = digest
        table, runs = _runs(table)
        digests, shown = table.column("leaf").to_pylist(), table.column("shown").to_pylist()
        trees = [
            _Multiproof(level_sizes(size), first, digests[a:b], have.get(tree, {})) for tree, size, first, a, b in runs
        ]
        count = table.column("trees")[0].as_py()
        top = _Multiproof(level_sizes(count), runs[0][0], [t.root for t in trees], have.get(TOP, {}))
        subroots, steps, proofs, folded = [], [], [], []
        for (tree, _, first, a, b), own in zip(runs, trees, strict=True):
            top_steps, top_proof = top.proof(tree)
            for i in range(a, b):
                own_steps, own_proof = own.proof(first + i - a)
                steps.append((own_steps + top_steps).rstrip())
                proofs.append(own_proof + top_proof)
                folded.append(fold(digests[i] if shown[i] is None else shown[i], steps[-1], proofs[-1]))
                subroots.append(own.root)
        return pa.table(
            {
                "key": table.column("key"), "leaf": table.column("leaf"), "subroot": pa.array(subroots, pa.binary()),
                "root": pa.array([top.root] * len(folded), pa.binary()), "steps": pa.array(steps, pa.string()),
                "proof": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.binary()),
            }
        )

    return leaves.groupBy("chunk").cogroup(fetched.groupBy("chunk")).applyInArrow(work, out)


def prove(
    rows: DataFrame, leaf: Column, shown: Column | None = None, key_col: str = "doc_id", group_col: str = "source"
) -> DataFrame:
    """One row per row: key_col, leaf, subroot, root, steps, proof and folded_root, digests as hex.

    leaf is a row's digest; shown the one that a checker would compute from the row it was
    given, if another: folded_root is the root that it reaches with the row's proof. steps has,
    for each level, the node's place in its run and the run's length; proof the siblings."""
    hidden = F.unhex(leaf)
    given = F.lit(None).cast("binary") if shown is None else F.unhex(shown)
    leaves = stored(
        rows.select(
            F.col(f"`{key_col}`").alias("key"), F.col(f"`{group_col}`").alias("group"), hidden.alias("leaf"), given.alias("shown")
        ).withColumn("row", F.monotonically_increasing_id()),
        "leaves",
    )
    placed = ranked(leaves, ["group"], ["key", "leaf", "row"], "placed")
    groups = stored(
        ranked(leaves.groupBy("group").agg(F.count(F.lit(1)).alias("leaves")), [], ["group"], "groups").select(
            "group", "leaves", F.col("place").alias("tree")
        ),
        "trees",
    )
    counts = groups.agg(F.count(F.lit(1)).alias("trees"), F.max("leaves").alias("most")).first()
    of = groups.select(F.col("group").alias("of"), "leaves", "tree", F.lit(counts["trees"]).alias("trees"))
    chunk = F.shiftleft(F.col("part").cast("long"), 33) + F.floor(F.col("part_row") / CHUNK_ROWS)
    table = stored(
        placed.join(of, F.col("group").eqNullSafe(F.col("of"))).select(
            chunk.alias("chunk"), "tree", "leaves", "trees", "place", "key", "leaf", "shown"
        ),
        "chunks",
    )
    discard(leaves)
    inner = ["chunk", "tree", "leaves", "trees", "place", "leaf"]
    found = stored(_partition_nodes(table.select(*inner), every=False), "found")
    nodes = _joined_nodes(found, groups.select("tree", "leaves"), counts["most"] or 0)
    roots = nodes.where("at = 0").groupBy("tree").agg(F.max_by("digest", "level").alias("leaf"))
    subroots = stored(
        roots.select(
            F.floor(F.col("tree") / CHUNK_ROWS).alias("chunk"), F.lit(TOP).cast("long").alias("tree"),
            F.lit(counts["trees"]).alias("leaves"), F.lit(counts["trees"]).alias("trees"),
            F.col("tree").alias("place"), "leaf",
        ),
        "subroots",
    )
    top_found = stored(_partition_nodes(subroots, every=True), "found")
    one = subroots.sparkSession.createDataFrame([(TOP, counts["trees"])], "tree long, leaves long")
    top_nodes = _joined_nodes(top_found, one, counts["trees"])
    wanted = found.where("missing").select("chunk", F.col("tree").alias("t"), F.col("level").alias("l"), F.col("at").alias("p"))
    everything = nodes.unionByName(top_nodes)
    fetched = stored(
        wanted.join(everything, (F.col("t") == F.col("tree")) & (F.col("l") == F.col("level")) & (F.col("p") == F.col("at")))
        .select("chunk", "tree", "level", "at", "digest"),
        "fetched",
    )
    key_type = leaves.schema["key"].dataType.simpleString()
    out = _expanded(table.select(*inner, "key", "shown"), fetched, key_type)
    text = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "folded_root")}
    return out.withColumns(text).withColumnRenamed("key", key_col)
