"""Exact Jaccard join of word shingles by groups and their token unions.

1. Equal sets form one class; all further work is on classes.
2. Grouping: classes that share two of four min-hashes with the smallest class that has
   them form groups with it. Then, ROUNDS times, the sketch of each class (one bit a token or
   two, the parity of the tokens that fall there) is compared with that of the one class of
   another group that it shares most with; if they are at least LOOSE percent alike, as far as
   sketches tell, their groups become one. Any partition gives the same links; a good one
   gives them sooner.
3. Token-group matrix: a set's tokens are ordered rarest first (a count sketch over all
   sets gives the order) and the first n - ceil(t n) + 1 form its prefix. Sets of
   similarity t share a prefix token, so only groups that share one with a query can hold a
   partner. The matrix has, per prefix token, the groups whose union holds it.
4. Bound: how many prefix tokens a query shares with a group's union limits the overlap
   with any member, and bits of the query's sketch that no member has limit it again. A query
   that may reach the overlap needed opens the group and visits it; groups without visitors
   and with one member stay closed.
5. Few members and visitors of an open group are compared by one task. More of them are
   written as differences from the group's core, the tokens that most of (a sample of) its members hold. The distance of two sets is
   that of their differences, so two sets near the core are linked without being compared,
   and others are linked only by tokens that both differences hold: those are counted,
   unless the tokens a set shares with any other of the group are too few for that.

Steps 3 to 5 cover every pair in different groups and step 5 every pair in one, so no link
that joins components is lost. Copies cost one row each, and texts near a core one link; no
step emits the pairs within a group. The count sketch and the filters have fixed sizes; what
they let through is settled by exact joins.

Sets are compared by 64-bit hashes of their shingles, classes by a 64-bit hash of the set.

Defined cases: null, empty and blank texts have empty sets, link with nothing and are their
own component; fewer words than a shingle has form one shingle; rows with the same or a
null id are each rows of their own; a component's id is its smallest known id (null if all
are null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.bitmaps import Bloom, bloom_of, merged
from ledgerline.llm.common import discard, stored, text_slices
from ledgerline.llm.graph import components
from ledgerline.llm.textscan import Texts, mix

KEYS = 4
SHARED_KEYS = 2
ROUNDS = 2
LOOSE = 60  # percent; groups of texts this much alike become one
CORE_MEMBERS = 15  # members, on average, that a large group's core is taken from
SKETCH = 1 << 19  # counters in each of two rows
TOKEN_BITS, CLASS_BITS = 25, 25
FEW_SETS, FEW_TOKENS = 64, 1 << 20  # a group of at most so many is compared by one task, pair by pair

_SEEDS = mix(np.arange(1, KEYS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class _Sets:
    """The shingle sets of a batch of texts."""

    def __init__(self, texts: pa.Array, words: int):
        self.tokens, self.bounds = Texts(texts.fill_null(""), lower=True).shingles(words)
        self.sizes = np.diff(self.bounds)
        self.full = np.flatnonzero(self.sizes)
        if not len(self.full):
            self.cls = np.zeros(len(texts), np.int64)
            return
        starts = self.bounds[:-1][self.full]
        total = np.add.reduceat(mix(self.tokens + np.uint64(1)), starts)
        cls = np.zeros(len(texts), np.uint64)
        cls[self.full] = mix(total + self.sizes[self.full].astype(np.uint64))
        self.cls = cls.view(np.int64)

    def keys(self) -> np.ndarray:
        """KEYS min-hashes of each non-empty set."""
        starts = self.bounds[:-1][self.full]
        out = np.empty((len(self.full), KEYS), np.uint64)
        for j, seed in enumerate(_SEEDS):
            out[:, j] = mix(np.minimum.reduceat(mix(self.tokens ^ seed), starts) ^ seed)
        return out.view(np.int64)

    def fresh(self, seen: set) -> np.ndarray:
        """Places of non-empty sets that this task has not met before."""
        out = []
        for d in self.full:
            c = int(self.cls[d])
            if c not in seen:
                seen.add(c)
                out.append(d)
        return np.array(out, np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.view(np.int64)))


def _sketch_bits(n: np.ndarray) -> np.ndarray:
    """The power of two from n on, a word at least: as many bits as a set of n tokens gets."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def _parities(tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words per set): a set's bit tells whether an odd number of its tokens fall there.
    Two sets differ in at least as many tokens as bits; one half XOR the other is the sketch of
    half the size."""
    size = _sketch_bits(n)
    begin = np.cumsum(size) - size
    at = np.repeat(begin, n) + (tokens & np.repeat(size - 1, n).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(size.sum())) & 1).astype(bool)
    return np.packbits(odd, bitorder="little").view(np.uint64), size // 64


def least_overlap(n, percent: int):
    return (n * percent + 99) // 100


def _sketch(rows: DataFrame, words: int) -> np.ndarray:
    """In how many sets a token occurs, at most: two rows of counters."""

    def fill(batches):
        counts, seen = np.zeros(2 * SKETCH, np.int32), set()
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                sets = _Sets(batch.column(1).slice(a, b - a), words)
                new = sets.fresh(seen)
                if len(new):
                    tokens = sets.tokens[_ranges(sets.bounds[new], sets.sizes[new])]
                    for row, at in enumerate(_cells(tokens)):
                        counts[row * SKETCH : (row + 1) * SKETCH] += np.bincount(at, minlength=SKETCH).astype(np.int32)
        return counts

    return merged(rows, fill, 2 * SKETCH, "i4", add=True)


def _cells(tokens: np.ndarray):
    yield (tokens & np.uint64(SKETCH - 1)).astype(np.int64)
    yield ((tokens >> np.uint64(32)) & np.uint64(SKETCH - 1)).astype(np.int64)


def _scan(rows: DataFrame, sketch: np.ndarray, words: int, percent: int) -> DataFrame:
    """Per row: id, n, cls; for the first row of a class in its task also keys, prefix, the
    place of the prefix's last token in the order, and parity, the sketch of the set."""
    usual = max(1.0, sketch[:SKETCH].mean())
    rare = np.maximum(0, np.floor(np.log2(np.maximum(sketch, 1) / usual))).astype(np.uint64)
    sent = rows.sparkSession.sparkContext.broadcast(rare.astype(np.uint8))  # 2 * SKETCH bytes

    def run(batches):
        level, seen = sent.value, set()
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                sets = _Sets(batch.column(1).slice(a, b - a), words)
                new = sets.fresh(seen)
                size = len(sets.sizes)
                own = np.zeros(size, bool)
                own[new] = True
                keys = np.zeros(size * KEYS, np.int64)
                prefix = parity = np.zeros(0, np.uint64)
                kept, last, held = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
                if len(new):
                    keys = sets.keys()[np.searchsorted(sets.full, new)].ravel()
                    n = sets.sizes[new]
                    tokens = sets.tokens[_ranges(sets.bounds[new], n)]
                    one, two = _cells(tokens)
                    rank = np.minimum(level[one], level[SKETCH + two]).astype(np.uint64)
                    place = (rank << np.uint64(58)) | (tokens >> np.uint64(6))
                    order = np.lexsort((place, np.repeat(np.arange(len(new)), n)))
                    kept[new] = n - least_overlap(n, percent) + 1
                    last[new] = place[order][np.cumsum(n) - n + kept[new] - 1].astype(np.int64)
                    prefix = tokens[order][_ranges(np.cumsum(n) - n, kept[new])]
                    parity, held[new] = _parities(tokens, n)
                else:
                    keys = keys[:0]
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column(0).slice(a, b - a),
                        "n": sets.sizes.astype(np.int64),
                        "cls": pa.array(sets.cls, mask=sets.sizes == 0),
                        "keys": _lists(keys, np.where(own, KEYS, 0)),
                        "prefix": _lists(prefix, kept),
                        "last": last,
                        "parity": _lists(parity, held),
                    }
                )

    return rows.mapInArrow(
        run, "id long, n long, cls long, keys array<long>, prefix array<long>, last long, parity array<long>"
    )


def _pair(cls: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix(cls.view(np.uint64) ^ mix(ids.astype(np.int64).view(np.uint64))).view(np.int64)


def _fetch(rows: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(cls, tokens) for needed(cls, id), where id (0 for none) names a row that has the set.
    Sets are made again from the texts: once per class, but for what the filter and
    repeated ids let through beyond that."""
    bits = bloom_of(
        needed.select("cls", "id"), CLASS_BITS, lambda b: _pair(b.column(0).to_numpy(), b.column(1).to_numpy())
    ).bytes
    sent = rows.sparkSession.sparkContext.broadcast(bits)  # 2^CLASS_BITS bits

    def run(batches):
        bloom = Bloom(CLASS_BITS, sent.value)
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            for a, b in text_slices(batch.column(1)):
                sets = _Sets(batch.column(1).slice(a, b - a), words)
                hit = sets.full[bloom.has(_pair(sets.cls[sets.full], ids[a:b][sets.full]))]
                if len(hit):
                    n = sets.sizes[hit]
                    yield pa.RecordBatch.from_pydict(
                        {"cls": sets.cls[hit], "tokens": _lists(sets.tokens[_ranges(sets.bounds[hit], n)], n)}
                    )

    return rows.select("id", "text").mapInArrow(run, "cls long, tokens array<long>")


def _sketches(scan: DataFrame, needed: DataFrame) -> DataFrame:
    """(cls, parity) of the classes in needed(cls), and of few others; a class may come back
    several times, with the same sketch."""
    sent = scan.sparkSession.sparkContext.broadcast(bloom_of(needed.select("cls"), CLASS_BITS).bytes)

    def run(batches):
        bloom = Bloom(CLASS_BITS, sent.value)
        for batch in batches:
            hit = pa.array(np.flatnonzero(bloom.has(batch.column(0).to_numpy())))
            yield pa.RecordBatch.from_arrays([c.take(hit) for c in batch.columns], names=["cls", "parity"])

    return scan.where(F.size("parity") > 0).select("cls", "parity").mapInArrow(run, "cls long, parity array<long>")


def _halved(words: str) -> str:
    half = f"cast(size({words}) / 2 as int)"
    return f"zip_with(slice({words}, 1, {half}), slice({words}, {half} + 1, {half}), (x, y) -> x ^ y)"


def _alike(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity, as far as their sketches tell, is at least percent / 100.
    d tokens that differ leave (1 - exp(-2 d / m)) m / 2 of m bits different, on average."""
    left = sketches.select(F.col("cls").alias("a"), F.col("parity").alias("pa"))
    right = sketches.select(F.col("cls").alias("b"), F.col("parity").alias("pb"))
    apart = "aggregate(zip_with(wa, wb, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)"
    differ = f"{100 - percent} * (na + nb) / {100 + percent}"
    return (
        pairs.select("a", "b", "na", "nb").join(left, "a").join(right, "b")
        .where("size(pa) <= 2 * size(pb) and size(pb) <= 2 * size(pa)")
        .withColumn("wa", F.expr(f"if(size(pa) > size(pb), {_halved('pa')}, pa)"))
        .withColumn("wb", F.expr(f"if(size(pb) > size(pa), {_halved('pb')}, pb)"))
        .where(f"{apart} <= 32 * size(wa) * (1 - exp(-({differ}) / (32 * size(wa))))")
        .select("a", "b").distinct()
    )


def _near_sizes(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _prefixes_of(scan: DataFrame, groups: DataFrame, nodes: Broadcast) -> DataFrame:
    """(cls, n, last, grp, prefix) of the classes in groups(node, root), and of few others; nodes
    are the bits of a filter of the groups' nodes."""

    def run(batches):
        bloom = Bloom(CLASS_BITS, nodes.value)
        for batch in batches:
            yield batch.take(pa.array(np.flatnonzero(bloom.has(batch.column(0).to_numpy()))))

    columns = scan.where(F.size("prefix") > 0).select("cls", "n", "last", "prefix")
    return (
        columns.mapInArrow(run, "cls long, n long, last long, prefix array<long>")
        .join(groups.select(F.col("node").alias("cls"), F.col("root").alias("grp")), "cls", "left")
        .select("cls", "n", "last", F.coalesce("grp", "cls").alias("grp"), "prefix")
    )


def _prefix_tokens(scan: DataFrame, joined: DataFrame, nodes: Broadcast, columns: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """token and columns of (cls, n, last, grp): the prefixes' tokens, or those of them in wanted and
    few others. Most classes are groups of their own: only the others' prefixes have been joined."""
    bits = None if wanted is None else scan.sparkSession.sparkContext.broadcast(bloom_of(wanted, TOKEN_BITS).bytes)

    def tokens(alone: bool):
        def run(batches):
            bloom = None if bits is None else Bloom(TOKEN_BITS, bits.value)
            known = Bloom(CLASS_BITS, nodes.value)
            for batch in batches:
                if alone:
                    batch = batch.take(pa.array(np.flatnonzero(~known.has(batch.column(0).to_numpy()))))
                lists = batch.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                if bloom is not None:
                    hit = np.flatnonzero(bloom.has(flat))
                    flat, row = flat[hit], row[hit]
                at = pa.array(row)
                rest = [batch.column(i + 2).take(at) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([pa.array(flat), *rest], names=["token", *columns])

        return run

    shape = ", ".join(f"{c} long" for c in ["token", *columns])
    own = scan.where(F.size("prefix") > 0).select("cls", "n", "last", F.col("cls").alias("grp"), "prefix")
    read = [F.col("cls").alias("node"), "prefix", *columns]
    return own.select(*read).mapInArrow(tokens(True), shape).union(joined.select(*read).mapInArrow(tokens(False), shape))


def _best_tries(postings: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b, na, nb): per class at most one class of another group. Every token names one class at
    random, the same for all who hold it; b is the one named by most of a's tokens."""
    named = F.struct(
        F.xxhash64("grp", F.lit(turn)).alias("h"), "grp", F.xxhash64("cls", F.lit(turn)).alias("hc"), "cls", "n"
    )
    heads = postings.groupBy("token").agg(F.min(named).alias("x"))
    overlap = f"ceil({percent} * (n + nb) / {100 + percent})"
    return (
        postings.join(heads, "token").where("grp <> x.grp")
        .groupBy("cls", "n", F.col("x.cls").alias("b"), F.col("x.n").alias("nb")).agg(F.count("*").alias("shared"))
        .where(_near_sizes("n", "nb", percent))
        .where(f"shared >= {overlap} - ceil(greatest(n, nb) * {percent} / 100)")
        .groupBy(F.col("cls").alias("a"), F.col("n").alias("na"))
        .agg(F.max(F.struct("shared", "b", "nb")).alias("x")).select("a", "x.b", "na", "x.nb")
    )


def _promising(postings: DataFrame, unions: DataFrame, percent: int) -> DataFrame:
    """(q, nq, grp): queries and groups whose prefixes share enough tokens for a partner.

    Of two prefixes, let that of x end first in the order. Tokens common to both sets lie in
    both prefixes, or in x beyond its prefix: at most shared + least_overlap(x) - 1. That has to
    reach the overlap of similar sets of these sizes. A group is judged by its union of
    prefixes and the sizes and ends that occur in it, a slack of one covering rounding."""
    matches = (
        postings.alias("q").join(unions.alias("u"), "token").where("q.grp > u.grp")
        .where(f"100 * q.n >= {percent} * u.least and 100 * u.most >= {percent} * q.n")
        .select("q.cls", "q.n", "q.last", "u.grp", "u.least", "u.most", "u.lo", "u.hi")
    )
    counted = matches.groupBy("cls", "n", "last", "grp").agg(
        F.count("*").alias("shared"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    small = f"greatest(least, ceil(n * {percent} / 100))"
    large = f"least(most, floor(n * 100 / {percent}))"
    if_q_ends = f"ceil({percent} * (n + {small}) / {100 + percent}) - ceil(n * {percent} / 100)"
    if_group_ends = f"ceil({percent} * (n + {large}) / {100 + percent}) - ceil({large} * {percent} / 100)"
    exact = "if(least = most, 1, 0)"  # one size: nothing to round over
    enough = (
        f"(last <= hi and shared >= {exact} + {if_q_ends}) or (last > lo and shared >= {exact} + {if_group_ends})"
        f" or (last = lo and shared >= {if_group_ends})"
    )
    return counted.where(enough).select(F.col("cls").alias("q"), F.col("n").alias("nq"), "grp")


def _levels(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, size, pos, word: the words of sketches as they are and at half the size, so that sets
    of near sizes meet at one size at least."""
    both = F.array(
        F.struct(F.size("parity").alias("size"), F.col("parity").alias("w")),
        F.struct(F.floor(F.size("parity") / 2).cast("int").alias("size"), F.expr(_halved("parity")).alias("w")),
    )
    sized = rows.select(*keys, F.inline(both)).where("size > 0")
    return sized.select(*keys, "size", F.posexplode("w").alias("pos", "word"))


def _near_groups(candidates: DataFrame, group_of: DataFrame, scan: DataFrame, percent: int) -> DataFrame:
    """The candidates (q, nq, grp) whose sketch leaves room for a partner in the group.

    A bit that all members of a group have alike and the query has not is a token, at least,
    in which it differs from each of them. Members of other sizes of sketch are no partners."""
    if percent < 50:  # partners' sketches may be more than twice as large
        return candidates
    members = group_of.join(candidates.select("grp").distinct(), "grp", "left_semi")
    named = candidates.select(F.col("q").alias("cls")).union(members.select("cls")).distinct()
    sketches = stored(_sketches(scan, named).distinct(), "sketches")
    groups = _levels(members.join(sketches, "cls"), "grp", "n").groupBy("grp", "size", "pos").agg(
        F.bit_and("word").alias("each"), F.bit_or("word").alias("some"), F.max("n").alias("most")
    )
    queries = _levels(candidates.withColumnRenamed("q", "cls").join(sketches, "cls"), "cls", "nq", "grp")
    return (
        queries.join(groups, ["grp", "size", "pos"])
        .groupBy("cls", "nq", "grp", "size")
        .agg(F.sum(F.expr("bit_count((word & ~some) | (~word & each))")).alias("apart"), F.max("most").alias("most"))
        .where(f"{100 + percent} * apart <= {100 - percent} * (nq + least(most, nq * 100 div {percent}))")
        .select(F.col("cls").alias("q"), "nq", "grp").distinct()
    )


def _needed(classes: DataFrame, *columns: DataFrame) -> DataFrame:
    """(cls, id) of the classes named by any of the one-column tables."""
    names = columns[0].toDF("cls")
    for c in columns[1:]:
        names = names.union(c.toDF("cls"))
    return names.distinct().join(classes.select("cls", "id"), "cls")


def _core(sample: pa.Table) -> pa.Table:
    """The tokens that more than half of a group's sampled members hold."""
    lists = sample.column("tokens").combine_chunks()
    tokens, held = np.unique(lists.flatten().to_numpy(), return_counts=True)
    most = tokens[2 * held > len(lists)]
    return pa.table({"grp": sample.column("grp").slice(0, 1), "core": _lists(most, np.array([len(most)]))})


def _differences(sets: DataFrame) -> DataFrame:
    """(grp, cls, n, diff) for sets(grp, cls, n, own, tokens): the tokens in which a set differs
    from the core of the group it is present in."""
    sizes = sets.where("own").groupBy("grp").agg(F.count("*").alias("held"))
    sample = sets.where("own").join(sizes, "grp").where(F.pmod(F.xxhash64("cls"), "held") < CORE_MEMBERS).select("grp", "tokens")
    cores = sample.groupBy("grp").applyInArrow(_core, "grp long, core array<long>")
    core = F.coalesce("core", F.array().cast("array<long>"))  # none sampled: compared as they are
    return sets.join(cores, "grp", "left").select(
        "grp", "cls", "n", F.concat(F.array_except("tokens", core), F.array_except(core, "tokens")).alias("diff")
    )


def _links_of_few(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join all that are linked in a group, for groups of so few sets and tokens
    that one task compares the sets themselves."""

    def compare(group: pa.Table) -> pa.Table:
        cls, at = np.unique(group.column("cls").to_numpy(), return_index=True)
        lists = group.column("tokens").combine_chunks().take(pa.array(at))
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        places = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        own = [places[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        root, held, links = list(range(len(cls))), np.zeros(len(places), bool), []
        for i in range(len(cls)):
            held[own[i]] = True
            for j in range(i + 1, len(cls)):
                n, m = sorted((len(own[i]), len(own[j])))
                if root[i] != root[j] and 100 * n >= percent * m:
                    both = int(held[own[j]].sum())
                    if 100 * both >= percent * (n + m - both):
                        links.append((cls[i], cls[j]))
                        root = [root[i] if r == root[j] else r for r in root]
            held[own[i]] = False
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    return sets.groupBy("grp").applyInArrow(compare, "a long, b long")


def _links_within(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join all that are linked among those present in a group.

    With d the size of a set's difference from the core, n its own size and s the tokens two
    differences share, sets are similar when far(x) + far(y) <= 2 unit s, where
    unit = 100 + percent and far = unit d - (100 - percent) n. The nearest to the core is
    thus linked with all of far <= -far(nearest), and no others are linked without shared
    tokens. A set cannot share more than the tokens (held) some other difference has too,
    which limits the far of its partners to reach = 2 unit held - far."""
    unit = 100 + percent
    diffs = stored(_differences(sets), "differences")
    tokens = diffs.select("grp", "cls", F.explode("diff").alias("token"))
    common = tokens.groupBy("grp", "token").agg(F.count("*").alias("held")).where("held > 1").select("grp", "token")
    met = stored(tokens.join(common, ["grp", "token"]), "differing")
    far = (F.size("diff") * unit - F.col("n") * (100 - percent)).alias("far")
    held = met.groupBy("grp", "cls").agg(F.count("*").alias("held"))
    placed = diffs.select("grp", "cls", far).join(held, ["grp", "cls"], "left").select(
        "grp", "cls", "far", (2 * unit * F.coalesce("held", F.lit(0)) - F.col("far")).alias("reach")
    )
    centres = placed.groupBy("grp").agg(
        F.min(F.struct("far", "cls")).alias("c"), F.max("reach").alias("furthest")
    ).select("grp", F.col("c.cls").alias("centre"), F.col("c.far").alias("nearest"), "furthest")
    placed = stored(placed.join(centres, "grp"), "placed")
    discard(diffs)
    near = placed.where("far + nearest <= 0 and cls <> centre").select(F.col("centre").alias("a"), F.col("cls").alias("b"))
    facts = placed.select("grp", "cls", "far", "reach", (F.col("far") + F.col("nearest") > 0).alias("outside"))
    partners = facts.where("reach > -far")
    outside = placed.where("far + nearest > 0 and far <= furthest and reach > -far").select("grp", "cls", "far", "reach")
    x, y = outside.join(met, ["grp", "cls"]), partners.join(met, ["grp", "cls"])
    counted = (
        x.alias("x").join(y.alias("y"), ["grp", "token"])
        .where("x.cls <> y.cls and (not y.outside or x.cls < y.cls) and y.far <= x.reach and x.far <= y.reach")
        .groupBy("grp", F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
        .agg(F.count("*").alias("s"), (F.first("x.far") + F.first("y.far")).alias("apart"))
        .where(F.col("apart") <= 2 * unit * F.col("s"))
    )
    return near.union(counted.select("a", "b"))


def join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    percent: int = 85,
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, cls (its class, null without words),
    root (the component) and component_id (the smallest id in the component)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    spark = docs.sparkSession
    scan = stored(_scan(rows, _sketch(rows.select("id", "text"), words), words, percent), "scan")
    members = stored(scan.select("id", "n", "cls"), "members")
    classes = stored(
        members.where("cls is not null").groupBy("cls")
        .agg(F.coalesce(F.min("id"), F.lit(0).cast("long")).alias("id"), F.first("n").alias("n")),
        "classes",
    )

    # Groups: classes that share keys with the smallest class that has them.
    keys = stored(scan.where(F.size("keys") > 0).select("cls", "n", F.explode("keys").alias("key")), "keys")
    lows = keys.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high")
    low_sizes = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"))
    stars = (
        keys.join(lows.select("key", "low"), "key").where("cls <> low")
        .groupBy(F.col("cls").alias("a"), F.col("low").alias("b"))
        .agg(F.first("n").alias("na"), F.countDistinct("key").alias("shared"))
        .where(F.col("shared") >= SHARED_KEYS)
        .join(low_sizes, "b").where(_near_sizes("na", "nb", percent))
    )
    alike = stored(stars.select("a", "b"), "stars")
    discard(keys)
    groups = components(alike)

    # Tokens of prefixes that several groups hold, and the queries and groups that share them.
    nodes = spark.sparkContext.broadcast(bloom_of(groups.select("node"), CLASS_BITS).bytes)  # 2^CLASS_BITS bits
    joined = stored(_prefixes_of(scan, groups, nodes), "prefixes")
    open_tokens = stored(
        _prefix_tokens(scan, joined, nodes, ["grp"])
        .groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("token"),
        "open-tokens",
    )
    held = _prefix_tokens(scan, joined, nodes, ["cls", "n", "last", "grp"], open_tokens)
    postings = stored(held.join(open_tokens, "token").distinct(), "postings")
    discard(joined, open_tokens)
    # Groups of loose families become one before queries meet groups.
    for turn in range(ROUNDS):
        tries = stored(_best_tries(postings, turn, percent), "tries")
        named = tries.select(F.col("a").alias("cls")).union(tries.select("b"))
        found = stored(_alike(tries, _sketches(scan, named), LOOSE), "tried")
        discard(tries)
        if not found.limit(1).count():
            break
        alike = alike.union(found)
        groups = components(alike)
        older, postings = postings, stored(
            postings.drop("grp").join(groups.select(F.col("node").alias("cls"), "root"), "cls", "left")
            .select("token", "cls", "n", "last", F.coalesce("root", "cls").alias("grp")),
            "postings",
        )
        discard(older)
    unions = postings.groupBy("token", "grp").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("last").alias("lo"), F.max("last").alias("hi")
    )
    candidates = stored(_promising(postings, unions, percent), "candidates")
    discard(postings)
    group_of = (
        classes.join(groups.select(F.col("node").alias("cls"), "root"), "cls", "left")
        .select("cls", "n", F.coalesce("root", "cls").alias("grp"))
    )
    near = stored(_near_groups(candidates, group_of, scan, percent), "near")
    discard(scan)
    visits = near.select("grp", F.col("q").alias("cls"), F.col("nq").alias("n"), F.lit(False).alias("own"))
    everyone = group_of.select("grp", "cls", "n", F.lit(True).alias("own")).union(visits)
    few = F.expr(f"count(*) <= {FEW_SETS} and sum(n) <= {FEW_TOKENS}").alias("few")
    opened = everyone.groupBy("grp").agg(F.count("*").alias("there"), few).where("there > 1").select("grp", "few")
    present = stored(everyone.join(opened, "grp"), "present")
    # A set may be made twice; the texts' sets are the large side and are not sorted.
    sets = stored(
        _fetch(rows, _needed(classes, present.select("cls")), words).join(present.hint("shuffle_hash"), "cls"), "sets"
    )
    many = stored(sets.where("not few").groupBy("grp", "cls", "n", "own").agg(F.first("tokens").alias("tokens")), "many")
    within = _links_of_few(sets.where("few").select("grp", "cls", "tokens"), percent).union(_links_within(many, percent))
    links = stored(within, "found")
    discard(present, sets, many)
    roots = components(links)

    found = members.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "cls", F.coalesce("root", "cls").alias("root")
    )
    lowest = found.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(lowest, "root", "left").select(
        "doc_id", "n_shingles", "cls", "root",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    percent: int = 85,
) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the smallest id
    (rows without an id come last), one row where several share that id. Rows without words all
    stay. Further columns are carried along whatever their names."""
    found = join(docs, id_col, text_col, words, percent).where("cls is not null")
    pairs = stored(found.groupBy("root", "cls", "doc_id").agg(F.count("*").alias("held")), "pairs")
    first = stored(
        pairs.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "cls")).alias("f"))
        .select("f.cls", F.col("f.doc_id").alias("id")),
        "first",
    )
    # Most rows are the only ones of a pair that stays. The others meet the pairs that stay; none is
    # missed, as a filter lets every pair through that it was made from.
    kept = pairs.alias("p").join(first.alias("f"), F.expr("p.cls = f.cls and p.doc_id <=> f.id"), "left")
    unsure = kept.where("f.cls is null or p.held > 1").select("p.cls", "p.doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(
        bloom_of(unsure, CLASS_BITS, lambda b: _pair(b.column(0).to_numpy(), b.column(1).fill_null(0).to_numpy())).bytes
    )  # 2^CLASS_BITS bits
    # The text is handed on once, beside the rest of the row.
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    own_id = F.col(f"`{id_col}`").cast("long")
    shaped = docs.select(F.struct(*rest).alias("row"), F.col(f"`{text_col}`").alias("text"), own_id.alias("id"))

    def run(batches):
        bloom = Bloom(CLASS_BITS, sent.value)
        for batch in batches:
            ids = batch.column(2).fill_null(0).to_numpy()
            for a, b in text_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                sets = _Sets(part.column(1), words)
                again = bloom.has(_pair(sets.cls, ids[a:b])) & (sets.sizes > 0)
                added = [pa.array(sets.cls, mask=sets.sizes == 0), pa.array(again)]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=["row", "text", "id", "cls", "unsure"])

    added = [T.StructField("cls", T.LongType()), T.StructField("unsure", T.BooleanType())]
    rows = shaped.mapInArrow(run, T.StructType([*shaped.schema.fields, *added]))
    unsure_rows = rows.where("unsure")
    hits = unsure_rows.alias("r").join(first.alias("f"), F.expr("r.cls = f.cls and r.id <=> f.id")).select("r.*")
    # Rows alike in id and shingles may differ in text; a task that runs again keeps the same one.
    order = [F.xxhash64("text"), F.xxhash64(F.to_json("row"))]
    once = Window.partitionBy("cls", "id").orderBy(*order)
    chosen = hits.withColumn("again", F.row_number().over(once)).where("again = 1").select("row", "text")
    whole = rows.where("not unsure").select("row", "text").union(chosen)
    return whole.select(
        *[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]
    )
