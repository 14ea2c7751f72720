"""Mixing, ranked search and the Merkle manifest against plain versions, with odd rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import prose

from ledgerline.llm import lexical_search, merkle, pareto_mix
from ledgerline.llm.ranks import ranked

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, prose(rng.choice([3, 20, 90, 91, 300]), i), "en", rng.choice(["a", "b", "b", "b", "é"])) for i in range(160)]
    out += [(200 + i, prose(60, 7), "en", "b") for i in range(40)]  # copies
    out += [
        (None, "no id here\nand a line", "en", "a"), (None, None, None, None), (300, None, "de", "a"), (301, "", "de", None),
        (302, " \t\n ", "de", "lone"), (303, prose(30_000, 9), "en", "long"), (304, "Été 日本 😀 x_y 9\n\n", None, "é"),
        (305, "twice", "en", "b"), (305, "twice", "en", "b"), (305, "other\n", "en", "b"), (306, "A-b.C a B c", "en", ""),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    clash = {n: F.lit(1) for n in ("size", "place", "part", "row", "u", "class", "leaf", "chunk", "tree", "terms", "score", "rank", "id", "of")}
    return df.withColumns(clash)


def test_places_in_a_sorted_order(spark, docs, rows):
    got = ranked(docs.select("doc_id", "source", "text"), ["source"], ["doc_id", "text"], "t").collect()
    groups = collections.defaultdict(list)
    for r in got:
        groups[r["source"]].append((r["place"], r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    assert {s: len(g) for s, g in groups.items()} == collections.Counter(r[3] for r in rows)
    for g in groups.values():
        g.sort()
        assert [x[0] for x in g] == list(range(len(g)))
        assert [x[1:3] for x in g] == sorted(x[1:3] for x in g)


def shares(sizes, weights, factor, most):
    """Targets by resharing until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = factor * sum(sizes.values()), set()
    while True:
        free = sum(w[s] for s in names if s not in stopped)
        level = (total - sum(most * sizes[s] for s in stopped)) / free if free else 0.0
        above = {s for s in names if s not in stopped and level * w[s] > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in stopped else level * w[s] for s in names}
        stopped |= above


def test_mix_meets_its_targets(docs, rows):
    mixed = pareto_mix.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()
    again = pareto_mix.mix(docs.repartition(5)).select("doc_id", "source", "size", "copies").collect()
    key = lambda r: str((r["doc_id"], r["source"], r["size"], r["copies"]))
    assert sorted(map(key, mixed)) == sorted(map(key, again))
    assert len(mixed) == len(rows)
    words = collections.Counter()
    for i, text, _, source in rows:
        words[source] += len(WORD.findall(text or ""))
    assert {r["source"]: r["source_size"] for r in mixed} == dict(words)
    want = shares(words, (5, 2, 1), 1.5, 2)
    taken = collections.Counter()
    longest = collections.Counter()
    for r in mixed:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 30, longest[s] if s == "long" else 0), s
    assert pareto_mix.mix(docs.where("false")).count() == 0
    assert "text" not in pareto_mix.mix(docs).columns and "part" in pareto_mix.mix(docs).columns


def test_mix_repeats_rows(docs):
    mixed = pareto_mix.mix(docs, with_text=True)
    copies = pareto_mix.repeated(mixed)
    assert copies.count() == mixed.agg(F.sum("copies")).first()[0]
    assert copies.where("size <> 0 AND text IS NULL").count() == 0


def test_pareto_draws_have_their_probabilities(spark):
    """Unequal weights: over many seeds a document comes about as often as it is expected to."""
    weights = [1.0, 2.0, 4.0, 8.0, float("nan"), -1.0, None]
    rows = [(i, "w " * 10, weights[i % 7], "s") for i in range(84)]
    df = spark.createDataFrame(rows, "doc_id long, text string, weight double, source string")
    seen, runs = collections.Counter(), 12
    for seed in range(runs):
        for r in pareto_mix.mix(df, factor=0.4, weight_col="weight", seed=seed).collect():
            seen[r["doc_id"] % 7] += r["copies"]
    expected = 0.4 * 84 / 12 / 15
    for k, w in enumerate(weights[:4]):
        assert seen[k] / runs / 12 == pytest.approx(min(2, expected * w), abs=0.11)
    assert seen[4] == seen[5] == seen[6] == 0
    full = pareto_mix.mix(df, factor=2.0, weight_col="weight").collect()
    assert {r["copies"] for r in full if r["weight"] and r["weight"] > 0} == {2}


def plain_search(rows, queries, k):
    docs = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, length = len(docs), sum(n for _, _, n in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in queries:
        asked = collections.Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for i, c, n in docs:
            m = 100 - 25 + (25 * n * n_docs) // length
            score = 0
            for t, q in asked.items():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += q * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda s: s[:2] if s[1] else s)
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("limits", [{}, {"TILE_ROWS": 16, "QUERY_ROWS": 4, "LEAF_ROWS": 2}, {"TILE_CELLS": 300, "RARE": 1}])
def test_search_equals_scoring_everything(spark, docs, rows, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical_search, name, value)
    queries = [(1, prose(8, 50)), (2, rows[7][1]), (3, "été 日本"), (4, None), (5, "nothing-of-that"), (5, "a b C c"), (None, "the " * 9), (7, prose(40, 7)), (8, "")]
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumn("score", F.lit(1))
    got = found(lexical_search.search(docs, asked))
    assert got == plain_search([(r[0], r[1]) for r in rows], queries, 20)
    assert found(lexical_search.search(docs, asked, k=1)) == plain_search([(r[0], r[1]) for r in rows], queries, 1)


def test_search_of_nothing(spark, docs):
    asked = spark.createDataFrame([(1, "the of")], "item_id long, text string")
    assert lexical_search.search(docs.where("false"), asked).count() == 0
    assert lexical_search.search(docs, asked.where("false")).count() == 0
    assert lexical_search.search(docs, asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_hold_and_prune():
    """No document scores above the bound of a node that holds it, and most go unscored."""
    rng = np.random.default_rng(4)
    themes = [rng.choice(400, 30, replace=False) for _ in range(8)]
    sets = [np.unique(rng.choice(themes[i % 8], 12)) for i in range(400)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    terms = np.concatenate(sets)
    texts = [" ".join(f"t{t}" for t in sets[i]) for i in range(0, 400, 40)]
    texts += [" ".join(f"t{t}" for t in theme) for theme in themes]  # no document is without a known term
    block = lexical_search.QueryBlock(texts)
    place = {int(h): i for i, h in enumerate(block.vocabulary)}
    names = lexical_search.Terms(__import__("pyarrow").array([f"t{i}" for i in range(400)])).word_hashes()
    known = np.array([place.get(int(names[t]), -1) for t in terms])
    keep = known >= 0
    rows = np.repeat(np.arange(400), np.diff(bounds))[keep]
    known = known[keep]
    bounds = np.searchsorted(rows, np.arange(401))
    frequencies = np.bincount(known, minlength=len(block.vocabulary))
    scorer = lexical_search.Scorer(block, 400, 4_000, frequencies)
    entries = scorer.entries(np.full(len(known), 12), known, np.ones(len(known), np.int64))
    tile = lexical_search.Tile(scorer, bounds, known, entries)
    dense = np.zeros((400, len(block.vocabulary)), np.int64)
    dense[rows, known] = entries
    scores = block.counts @ dense.T
    local = block.counts[:, tile.local].astype(float)
    norms = np.sqrt(np.add.reduceat(local**2, tile.cuts, axis=1))
    reach = (local @ tile.centres.T + norms @ tile.radii.T) * (1 + lexical_search.SLACK) + 1
    for node, (begin, end, _, _) in enumerate(tile.nodes):
        assert (scores[:, tile.order[begin:end]] <= reach[:, node, None]).all()
    best = lexical_search._Best(len(texts), 3, np.ones(len(texts), np.int64))
    scored = lexical_search.search_tile(tile, scorer, list(range(400)), best)
    for q in range(len(texts)):
        best.cut(q)
        assert [(-s, i) for s, _, i in best.found[q]] == sorted(((int(s), i) for i, s in enumerate(scores[q])), key=lambda x: (-x[0], x[1]))[:3]
    assert scored < 0.6 * scores.size


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def written(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_proof(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        out.append((run[: at % 3], run[at % 3 + 1 :]))
        at //= 3
    return out


def plain_manifest(rows):
    sources = collections.defaultdict(list)
    for i, text, lang, source, n in rows:
        sources[source].append((i is not None, i or 0, digest(written(i, source, lang, n, text)), i))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(sources[s])]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, _, leaf, i) in enumerate(sorted(sources[s])):
            proof = plain_proof(trees[s], at) + plain_proof(top, k)
            out.append((i, leaf, trees[s][-1][0], top[-1][0], "".join("".join(a) + "".join(b) for a, b in proof)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk,levels", [(1 << 14, 8), (4, 1), (7, 2)])
def test_manifest_equals_a_plain_tree(docs, rows, monkeypatch, chunk, levels):
    """Also with leaf partitions so small that most nodes lie over several of them."""
    monkeypatch.setattr(merkle, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(merkle, "ROUND_LEVELS", levels)
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaf = merkle.digest_of(*columns)
    proved = merkle.prove(docs, leaf, F.when(F.col("doc_id") == 7, F.sha2(F.lit("no"), 256)))
    got = proved.collect()
    have = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got), key=str)
    assert have == plain_manifest([(*r, len(r[1] or "")) for r in rows])
    assert {r["doc_id"] for r in got if r["folded_root"] != r["root"]} == {7}
    for r in got:
        assert merkle.fold(bytes.fromhex(r["leaf"]), r["steps"], r["proof"]).hex() == r["root"]


def test_manifest_of_one_and_of_none(docs):
    leaf = merkle.digest_of(F.col("doc_id"), F.col("text"))
    (one,) = merkle.prove(docs.where("doc_id = 5"), leaf).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof"] == ""
    assert merkle.prove(docs.where("false"), leaf).count() == 0


def test_the_union_of_missing_nodes_is_the_least():
    """Nodes that are fetched cannot be made from known ones, and all others can."""
    rng = random.Random(8)
    for _ in range(200):
        size = rng.randint(1, 120)
        known = np.array(sorted(rng.sample(range(size), rng.randint(1, size))))
        sizes = merkle.level_sizes(size)
        have = {(0, int(i)) for i in known}
        for level, places in merkle.missing_nodes(known, sizes):
            for at in places.tolist():
                below = set(range(at * 3**level, min((at + 1) * 3**level, size)))
                assert not below & set(known.tolist()) and (level, at) not in have
                have.add((level, at))
            for parent in {i // 3 for lv, i in have if lv == level}:
                assert all((level, c) in have for c in range(parent * 3, min(parent * 3 + 3, sizes[level])))
                have.add((level + 1, parent))
        assert (len(sizes) - 1, 0) in have
