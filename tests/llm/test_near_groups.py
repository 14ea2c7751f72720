"""Near copies without work on texts that sketches tell apart, or that stay as they are."""

import random

import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_components, prose

from ledgerline.llm import jaccard_groups


def _families(seed):
    """Loose families, each text near some others of its own, and as many texts of no family."""
    rng = random.Random(seed)
    rows = []
    for family in range(5):
        base = [f"{w}{family}" for w in prose(40 + 60 * family, seed + family).split()]
        for _ in range(12):
            text = base.copy()
            for at in rng.sample(range(len(base)), rng.randint(0, 3)):
                text[at] = f"y{rng.randrange(3)}"
            rows.append((len(rows), " ".join(text)))
    for alone in range(60):
        rows.append((len(rows), " ".join(f"{w}x{alone}" for w in prose(40 + 5 * alone, seed + 100 + alone).split())))
    return rows


def _components(spark, rows, words, percent):
    got = jaccard_groups.join(spark.createDataFrame(rows, "doc_id long, text string"), words=words, percent=percent).collect()
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got)


@pytest.mark.parametrize("words,percent", [(4, 85), (3, 40)])
def test_sketches_close_groups_without_partner(spark, monkeypatch, words, percent):
    """Were each class to visit every other group, only those near would be made from texts again."""
    rows = _families(words)

    def everyone(postings, unions, percent):
        queries = postings.select(F.col("cls").alias("q"), F.col("n").alias("nq"), F.col("grp").alias("own")).distinct()
        return queries.crossJoin(seen["classes"].select(F.col("cls").alias("grp"))).where("own <> grp").drop("own")

    seen, kept = {}, jaccard_groups.stored
    monkeypatch.setattr(jaccard_groups, "_promising", everyone)
    monkeypatch.setattr(jaccard_groups, "discard", lambda *tables: None)
    monkeypatch.setattr(jaccard_groups, "stored", lambda df, label: seen.setdefault(label, kept(df, label)))
    monkeypatch.setattr(jaccard_groups, "ROUNDS", 0)  # tables are kept by label
    assert _components(spark, rows, words, percent) == brute_components([(*r, None) for r in rows], words, percent)
    if percent > 80:  # of sets that may differ much, sketches tell little
        assert 0 < seen["sets"].select("cls").distinct().count() <= 60


@pytest.mark.parametrize("sets,tokens", [(64, 1 << 20), (1, 1 << 20), (64, 400)])
def test_groups_of_few_and_of_many(spark, monkeypatch, sets, tokens):
    """Whether one task compares a group or its differences are joined, components are the same."""
    monkeypatch.setattr(jaccard_groups, "FEW_SETS", sets)
    monkeypatch.setattr(jaccard_groups, "FEW_TOKENS", tokens)
    rows = _families(9)
    assert _components(spark, rows, 4, 85) == brute_components([(*r, None) for r in rows], 4, 85)


def test_rows_without_copies_are_not_moved(spark):
    """A text that stays anyway goes through no shuffle: rows of a partition stay together."""
    rows = [(i, text) for i, text in _families(2)[60:]] + [(900, "a b c d e f g"), (900, "a b c d e f g"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("from", F.spark_partition_id())
    kept = jaccard_groups.keep_one(docs).withColumn("to", F.spark_partition_id()).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(i) for i in [*range(60, 120), 900, None])
    places = {(r["from"], r["to"]) for r in kept if r["doc_id"] != 900}
    assert len(places) == len({f for f, _ in places}) == 3
