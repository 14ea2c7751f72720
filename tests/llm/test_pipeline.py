"""The stages of the corpus pipeline, one after another, on rows that each has to treat."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_llm_operators import prose

import corpus_pipeline


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(150, 1)
    rows = [
        (1, base), (2, base), (3, base + " more words."), (4, None), (5, "too short."), (6, prose(90, 2) + " password: hunter2secret"),
        (None, prose(100, 3)), (8, "12 34 56 78 90 " * 30),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "kept": F.lit(1)})


def test_stages(spark, docs):
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns, before = docs.columns, docs.dtypes
        docs = stage(spark, docs, "")
        assert docs.columns == columns and docs.dtypes == before, name
        seen.append(sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str))
    assert seen == [[1, 2, 3, 6, None], [1, 2, 3, 6, None], [1, 6, None], [1, 6, None]]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert texts[6].endswith("[SECRET]")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r["doc_id"] for r in packed.collect()} == {1, 6, None}


def test_empty(spark, docs):
    docs = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


NAV, LEGAL = "Sign in | My account | Order history | Contact us", "Read our privacy policy before you go on with this page."
ALPHABETS = {"en": "abcdefghijklmnop", "el": "αβγδεζηθικλμνξοπ", "ru": "абвгдежзийклмноп"}


def planted():
    """Rows of three languages in scripts of their own, with copies, secrets, junk lines, mixtures."""
    rng = random.Random(11)

    def body(lang, n):
        words = ["".join(rng.choices(ALPHABETS[lang], k=rng.randint(3, 8))) for _ in range(n)]
        return " ".join(words) + "."

    rows = []
    for k in range(36):
        lang = list(ALPHABETS)[k % 3]
        text = body(lang, 80 + k)
        rows.append((k, text, lang))
        if k % 4 == 0:
            words = text.split()
            words[len(words) // 2] = "changed"
            rows += [(100 + k, text, lang), (200 + k, NAV + "\n" + " ".join(words), lang)]
        if k % 4 == 1:
            rows.append((300 + k, body(lang, 80) + "\n" + LEGAL + "\n" + body(lang, 60) + " password=" + f"hunter{k}secret.", lang))
        if k % 4 == 2:
            rows.append((400 + k, " ".join(body(x, 40) for x in ALPHABETS), lang))
        if k % 4 == 3:
            rows += [(500 + k, " ".join(str(rng.randint(1000, 9999)) for _ in range(80)) + ".", lang), (600 + k, body(lang, 20), lang)]
    return rows


def brute(rows, labelled):
    left = []
    for i, text, _ in rows:
        text = "\n".join(x for x in text.split("\n") if x not in (NAV, LEGAL))
        counts = [sum(c in letters for c in text.lower()) for letters in ALPHABETS.values()]
        total = sum(map(str.isalpha, text))
        if len(text.split()) >= 50 and total and (not labelled or 2 * max(counts) >= total):
            left.append((i, text, {tuple(text.split()[j : j + 5]) for j in range(len(text.split()) - 4)}))
    group = {i: i for i, _, _ in left}
    for i, _, a in left:
        for j, _, b in left:
            if len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return {i: re.sub(r"password=\w+\.", "[SECRET]", text) for i, text, _ in left if group[i] == i}


@pytest.mark.parametrize("labelled", [True, False])
def test_run_is_brute_force(spark, tmp_path, monkeypatch, labelled):
    rows = planted()
    df = spark.createDataFrame([(i, t, lang if labelled else None) for i, t, lang in rows], "doc_id long, text string, lang string")
    df = df.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark, label: str(tmp_path / label))
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    expected = brute(rows, labelled)
    masked = spark.read.parquet(str(tmp_path / "pipeline" / "4-secret_scan")).collect()
    assert {r["doc_id"]: r["text"] for r in masked} == expected and len(masked) == len(expected)
    assert packed == set(expected) and not any(500 <= i < 600 for i in packed)
