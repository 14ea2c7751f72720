"""A training corpus from raw documents: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as
Parquet to the shared folder and reads it again for the next. All stages but the last
return the columns of documents.

1. quality_rules   failing lines go from the text, rejected documents go
2. language_id     documents without letters, or without a language that holds half of
                   their letters, go; a missing lang is filled in. Where no row to learn
                   from has a lang, only documents without letters go
3. jaccard_groups  of documents whose five-word shingles are at least 0.8 alike, the one
                   with the smallest id stays
4. secret_scan     secrets in texts are masked
5. packing         texts become sequences of 2048 ids, one row per piece

Defined cases: a null text has no words and goes at stage 1; rows with a null id are judged
like others and stay last among copies; an empty table gives empty results; further columns
are carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import jaccard_groups, language, line_rules, packing, secrets
from ledgerline.llm.common import shared_folder, table
from ledgerline.llm.queries import WORD_BPE
from ledgerline.session import ship_package

MIN_LANGUAGE_SHARE = 0.5
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _packed(docs: DataFrame) -> DataFrame:
    """The text beside the rest of the row, so that no result column meets a column of docs and
    the text is handed on once."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest, F.lit(0).alias("no text")).alias("row"), F.col("text"))


def _unpacked(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    columns = []
    for c in docs.columns:
        kind = docs.schema[c].dataType
        value = changed.get(c, F.col("text") if c == "text" else F.col(f"row.`{c}`"))
        columns.append(value.cast(kind).alias(c))
    return df.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = line_rules.apply_rules(_packed(docs), keep_text=False).where("kept")
    return _unpacked(judged, docs, text=F.col("cleaned_text"), n_chars=F.length("cleaned_text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs.where(~language.held_out(F.col("doc_id"), 3, 1)))
    if not model.languages:  # nothing to tell languages by; letters need no model
        return _unpacked(language.with_letters(_packed(docs)).where("has_letters"), docs)
    found = language.predict(_packed(docs), model, spans=False)
    known = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE))
    return _unpacked(known, docs, lang=F.coalesce(F.col("row.lang"), F.col("lang_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_groups.keep_one(docs, words=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(_packed(docs))
    return _unpacked(masked, docs, text=F.col("text"), n_chars=F.length("text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, WORD_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("jaccard_groups", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack_sequences),
]

#: Language labels, 64-bit set hashes and vocabularies have no SQL form; the stages are tested
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES, 1):
        path = f"{folder}/{number}-{name}"
        result = stage(spark, docs, sf_dir)
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
