"""A training corpus from raw documents: filter, drop near duplicates, cut repeats, mix sources, pack.

Every stage but the last takes and returns the columns of documents (doc_id, text, lang, source, n_chars; others are
dropped by the first stage) and works on all rows that the one before kept. An empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.chosenpath import jaccard_join
from spreadloom.llm.common import cut, discard, table
from spreadloom.llm.mixture import mixed_documents
from spreadloom.llm.packing import pack_documents
from spreadloom.llm.quality import fit_quality, score_quality
from spreadloom.llm.suffixes import without_repeats
from spreadloom.llm.tokens import public

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on these rows and the labels, scores 0.3 or more."""
    docs = docs.select(*COLUMNS)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).filter("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest doc_id, of each group of near duplicates, whichever ids they have. Rows with a null doc_id,
    and wordless texts, stay. Rows are numbered in a copy first, since a doc_id may repeat."""
    rows = cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "near-rows")
    found = cut(jaccard_join(rows, row="_row"), "near-duplicates")
    return rows.join(found.filter("not kept").select("_row"), "_row", "left_anti").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings of earlier documents; rows that were repeats throughout go."""
    return without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and in such parts, as the mix takes them."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return pack_documents(docs, public("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mix", mix), ("pack", pack)]

#: A learnt model, hashes and a tokenizer's vocabulary are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
