"""Training-corpus pipeline over ``documents``: five stages, each one operator of the llm package.

Every stage reads what the one before it wrote.  All but the last return the columns of
``documents``; the last returns packed pieces.

In every stage rows with null or repeated ids stay rows of their own, texts of any length are read
whole, an empty table gives an empty table, and further columns pass through unchanged whatever
their names: stages carry each input row as one struct beside what they work out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import decontam, ngram_join, packing, pii, quality
from bidloom.llm.common import materialise, whole_row, with_row_id
from bidloom.llm.registry import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the weakly supervised quality rules reject.

    Texts without words fail the base rules and go; repeated rows share one verdict.
    """
    return quality.select_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of smallest id of each class of near duplicates, of equal ids one row.

    Texts without words are no duplicates of each other and stay; a class whose ids are all null
    keeps one row.
    """
    rows = materialise(with_row_id(docs.select(whole_row(docs.columns, "row"))), "rows")
    classes = ngram_join.join(rows, id_col="row.doc_id", text_col="row.text", row_col="rid")
    first = classes.filter("rid = class_rid").select("rid")
    # A shuffle at every size: the rows that stay have no bound.
    return rows.join(first.hint("merge"), "rid", "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark windows in a twentieth of their words or more.

    Texts without words stay; an empty benchmark drops nothing.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.scan(docs, benchmark, keep=tuple(docs.columns)).filter("not contaminated").select("kept.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; ``n_chars`` follows the new text.

    Null and empty texts stay as they are.
    """
    found = pii.find(docs, keep=tuple(docs.columns)).select("kept", "all", F.col("kept.text").alias("t"))
    found = found.select("kept", pii.masked("t", "all").alias("t"))
    made = {"text": F.col("t"), "n_chars": F.char_length("t").cast("long")}
    return found.select(*[made.get(c, F.col(f"kept.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Label models, MinHash forests, context scoring and tokenizers are no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
