"""The evaluation job over the synthetic tender views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.fixtures import view
from bidloom.operators import decide, evidence


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "bidder_docs").withColumnRenamed("id", "doc_id")


def rows(spark: SparkSession, sf_dir: str, told: tuple[str, ...] = decide.WORDS) -> DataFrame:
    """All decisions, with what is ``told`` of the evidence they rest on."""
    return decide.decide(view(spark, sf_dir, "bidders"), view(spark, sf_dir, "criteria"), documents(spark, sf_dir), told)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, told=()).select(
        "tender_id", "bidder_id", "criterion_id", "field", "verdict", "reason",
        F.round("confidence", 6).alias("confidence"),
    )


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    criteria = view(spark, sf_dir, "criteria")
    return evidence.gather(criteria, evidence.facts(documents(spark, sf_dir), evidence.asked_fields(criteria)))


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of each decision."""
    return decide.explanations(rows(spark, sf_dir), evidence_rows(spark, sf_dir))
