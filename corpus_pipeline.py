"""A corpus pipeline in five stages over documents; each stage works on all that the one before kept.

STAGES holds (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of their input. run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import common, decontaminate, mixing, neardup, secrets, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays."""
    return neardup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, those it does not take not at all."""
    return mixing.emit(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", neardup_stage),
    ("decontamination", decontaminate_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]
#: Training, sampling and tagging can't be put in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept: list[DataFrame] = []
        # what a stage has stored on its way goes when its rows are written, and then the rows of the stage before
        with common.scratch(lambda kept=kept: kept[0]):
            kept.append(common.store(stage(spark, docs, sf_dir), f"stage-{name}"))
        common.discard(docs)
        docs = kept[0]
    return STAGES[-1][1](spark, docs, sf_dir)
