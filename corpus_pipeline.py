"""A corpus pipeline of five of the operators for language-model training data.

language ID -> near duplicates -> benchmark decontamination -> secrets -> BPE.
Each stage works on all that its predecessor kept. SQL can express neither the language
models nor the near duplicates, so the pipeline is held against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecframe.llm import stages
from vecframe.llm.shared import documents, scratch, written
from vecframe.llm.tokens import public_path

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.known_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.without_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.encoded(docs, public_path(TOKENIZER))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again.

    What a stage wrote for itself goes once its rows are written.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            rows = stage(spark, docs, sf_dir)
            docs = written(rows, name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
