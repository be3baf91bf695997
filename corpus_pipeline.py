"""From raw documents to token shards: five stages, each on what its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; between two stages the rows
are written as Parquet to the shared folder and read again, and go once the next stage
has been written. All but the last return the columns of ``documents``. See each
operator's module for its edge cases.
"""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession


def _stage(module: str):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return importlib.import_module(f"radarlake.llm.{module}").stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _stage("op9_toxicity")),
    ("simhash_near_dedup", _stage("op5_simhash")),
    ("substring_dedup", _stage("op2_substrings")),
    ("benchmark_decontamination", _stage("op1_decontaminate")),
    ("bpe_encoding", _stage("op3_bpe")),
]

#: SQL can't express four of the stages; tests/llm holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from radarlake.llm.common import discard, materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        got = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return got
        got = materialize(got)
        discard(docs)  # nothing was written of the table itself
        docs = got
    return docs
