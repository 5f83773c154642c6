"""The training-data pipeline over documents: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import linededup, mixing, neardup, packing, toxicity
from inkwell.llm.common import shared_folder

#: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents.
STAGES = [
    ("toxicity", toxicity.stage),
    ("line dedup", linededup.stage),
    ("minhash near-dedup", neardup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Toxicity scores and token ids can't be had in SQL; a test runs the pipeline over a small corpus with known groups.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of sf_dir's documents."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
