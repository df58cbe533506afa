"""Helpers shared by the training-data operators: reading tables and cutting lineage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelrank.session import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table below ``sf_dir`` (any file system that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, rows_of_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, lost executors don't matter.

    ``rows_of_file`` bounds the rows of a file, for rows that are large.  The files stay until the driver
    process ends, as later reads need them.
    """
    path = scratch(df.sparkSession)
    df.write.option("maxRecordsPerFile", rows_of_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(col: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file: below $TOKENIZER_DIR if set, else where its package has it."""
    if base := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(base, name)
    import public_tokenizers

    return public_tokenizers.path(name)
