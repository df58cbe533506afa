"""The corpus pipeline: quality classifier, exact dedup, near dedup, secret redaction, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelrank.llm import exact, nearjoin, packing, quality, secrets
from voxelrank.llm.common import materialise, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null text is empty and scored like any other, at any length; a score that ties with the cut-off is
    kept; rows that repeat score alike; an empty table stays empty; columns of any name pass through.
    """
    return quality.keep_good(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest id stays.

    Null text equals empty text; a null id is smaller than any other; of rows that repeat id and text
    the first in the table stays; long texts are compared whole; an empty table stays empty; columns
    of any name pass through.
    """
    return exact.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, similarity 0.8), the row with the least id stays.

    Of rows that repeat this id the first in the table stays; rows without words (null, empty, signs)
    and rows with a null id stay all; texts of any length enter whole; an empty table stays empty;
    columns of any name pass through.
    """
    return nearjoin.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays, in the order and with the repeats it had.

    Null text stays null, empty text empty; texts of any length are scanned whole; ``n_chars`` follows
    the new text (0 for null); an empty table stays empty; other columns of any name pass through.
    """
    return secrets.redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their places in training sequences, as ``packing.pack`` returns them.

    Null and empty texts are one token; rows that repeat are packed each; long texts are cut; an empty
    table gives no rows; columns other than id and text are left out.
    """
    return packing.pack(docs)


STAGES = [("quality", good_documents), ("exact", without_copies), ("near", without_near_copies), ("secrets", without_secrets), ("packing", packed)]

#: The stages train a classifier, hash shingles and tokenise: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
