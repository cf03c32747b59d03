"""From raw documents to packed training sequences: each stage is written as Parquet and read again by the next.

1. quality: documents that fail the rules, or whose host is rejected, go.
2. near_duplicates: one document of each group of near copies stays (five words, similarity 0.8).
3. secrets: secrets in the texts are replaced by a mark; ``n_chars`` follows.
4. mixing: rows are repeated as the sources' token budgets ask; every document stays at least once.
5. packing: pieces with their place in sequences of 2,048 tokens.

All but the last keep the columns of ``documents``, whatever else a table holds and however its columns are called. SQL cannot express
stages 2, 4 and 5, so the whole is tested against plain versions.

Null texts are empty: stage 1 rejects them. Rows without an id pass stages 1 to 4 as documents of their own (stage 2 does not compare
them) and are packed. Repeated rows are judged each; as equal ids they stand or fall together in stage 2. Ties: of near copies the
smallest id stays. An empty table stays empty. A very long text is one row to the end and is cut in stage 5 only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import minhash, mixing, packing, quality_rules, secrets_scan
from talus.llm.common import materialize
from talus.session import ship, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.drop_near_duplicates(docs, size=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secrets_scan.redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.best_fit_packing(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
