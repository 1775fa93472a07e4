"""From raw documents to packed training sequences, in five stages over the whole table.

Each stage takes all rows that the one before kept, as written to the shared folder. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import exact_dedup, jaccard, mixing, packing, toxicity
from folioloom.llm.common import attach, crc_fold, read_table, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it learns from the labels outside the held-out fold."""
    attach(spark)
    learn = F.coalesce(crc_fold(F.col("doc_id"), 5) != 0, F.lit(False))
    labels = read_table(spark, sf_dir, "labels").filter(learn).select("doc_id", "toxic")
    return toxicity.clean(docs, toxicity.train(docs.filter(learn).select("doc_id", "text", "lang"), labels))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.keep_one(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id."""
    return jaccard.keep_one(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to twice."""
    return mixing.draw(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs


#: A trained classifier and best-fit packing can't be expressed in SQL. The operators have brute-force tests of their own;
#: of the whole pipeline the tests check columns, row counts and ids.
ORACLE_SQL = None
