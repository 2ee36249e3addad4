"""The corpus pipeline over ``documents``: quality rules, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and reads nothing but docs, of which it works on every row; its result is written
as Parquet and read again as the next one's docs. All but the last return the columns of ``documents``: rejected
documents are gone, texts (and n_chars) are without their site's boilerplate lines, one document of each near-duplicate
class stays, and documents stand in the mixture as often as it takes them, in the order of its slots. The last returns
the pieces and their places.

Defined results, besides the operators' own: the quality rules reject null, empty and very short texts, and repeated rows
are each judged; of repeated rows the near-duplicate stage keeps one; very long texts go through whole; ties (rows of
equal id) are told apart by text; a null source is a site and a source of its own; columns beside those of ``documents``
are passed on whatever their names, up to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import best_fit_packing, line_dedup, near_duplicates, quality_rules, source_mixing
from loomwork.llm.common import shared_dir, shipped, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    shipped(spark)
    return quality_rules.kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many of a source's documents have go; n_chars follows the text."""
    counts = unused("__lines", docs), unused("__dropped", docs)
    clean = line_dedup.deduplicated(docs, counts=counts)
    n_chars = F.when(F.col(counts[1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_duplicates.first_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return source_mixing.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    shipped(spark)
    return best_fit_packing.packed(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near), ("source mixing", mixing), ("best-fit packing", packing)]

#: Near-duplicate classes and tokenization have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the whole table; between them Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out.write.parquet(f"{folder}/{k}")
            docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return out
