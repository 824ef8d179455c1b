"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from cargolake.llm import decontaminate, langid, packing, quality, simhash  # noqa: E402
from cargolake.llm.common import table  # noqa: E402
from cargolake.session import checkpoint_dir  # noqa: E402

LEAST_LIKENESS = 0.2  # a text less like every language than this is no language; prose scores above 0.4
LEAST_QUALITY = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike all learned languages, go."""
    profiles = langid.learn(docs, F.col("doc_id").isNotNull())
    found = langid.prediction(profiles, F.col("text"))
    return docs.filter((found.getField("lang_pred") != langid.UNKNOWN) & (found.getField("score") >= LEAST_LIKENESS))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for bad go."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return docs.filter(model.score(F.col("text")) >= LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, or an edited copy, go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, each with its sequence and offset."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("quality", good_quality),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]

# Rank profiles, fitted classifiers, hashes and a packing program have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(kept.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
