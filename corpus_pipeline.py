"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

1. language ID (op 7): documents without a determined language go, and those of which less than half is in one language;
2. n-gram Jaccard join (op 3): of each group of near copies the document with the smallest doc_id stays;
3. benchmark decontamination (op 2): documents that hold 75 % of a benchmark item's shingles go;
4. PII (op 8): personal data is masked in the text, and ``n_chars`` counted anew;
5. best-fit packing (op 1): the documents are packed into sequences of token ids.

All stages but the last return the columns of ``documents``. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import language, pii
from wayfare.llm.decontamination import decontaminated
from wayfare.llm.jaccard import one_of_each
from wayfare.llm.packing import pack_documents
from wayfare.llm.queries import tokenizer
from wayfare.llm.shipping import ship_package
from wayfare.sources.sinks import stored

LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    learned = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    return language.keep_determined(docs, language.fit(docs, allowed=learned), LEAST_LANGUAGE_SCORE)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return one_of_each(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    kept = pii.mask_personal_data(docs, pii.fit(docs))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pack_documents(docs, *tokenizer())


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", remove_benchmarks),
    ("PII", mask_pii),
    ("best-fit packing", pack),
]

# Trained models, belief propagation and a tokenizer are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
