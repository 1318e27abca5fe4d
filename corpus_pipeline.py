"""From raw documents to piece ids: five stages, each written and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents. Stages in order:

1. language: texts without letters, and texts of which no language holds half, go.
2. quality: texts whose neighbours vote below the threshold go.
3. near copies: one document of each group stays.
4. mixing: documents are repeated or left out so that sources meet their targets.
5. pieces: texts become piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm import common, language, mixing, near_copies, pieces, quality

MIN_LANGUAGE_SHARE = 0.5

# Classifiers and signatures are not SQL. tests/llm compares the rows that each stage keeps with plain
# Python on the smallest table, where columns are also named like the helpers of the stages.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    predict = language.predictor(spark, *language.fit(language.training_rows(docs)))
    (name,) = common.free_names(docs, "_language")
    found = docs.withColumn(name, predict("text"))
    known = (F.col(f"{name}.lang") != language.UNKNOWN) & (F.col(f"{name}.score") >= MIN_LANGUAGE_SHARE)
    return found.filter(known).drop(name)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = common.read(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.fit(docs, labels.filter(common.fold("doc_id", 4) != 2))
    (name,) = common.free_names(docs, "_quality")
    found = docs.withColumn(name, quality.scorer(spark, model)("text"))
    return found.filter(F.col(name) >= quality.THRESHOLD).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = pieces.encode_rows(docs, pieces.model_path(), "doc_id", "source")
    return coded.withColumn("n_pieces", F.size("piece_ids").cast("long"))


STAGES = [
    ("language", identify_language),
    ("quality", keep_quality),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
