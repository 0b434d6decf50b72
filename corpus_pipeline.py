"""The training-data pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. Stages see all that their predecessor
kept, and nothing else of it: the quality stage learns from the labels of the documents
it is given, the mixing stage's targets are shares of the sizes it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm.common import documents, materialize
from gleanwork.llm.language import fit_languages, identify
from gleanwork.llm.mixing import mixed
from gleanwork.llm.neardup import BROADCAST_ROWS, Settings, bands_for, near_duplicates
from gleanwork.llm.packing import pack
from gleanwork.llm.quality import fit_quality, labelled, score_quality

#: Languages to keep; None: all that the documents state.
LANGUAGES: tuple[str, ...] | None = None
#: Least posterior of the language, and least quality score, of a document that stays.
MIN_LANGUAGE_SCORE = 0.5
MIN_QUALITY = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = LANGUAGES) -> DataFrame:
    """Keeps documents that are clearly in one of ``languages``.

    What goes: documents without letters (und) or without a clear language; those no likelier in any
    language than in equally likely n-grams, such as random letters or an unknown script; those in
    another language than they state.
    """
    told = identify(docs, fit_languages(docs))
    lang = F.col("__predicted.lang_pred")
    keep = (lang != "und") & (F.col("__predicted.score") >= MIN_LANGUAGE_SCORE) & (F.col("__predicted.fit") > 0) & F.coalesce(F.col("lang") == lang, F.lit(True))
    if languages is not None:
        keep &= lang.isin(*languages)
    return told.where(keep).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score is at least a half; the rest is likelier label 0 than 1."""
    model = fit_quality(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_quality(docs, model).where(F.col("__score") >= MIN_QUALITY).select(*docs.columns)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, the one of smallest doc_id; of rows that repeat a doc_id, one. Documents without an id stay.

    Texts stay where they are: only the ids that go are joined to them, by broadcast while those are few.
    """
    told = materialize(near_duplicates(docs.select("doc_id", "text"), Settings(words=5, percent=80, bands=bands_for(80))).where(F.col("doc_id").isNotNull()))
    twice = told.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"))
    kept_twice = told.where("kept").join(twice, F.col("doc_id") == F.col("__id"), "left_semi").select(F.col("doc_id").alias("__id")).distinct()
    gone = materialize(told.where("NOT kept").select(F.col("doc_id").alias("__id")).union(twice).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    once = docs.join(gone, F.col("doc_id") == F.col("__id"), "left_anti")
    one_each = docs.join(F.broadcast(kept_twice) if kept_twice.count() <= BROADCAST_ROWS else kept_twice, F.col("doc_id") == F.col("__id"), "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(one_each)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces with their token ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_stage),
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", neardup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models and hashed sketches are beyond SQL; the tests hold the near-duplicate stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
