"""A corpus pipeline: reject low quality, strip boilerplate lines, keep one of near copies, decontaminate, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import decontaminate as decontaminate_
from tallyward.llm import line_dedup, mixing, ngram_join, quality
from tallyward.llm.common import Scratch, table

#: Documents stay unless the classifier is this sure that they are junk.
KEEP_SCORE = 0.3


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, learnt from labels.quality: documents below KEEP_SCORE go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs.select("doc_id", "text"), labels)
    scored = quality.score(docs, model)
    return scored.where(F.col(f"`{scored.columns[-1]}`") >= KEEP_SCORE).select(*[F.col(f"`{c}`") for c in docs.columns])


def strip_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup with the source as the host; n_chars follows the text. Pages of boilerplate alone stay for the next stage, which keeps one of equal ones."""
    out = line_dedup.drop_lines(docs, keep_whole=True)
    chars = F.length("text").cast(dict(docs.dtypes)["n_chars"]) if "n_chars" in docs.columns else None
    return out.select(*[chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five-word shingles at 0.8: one document of each component stays."""
    return ngram_join.keep_one(docs, n=5, num=80, den=100)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark template go."""
    return decontaminate_.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each row as often as the mix takes it, numbered by copy."""
    return mixing.expand(mixing.mix(docs))


STAGES = [("quality_classifier", classify), ("line_dedup", strip_lines), ("jaccard_join", keep_one), ("decontamination", clean), ("mixing", mix_sources)]

#: SQL cannot express the fitted classifier or the Newton iterations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
