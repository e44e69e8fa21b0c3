"""From raw documents to token ids: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``.  ``run`` writes the
stages' results below the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgefuse.llm import bpe, jaccard, mixing, queries, substring, toxicity
from judgefuse.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores below its cut."""
    labels = table(spark, sf_dir, "labels").filter(toxicity.learnable())
    model = toxicity.fit(table(spark, sf_dir, "documents"), labels)
    return toxicity.score(docs, model, name="__score").filter(F.col("__score") < toxicity.CUT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard of 0.8 or more."""
    return jaccard.keep_one(docs, n=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that start earlier; untouched texts stay as they are."""
    cut = substring.drop_repeats(docs)
    touched = F.col("n_removed") > 0
    return cut.withColumns({
        "text": F.when(touched, F.col("kept_text")).otherwise(F.col("text")),
        "n_chars": F.when(touched, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")),
    }).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say."""
    return mixing.mix(docs, queries.mix_labels(spark, sf_dir), queries.MIX_TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids; texts are whole."""
    ids = bpe.encode_text(docs, queries.tokenizer_path())
    return ids.withColumn("n_tokens", F.size("token_ids").cast("long")).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# A trained classifier, components and merges: no SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last one."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
