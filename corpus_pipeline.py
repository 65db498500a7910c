"""A corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Quality rules and the toxicity score drop documents, near-duplicate classes keep one document each, and the rest is
packed into windows of token ids.

Defined results, for the pipeline and for each stage on its own: a null text counts as empty and fails the quality rules;
rows with a null id pass through the stages like any others, as a class without a name; repeated rows are copies, of
which one stays; of a class that holds several ids the row with the least id stays; ties of texts and lengths change
nothing; very long texts are read whole; an empty table gives an empty table; extra columns, whatever their names, are
kept by all stages but the last, which returns pieces alone.  Documents without labels are scored like any others, and
labels of absent documents are left out.  Every stage ends in a written table in the folder of spark.checkpoint.dir, and
the table of a stage is deleted once the next one is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bag_minhash, packing, quality_rules, toxicity
from rasterloom.llm.common import discard, id_bucket, materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_filter(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3 by a model learned from the labelled ones outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.toxicity_model(docs, labels, id_bucket(F.col("doc_id"), 4) != 2)
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return bag_minhash.keep_one(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed windows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("quality rules", keep_quality), ("toxicity", drop_toxic), ("minhash near-dedup", drop_copies), ("packing", pack_tokens)]

#: Tokens and the learned score have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)  # the next stage reads this one's table alone
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
