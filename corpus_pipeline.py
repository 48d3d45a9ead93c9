"""Corpus cleaning: five stages, each a table of documents that the next one reads.

toxicity rejects texts predicted toxic, near_dedup keeps one text of each group
of near duplicates (five words, similarity 0.8), decontaminate drops texts that
hold a benchmark passage, pii replaces personal data, bpe encodes what is left.
Every stage works on all rows that the one before kept and, but for the last,
returns the columns of documents.

Verdicts belong to rows, not to keys: rows with a null doc_id are judged like
any other, and of several texts under one doc_id only those that are rejected
go. Of rows that are the same in every column, near_dedup keeps one. A null or
empty text is never toxic, a duplicate or a leak, and stays. Other columns pass
unchanged, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.llm import bpe, decontamination, near_dedup, pii, toxicity
from kinetra.llm.common import materialize

#: Of near duplicates, in percent, and the bands by which they meet: a pair at the threshold is missed with a chance of 3e-6.
SIMILARITY, BANDS, ROWS = 80, 32, 5


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key made of all their columns, and its name; only rows that are the same in all of them share it."""
    name = next(f"row{k}" for k in itertools.count() if f"row{k}" not in docs.columns)
    return docs.withColumn(name, F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))), name


def _keep(docs: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the rejected ones, without it."""
    return docs.join(rejected.select(key).distinct(), key, "left_anti").drop(key)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, key = _keyed(docs)
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=key)
    return _keep(docs, scored.where("predicted = 1"), key)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    docs, key = _keyed(docs)
    # a row without a doc_id takes part under a number above all others
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.col(key), 2))
    found = near_dedup.near_duplicates(docs.select(number.alias("doc_id"), "text", key), SIMILARITY, bands=BANDS, rows=ROWS, carry=key)
    found = materialize(found.select(key, "kept", (F.col("n_shingles") > 0).alias("worded")), "pipeline-verdicts")
    again = found.where("kept and worded").groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    # rows that are the same in every column are few; the rest is not shuffled for their sake
    once = _keep(docs, found.where("not kept").select(key).unionByName(again), key)
    repeated = docs.join(again, key, "left_semi").dropDuplicates([key]).select(*columns)
    return once.select(*columns).unionByName(repeated)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, key = _keyed(docs)
    leaks = decontamination.find_leaks(docs.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _keep(docs, leaks.select(F.col("doc_id").alias(key)), key)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("bpe", encode_bpe),
]

#: SQL has no counterpart of the models and of near-duplicate groups; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
