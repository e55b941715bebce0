"""From raw documents to token ids: STAGES, and run() over all of them.

1. toxicity: documents that the labelled examples vote toxic go.
2. near_duplicates: one document of each class of near duplicates (5-word shingles, similarity 0.8) stays.
3. mixing: each document is taken as often as the mix of sources to their target weights takes it.
4. byte_bpe: the texts as token ids, with a check that these decode to the same bytes.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
SQL can't express the toxicity stage (a fitted model), so ORACLE_SQL is None and tests compare with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.cluster import send_package
from factloom.llm import byte_bpe, mixing, parity_join, toxicity
from factloom.llm.common import stored, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    send_package(spark)
    learn = table(spark, sf_dir, "labels").where(toxicity.fold(F.col("doc_id")) != 0)
    return toxicity.score(docs, toxicity.fit(docs, learn)).where("predicted = 0").select(*docs.columns)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    send_package(spark)
    return parity_join.one_of_each(docs, k=5, s=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    send_package(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    send_package(spark)
    out = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [("toxicity", clean), ("near_duplicates", unlike), ("mixing", mixed), ("byte_bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
