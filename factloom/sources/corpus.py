"""The contract texts that tests and queries use, derived from the orders table by one SQL text for both engines."""

from __future__ import annotations

import uuid
from functools import cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession

from factloom.sources.files import spread


@cache
def _sql(name: str) -> str:
    """A file of this package, also where it is an archive."""
    return (resources.files("factloom.sources") / f"{name}.sql").read_text(encoding="utf-8").strip()


def contracts_sql() -> str:
    return _sql("contracts")


def with_contracts(sql: str) -> str:
    return f"WITH contracts AS ({contracts_sql()}), {sql}"


def _from(spark: SparkSession, sql: str, name: str, source: DataFrame) -> DataFrame:
    view = f"_{name}_{uuid.uuid4().hex}"
    source.createOrReplaceTempView(view)
    return spark.sql(sql.replace(f"FROM {name}", f"FROM {view}"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return _from(spark, contracts_sql(), "orders", spread(orders, "o_orderkey"))  # a few numbers a row are dealt out, not the texts


def answers_sql() -> str:
    return _sql("answers")


def positional_sql() -> str:
    return _sql("positional")


def answers(spark: SparkSession, sf_dir: str, positional: bool = False) -> DataFrame:
    return _from(spark, positional_sql() if positional else answers_sql(), "contracts", contracts(spark, sf_dir))
