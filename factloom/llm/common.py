"""What several operators of this package need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.sources.files import new_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
