"""Files: contracts as whole texts, model answers, and the shared folder for results that are read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ANSWERS = "doc_id bigint, chunk_id int, raw_text string"


def dealt(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: small files are one partition each, too few for work that is dear for each row.

    Tables of as many partitions or more, as all large ones are, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def spread(df: DataFrame, key: str, rows: int = 20_000) -> DataFrame:
    """Narrow rows in even partitions of about so many rows, for work that is dear for each row and far more than moving it.

    The partitions that a file is read in say nothing of its rows: a row group is read by one task whole, and the others of its file have none.
    Rows are dealt by their key (unique, or nearly so), and Spark knows it: joins, groups and windows by it, or by what it is renamed to, need no further exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)), key)  # rows are counted from the files' footers


def contract_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: each file as one row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def model_answers(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, chunk_id, raw_text from JSON lines."""
    return spark.read.schema(ANSWERS).json(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: what is used several times is made once, and lost executors cost no more than a stage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors see.

    A local session that names none, as in tests, gets a new temporary folder; on a cluster that would lie on each machine's own disk.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = tempfile.mkdtemp(prefix="spark-factloom-")
        spark.sparkContext.setCheckpointDir(there)
        spark.conf.set("spark.checkpoint.dir", there)
    return there
