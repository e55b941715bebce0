"""The same tables as streams of files: new files are taken up once, and what is made of them is appended to a folder.

Extraction, normalisation, validation and the parsing of answers work on rows, so they take a stream as they take a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.sources.files import ANSWERS


def contract_files(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """path, text of each new file."""
    rows = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_at_once).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def model_answers(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """doc_id, chunk_id, raw_text from new files of JSON lines."""
    return spark.readStream.schema(ANSWERS).option("maxFilesPerTrigger", files_at_once).json(path)


def appended(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes up what is there and ends. With the same checkpoint a later run goes on where this one stopped, and no file counts twice."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
