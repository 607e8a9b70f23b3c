"""XML files as rows, and rows as XML files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import xml


def load(spark: SparkSession, path: str) -> DataFrame:
    """path, encoding, text: a row for each file, whole, decoded as its bytes or its declaration say (see xml.encoding_of)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", xml.encoding_of(F.col("content")).alias("encoding"))
    return files.select("path", "encoding", xml.decoded("content", "encoding").alias("text"))


def save(rows: DataFrame, root: str, name: str = "name", text: str = "text") -> None:
    """Each row's text, and a line end, as a UTF-8 file of its own below root/name=<its name>; names are meant to be distinct."""
    rows.select(F.col(name).alias("name"), F.col(text).alias("text")).write.partitionBy("name").text(root)
