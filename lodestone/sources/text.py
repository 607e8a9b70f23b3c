"""Text files by class, and labelled vectors as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.weights import parsed

#: Labels by the name of the folder that a file lies in.
LABELS = {"positive": 1, "negative": -1, "predict": 0}


def label_of(path: Column) -> Column:
    folder = F.element_at(F.split(path, "/"), -2)
    return F.coalesce(*(F.when(folder == k, F.lit(v)) for k, v in LABELS.items()))


def labelled_lines(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """doc_id, label, line of all files root/<class>/*.<suffix>. Nothing is deleted.

    doc_id is a hash of a line's file, its content and, where a file repeats a line, which of the repeats it is; so it does
    not depend on how files are split.
    """
    lines = spark.read.text([f"{root}/{k}" for k in LABELS], pathGlobFilter=f"*.{suffix}").select("value", F.col("_metadata.file_path").alias("path"))
    lines = lines.withColumn("nth", F.row_number().over(W.partitionBy("path", "value").orderBy(F.lit(0))))
    return lines.select(F.xxhash64("path", "value", "nth").alias("doc_id"), label_of(F.col("path")).alias("label"), F.col("value").alias("line"))


def token_documents(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, label, tokens of the token lines root/<class>/*.data; lines of one character or none are no documents."""
    return labelled_lines(spark, root, "data").select("doc_id", "label", parsed(F.col("line")).alias("tokens")).where("tokens IS NOT NULL")


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """word: a line each, lower-cased (A-Z)."""
    return spark.read.text(path).select(F.translate("value", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("word")).where("word <> ''").distinct()


def write_vectors(lines: DataFrame, root: str) -> None:
    """line of rows with label 0 to root/predict, of others to root/train."""
    lines.where("label <> 0").select("line").write.text(f"{root}/train")
    lines.where("label = 0").select("line").write.text(f"{root}/predict")


def write_tokens(rows: DataFrame, root: str, tokens: str = "tokens") -> None:
    """Comma-separated tokens of rows with a label, a line each, to root/positive, root/negative and root/predict."""
    for name, label in LABELS.items():
        rows.where(F.col("label") == label).select(F.array_join(tokens, ",").alias("line")).write.text(f"{root}/{name}")
