"""The corpus pipeline: STAGES in order, each over all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import encode
from lodestone.llm.common import table, written
from lodestone.llm.minhash import near_duplicates
from lodestone.llm.mixing import mix
from lodestone.llm.substring import remove_duplicates
from lodestone.llm.toxicity import score


def _own(docs: DataFrame, *used: str) -> DataFrame:
    """docs with the columns used under their names and all others under names that no operator adds, in the same order."""
    seen: set[str] = set()
    names = [c if c in used and not (c in seen or seen.add(c)) else f"_given_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; each row is judged by its own text.

    Null and empty texts score as a text without words; rows that repeat share their fate; other columns, whatever their
    names, come back unchanged; an empty table gives an empty table.
    """
    own = _own(docs, "doc_id", "text")
    return score(own, table(spark, sf_dir, "labels"), keep=own.columns).where("score < 0.5").select(own.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8, the least doc_id stays.

    Rows without doc_id stay, and so do null and empty texts. Rows that repeat a doc_id are one document: all of them stay
    or go. Other columns come back unchanged; an empty table gives an empty table.
    """
    own = _own(docs, "doc_id", "text")
    kept = near_duplicates(own).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = own.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").select(own.columns)
    return rows.union(own.where("doc_id IS NULL")).toDF(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that stand in a window of 50 words of an earlier document; other texts stay as they are.

    Where words went, the others are joined by one space and n_chars (if there is such a column) is the new length. A row
    without doc_id, and a null or empty text, stays as it is; rows that repeat a doc_id don't count against one another.
    Other columns come back unchanged; an empty table gives an empty table.
    """
    own = _own(docs, "doc_id", "text", "n_chars")
    cut = remove_duplicates(own, with_text=True).where("n_removed > 0").select(F.col("doc_id").alias("cut_id"), "row_key", "kept_text").dropDuplicates(["cut_id", "row_key"])
    rows = own.join(cut, (own["doc_id"] == F.col("cut_id")) & (F.xxhash64(own["text"]) == F.col("row_key")), "left")
    new = {"text": F.coalesce("kept_text", "text").alias("text")}
    if "n_chars" in own.columns:
        new["n_chars"] = F.when(F.col("kept_text").isNotNull(), F.length("kept_text").cast(own.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return rows.select(*(new.get(c, F.col(c)) for c in own.columns)).toDF(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, which may be none.

    Null texts are of no words; null sources are one source; equal rows tie. Other columns come back unchanged; an empty
    table gives an empty table.
    """
    own = _own(docs, "doc_id", "text", "source")
    mixed = mix(own).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return mixed.select(own.columns).toDF(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row's ids and of the text decoded from them; null and empty texts have no ids."""
    return encode(docs)


STAGES = [("toxicity", toxicity), ("minhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("bpe", bpe)]

#: The classifier and the fuzzy stages have no SQL; tests compare the stages with brute-force versions on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
