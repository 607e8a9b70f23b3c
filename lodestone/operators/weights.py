"""Term weights of labelled documents, and their vectors as lines of text.

Documents are dealt over tasks by doc_id and counted row by row before their tokens become rows, so that counts, sizes and
lines of a document need no further shuffle and no task holds more than a text; document frequencies, summed within tasks
first, and rows of features too many to broadcast are shuffled by feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.shared import written

#: Features that are broadcast, at most: of a larger vocabulary the most frequent ones. The others are joined by shuffle.
BROADCAST = 100_000
#: Bytes of a feature that is broadcast, at most: with the number, these bound what the driver holds. Longer ones are joined by shuffle.
LONG = 64


def parsed(line: Column) -> Column:
    """Tokens of a comma-separated line; null for a line of one character or none, which is no document."""
    return F.when(F.length(line) > 1, F.filter(F.split(line, ","), lambda x: x != ""))


def _words(tokens: str | Column) -> Column:
    return F.filter(tokens, lambda x: x != "")


def _runs(words: Column) -> Column:
    """Array of feature, n: the distinct words of a text, sorted, and how often each is there. Null words have none."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (k == 0) | (F.get(s, k) != F.get(s, k - 1)))
        whole = lambda b: F.transform(b, lambda k, i: F.struct(F.get(s, k).alias("feature"), (F.coalesce(F.get(b, i + 1), F.size(s)) - k).cast("long").alias("n")))
        return F.transform(F.array(begins), whole)[0]

    # An array of one is a way to name a value, so that it is made once a row.
    return F.transform(F.array(F.sort_array(words)), lambda s: F.when(F.size(s) > 0, runs(s)))[0]


def _counted(docs: DataFrame, tokens: str | Column) -> DataFrame:
    """doc_id, label, size (of the document, in tokens), feature, n; a document without tokens has a row without feature.

    tokens may be an expression over docs: texts are dealt as they are and split where they arrive. Each text is counted in its
    own row, so a task holds one text at a time. Rows that share a doc_id are one document, and only theirs are grouped.
    explode_outer, since Spark puts a filter by the array's size below explode, and makes the tokens twice for it.
    """
    twice = written(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice_id")))
    words = _words(tokens)
    rows = docs.repartition("doc_id").select("doc_id", "label", _runs(words).alias("runs"), F.greatest(F.size(words), F.lit(0)).alias("size"))
    rows = rows.select("doc_id", "label", F.col("size").cast("long").alias("size"), F.explode_outer("runs").alias("run")).select("doc_id", "label", "size", "run.feature", "run.n")
    if twice.isEmpty():
        return rows
    # The hint is needed: keys are so small on disk that Spark would broadcast millions of them.
    twice = twice.hint("shuffle_hash")
    shared = F.col("doc_id").eqNullSafe(F.col("twice_id"))
    many = docs.join(twice, shared, "left_semi").select("doc_id", "label", _words(tokens).alias("tokens"))
    sizes = many.groupBy("doc_id").agg(F.sum(F.greatest(F.size("tokens"), F.lit(0))).alias("size")).withColumnRenamed("doc_id", "size_id")
    many = many.select("doc_id", "label", F.explode_outer("tokens").alias("feature")).groupBy("doc_id", "label", "feature").agg(F.count("feature").alias("n"))
    many = many.join(sizes, F.col("doc_id").eqNullSafe(F.col("size_id"))).select("doc_id", "label", "size", "feature", "n")
    return rows.join(twice, shared, "left_anti").unionByName(many)


def term_counts(docs: DataFrame, tokens: str | Column = "tokens") -> DataFrame:
    """doc_id, label, feature, n of tokens that are not empty."""
    return _counted(docs, tokens).where("feature IS NOT NULL").drop("size")


def doc_freq(docs: DataFrame, tokens: str | Column = "tokens") -> DataFrame:
    """feature, df: labelled documents (not 0) that contain it."""
    some = docs.where("label <> 0").repartition("doc_id").select(F.explode_outer(F.array_distinct(_words(tokens))).alias("feature"))
    return some.where("feature IS NOT NULL").groupBy("feature").agg(F.count("*").alias("df"))


def tf(docs: DataFrame, tokens: str | Column = "tokens") -> DataFrame:
    """doc_id, label, feature, n and tf, a feature's share of its document's tokens."""
    return _counted(docs, tokens).where("feature IS NOT NULL").withColumn("tf", F.col("n") / F.col("size")).drop("size")


def vocabulary(docs: DataFrame, tokens: str | Column = "tokens", least: int = 2) -> DataFrame:
    """feature, df, idx (from 1, by feature) of features that `least` labelled documents share.

    Numbers are places within ranges of features plus the sizes of the ranges before, so no task sorts the whole list.
    """
    kept = written(doc_freq(docs, tokens).where(F.col("df") >= least))
    lead = kept.withColumn("part", F.substring("feature", 1, 2))
    before = lead.groupBy("part").agg(F.count("*").alias("many")).withColumn("before", F.coalesce(F.sum("many").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(W.partitionBy("part").orderBy("feature"))
    return lead.withColumn("nth", nth).join(before.select("part", "before"), "part").select("feature", "df", (F.col("before") + F.col("nth")).cast("int").alias("idx"))


def _parts(known: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """known (a written table) as its BROADCAST most frequent features of LONG bytes at most, and the others if there are any."""
    common = known.where(F.octet_length("feature") <= LONG)
    whole, short = known.count(), common.count()
    if short > BROADCAST:
        common = written(common.orderBy(F.desc("df"), "feature").limit(BROADCAST))
    elif short == whole:
        return known, None
    return common, written(known.join(F.broadcast(common.select("feature")), "feature", "left_anti"))


def _rare(rows: DataFrame, common: DataFrame, others: DataFrame) -> DataFrame:
    """rows of features that are not common, joined with the others by shuffle.

    A feature that isn't common has few rows, or is longer than LONG; should one of those be frequent, Spark splits its rows as
    it does for any skewed join. The hint is needed: others is small on disk and would be broadcast by its size there, however
    many features it has.
    """
    return rows.join(F.broadcast(common.select("feature")), "feature", "left_anti").join(others.hint("merge"), "feature")


def to_4(x: Column) -> Column:
    """A double to 4 decimals as SQL engines do it: scaled, then rounded. round(x, 4) rounds x as it prints, which parts where a
    tie has no exact double: 57 of 800 prints as 0.07125, but 10,000 times that is below 712.5.
    """
    return F.round(x * 10_000) / 10_000


def _weight(scheme: str, n_docs: int) -> Column:
    """From n, size and df, to 4 decimals: binary, tf or tfidf = tf * ln(all documents / df)."""
    if scheme == "binary":
        return F.lit(1)
    share = F.col("n") / F.col("size")
    return to_4(share if scheme == "tf" else share * F.log(F.lit(n_docs) / F.col("df")))


def weights(docs: DataFrame, scheme: str = "tfidf", tokens: str | Column = "tokens", least: int = 2) -> DataFrame:
    """doc_id, label, feature, w (to 4 decimals); scheme: binary, tf or tfidf."""
    known = written(doc_freq(docs, tokens).where(F.col("df") >= least))
    n_docs = docs.count() if scheme == "tfidf" else 0
    (common, others), rows = _parts(known), _counted(docs, tokens)
    out = rows.join(F.broadcast(common), "feature")
    out = out.unionByName(_rare(rows, common, others)) if others else out
    return out.select("doc_id", "label", "feature", _weight(scheme, n_docs).alias("w"))


def class_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("label").agg(F.count("*").alias("n_docs"))


def vector_lines(docs: DataFrame, scheme: str = "tf", tokens: str | Column = "tokens", least: int = 2) -> DataFrame:
    """doc_id, label, line: `label idx:w ... # feature,...`, indexed features by index, then all features by name.

    docs are read twice: for the vocabulary, and for the lines. doc_id is meant to be distinct.
    """
    known = written(vocabulary(docs, tokens, least))
    n_docs = docs.count() if scheme == "tfidf" else 0
    (common, others), counted = _parts(known), _counted(docs, tokens)
    w = _weight(scheme, n_docs)
    text = F.lit("1") if scheme == "binary" else w.cast("decimal(30,4)").cast("string")
    pair = F.when(F.col("idx").isNotNull(), F.struct("idx", F.concat_ws(":", F.col("idx").cast("string"), text).alias("pair")))
    rows = counted.join(F.broadcast(common), "feature", "left")
    rows = rows.groupBy("doc_id", "label").agg(F.collect_list(pair).alias("pairs"), F.array_sort(F.collect_list("feature")).alias("names"))
    if others:
        more = _rare(counted, common, others).groupBy("doc_id", "label").agg(F.collect_list(pair).alias("more"))
        more = more.withColumnsRenamed({"doc_id": "more_id", "label": "more_label"})
        rows = rows.join(more.hint("merge"), F.col("doc_id").eqNullSafe(F.col("more_id")) & F.col("label").eqNullSafe(F.col("more_label")), "left")
        rows = rows.withColumn("pairs", F.when(F.col("more").isNull(), F.col("pairs")).otherwise(F.concat("pairs", "more")))
    rows = rows.withColumn("pairs", F.array_sort("pairs"))
    sign = F.when(F.col("label") > 0, F.lit("+1")).otherwise(F.col("label").cast("string"))
    pairs = F.when(F.size("pairs") > 0, F.array_join(F.transform("pairs", lambda p: p["pair"]), " "))
    return rows.select("doc_id", "label", F.concat_ws(" ", sign, pairs, F.lit("#"), F.array_join("names", ",")).alias("line"))
