"""Words of URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What parts words in a URL.
DELIMITERS = "-&./?=,;:"


def url_tokens(url: Column) -> Column:
    """Words of a URL: a leading http:// goes, so does the value after each =, and the rest is split on DELIMITERS."""
    bare = F.regexp_replace(F.regexp_replace(url, "^http://", ""), f"=[^{DELIMITERS}]*", "=")
    return F.filter(F.split(bare, f"[{DELIMITERS}]"), lambda t: t != "")


def without(tokens: Column, stop: list[str]) -> Column:
    """Tokens that are not in a short list of stop words; case counts."""
    return F.filter(tokens, lambda t: ~t.isin(*stop)) if stop else tokens


#: Stop words that are broadcast as one array, at most (it is hashed for each row); a longer table is joined.
BROADCAST = 1_000


def without_stop_words(rows: DataFrame, stop: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """As `without`, for a stop table of any size (column word); key: a column of rows that tells them apart.

    A short table, by its counted size, becomes one broadcast array, and rows are filtered where they are. A longer one is
    joined by word, and its rows' tokens are put together again by key. Null tokens stay null.
    """
    words = stop.select("word").where("word IS NOT NULL").distinct()
    if words.limit(BROADCAST + 1).count() <= BROADCAST:
        whole = words.agg(F.collect_list("word").alias("_stop"))
        # array_intersect hashes the long list once a row; what a row holds of it is short.
        kept = F.transform(F.array(F.array_intersect(tokens, "_stop")), lambda own: F.filter(tokens, lambda t: ~F.array_contains(own, t)))[0]
        return rows.crossJoin(F.broadcast(whole)).select(*[kept.alias(c) if c == tokens else F.col(c) for c in rows.columns])
    each = rows.select(F.col(key).alias("_key"), F.posexplode(tokens).alias("_at", "_word"))
    kept = each.join(words.select(F.col("word").alias("_word")), "_word", "left_anti")
    kept = kept.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_word"))), lambda x: x["_word"]).alias("_kept"))
    own = F.when(F.col(tokens).isNotNull(), F.coalesce("_kept", F.array().cast("array<string>")))
    return rows.join(kept, F.col(key) == F.col("_key"), "left").select(*[own.alias(c) if c == tokens else F.col(c) for c in rows.columns])


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, ",")
