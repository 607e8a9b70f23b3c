"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, quoted, table, unused, without, written

#: Slices of the order within a source. Only the slice in which a source's need ends is sorted.
SLICES = 4096
#: Size classes to a doubling of the size: documents of a class have the same chance.
STEPS = 4
#: Rows of a plan that are broadcast; a longer plan is joined by shuffle.
BROADCAST = 200_000


def targets(sized: DataFrame, weights: int = 3, most: int = 3) -> DataFrame:
    """source, source_size, target. One row a source, so the windows over all of them are as long as the list of sources.

    Sources by code point, null last, weigh 1, 2 ... `weights`, repeating. A target is its weight times a common level, or
    `most` times its source's size if that is less; the level makes the targets add up to all sizes.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("weight", (F.row_number().over(order) - 1) % weights + 1)
    stop = by.withColumn("ratio", F.lit(most) * F.col("source_size") / F.col("weight"))
    up, every = W.orderBy("ratio", "weight", F.col("source").asc_nulls_last()), W.partitionBy()
    stop = stop.withColumn("below", F.sum(F.lit(most) * F.col("source_size")).over(up.rowsBetween(W.unboundedPreceding, -1))).withColumn("above", F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing))).withColumn("all", F.sum("source_size").over(every))
    level = (F.col("all") - F.coalesce("below", F.lit(0))) / F.col("above")
    stop = stop.withColumn("level", F.max(F.when(level <= F.col("ratio"), level)).over(every))
    return stop.select("source", "source_size", F.when(F.col("ratio") <= F.col("level"), F.lit(most) * F.col("source_size").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, of no more than so many rows, to be broadcast if these are few."""
    return F.broadcast(df) if rows <= BROADCAST else df


def chances(classes: DataFrame, goals: DataFrame, lean: float) -> DataFrame:
    """name, class, p: a document's chance of one more copy, by source and size class.

    A chance is a level times the size to the power `lean`, and 1 at most; a source's level makes the words that its chances
    promise, p * size summed over its documents, equal its need. Classes are few, so a source's window is short.
    """
    rows = classes.join(goals, F.col("source").eqNullSafe(F.col("name"))).where("need > 0")
    rows = rows.withColumn("g", F.pow(F.lit(2.0), F.col("class") * (lean / STEPS)))
    # Classes with the greatest g are the first whose chance is certain.
    down = W.partitionBy("name").orderBy(F.desc("g"), F.desc("class"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("words") * F.col("g")).over(down.rowsBetween(W.currentRow, W.unboundedFollowing))
    # Without words below there is no level: a class of no words takes all or nothing at no cost.
    rows = rows.withColumn("level", F.try_divide(F.col("need") - above, below))
    # The first class whose chance is no more than 1 has the source's level.
    fits = F.when(F.col("level") * F.col("g") <= 1, F.struct((-F.col("g")).alias("first"), "level"))
    level = F.min(fits).over(W.partitionBy("name"))["level"]
    return rows.select("name", "class", F.least(F.lit(1.0), F.coalesce(level, F.lit(float("inf"))) * F.col("g")).alias("p"))


def mix(docs: DataFrame, keep: list[str] | None = None, weights: int = 3, most: int = 3, lean: float = 0.5, seed: int = 4) -> DataFrame:
    """keep (all columns of docs by default), size, source_size, target, copies and taken (size * copies) for each row.

    target / source_size is how many copies of a source's words are wanted. The whole part goes to each document for
    certain. What is still needed is a Pareto order sample with unequal chances: documents rank by U/(1-U) / (p/(1-p)),
    where U is a hash of the row and p its inclusion chance, which grows with the size (see chances; lean 0: all equal),
    and the least are taken. The sample is of fixed size in words, the unit of the targets: it ends where the source's need
    is filled as nearly as whole documents can. The chances promise that need, so it ends near rank 1, and a document is
    taken about as often as p says. A chance of 1 ranks first.

    Words are summed by source and slice of the order (pre-aggregated), and only the slice in which the need ends is
    sorted: no source is gathered in one task. Texts are read once; what follows reads the columns kept.
    Defined results: a null text has size 0, and 0 words taken; null sources are one source; columns kept that are named
    like those added are replaced. Rows of equal doc_id and text tie, and are all taken or all left. Reruns agree. An empty
    table gives an empty table.
    """
    rest = without(keep or docs.columns, "size", "source_size", "target", "copies", "taken")
    name = {c: unused(c, rest) for c in ("own_source", "own_size", "u", "class", "name", "n", "p", "of", "all", "part", "ends")}
    # 52 bits of a digest that SQL engines share.
    digest = F.md5(F.concat_ws(" ", F.lit(str(seed)), F.col("doc_id").cast("string"), "text"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own_size, own_source, own_class, own_u = (name[c] for c in ("own_size", "own_source", "class", "u"))
    rows = docs.select(*map(quoted, rest), F.col("source").alias(own_source), size.alias(own_size), u.alias(own_u))
    rows = written(rows.withColumn(own_class, F.floor(F.log2(F.greatest(F.col(own_size), F.lit(1)).cast("double")) * STEPS + 1e-9).cast("int")))

    slim = rows.select(F.col(own_source).alias("source"), F.col(own_size).alias("size"), F.col(own_u).alias("u"), F.col(own_class).alias("class"))
    classes = written(slim.groupBy("source", "class").agg(F.sum("size").alias("words")))
    goals = targets(classes.select("source", F.col("words").alias("size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    goals = written(goals.withColumnRenamed("source", "name"))
    chance = written(chances(classes, goals, lean))
    many, most_chances = goals.count(), chance.count()

    def odds(u: str, p: str) -> F.Column:
        """The rank: a chance of 1 has odds without bound, and comes first."""
        return F.when(F.col(p) >= 1, F.lit(0.0)).otherwise(F.col(u) / (1 - F.col(u)) / (F.col(p) / (1 - F.col(p))))

    same = F.col("source").eqNullSafe(F.col("name"))
    ranked = slim.join(_small(chance.withColumnRenamed("class", "of"), most_chances), same & (F.col("class") == F.col("of")))
    ranked = ranked.select("source", "size", odds("u", "p").alias("rank"))
    place = F.floor(F.col("rank") / (1 + F.col("rank")) * SLICES).alias("slice")
    slices = ranked.groupBy("source", place).agg(F.sum("size").alias("words"))
    run = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    before = slices.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    cut = before.join(_small(goals, many), same).where("before < need AND before + words >= need").select("name", "need", "before", F.col("slice").alias("at"))
    cut = written(cut)
    last = ranked.withColumn("slice", place).join(_small(cut, many), same & (F.col("slice") == F.col("at")))
    up = W.partitionBy("source").orderBy("rank").rangeBetween(W.unboundedPreceding, W.currentRow)
    last = last.withColumn("upto", F.col("before") + F.sum("size").over(up))
    tied = last.groupBy("source", "need", "rank").agg(F.max("upto").alias("upto"), F.sum("size").alias("own"))
    # Of the rows that tie at a rank, the middle lies within the need: the mix ends as near to it as it can. Where no row of
    # the slice does, the limit lies below all of them.
    ends = tied.groupBy("source").agg(F.max(F.when(F.col("upto") - F.col("own") / 2 <= F.col("need"), F.col("rank"))).alias("limit"))
    ends = cut.join(ends, F.col("name").eqNullSafe(F.col("source"))).select(F.col("name").alias("cut_name"), "at", "limit")
    # A need that all ranked words don't fill (by rounding) has no cut: then all are taken.
    plan = goals.join(ends, F.col("name").eqNullSafe(F.col("cut_name")), "left").withColumn("all", F.col("cut_name").isNull() & F.col("at").isNull() & (F.col("need") > 0))
    plan = plan.select(F.col("name").alias(name["name"]), F.struct("source_size", "target", "whole", "need", "at", "limit", "all").alias(name["part"]))
    chance = chance.select(F.col("name").alias(name["n"]), F.col("class").alias(name["of"]), F.col("p").alias(name["p"]))
    out = rows.join(_small(plan, many), F.col(own_source).eqNullSafe(F.col(name["name"])))
    out = out.join(_small(chance, most_chances), F.col(own_source).eqNullSafe(F.col(name["n"])) & (F.col(own_class) == F.col(name["of"])), "left")
    part, rank = F.col(name["part"]), odds(own_u, name["p"])
    at = F.floor(rank / (1 + rank) * SLICES)
    more = F.coalesce((part["need"] > 0) & (part["all"] | (at < part["at"]) | (at == part["at"]) & (rank <= part["limit"])), F.lit(False))
    copies = (part["whole"] + more.cast("int")).cast("int")
    return out.select(*map(quoted, rest), F.col(own_size).alias("size"), part["source_size"].alias("source_size"), part["target"].alias("target"), copies.alias("copies"), (F.col(own_size) * copies).alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, (('0x' || md5(concat_ws(' ', '4', doc_id, text))[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM by_source
), poured AS (
  SELECT *, 3 * source_size / weight AS ratio FROM weighed
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
    / (sum(weight) OVER (ORDER BY ratio, weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS own FROM poured
), level AS (
  SELECT max(own) AS level FROM levels WHERE own <= ratio
), target AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN (3 * source_size)::DOUBLE ELSE weight * level END AS target FROM poured, level
), goal AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, target - whole * source_size AS need FROM target
), classed AS (
  SELECT *, pow(2::DOUBLE, floor(log2(greatest(size, 1)) * 4 + 1e-9) * 0.125) AS g FROM sized
), class AS (
  SELECT source, g, sum(size)::BIGINT AS words FROM classed GROUP BY source, g
), chance AS (
  SELECT c.source, c.g, need, (need - coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / nullif(sum(words * g) OVER (PARTITION BY c.source ORDER BY g DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM class c JOIN goal ON c.source IS NOT DISTINCT FROM goal.source
), chosen AS (
  SELECT source, arg_max(level, g) AS level FROM chance WHERE level * g <= 1 GROUP BY source
), settled AS (
  SELECT c.source, c.g, need, least(1, coalesce(chosen.level, 'inf'::DOUBLE) * c.g) AS p FROM chance c LEFT JOIN chosen ON c.source IS NOT DISTINCT FROM chosen.source
), ranked AS (
  SELECT doc_id, c.source, size, need, CASE WHEN p >= 1 THEN 0 ELSE u / (1 - u) / (p / (1 - p)) END AS rank FROM classed c JOIN settled s ON c.source IS NOT DISTINCT FROM s.source AND c.g = s.g
), tied AS (
  SELECT source, rank, need, sum(size) AS own, sum(sum(size)) OVER (PARTITION BY source ORDER BY rank) AS upto FROM ranked GROUP BY source, rank, need
), ends AS (
  SELECT source, max(rank) AS last FROM tied WHERE need > 0 AND upto - own / 2 <= need GROUP BY source
)
SELECT doc_id, size, source_size, target, size * (whole::BIGINT + coalesce(rank <= last, false)::BIGINT) AS taken
FROM ranked r JOIN goal ON r.source IS NOT DISTINCT FROM goal.source LEFT JOIN ends ON r.source IS NOT DISTINCT FROM ends.source
"""
