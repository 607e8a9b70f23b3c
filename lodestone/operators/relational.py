"""Select, project, join, distinct and order, as DataFrame plans that Catalyst optimises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.shared import written


def project(df: DataFrame, *columns: str) -> DataFrame:
    """Listed columns in order; one named twice comes once."""
    return df.select(*dict.fromkeys(columns))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True)) if conditions else F.lit(True)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def int_div(a: str, b: str) -> Column:
    """32-bit integer division of two SQL expressions, truncating towards zero; a zero divisor is an error."""
    return F.expr(f"cast(({a}) div ({b}) as int)")


def join_on(left: DataFrame, right: DataFrame, *conditions: Column) -> DataFrame:
    """Inner join; without conditions the product that was asked for."""
    return left.join(right, all_of(*conditions)) if conditions else left.crossJoin(right)


#: Rows that a task works on for long, and pairs that a task of a join makes, about. Rows of a table that is broadcast, at most.
ROWS, PAIRS, BROADCAST = 10_000, 2_000_000, 100_000


def dealt(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df over as many tasks as its rows ask for: a small file is one task, however long its rows take."""
    tasks = -(-df.count() // (rows or ROWS))
    return df.repartition(tasks) if tasks > 1 else df


def join_few(left: DataFrame, right: DataFrame, left_key: str, right_key: str, *conditions: Column) -> DataFrame:
    """Inner join by keys of few values, with many rows of each on both sides: dealt by the number of pairs, not of rows or keys.

    Both sides of a key are cut into groups, and any two groups meet in a cell of their own, which makes PAIRS pairs at most, about.
    So a row is sent once for each group of the other side: of all pairs, one in hundreds is sent. A cell's pairs come left row by
    left row, with the same right rows in turn, so saved columns repeat many times in a page and compress; for that, groups on the
    right are the smaller ones and numbered, a multiple of 8 to keep packed bits in step.
    conditions on one side alone go first (filter that side); all others may name both. Column names of the sides differ.
    """
    counts = [df.groupBy(F.col(k).alias(f"{side}_key")).agg(F.count("*").alias(side)) for side, df, k in (("a", left, left_key), ("b", right, right_key))]
    keys = counts[0].join(counts[1], F.col("a_key") == F.col("b_key"))
    pairs = keys.agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0]
    tasks = int(-(-(pairs or 0) // PAIRS))
    if tasks < 2:
        return join_on(left, right, F.col(left_key) == F.col(right_key), *conditions)
    group = max(8, int(PAIRS**0.5 / 3) // 8 * 8)
    cells = keys.select("a_key", "b_key", F.ceil(F.col("a") * group / PAIRS).alias("_a"), F.ceil(F.col("b") / group).alias("_b"))
    cells = written(cells.withColumn("_end", F.sum(F.col("_a") * F.col("_b")).over(W.orderBy("a_key"))))
    many, most = cells.agg(F.count("*"), F.max("_a")).first()
    cells = F.broadcast(cells) if many <= BROADCAST else cells
    # Left rows are grouped by the part that they are dealt to, by turns: equal ones part as well.
    a = left.repartition(4 * most).withColumn("_nth", F.spark_partition_id()).join(cells, F.col(left_key) == F.col("a_key"))
    a = a.withColumn("_nth", F.pmod("_nth", "_a")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)))
    a = a.select(*left.columns, (F.col("_end") - 1 - F.col("_nth") * F.col("_b") - F.col("_other")).alias("_cell"))
    b = right.withColumn("_nth", F.row_number().over(W.partitionBy(right_key).orderBy(*right.columns)) - 1).join(cells, F.col(right_key) == F.col("b_key"))
    b = b.withColumn("_nth", F.floor(F.col("_nth") / group)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_a") - 1)))
    b = b.select(*right.columns, (F.col("_end") - 1 - F.col("_other") * F.col("_b") - F.col("_nth")).alias("_cell_b"))
    met = join_on(a.repartition(tasks, "_cell"), b.repartition(tasks, "_cell_b").hint("merge"), F.col("_cell") == F.col("_cell_b"), *conditions)
    return met.drop("_cell", "_cell_b")


def product(tables: list[DataFrame], *conditions: Column) -> DataFrame:
    """Joins of several tables. Conditions go into one filter: Catalyst makes equi joins of them and pushes the rest down."""
    out = reduce(lambda a, b: a.crossJoin(b), tables)
    return out.where(all_of(*conditions)) if conditions else out


def order_by(df: DataFrame, column: str) -> DataFrame:
    """Ascending, ties by the remaining columns in order of name: a total order up to equal rows."""
    return df.orderBy(column, *sorted(c for c in df.columns if c != column))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def described(df: DataFrame) -> DataFrame:
    """A row a column: name, type, place from 1."""
    rows = [(f.name, f.dataType.simpleString(), k) for k, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string, place int")
