"""Tables: named, typed, changed by replacement. Each change is a new DataFrame; checkpoint() cuts a long history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column types of a declared table.
TYPES = {"int": T.IntegerType(), "str20": T.StringType()}


class Tables:
    """Named tables of one session, held as DataFrames and visible to spark.sql as temporary views."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._own = spark, {}

    def _put(self, name: str, df: DataFrame) -> DataFrame:
        self._own[name] = df
        df.createOrReplaceTempView(name)
        return df

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._own:
            raise KeyError(f"no table {name}")
        return self._own[name]

    def names(self) -> list[str]:
        return sorted(self._own)

    def create(self, name: str, columns: dict[str, str]) -> DataFrame:
        """An empty table. A name in use and an unknown type are errors."""
        if name in self._own:
            raise ValueError(f"table {name} exists")
        if bad := [t for t in columns.values() if t.lower() not in TYPES]:
            raise ValueError(f"type {bad[0]} is not supported")
        return self._put(name, self.spark.createDataFrame([], T.StructType([T.StructField(c, TYPES[t.lower()]) for c, t in columns.items()])))

    def register(self, name: str, df: DataFrame) -> DataFrame:
        return self._put(name, df)

    def drop(self, name: str) -> None:
        self[name]
        del self._own[name]
        self.spark.catalog.dropTempView(name)

    def insert(self, name: str, columns: Sequence[str], *rows: Sequence) -> DataFrame:
        """Rows of values for columns in any order."""
        types = {f.name: f.dataType for f in self[name].schema.fields}
        new = self.spark.createDataFrame([*map(tuple, rows)], T.StructType([T.StructField(c, types[c]) for c in columns]))
        return self.insert_from(name, new)

    def insert_from(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows of a query, by column name; columns that it lacks are null, and those that the table lacks are an error."""
        old = self[name]
        if more := [c for c in rows.columns if c not in old.columns]:
            raise ValueError(f"table {name} has no column {more[0]}")
        new = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in old.dtypes]
        return self._put(name, old.union(rows.select(*new)))

    def delete(self, name: str, condition: Column | None = None) -> DataFrame:
        """Rows where the condition is true go; where it is null they stay."""
        gone = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
        return self._put(name, self[name].where(~gone))

    def checkpoint(self, name: str) -> DataFrame:
        """Cuts a table's history of changes by a written copy in the session's checkpoint folder, which must be set."""
        return self._put(name, self[name].checkpoint())


def random_table(spark: SparkSession, rows: int, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """sid 0-199, homework 0-99, grade stt0-stt9, project 0-49, exam 0-4; the same rows for a seed however it is split."""

    def upto(n: int, k: int) -> Column:
        # Two steps of a congruential generator on the row's number: arithmetic that any SQL engine has.
        x = F.pmod((F.col("id") + F.lit(1009 * seed + 97 * k)) * F.lit(48271) + F.lit(11), F.lit(2147483647))
        return ((F.pmod(x * F.lit(48271) + F.lit(k), F.lit(2147483647)) / F.lit(97)).cast("long") % n).cast("int")

    ids = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    return ids.select(upto(200, 1).alias("sid"), upto(100, 2).alias("homework"), F.concat(F.lit("stt"), upto(10, 3)).alias("grade"), upto(50, 4).alias("project"), upto(5, 5).alias("exam"))
