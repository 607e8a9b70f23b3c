"""What the corpus operators share: tables, names, word hashes; written() is the library's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.shared import written as written

#: A word, as the contracts have it: a run of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
_ODD1, _ODD2, _ODD3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused(name: str, columns: list[str]) -> str:
    """name, with as many underscores before it as make it none of columns (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(columns: list[str], *names: str) -> list[str]:
    """columns that are none of names, whatever their case."""
    return [c for c in columns if c.lower() not in names]


def words(text: bytes | None) -> list[bytes]:
    """bytes.split() parts at exactly the six characters that WORD leaves out."""
    return text.split() if text else []


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes | None]:
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    return (x.as_py() for x in column)


def per_row(make: Callable[[bytes | None], tuple], keep: list[str], schema: pa.Schema) -> Callable:
    """A mapInArrow function: the columns keep, then what make has of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = list(zip(*map(make, texts_of(batch)), strict=True))
                columns = [batch.column(batch.schema.get_field_index(k)) for k in keep]
                own = [pa.array(v, f.type) for v, f in zip(made, list(schema)[len(keep) :], strict=True)]
                yield pa.record_batch([*(c.cast(f.type) for c, f in zip(columns, schema)), *own], schema=schema)

    return run


def hashed(parts: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * _ODD1
    x ^= x >> _HALF
    x *= _ODD2
    x ^= x >> _HALF
    return x


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive hashes: runs of 1, 2, 4 ... are joined as k's binary digits say."""
    n, size, used, out = len(h) - k + 1, 1, 0, None
    if n <= 0:
        return np.zeros(0, np.uint64)
    while k:
        if k & 1:
            part = h[used : used + n]
            out = part.copy() if out is None else mixed(out * _ODD3 + part)
            used += size
        k >>= 1
        if k:
            h = mixed(h[:-size] * _ODD3 + h[size:])
            size *= 2
    return out


def least_at(v: np.ndarray, w: int) -> np.ndarray:
    """For every w consecutive values, where the leftmost least one stands."""
    at, size = np.arange(len(v)), 1
    while size < w:
        step = min(size, w - size)
        a, b = at[:-step], at[step:]
        at = np.where(v[a] <= v[b], a, b)
        size += step
    return at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
