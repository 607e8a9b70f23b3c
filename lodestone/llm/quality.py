"""Quality by co-training: a classifier of the words and one of the page's metadata teach each other."""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, table, texts_of, without, written
from .toxicity import remainder

#: Labelled documents of either class that the models are fitted on, at most.
SAMPLE = 4000
#: Rounds of exchange, and the unlabelled documents of a class that either view labels for the other in a round, at most: the
#: surest of all rows, and only such as score beyond SURE.
ROUNDS, TAUGHT, SURE = 4, 300, 0.95
#: One-hot places for sources and for languages, and hash places for words and for pairs of words.
PLACES, WORDS = 32, 128

_LETTERS, _DIGITS, _BLANKS = string.ascii_letters.encode() + bytes(range(128, 256)), string.digits.encode(), b" \t\n\v\f\r"
_ENDS = (b".", b"!", b"?", b":", b'"', b"|")


def content(text: bytes) -> np.ndarray:
    """What the text says: its words and pairs of words by hash, their repetition and variety, the make-up of its
    characters, and the lines that it is written in."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    if not n:
        return np.concatenate([[1.0], np.zeros(20 + 2 * WORDS)])
    counts, twos = Counter(words), Counter(zip(words, words[1:]))
    common = sorted(counts.values(), reverse=True)[:5]
    lower = len(text.translate(None, string.ascii_uppercase.encode()))
    letters, digits = size - len(text.translate(None, _LETTERS)), size - len(text.translate(None, _DIGITS))
    marks = size - letters - digits - (size - len(text.translate(None, _BLANKS)))
    odd = size - len(text.translate(None, b"#$%&*|@^~<>{}[]\\=_+"))
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    long = [len(x) for x in lines]
    ends = sum(x.rstrip().endswith(_ENDS) for x in lines) / len(lines)
    made = [0.0, again / n, np.sqrt(again / n), common[0] / n, sum(common) / n, len(counts) / n, np.log(len(counts)) / np.log(n + 1), len(twos) / max(1, n - 1), letters / size, digits / size, marks / size, np.sqrt(odd / size), (size - lower) / size, size / n / 10]
    made += [np.log1p(len(lines)), np.log1p(max(long)), np.log1p(sum(long) / len(long)), ends, len({*lines}) / len(lines), sum(k < 30 for k in long) / len(long), np.log1p(n)]
    code = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts))
    one = np.bincount(code % WORDS, np.fromiter(counts.values(), float, len(counts)), WORDS)
    hashes = dict(zip(counts, code.tolist()))
    pair = np.fromiter(((hashes[x] * 31 + hashes[y]) % 2_147_483_647 % WORDS for x, y in twos), np.int64, len(twos))
    two = np.bincount(pair, np.fromiter(twos.values(), float, len(twos)), WORDS)
    return np.concatenate([made, np.sqrt(one / n), np.sqrt(two / max(1, n - 1))])


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """What is known of the page without its text: its noted length, its language and its source."""
    size = np.log1p(max(0, n_chars or 0))
    out = [float(n_chars is None), size, size**2 / 10]
    for x in (lang, source):
        hot = [0.0] * PLACES
        hot[zlib.crc32(x.encode()) % (PLACES - 1) + 1 if x is not None else 0] = 1.0
        out += hot
    return out


@dataclass
class Logistic:
    """Logistic regression on standardised features; `slope` and `shift` calibrate its logit."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return self.slope * (z @ self.weights[1:] + self.weights[0]) + self.shift

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))

    @classmethod
    def fitted(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1
        z = np.column_stack([np.ones(len(x)), np.clip((x - mean) / scale, -6, 6)])
        w, keep = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
        keep[0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-9), z.T @ (y - p) - keep * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        return cls(mean, scale, w)


def _calibrate(model: Logistic, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling on given labels."""
    fit = Logistic.fitted(model.logit(x)[:, None], y, 1e-3)
    model.slope = float(fit.weights[1] / fit.scale[0])
    model.shift = float(fit.weights[0] - fit.weights[1] * fit.mean[0] / fit.scale[0])


@dataclass
class CoTrained:
    """Views 0 (content) and 1 (metadata), each calibrated, and how their logits add up."""

    views: list[Logistic]
    weights: np.ndarray

    def scores(self, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both = self.weights[0] + self.weights[1] * self.views[0].logit(x[0]) + self.weights[2] * self.views[1].logit(x[1])
        return self.views[0].score(x[0]), self.views[1].score(x[1]), 1 / (1 + np.exp(-np.clip(both, -30, 30)))


def co_train(x: list[np.ndarray], y: np.ndarray, surest: Callable, rounds: int = ROUNDS) -> CoTrained:
    """In each round either view is fitted on its labels and labels for the other those unlabelled documents that it is surest of.

    surest(models, taught) returns, for each view, the features of such documents in both views and their pseudo-labels;
    taught[v] has the ids that view v was given before. A third of the given labels is kept back for calibration;
    pseudo-labels never enter that.
    """
    back = np.arange(len(y)) % 3 == 0
    if len({*y[back]}) < 2 or len({*y[~back]}) < 2:
        back = np.zeros(len(y), bool)
    teach, check = ~back, back if back.any() else ~back
    own = [(x[v][teach], y[teach]) for v in (0, 1)]
    taught = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for _ in range(rounds):
        models = [Logistic.fitted(*own[v]) for v in (0, 1)]
        for v, (ids, views, labels) in enumerate(surest(models, taught)):
            other = 1 - v
            if len(ids):
                taught[other] = np.concatenate([taught[other], ids])
                own[other] = (np.concatenate([own[other][0], views[other]]), np.concatenate([own[other][1], labels]))
    views = [Logistic.fitted(*own[v]) for v in (0, 1)]
    for v in (0, 1):
        _calibrate(views[v], x[v][check], y[check])
    logits = np.column_stack([views[v].logit(x[v][check]) for v in (0, 1)])
    last = Logistic.fitted(logits, y[check], 1.0)
    slopes = last.weights[1:] / last.scale
    return CoTrained(views, np.array([last.weights[0] - slopes @ last.mean, *slopes]))


def _features(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Of both views, from text, lang, source and n_chars."""
    texts = [t or b"" for t in texts_of(batch)]
    known = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _GIVEN[1:])
    return [np.array([content(t) for t in texts]), np.array([metadata(*r) for r in zip(*known, strict=True)])]


_GIVEN = ["text", "lang", "source", "n_chars"]


def _given(columns: list[str]) -> list[F.Column]:
    """text, lang, source and n_chars of a table with these columns, null where it has none."""
    have = {c.lower() for c in columns}
    return [(F.col(c) if c in have else F.lit(None)).cast("long" if c == "n_chars" else "string").alias(c) for c in _GIVEN]


def _single(rows: DataFrame) -> DataFrame:
    """One row a doc_id, that of its least text."""
    return rows.groupBy("doc_id", "quality").agg(F.min(F.struct(*_GIVEN)).alias("d")).select("doc_id", "quality", "d.*")


def _measured(rows: DataFrame) -> DataFrame:
    """doc_id, quality and the features of both views, in single precision."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                x = [pa.array([v.astype(np.float32).tobytes() for v in view], pa.binary()) for view in _features(part)]
                yield pa.record_batch([part.column(0), part.column(1), *x], names=["doc_id", "quality", "x0", "x1"])

    return rows.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), *_GIVEN).mapInArrow(measure, "doc_id long, quality int, x0 binary, x1 binary")


def _matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1).astype(np.float64)


def _surest(pool: DataFrame, labels: DataFrame, models: list[Logistic], taught: list[np.ndarray]) -> list[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """See co_train. All of pool is scored; a task keeps TAUGHT documents a view and class, and so do all tasks together."""
    shared = pool.sparkSession.sparkContext.broadcast((models, taught))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, taught = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            for v, name in enumerate(("x0", "x1")):
                p = models[v].score(_matrix(batch.column(batch.schema.get_field_index(name)).to_pylist()))
                free = ~np.isin(ids, taught[1 - v])
                for label, sure in ((1, p), (0, 1 - p)):
                    at = np.flatnonzero(free & (sure > SURE))
                    at = at[np.lexsort((ids[at], -sure[at]))][:TAUGHT]
                    if len(at):
                        rows = batch.select(["doc_id", "x0", "x1"]).take(pa.array(at))
                        yield pa.record_batch([*rows.columns, pa.array(np.full(len(at), v, np.int32)), pa.array(np.full(len(at), label, np.int32)), pa.array(sure[at])], names=["doc_id", "x0", "x1", "view", "label", "sure"])

    found = written(pool.mapInArrow(run, "doc_id long, x0 binary, x1 binary, view int, label int, sure double"))
    # Labelled documents drop out here, where few rows are left, so that no texts or features are shuffled.
    found = found.join(labels.select("doc_id"), "doc_id", "left_anti")
    out = []
    for v in (0, 1):
        some = [found.where((F.col("view") == v) & (F.col("label") == k)).orderBy(F.desc("sure"), "doc_id").limit(TAUGHT) for k in (0, 1)]
        got = some[0].union(some[1]).toArrow()
        views = [_matrix(got.column(c).to_pylist()) for c in ("x0", "x1")] if got.num_rows else []
        out.append((got.column("doc_id").to_numpy(), views, got.column("label").to_numpy().astype(float)))
    shared.unpersist()
    return out


def score(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """keep (doc_id by default), held_out, content_score, metadata_score, score, predicted (of good quality) for every row.

    Two views: the text, and the page's language, source and noted length. Both are fitted on the driver, on features (not
    texts) of at most SAMPLE labelled documents a class; in each round Spark scores all unlabelled documents with both, and
    the surest teach the other view. All of these rows have crc32(doc_id) mod 5 not 0. Every row is scored, whole.
    Defined results: null and empty texts have no words and no lines; null or missing lang, source or n_chars have a place
    of their own; without labels of both classes all score the prior 1; a null doc_id is not held out. Of rows that repeat a
    doc_id one is learned from, and each is scored by itself. Very long texts score whole. Columns of keep named like those
    added are replaced. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(remainder() != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = [known.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    given = docs.select("doc_id", *_given(docs.columns)).where("doc_id IS NOT NULL")
    # At most 2 * SAMPLE rows of two numbers.
    got = _measured(_single(given.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id"))).orderBy("doc_id").toArrow()
    y = got.column("quality").to_numpy()
    model = None
    if {0, 1} <= {*y.tolist()}:
        free = given.where(remainder() != 0).withColumn("quality", F.lit(-1))
        pool = written(_measured(free))
        model = co_train([_matrix(got.column(c).to_pylist()) for c in ("x0", "x1")], y.astype(float), lambda m, t: _surest(pool, labels, m, t))
    shared = spark.sparkContext.broadcast(model)
    rest = without(keep or ["doc_id"], "held_out", "content_score", "metadata_score", "score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                parts = shared.value.scores(_features(part)) if shared.value else [np.ones(part.num_rows)] * 3
                yield pa.record_batch([*part.columns[:-4], *(pa.array(p) for p in parts), pa.array((parts[2] >= 0.5).astype(np.int32))], names=[*part.schema.names[:-4], "content_score", "metadata_score", "score", "predicted"])

    # Columns go by number while they are with Python, which takes no name with a dot.
    rows = docs.select(*(F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(rest)), F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), *_given(docs.columns))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-4])
    out = rows.mapInArrow(run, f"{schema}, content_score double, metadata_score double, score double, predicted int")
    return out.toDF(*rest, "held_out", "content_score", "metadata_score", "score", "predicted")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
