"""Toxicity: subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import grams, mixed, quoted, table, texts_of, without

#: Embedding rows, their length, and the lengths of character n-grams (a word with its two bounds is a gram too).
ROWS, DIM, GRAMS = 1 << 18, 8, (3, 4, 5)
#: Labelled documents of either class that the model is fitted on, at most; the characters that those of a class hold together,
#: at most, and how many of these one document may hold (a longer one is left out of the sample, whole).
SAMPLE, CHARACTERS, LONGEST = 2000, 16_000_000, 2_000_000
#: Subwords in a step of the fit: what a step needs of memory, however long the documents are.
STEP = 150_000
#: Words averaged at once: a text scores as its worst run of so many words, so length doesn't dilute it.
RUN = 6
#: Texts are worked on in slices of about so many characters.
SLICE = 2_000_000


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all words' subwords, word by word, and where each word begins."""
    text = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    left = (begin + size)[word] - np.arange(len(codes))
    rows, owner = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        if len(at):
            rows.append(grams(codes, n)[at] + np.uint64(n))
            owner.append(word[at])
    # The whole word: its characters' hashes, each turned by its place, summed.
    place = (np.arange(len(codes)) - begin[word]).astype(np.uint64)
    rows.append(np.add.reduceat(mixed(codes + (place << np.uint64(24))), begin))
    owner.append(np.arange(len(words)))
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    rows = (mixed(rows) >> np.uint64(40)) % np.uint64(ROWS)
    return rows[order].astype(np.int32), np.searchsorted(owner[order], np.arange(len(words)))


def tokens(text: str) -> list[str]:
    """Lower-case words without the marks around them; words of marks alone stay."""
    return [w.strip(".,;:!?\"'()[]") or w for w in text.lower().split()]


class Bag:
    """Texts as word numbers: words are numbered by first use; rows and begins give each word's subwords."""

    def __init__(self, texts: list[str]) -> None:
        number: dict[str, int] = {}
        # A word said many times running counts once: the mean of a run is over what is said, not how often.
        ids = [x[np.append(True, x[1:] != x[:-1])] if len(x) else x for x in (np.fromiter((number.setdefault(w, len(number)) for w in tokens(t)), np.int32) for t in texts)]
        self.size = np.array([len(x) for x in ids], np.int64)
        self.ids = np.concatenate([*ids, np.zeros(0, np.int32)])
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        distinct = [*number]
        parts = [grams_of(distinct[k : k + 10_000]) for k in range(0, len(distinct), 10_000)]
        before = np.cumsum([0, *(len(rows) for rows, _ in parts)])
        self.rows = np.concatenate([*(rows for rows, _ in parts), np.zeros(0, np.int32)])
        self.at = np.concatenate([*(at + n for (_, at), n in zip(parts, before)), np.zeros(0, np.int64)])
        self.count = np.diff(np.append(self.at, len(self.rows)))
        #: Subwords of a text's words, on the average.
        total = np.concatenate([[0], np.cumsum(self.count[self.ids])])
        self.heavy = (total[self.end] - total[self.begin]) / np.maximum(1, self.size)

    def worst(self, row_score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text, where its run of RUN words with the highest mean begins, and that mean (0 without words)."""
        where, best = np.zeros(len(self.size), np.int64), np.zeros(len(self.size))
        if not len(self.ids):
            return where, best
        own = np.add.reduceat(row_score[self.rows], self.at)
        total = np.concatenate([[0.0], np.cumsum(own[self.ids])])
        count = np.concatenate([[0], np.cumsum(self.count[self.ids])])
        some = np.flatnonzero(self.size)
        last = np.repeat(self.end[some], self.size[some])
        begin = np.minimum(np.arange(len(self.ids)), np.maximum(last - RUN, np.repeat(self.begin[some], self.size[some])))
        end = np.minimum(begin + RUN, last)
        mean = (total[end] - total[begin]) / (count[end] - count[begin])
        top = np.maximum.reduceat(mean, self.begin[some])
        best[some] = top
        hit = np.flatnonzero(mean == np.repeat(top, self.size[some]))
        owner = np.repeat(some, self.size[some])[hit]
        first = np.unique(owner, return_index=True)[1]
        where[some] = begin[hit[first]]
        return where, best


@dataclass
class Model:
    rows: np.ndarray  # what each embedding row adds to the logit: embeddings times the softmax's difference of classes
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(Bag(texts).worst(self.rows)[1] + self.bias, -30, 30)))


def steps(order: np.ndarray, weight: np.ndarray, most: int = 256) -> Iterator[np.ndarray]:
    """Documents of order in runs of at most `most`, each of about STEP subwords or of a single document."""
    at, total = 0, np.concatenate([[0.0], np.cumsum(weight[order])])
    while at < len(order):
        end = int(np.searchsorted(total, total[at] + STEP, "right")) - 1
        end = min(max(end, at + 1), at + most, len(order))
        yield order[at:end]
        at = end


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 14, rate: float = 0.3, seed: int = 8) -> Model:
    """Embeddings and softmax trained jointly by Adagrad.

    At first a document is all its words; after a few rounds it is its worst run under the present model, for both classes.
    """
    draw = np.random.default_rng(seed)
    e = draw.uniform(-1 / DIM, 1 / DIM, (ROWS, DIM)).astype(np.float32)
    w = draw.normal(0, 0.1, (2, DIM))
    bias = np.zeros(2)
    ge, gw, gb = np.full(ROWS, 1e-6), np.full((2, DIM), 1e-6), np.full(2, 1e-6)
    bag = Bag(texts)
    y = np.eye(2)[toxic.astype(int)]
    # Both classes weigh the same while all words count; later a wrong alarm weighs as it occurs.
    n = np.maximum(1, np.bincount(toxic.astype(int), minlength=2))
    for r in range(rounds):
        if r < 2:
            begin, size = bag.begin, bag.size
        else:
            begin, _ = bag.worst(e @ (w[1] - w[0]))
            size = np.minimum(bag.size, RUN)
        for part in steps(draw.permutation(np.flatnonzero(size)), size * bag.heavy):
            span = np.repeat(np.arange(len(part)), size[part])
            first = np.cumsum(size[part]) - size[part]
            word = bag.ids[np.arange(len(span)) - first[span] + begin[part][span]]
            count = bag.count[word]
            start = np.cumsum(count) - count
            row = bag.rows[np.arange(count.sum()) - np.repeat(start, count) + np.repeat(bag.at[word], count)]
            owner = np.repeat(span, count)
            many = np.bincount(owner, minlength=len(part))[:, None]
            mean = np.add.reduceat(e[row], np.searchsorted(owner, np.arange(len(part)))) / many
            logit = mean @ w.T + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            g = p / p.sum(axis=1, keepdims=True) - y[part]
            g *= (len(toxic) / 2 / n)[toxic[part].astype(int)][:, None]
            gm = g @ w / many
            dw, db = g.T @ mean / len(part), g.mean(axis=0)
            gw += dw**2
            gb += db**2
            w -= rate * dw / np.sqrt(gw)
            bias -= rate * db / np.sqrt(gb)
            used, at = np.unique(row, return_inverse=True)
            de = np.stack([np.bincount(at, gm[owner, k], len(used)) for k in range(DIM)], axis=1)
            ge[used] += (de**2).mean(axis=1)
            e[used] -= (rate * de / np.sqrt(ge[used])[:, None]).astype(np.float32)
    return Model(e @ (w[1] - w[0]), float(bias[1] - bias[0]))


def slices(texts: Iterator[bytes | None]) -> Iterator[list[str]]:
    own, size = [], 0
    for t in texts:
        own.append(t.decode("utf-8", "replace") if t else "")
        size += len(own[-1])
        if size >= SLICE:
            yield own
            own, size = [], 0
    if own:
        yield own


def remainder(column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(column).cast("string")) % 5


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most `most` documents of each class, those of the least hashes among the rows to learn from.

    Spark chooses them, one text a doc_id (the least one), so that no more than the sample reaches the driver: at most
    CHARACTERS a class, in whole texts.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(remainder() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    # At most 2 * most rows of two numbers, so this side is small at any scale.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).withColumn("long", F.length("text")).where(F.col("long") <= LONGEST)
    upto = F.sum("long").over(W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= CHARACTERS).orderBy("doc_id").select("toxic", F.col("text").cast("binary").alias("text"))
    table = rows.toArrow()
    return [t.decode("utf-8", "replace") for t in table.column("text").to_pylist()], table.column("toxic").to_numpy().astype(int)


def score(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """keep (doc_id by default), held_out, score, predicted for every row of docs.

    The model is fitted on the driver from at most 2 * SAMPLE labelled documents whose crc32(doc_id) mod 5 is not 0 (see
    sample for the bounds), in steps of about STEP subwords, and broadcast (ROWS numbers). A score depends on the text alone, all of it. Words share the vectors of their character
    n-grams, so a misspelling that was never seen scores like its kin.
    Defined results: null and empty texts score as a text without words; without labels of both classes every score is
    the prior 0; a null doc_id is not held out. Rows that repeat score alike. Bytes that are no UTF-8 are read as U+FFFD.
    Very long texts score whole. Columns of keep named like those added are replaced. An empty table gives an empty table.
    """
    texts, toxic = sample(docs, labels)
    model = fit(texts, toxic) if 0 < toxic.sum() < len(toxic) else Model(np.zeros(ROWS), -30.0)
    del texts, toxic
    pa.default_memory_pool().release_unused()
    shared = docs.sparkSession.sparkContext.broadcast((model.rows.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            if batch.num_rows:
                got = np.concatenate([own.scores(part) for part in slices(texts_of(batch))])
                columns = batch.columns[:-1]
                yield pa.record_batch([*columns, pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    rest = without(keep or ["doc_id"], "held_out", "score", "predicted")
    # Columns go by number while they are with Python, which takes no name with a dot.
    rows = docs.select(*(F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(rest)), F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), F.col("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, score double, predicted int").toDF(*rest, "held_out", "score", "predicted")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
