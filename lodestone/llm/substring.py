"""Exact substring dedup by relative Lempel-Ziv parsing against indexed reference blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grams, hashed, least_at, per_row, signed, table, texts_of, words, written

#: Words in an anchor. Every window picks the anchor with the least hash among those it holds.
ANCHOR = 16
#: A reference block holds about so many occurrences of an anchor at most; an anchor with more has several blocks.
BLOCK = 1_000


def _picked(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hashes, and for each window the position of the one it picks."""
    v = grams(h, ANCHOR)
    return v, least_at(v, window - ANCHOR + 1)


def summaries(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, row_key (a hash of the text), n_words, sha (of all words joined) and the distinct anchors that the windows of each text pick."""

    def make(text: bytes | None) -> tuple:
        w = words(text)
        digest = hashlib.sha256(b" ".join(w)).digest()
        anchors = None
        if len(w) >= window:
            v, at = _picked(hashed(w), window)
            anchors = signed(np.unique(v[np.unique(at)]))
        return len(w), digest, anchors

    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_words", pa.int64()), ("sha", pa.binary()), ("anchors", pa.list_(pa.int64()))])
    return docs.mapInArrow(per_row(make, ["doc_id", "row_key"], schema), "doc_id long, row_key long, n_words long, sha binary, anchors array<long>")


_SEGMENTS = pa.schema([("anchor", pa.int64()), ("block", pa.int32()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("at", pa.int32()), ("words", pa.binary()), ("seeds", pa.binary())])


def occurrences(texts: DataFrame, window: int) -> DataFrame:
    """A row for each place where windows of a text pick a shared anchor: the words of these windows (a segment), the place
    of the first, and a hash of the segment.

    An anchor that occurs very often has several blocks. A segment goes to each block in which one of its windows belongs,
    by the window's hash, so equal windows meet in one; seeds has the places of those windows (empty: all).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            ids, keys, shared = batch.column(names.index("doc_id")).to_pylist(), batch.column(names.index("row_key")).to_pylist(), batch.column(names.index("shared"))
            out: list[tuple] = []
            for doc_id, key, have, text in zip(ids, keys, shared, texts_of(batch), strict=True):
                w = words(text)
                if len(w) < window:
                    continue
                have = have.values.flatten()
                known, count = have[0].to_numpy().view(np.uint64), have[1].to_numpy()
                order = np.argsort(known)
                known, count = known[order], count[order]
                h = hashed(w)
                v, at = _picked(h, window)
                where = np.minimum(np.searchsorted(known, v[at]), len(known) - 1)
                starts = np.flatnonzero(known[where] == v[at])
                if not len(starts):
                    continue
                at, where = at[starts], where[starts]
                whole, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w])
                edge = np.flatnonzero(np.diff(at)) + 1
                for a, b in zip([0, *edge], [*edge, len(at)], strict=True):
                    first, last = int(starts[a]), int(starts[b - 1]) + window
                    part = whole[ends[first] - len(w[first]) - 1 : ends[last - 1] - 1]
                    anchor, blocks = int(signed(v[at[a] : at[a] + 1])[0]), -(-int(count[where[a]]) // BLOCK)
                    if blocks == 1:
                        out.append((anchor, 0, _name(part, b""), doc_id, key, first, part, b""))
                        continue
                    own = grams(h[first:last], window) % np.uint64(blocks)
                    for k in np.unique(own).tolist():
                        seeds = np.flatnonzero(own == k).astype(np.uint16).tobytes()
                        out.append((anchor, k, _name(part, seeds), doc_id, key, first, part, seeds))
                if len(out) > 20_000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SEGMENTS)], schema=_SEGMENTS)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SEGMENTS)], schema=_SEGMENTS)

    return texts.mapInArrow(cut, "anchor long, block int, segment long, doc_id long, row_key long, at int, words binary, seeds binary")


def _name(part: bytes, seeds: bytes) -> int:
    return int(signed(np.array([xxhash.xxh3_64_intdigest(part + b" " + seeds)], np.uint64))[0])


class Reference:
    """An indexed reference block: segments in the order of their least document, and where each window first stands.

    The index is by a hash of the window; what it finds counts only if the words are the same.
    """

    def __init__(self, window: int) -> None:
        self.window, self.index = window, {}
        self.segments: list[tuple[bytes, list[bytes], list[int], int]] = []

    def find(self, window: bytes) -> tuple[int, tuple[int, int] | None]:
        """The window's number in the index, and its segment and place if it is there."""
        number = hash(window)
        while (found := self.index.get(number)) is not None:
            whole, _, begin, _ = self.segments[found[0]]
            if whole[begin[found[1]] : begin[found[1] + self.window] - 1] == window:
                break
            number += 1  # another window of the same hash
        return number, found

    def parse(self, whole: bytes, seeds: bytes, least: int) -> list[tuple[int, int, int]]:
        """Greedy factors of a segment against the block: first word, length in words, and the document they come from.

        A factor begins at a window that an earlier document holds, and goes on as long as that document's segment has the
        same words: `window` words at least. The parse goes on at the boundary, with the first window that the factor does
        not hold whole, so that a window across it isn't missed. Windows found nowhere join the index, and so does one
        that the same document held before.
        """
        w = whole.split(b" ")
        begin, size = [0], self.window
        for x in w:
            begin.append(begin[-1] + len(x) + 1)
        wanted = np.frombuffer(seeds, np.uint16).tolist() if seeds else range(len(w) - size + 1)
        found, new, following = [], [], 0
        for i in wanted:
            if i < following:
                continue
            number, ref = self.find(whole[begin[i] : begin[i + size] - 1])
            if ref is None:
                new.append((number, i))
                continue
            _, source, _, document = self.segments[ref[0]]
            if document >= least:
                continue
            n, j = size, ref[1]
            while i + n < len(w) and j + n < len(source) and w[i + n] == source[j + n]:
                n += 1
            found.append((i, n, document))
            following = i + n - size + 1
        if new:
            for number, i in new:
                while number in self.index:
                    number += 1
                self.index[number] = (len(self.segments), i)
            self.segments.append((whole, w, begin, least))
        return found


def factors(segments: DataFrame, window: int) -> DataFrame:
    """The relative Lempel-Ziv parse of each distinct segment against its anchor's reference block (see Reference).

    Segments come by least document. Equal segments are one; for the documents beyond the least one, the segment as a whole
    is one factor. Returns anchor, block, segment and factors (first word, words, source document).
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, reference = None, Reference(window)
        for batch in batches:
            out = []
            for anchor, number, segment, least, more, whole, seeds in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if block != (anchor, number):
                    block, reference = (anchor, number), Reference(window)
                found = reference.parse(whole, seeds, least)
                if more:
                    found.append((0, whole.count(b" ") + 1, least))
                if found:
                    out.append((anchor, number, segment, [{"first": a, "n": b, "source": c} for a, b, c in found]))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), kind), strict=True)], names=["anchor", "block", "segment", "factors"])

    kind = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("source", pa.int64())]))
    distinct = segments.groupBy("anchor", "block", "segment", "words", "seeds").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    distinct = distinct.select("anchor", "block", "segment", "least", (F.col("most") > F.col("least")).alias("more"), "words", "seeds")
    return distinct.repartition("anchor", "block").sortWithinPartitions("anchor", "block", "least", "segment").mapInArrow(parse, "anchor long, block int, segment long, factors array<struct<first:int,n:int,source:long>>")


def duplicate_spans(docs: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summaries of all rows, texts of those with shared anchors, and doc_id, row_key, spans: the [begin, end) word spans of
    duplicate windows, those whose words also start in a document with a smaller doc_id."""
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_key"), "text")
    all_rows = written(summaries(docs, window))
    anchors = all_rows.where("doc_id IS NOT NULL").select("doc_id", "row_key", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("anchor", "n")
    held = anchors.join(shared, "anchor").groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("anchor", "n")).alias("shared"))
    texts = written(docs.join(held, ["doc_id", "row_key"]).select("doc_id", "row_key", "text", "shared"))
    found = written(occurrences(texts, window))
    parsed = factors(found, window)
    spans = found.select("anchor", "block", "segment", "doc_id", "row_key", "at").join(parsed, ["anchor", "block", "segment"])
    spans = spans.select("doc_id", "row_key", "at", F.explode("factors").alias("f")).where("f.source < doc_id")
    begin = F.col("at") + F.col("f.first")
    spans = spans.select("doc_id", "row_key", F.struct(begin.alias("begin"), (begin + F.col("f.n")).alias("end")).alias("span"))
    return all_rows, texts, spans.groupBy("doc_id", "row_key").agg(F.collect_list("span").alias("spans"))


def _without(spans: list[dict], w: list[bytes]) -> tuple[list[bytes], int]:
    edge = np.zeros(len(w) + 1, np.int64)
    for s in spans:
        edge[s["begin"]] += 1
        edge[s["end"]] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [x for x, g in zip(w, gone.tolist(), strict=True) if not g], int(gone.sum())


def remove_duplicates(docs: DataFrame, window: int = 50, with_text: bool = False) -> DataFrame:
    """doc_id, row_key, n_words, n_removed, kept_sha256 for every row of docs (doc_id, text; other columns are not read).

    A word goes if a window of `window` words that covers it also starts in a document with a smaller doc_id; windows are
    judged on the input. Every window picks its least `ANCHOR`-word hash, and equal windows pick the same; so the text
    around an anchor that two documents share, and no other, is brought together as reference blocks, and each document's
    part is factored greedily against its block. Factors of neighbouring anchors overlap and add up to a document's spans.
    No count of copies makes a pair of documents.
    with_text adds kept_text, the kept words joined by one space, where words were removed (else null).
    Defined results: a null text has no words. A null doc_id has no order, so such rows lose nothing and take nothing.
    Rows that repeat a doc_id don't count against one another. Texts of under `window` words lose nothing; very long ones are
    worked on whole. Bytes that are no UTF-8 count as they are, and are U+FFFD in kept_text. Other columns, whatever their
    names, are not returned. An empty table gives an empty table.
    """
    all_rows, texts, spans = duplicate_spans(docs, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, spans, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts_of(batch), strict=True):
                left, n = _without(spans, words(text))
                left = b" ".join(left)
                out.append((doc_id, key, n, hashlib.sha256(left).digest(), left.decode("utf-8", "replace") if with_text else None))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["doc_id", "row_key", "n", "left_sha", "left_text"])

    changed = texts.select("doc_id", "row_key", "text").dropDuplicates(["doc_id", "row_key"]).join(spans, ["doc_id", "row_key"]).select("doc_id", "spans", "row_key", "text")
    changed = changed.mapInArrow(cut, "doc_id long, row_key long, n long, left_sha binary, left_text string")
    out = all_rows.select("doc_id", "row_key", "n_words", "sha").join(changed, ["doc_id", "row_key"], "left")
    out = out.select("doc_id", "row_key", "n_words", F.coalesce("n", F.lit(0)).alias("n_removed"), F.lower(F.hex(F.coalesce("left_sha", "sha"))).alias("kept_sha256"), F.col("left_text").alias("kept_text"))
    return out if with_text else out.drop("kept_text")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_duplicates(table(spark, sf_dir, "documents")).drop("row_key")


OP10_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts
), windows AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS x FROM starts
), earliest AS (
  SELECT x, min(doc_id) AS d FROM windows GROUP BY x
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS k FROM windows JOIN earliest USING (x) WHERE d < doc_id
), every AS (
  SELECT r, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM texts
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM every ANTI JOIN gone USING (r, k) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (r)
"""
