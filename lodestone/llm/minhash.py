"""MinHash near-dedup with tensored banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import grams, hashed, mixed, per_row, signed, table, words, written
from .components import components


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; fewer words are one shingle, no words none."""
    h = hashed(words(text.lower())) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    return np.unique(grams(h, k) if len(h) >= k else mixed(grams(h, len(h)) + np.uint64(len(h))))


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set, and two collections a and b of `bands` half keys, each from `rows` minhashes."""
    draw = np.random.default_rng(9)
    odd = draw.integers(0, 2**63, 2 * bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    turn = draw.integers(0, 2**63, 2 * bands * rows, dtype=np.uint64)

    def sign(text: bytes | None) -> tuple:
        s = shingles(text, k)
        if not len(s):
            return 0, None, None, None
        low = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), 2048):
            np.minimum(low, ((s[None, at : at + 2048] ^ turn[:, None]) * odd[:, None]).min(axis=1), out=low)
        half = low.reshape(2 * bands, rows)
        key = half[:, 0]
        for r in range(1, rows):
            key = mixed(key + half[:, r])
        key = signed(np.ascontiguousarray(key))
        return len(s), xxhash.xxh3_128_digest(s.tobytes()), key[:bands], key[bands:]

    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(per_row(sign, ["doc_id"], schema), "doc_id long, n_shingles long, digest binary, a array<long>, b array<long>")


def meetings(sets: DataFrame) -> DataFrame:
    """A row for each document and table key that others share: key, d, the bucket's least and greatest document (lo, hi)
    and its size. A key joins a half key of a with one of b. Minima are pre-aggregated, and written before they are joined
    back, so that both sides of the join are plain shuffles: Spark then splits a large bucket over tasks."""
    keys = sets.select(F.struct("doc_id", "n_shingles").alias("d"), F.explode(F.expr("flatten(transform(a, (x, i) -> transform(b, (y, j) -> xxhash64(i, j, x, y))))")).alias("key"))
    ends = keys.groupBy("key").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("size")).where("lo.doc_id < hi.doc_id")
    return keys.join(written(ends), "key")


def _sized(met: DataFrame, percent: int) -> DataFrame:
    """Pairs x < y of d and e that their sizes don't rule out."""
    met = met.where("d.doc_id <> e.doc_id").where(f"100 * least(d.n_shingles, e.n_shingles) >= {percent} * greatest(d.n_shingles, e.n_shingles)")
    return met.select(F.least("d.doc_id", "e.doc_id").alias("x"), F.greatest("d.doc_id", "e.doc_id").alias("y")).distinct()


def candidates(met: DataFrame, percent: int) -> DataFrame:
    """Each member of a bucket with the bucket's least and greatest document: all pairs of a bucket of up to three."""
    return _sized(met.select("d", F.explode(F.array("lo", "hi")).alias("e")), percent)


def _component_of(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("x").alias("u"), F.col("y").alias("v")))


def _as_links(part: DataFrame) -> DataFrame:
    """Each node linked with its component's least: as much as all links say, and next to no rounds for components()."""
    return part.where("node <> component").select(F.col("component").alias("x"), F.col("node").alias("y"))


def _split(crowd: DataFrame, part: DataFrame) -> DataFrame:
    """key, d, c of buckets whose members lie in different components c; size (members) and load (their shingles)."""
    own = crowd.join(part.select(F.col("node").alias("doc"), "component"), F.col("d.doc_id") == F.col("doc"), "left")
    own = written(own.select("key", "d", F.coalesce("component", "d.doc_id").alias("c")))
    ends = own.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size"), F.sum("d.n_shingles").alias("load")).where("low < high")
    # Written first, as in meetings(): a large meeting can be split.
    return written(own.join(written(ends.select("key", "size", "load")), "key"))


def prefixes(members: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """key, d: for each member d the shingles of its prefix that another member has too.

    A set's prefix is its rarest shingles among all members, so many that two sets that are similar enough can't have
    disjoint ones. A passage that many members share is not rare, so it gathers no one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, have in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                have = np.frombuffer(have.as_buffer(), np.int64)
                yield pa.record_batch([pa.array(np.full(len(have), doc_id, np.int64)), pa.array(have)], schema=schema)

    every = written(full.select("doc_id", "set").join(members.select(F.col("d.doc_id").alias("doc_id")), "doc_id", "left_semi").mapInArrow(each, "doc_id long, key long"))
    often = written(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = every.join(often, "key")
    # Shingles of one member alone come first in its order, so counting them does.
    size = every.groupBy("doc_id").agg(F.count("*").alias("n_shingles"))
    least = W.partitionBy("doc_id").orderBy(F.desc("n"), F.desc("key"))
    last = shared.withColumn("after", F.row_number().over(least)).join(size, "doc_id")
    # The prefix leaves ceil(percent * size) - 1 shingles out, the most frequent.
    last = last.where(F.col("after") >= F.ceil(F.col("n_shingles") * percent / 100))
    return last.select("key", F.struct("doc_id", "n_shingles").alias("d"))


def settled(links: DataFrame, crowd: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """x, y that join what links join, and what buckets of over three members still hide; crowd: key and d of such buckets.

    Members of a bucket that lies in one component hide nothing. The others meet again by exact prefixes (see prefixes),
    so what they are brought together by is rare. Those that still lie in different components are compared in tiles of
    TILE by TILE members: a meeting of any size is dealt over many tasks, and only links become rows. What is left out
    can't change a component.
    """
    part = _component_of(links)
    live, links = _split(crowd, part), _as_links(part)
    if live.isEmpty():
        return links
    live = _split(written(prefixes(live.select("d").distinct(), full, percent)), part)
    few = live.where(f"size <= {FEW}")
    met = few.join(few.select("key", F.col("d").alias("e"), F.col("c").alias("p")), "key").where("c <> p AND d.doc_id < e.doc_id")
    pairs = written(_sized(met.select("d", "e"), percent))
    return written(links.union(confirmed(pairs, full, percent)).union(_tiled(live.where(f"size > {FEW}"), full, percent)))


#: Meetings of up to so many members are joined as they are; larger ones are cut into tiles of about so many members a side,
#: or fewer if they have more than so many shingles (a meeting of n members makes n * n / TILE rows of under 1 KB). A member's row in a tile names its least keys, up to so many.
FEW, TILE, LOAD, NAMED = 8, 1024, 2_000_000, 64


def _met_before(key: int, keys: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a by b: do the two members also share a smaller key? Then they are compared at their least one."""
    known, count = np.unique(np.concatenate([k[k < key] for k in keys]), return_counts=True)
    known, out = known[count > 1], np.zeros((len(a), len(b)), bool)
    for at in range(0, len(known), 4096):
        some = known[at : at + 4096]
        has = np.zeros((len(keys), len(some)), np.float32)
        for i, k in enumerate(keys):
            has[i] = np.isin(some, k)
        out |= has[a] @ has[b].T > 0
    return out


def _tiled(live: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """x, y: links between different components among the members of large meetings; live: key, d, c, size, load.

    A tile holds two chunks of a meeting, and each pair is compared in one of its meetings only. First sketches tell which
    members of a tile have a likely partner in another component. Only their whole sets are then sent to the tile, which
    compares them exactly and returns the links that join its components, never its pairs.
    """

    def alike(group: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """A member, its likely partners and the members' components, which the caller may merge on the way."""
        key, low = group.column("key")[0].as_py(), group.column("low")[0].as_py()
        chunk, ids, part, n = (group.column(c).to_numpy() for c in ("chunk", "doc_id", "c", "n"))
        keys = [np.array(k, np.int64) for k in group.column("keys").to_pylist()]
        part = part.copy()
        own = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        one = group.column("high")[0].as_py() == low
        a = np.flatnonzero(chunk == low)
        b = a if one else np.flatnonzero(chunk != low)
        before = _met_before(key, keys, a, b)
        for i, met in zip(a.tolist(), before, strict=True):
            other = b[~met & (part[b] != part[i]) & (100 * np.minimum(n[b], n[i]) >= percent * np.maximum(n[b], n[i]))]
            other = other[ids[other] > ids[i]] if one else other
            if len(other := other[likely(own[other], own[i][None], percent)]):
                yield i, other, part

    def flag(group: pa.Table) -> pa.Table:
        some = np.zeros(group.num_rows, bool)
        for i, other, _ in alike(group):
            some[i] = some[other] = True
        return group.select(["key", "low", "high", "doc_id"]).filter(pa.array(some))

    def link(group: pa.Table) -> pa.Table:
        ids, out = group.column("doc_id").to_pylist(), []
        sets = [np.frombuffer(s, np.uint64) for s in group.column("set").to_pylist()]
        known, code = np.unique(np.concatenate(sets), return_inverse=True)
        code, has = np.split(code, np.cumsum([len(s) for s in sets])[:-1]), np.zeros(len(known), bool)
        for i, other, part in alike(group):
            has[code[i]] = True
            for j in other.tolist():
                if part[i] != part[j]:
                    common = int(np.count_nonzero(has[code[j]]))
                    if 100 * common >= percent * (len(code[i]) + len(code[j]) - common):
                        part[part == part[j]] = part[i]
                        out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
            has[code[i]] = False
        return pa.table([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["x", "y"])

    chunks = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("load") / LOAD)).alias("chunks")
    live = live.select("key", "c", chunks, F.col("d.doc_id").alias("doc_id"), F.col("d.n_shingles").alias("n"))
    keys = live.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, NAMED).alias("keys"))
    rows = live.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), "chunks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "doc_id", "n", "c")
    facts = full.select("doc_id", "sketch", "set").join(keys, "doc_id")
    flagged = rows.join(facts.drop("set"), "doc_id").groupBy("key", "low", "high").applyInArrow(flag, "key long, low long, high long, doc_id long")
    rows = rows.join(written(flagged), ["key", "low", "high", "doc_id"]).join(facts, "doc_id")
    return rows.groupBy("key", "low", "high").applyInArrow(link, "x long, y long").distinct()


#: Bins of a sketch: the least hash of a set in each, by 8 bits of it (0: none).
BINS = 128


def sketch(s: np.ndarray) -> bytes:
    """s: sorted hashes."""
    out = np.zeros(BINS, np.uint8)
    first = np.searchsorted(s, np.arange(BINS, dtype=np.uint64) << np.uint64(57))
    some = np.flatnonzero(np.append(first[1:], len(s)) > first)
    out[some] = mixed(s[first[some]]) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def likely(p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Of rows of sketches, those whose share of equal bins isn't 4.5 standard deviations below the similarity asked for."""
    some = ((p | q) > 0).sum(axis=1)
    equal = ((p == q) & (p > 0)).sum(axis=1)
    s = percent / 100
    return equal >= s * some - 4.5 * np.sqrt(s * (1 - s) * some)


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs x, y whose whole sets are similar enough. Sketches rule most of the others out (and a pair at the
    threshold with a chance of under 1 in 100,000), so that few whole sets are moved."""

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, q = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(likely(p, q, percent)))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                common = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def both(rows: DataFrame, name: str) -> DataFrame:
        left, right = (full.select(F.col("doc_id").alias(c), F.col(name).alias(f"_{c}")) for c in "xy")
        return rows.join(left, "x").join(right, "y").select("x", "y", "_x", "_y")

    near = both(pairs, "sketch").mapInArrow(guess, "x long, y long")
    return both(near, "set").mapInArrow(check, "x long, y long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 9, rows: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are not read).

    Documents whose sets of k-word shingles have 100 * intersection >= percent * union are linked. Equal sets are one
    node. The others are found by tensored banding: bands * bands table keys a document come from 2 * bands half keys,
    so 2 * bands * rows minhashes do for what would take bands * bands * 2 * rows. A pair at the threshold 0.8 shares a
    key but for a chance of 2 * (1 - 0.8 ** rows) ** bands (2 in 10,000 as set). Every candidate is confirmed on whole sets.

    First each document's least candidate is confirmed, then every candidate that still lies between two components, then
    what large buckets still hide (see settled). Pairs within a component are not needed, and not made.
    Defined results: null or empty texts have no shingles, no links and are kept. Rows with a null doc_id have a null
    component, no links and are kept. Rows that repeat a doc_id are one document, linked if any of them is.
    An empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text")
    signed_docs = written(signatures(docs, k, bands, rows))
    some = signed_docs.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    node = some.groupBy("digest").agg(F.min("doc_id").alias("node"))
    sets = some.join(node, "digest").where("doc_id = node").select("doc_id", "n_shingles", "a", "b").dropDuplicates(["doc_id", "n_shingles", "a", "b"])
    met = written(meetings(sets))
    pairs = written(candidates(met, percent))
    crowd = met.where("size > 3 AND d.doc_id <> lo.doc_id AND d.doc_id <> hi.doc_id").select("key", "d")
    schema = pa.schema([("doc_id", pa.int64()), ("set", pa.binary()), ("sketch", pa.binary())])

    def whole_set(text: bytes | None) -> tuple[bytes, bytes]:
        s = shingles(text, k)
        return s.tobytes(), sketch(s)

    held = met.select(F.col("d.doc_id").alias("doc_id")).distinct()
    full = written(docs.join(held, "doc_id").mapInArrow(per_row(whole_set, ["doc_id"], schema), "doc_id long, set binary, sketch binary").where("length(set) > 0"))
    first = pairs.groupBy("y").agg(F.min("x").alias("x")).select("x", "y")
    part = _component_of(confirmed(first, full, percent))
    a, b = (part.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "xy")
    apart = pairs.join(first, ["x", "y"], "left_anti").join(a, "x", "left").join(b, "y", "left").where("NOT coalesce(cx = cy, false)").select("x", "y")
    links = _as_links(part).union(confirmed(apart, full, percent))
    links = settled(links, crowd, full, percent).select(F.col("x").alias("u"), F.col("y").alias("v"))
    same = some.join(node, "digest").where("doc_id <> node").select(F.col("node").alias("u"), F.col("doc_id").alias("v"))
    part = components(links.union(same))
    whole = signed_docs.select("doc_id", "n_shingles").join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return whole.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


OP9_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM texts WHERE len(w) > 0
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x FROM starts
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * common.n >= 80 * (s.n + t.n - common.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM texts UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM texts JOIN least USING (doc_id) LEFT JOIN size USING (doc_id)
"""
