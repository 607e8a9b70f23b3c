"""BPE encoding and decoding with a public vocabulary file."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts_of

#: Pieces that a worker remembers; then it forgets them all.
REMEMBER = 500_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Codec:
    """A BPE vocabulary in the JSON form of the tokenizers library: lower case, white space dropped, word ends marked."""

    def __init__(self, definition: str) -> None:
        model = (whole := json.loads(definition))["model"]
        self.ids: dict[str, int] = model["vocab"] | {x["content"]: x["id"] for x in whole["added_tokens"]}
        # The inverse of ids, by number: the vocabulary's strings, and the numbers in decimal digits.
        self.strings = [""] * (1 + max(self.ids.values()))
        for string, k in self.ids.items():
            self.strings[k] = string
        self.decimal = [*map(str, range(len(self.strings)))]
        self.rank = {tuple(x if isinstance(x, list) else x.split(" ")): i for i, x in enumerate(model["merges"])}
        self.end: str = model["end_of_word_suffix"]
        self.special = regex.compile("(" + "|".join(regex.escape(x["content"]) for x in whole["added_tokens"]) + ")")
        self.pieces = regex.compile(next(x for x in whole["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"), regex.V1)
        self.letters = byte_letters()
        self.seen: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: str) -> list[str]:
        """Vocabulary strings of one piece.

        Symbols stand in a doubly linked list; a queue gives the pair of least rank, leftmost first. An entry is stale, and
        skipped, if its left symbol is gone or either symbol has grown since.
        """
        part: list[str | None] = [self.letters[b] for b in piece.encode()]
        part[-1] += self.end
        n, rank = len(part), self.rank
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = right[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank.get((part[i], part[k]))) is not None:
                    heapq.heappush(queue, (r, i, part[i], part[k]))
            if (h := left[i]) >= 0 and (r := rank.get((part[h], part[i]))) is not None:
                heapq.heappush(queue, (r, h, part[h], part[i]))
        return [x for x in part if x is not None and x in self.ids]

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of text that no white space splits."""
        got = tuple(self.ids[t] for piece in self.pieces.findall(chunk) for t in self.merge(piece))
        if len(chunk) <= 64:
            if len(self.seen) >= REMEMBER:
                self.seen.clear()
            self.seen[chunk] = got
        return got

    def encode(self, text: str) -> list[int]:
        out, seen = [], self.seen
        for k, part in enumerate(self.special.split(text) if "<|" in text else (text,)):
            if k % 2:
                out.append(self.ids[part])
                continue
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for chunk in regex.split(r"\p{White_Space}+", part) if regex.search("[\x1c-\x1f]", part) else part.split():
                got = seen.get(chunk)
                out += self.chunk(chunk) if got is None else got
        return out

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings of ids in order; without a decoder in the definition, a space stands between them."""
        return " ".join(map(self.strings.__getitem__, ids))

    def written(self, ids: list[int]) -> str:
        """Decimal ids, one space between them."""
        return " ".join(map(self.decimal.__getitem__, ids))


@lru_cache(2)
def codec(definition: str) -> Codec:
    return Codec(definition)


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs (doc_id, text; other columns are not read).

    The vocabulary file, of fixed size, is read on the driver and broadcast. Each text is encoded as a whole in one task;
    the decoded text is made from the integer ids alone. with_ids adds the ids themselves (array<int>) and the decoded text.
    Defined results: a null or empty text has no ids and decodes to an empty text; rows that repeat or lack a doc_id are
    encoded like any other; bytes that are no UTF-8 are read as U+FFFD; other columns, whatever their names, are not
    returned. An empty table gives an empty table.
    """
    with open(path or default_vocabulary()) as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(definition.value)
        for batch in batches:
            out = []
            for text in texts_of(batch):
                ids = own.encode(text.decode("utf-8", "replace") if text else "")
                decoded = own.decode(ids)
                row = len(ids), hashlib.sha256(own.written(ids).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
                out.append((*row, ids, decoded) if with_ids else row)
            if out:
                yield pa.record_batch([batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[1:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
