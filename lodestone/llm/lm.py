"""LM scoring: a causal self-attention model on subword ids, trained in numpy by tasks over all training rows, mixed with what
follows what in them, beside a unigram base."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed, signed, table, texts_of, written

#: Characters of text in a block: the unit whose distinct words are looked up together.
BLOCK = 8_000_000
#: Width of vectors, context window, and the positions by which a window overlaps the one before.
WIDTH, WINDOW, OVERLAP = 32, 16, 5
#: Classes of subwords, and subwords in each. Rarer subwords are one class more, spread by their corpus counts.
CLASSES, MEMBERS = 32, 32
#: Steps (at least: small tables are passed more than once), and windows in a step; documents that train() takes, at most.
SAMPLE, STEPS, BATCH = 1500, 2000, 128
#: Where tables are passed once: windows in a step, and rounds of tasks after whose last step the weights are averaged.
LARGE, ROUNDS = 512, 3
#: The mixture's weights are fitted to logarithms of ratios, by so many steps in each direction, BINS over 2 * RANGE in all.
BINS, RANGE = 512, 16
#: Windows scored at once, and parts in which counts of subwords after others are summed.
AT_ONCE, SLICES = 1024, 64
#: Windows whose attention is computed together.
CACHED = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Subwords:
    """A public byte-level vocabulary in tiktoken's form. The id after its last is the end of a text."""

    def __init__(self, ranks: str) -> None:
        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.end = max(table.values()) + 1
        self.opens = np.zeros(self.end + 1, bool)
        self.opens[[i for x, i in table.items() if x[:1] == b" "]] = True

    def of(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Subwords of words, one after another, each word with a blank before it; and where each word's begin."""
        if not distinct:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        text = b" " + b" ".join(distinct)
        ids = np.array(self.coder.encode_ordinary(text.decode("utf-8", "replace")), np.int32)
        begin = np.flatnonzero(self.opens[ids])
        if len(begin) != len(distinct):
            each = [self.coder.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in distinct]
            size = np.array([*map(len, each)])
            return np.concatenate([np.array(x, np.int32) for x in each]), np.cumsum(size) - size
        return ids, begin


@lru_cache(2)
def _subwords(ranks: str) -> Subwords:
    return Subwords(ranks)


def packed(x: np.ndarray, planes: int) -> bytes:
    """Numbers below 256 ** planes by planes of their bytes: the higher ones are mostly zero, and compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes].T).tobytes()


def unpacked(x: pa.Scalar, planes: int) -> np.ndarray:
    own = np.frombuffer(x.as_buffer(), np.uint8).reshape(planes, -1)
    out = np.zeros((own.shape[1], 4), np.uint8)
    out[:, :planes] = own.T
    return out.reshape(-1).view("<u4").astype(np.int32)


def listed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """How many words each text has, all their words as places among the distinct ones, and these, by first occurrence.

    The split is Arrow's, at the six characters that WORD leaves out; it would make an empty word of a blank that begins or
    ends a text, so these are stripped.
    """
    each = pa.array([x.strip() or None for x in texts], pa.large_binary())
    own = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(each), each.buffers(), each.null_count))
    size, coded = pc.fill_null(pc.list_value_length(own), 0).to_numpy().astype(np.int64), own.flatten().dictionary_encode()
    _, at, data = coded.dictionary.buffers()
    whole, at = (data.to_pybytes() if data else b""), np.frombuffer(at, np.int64)[: len(coded.dictionary) + 1].tolist()
    return size, coded.indices.to_numpy(), [whole[i:j] for i, j in pairwise(at)]


def _rows(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1 ... for each run of size."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - begin, size)


# The model


@dataclass
class Seen:
    """What follows what in all training rows, between slots; for rare subwords, after each class."""

    pairs: np.ndarray  # slot before x slot: the counts' part of its probability
    rest: np.ndarray  # of each slot before: the model's part
    rare: np.ndarray  # class before x subword: log probability among the rare ones

    @classmethod
    def fitted(cls, model: Attention, counts: np.ndarray, texts: list[np.ndarray], end: int) -> Seen:
        """counts: of slots after slots, then of rare subwords after classes; the mixture fits texts of the training rows (see mixed)."""
        slot, context = model.slot, Context.of(counts)
        target, given = _stream(np.concatenate(texts), np.array([*map(len, texts)]), end)
        at, own = windows(np.array([len(t) + 1 for t in texts]))
        np.minimum(at, len(target) - 1, out=at)
        met = np.zeros(64 * BINS)
        for i in range(0, len(at), AT_ONCE):
            part, wanted = at[i : i + AT_ONCE], own[i : i + AT_ONCE]
            goal, last = target[part[wanted]], slot[given[part[wanted]]]
            p = model.log_probs(given[part], target[part], wanted).astype(np.float64)
            p -= np.where(slot[goal] == CLASSES * MEMBERS, model.rare[goal], 0)
            met += context.met(last, slot[goal], p)
        return cls.mixed(model, counts, met, end)

    @classmethod
    def mixed(cls, model: Attention, counts: np.ndarray, met: np.ndarray, end: int) -> Seen:
        """Witten-Bell probabilities of the counts over the model's are mixed with the model's own.

        The mixture's weights, by the size of the count before, fit the targets whose ratios were met (see Context).
        """
        context, met, share = Context.of(counts), met.reshape(64, BINS), np.full((64, 1), 0.5)
        rare = counts[context.pairs.size :].reshape(CLASSES + 1, end + 1)
        ratio = np.exp((np.arange(BINS) + 0.5) * (2 * RANGE / BINS) - RANGE)
        for _ in range(20):
            part = met * (share * ratio / (share * ratio + 1 - share))
            share = (part.sum(axis=1, keepdims=True) + 1) / (met.sum(axis=1, keepdims=True) + 2)
        share, total, kinds = share[context.bucket, 0], context.total, context.kinds
        low = np.maximum(1, (rare > 0).sum(axis=1, keepdims=True))
        spread = np.log((rare + low * np.exp(model.rare)) / (rare.sum(axis=1, keepdims=True) + low))
        return cls((context.pairs * (share / (total + kinds))[:, None]).astype(np.float32), 1 - share + share * kinds / (total + kinds), spread.astype(np.float32))


@dataclass
class Context:
    """Counts of what follows what: how much likelier than by the model a target is by them, when it is left out itself."""

    pairs: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    bucket: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Context:
        n = CLASSES * MEMBERS + 1
        pairs = counts[: n * n].reshape(n, n)
        total = pairs.sum(axis=1)
        return cls(pairs, total, np.maximum(1, (pairs > 0).sum(axis=1)), np.log2(total + 1).astype(np.int64))

    def met(self, last: np.ndarray, goal: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """How many targets (slots, after the slots last, with the model's log probabilities) have which ratio, by bucket."""
        p, seen = np.exp(np.maximum(log_p, -60.0)), self.pairs[last, goal]
        left, many = np.maximum(seen - 1, 0), np.maximum(1, self.kinds[last] - (seen == 1))
        ratio = np.log((left + many * p) / (np.maximum(self.total[last] - 1, 0) + many) / p)
        at = np.clip((ratio + RANGE) * (BINS / (2 * RANGE)), 0, BINS - 1).astype(np.int64)
        return np.bincount(self.bucket[last] * BINS + at, minlength=64 * BINS)


@dataclass
class Attention:
    """One layer of causal self-attention; a softmax over classes of subwords, then one over the class's members.

    slot: for each subword, its place among CLASSES * MEMBERS (class after class), or the last slot, for rare ones.
    """

    slot: np.ndarray
    rare: np.ndarray  # log probability of each subword among the rare ones
    weights: dict[str, np.ndarray]
    seen: Seen | None = None

    def _attend(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        w = self.weights
        n, length, d = x.shape
        q, k, v = (x.reshape(-1, d) @ w["qkv"]).reshape(n, length, 3, d).transpose(2, 0, 1, 3)
        a = _shares(q @ k.transpose(0, 2, 1), np.float32(d**-0.5))
        a /= (a.reshape(-1, length) @ np.ones(length, np.float32)).reshape(n, length, 1)
        z = a @ v
        return q, k, v, a, z, x + (z.reshape(-1, d) @ w["out"]).reshape(x.shape)

    def _products(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query (scaled), key, value (after "out") and the vector itself, side by side: the matrix, and its products with slots and places."""
        w, d = self.weights, WIDTH
        by = np.concatenate([w["qkv"][:, :d] * np.float32(d**-0.5), w["qkv"][:, d : 2 * d], w["qkv"][:, 2 * d :] @ w["out"], np.eye(d, dtype=np.float32)], axis=1)
        return by, w["token"] @ by, w["place"] @ by

    def _wide(self, slots: np.ndarray, wanted: np.ndarray | None = None, made: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """What _attend makes of windows of slots, for given weights, and a one after each row, by which biases are added.

        Products with weights are made once a slot, not once a position. Windows go in parts that stay in a core's own cache;
        positions before the first that any of a part's windows wants are only looked at (of what they would be, nothing is set).
        """
        (n, length), d = slots.shape, WIDTH
        _, each, place = made or self._products()
        out, ones = np.ones((n, length, d + 1), np.float32), np.ones(length, np.float32)
        for i in range(0, n, CACHED):
            part = slice(i, i + CACHED)
            lead = 0 if wanted is None else int(wanted[part].any(axis=0).argmax())
            x = np.take(each, slots[part], axis=0)
            x += place
            a = _shares(x[:, lead:, :d] @ x[:, :, d : 2 * d].transpose(0, 2, 1), np.float32(1))
            a /= (a.reshape(-1, length) @ ones).reshape(*a.shape[:2], 1)
            np.add(a @ x[:, :, 2 * d : 3 * d], x[:, lead:, 3 * d :], out=out[part, lead:, :d])
        return out.reshape(-1, d + 1)

    def _hidden(self, slots: np.ndarray) -> np.ndarray:
        return self._wide(slots)[:, :WIDTH]

    def _outer(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes and of each class's members, the biases being a row more."""
        w = self.weights
        return np.concatenate([w["class"], w["class_bias"][None]]), np.concatenate([w["member"], w["member_bias"][:, None]], axis=1)

    @staticmethod
    def _members(h: np.ndarray, weights: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of the members of the classes that rows of h, in order of class, belong to: class c's rows end before ends[c + 1]."""
        out = np.empty((ends[CLASSES], MEMBERS), np.float32)
        for c in np.flatnonzero(np.diff(ends[: CLASSES + 1])):
            np.matmul(h[ends[c] : ends[c + 1]], weights[c], out=out[ends[c] : ends[c + 1]])
        return out

    def log_probs(self, ids: np.ndarray, target: np.ndarray, wanted: np.ndarray, made: tuple[tuple[np.ndarray, ...], ...] | None = None) -> np.ndarray:
        """Natural log probabilities of target (windows x WINDOW) at the positions wanted, in order. made: _products and _outer, if known.

        Scores are small numbers as a rule, and then sums of exponentials are taken as they are, by products with ones; where
        one could overflow, rows are first lowered by their maxima.
        """
        products, (by_class, by_member) = made or (self._products(), self._outer())
        slots, at = self.slot[ids], np.flatnonzero(wanted)
        goal = target.ravel()[at]
        slot = self.slot[goal]
        kind = (slot // MEMBERS).astype(np.uint8)
        order = np.argsort(kind, kind="stable")
        kind, slot, goal = kind[order], slot[order], goal[order]
        h = np.take(self._wide(slots, wanted, products), at[order], axis=0)
        logit = h @ by_class
        _lower(logit)
        out = logit.ravel()[np.arange(0, logit.size, CLASSES + 1) + kind]
        out -= np.log(np.exp(logit, out=logit) @ np.ones(CLASSES + 1, np.float32))
        ends = np.searchsorted(kind, np.arange(CLASSES + 2))
        logit, few = self._members(h, by_member, ends), slice(ends[CLASSES])
        _lower(logit)
        out[few] += logit.ravel()[np.arange(0, logit.size, MEMBERS) + slot[few] % MEMBERS]
        out[few] -= np.log(np.exp(logit, out=logit) @ np.ones(MEMBERS, np.float32))
        some = slice(ends[CLASSES], None)
        if self.seen:
            before = slots.ravel()[at[order]]
            out = np.log(np.maximum(1e-300, self.seen.pairs[before, slot] + self.seen.rest[before] * np.exp(out, dtype=np.float64)))
            out[some] += self.seen.rare[before[some] // MEMBERS, goal[some]]
        else:
            out[some] += self.rare[goal[some]]
        back = np.empty_like(out)
        back[order] = out
        return back


#: Of what is larger, an exponential could overflow in sums of single precision.
HIGH = 60


def _lower(logit: np.ndarray) -> None:
    if logit.max(initial=0) > HIGH:
        logit -= logit.max(axis=1, keepdims=True)


def _shares(a: np.ndarray, scale: np.float32) -> np.ndarray:
    """Exponentials of a times scale, of what may be seen, in place; rows are lowered first where one could overflow."""
    if scale != 1:
        a *= scale
    if a.max(initial=0) > HIGH:
        a += MASK[-a.shape[1] :]
        a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    a *= SEEN[-a.shape[1] :]  # windows may be without their first rows
    return a


SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))
MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def windows(size: np.ndarray, overlap: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows over texts of so many targets, and which of them a window scores: each target once.

    The first window scores all of its positions, each later one those after its first OVERLAP (or overlap).
    """
    overlap = OVERLAP if overlap is None else overlap
    step = WINDOW - overlap
    many = 1 + np.maximum(0, -(-(size - WINDOW) // step))
    end = np.cumsum(size)
    nth = _rows(np.zeros(len(size), np.int64), many)
    at = (np.repeat(end - size, many) + nth * step)[:, None] + np.arange(WINDOW)
    own = at < np.repeat(end, many)[:, None]
    own[:, :overlap] &= (nth == 0)[:, None]
    return at, own


def _stream(ids: np.ndarray, size: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Targets of texts of the given sizes, each with its end, and what stands before each target."""
    target = np.full(len(ids) + len(size), end, np.int32)
    inner = np.ones(len(target), bool)
    inner[np.cumsum(size) + np.arange(len(size))] = False
    target[inner] = ids
    return target, np.concatenate([np.array([end], np.int32), target[:-1]])  # a text begins after the end of the one before


def scores(model: Attention, ids: np.ndarray, size: np.ndarray, end: int, alone: float | None = None) -> np.ndarray:
    """log10 probability of each text of the given sizes (its subwords, then the end); alone: of an end only, if known."""
    if not len(size):
        return np.zeros(0)
    after = np.cumsum(size) + np.arange(len(size))
    target, given = _stream(ids, size, end)
    at, own = windows(size + 1)
    got, made = np.zeros(len(target)), (model._products(), model._outer())
    np.minimum(at, len(target) - 1, out=at)
    # Texts' first windows go together, since the others need nothing of their first positions.
    order = np.argsort(~own[:, 0], kind="stable")
    for i in range(0, len(at), AT_ONCE):
        part, wanted = at[order[i : i + AT_ONCE]], own[order[i : i + AT_ONCE]]
        got[part[wanted]] = model.log_probs(given[part], target[part], wanted, made)
    out = np.add.reduceat(got, after - size) / np.log(10)
    if (size == 0).any():
        # Texts of an end only are alike in all blocks: one window, taken by itself.
        ends = np.full((1, WINDOW), end)
        out[size == 0] = model.log_probs(ends, ends, np.arange(WINDOW)[None] == 0)[0] / np.log(10) if alone is None else alone
    return out


def _classes(seen: np.ndarray, n: int) -> np.ndarray:
    """n subwords, numbered 0 to n - 1, in an order in which those that follow the same ones stand together.

    seen: how often each (and all others, as number n) follows each.
    """
    like = np.sqrt(seen[:n] / np.maximum(1, seen[:n].sum(axis=1, keepdims=True)))
    left, value, _ = np.linalg.svd(like - like.mean(axis=0), full_matrices=False)
    place = left[:, :8] * value[:8]

    def halves(members: np.ndarray, parts: int) -> list[np.ndarray]:
        if parts == 1:
            return [members]
        own = place[members]
        axis = np.linalg.svd(own - own.mean(axis=0), full_matrices=False)[2][0]
        order = members[np.argsort(own @ axis, kind="stable")]
        return halves(order[: len(order) // 2], parts // 2) + halves(order[len(order) // 2 :], parts // 2)

    return np.concatenate(halves(np.arange(n), CLASSES))


def _first(counts: np.ndarray) -> np.ndarray:
    """Numbers of the most frequent subwords, the end being 0; all others have one number more."""
    end, n = len(counts) - 1, CLASSES * MEMBERS
    order = np.argsort(-counts, kind="stable")
    first = np.full(len(counts), n, np.int32)
    first[np.concatenate([[end], order[order != end][: n - 1]])] = np.arange(n)
    return first


def begun(counts: np.ndarray, seen: np.ndarray, seed: int = 1) -> Attention:
    """The model before training. counts: of each subword and the end; seen: of what follows what by _first (see _classes)."""
    draw, n, d = np.random.default_rng(seed), CLASSES * MEMBERS, WIDTH
    place, first = np.full(n + 1, n, np.int32), _first(counts)
    place[_classes(seen, n)] = np.arange(n)
    slot = place[first]
    tail = np.where(slot == n, counts + 0.5, 0)
    rare = np.log(np.maximum(tail, 1e-30) / tail.sum())
    # Biases begin at the corpus's own frequencies.
    by = np.bincount(slot, counts + 0.5, n + 1)
    classes = np.add.reduceat(by, np.arange(0, n + 1, MEMBERS))
    members = by[:n].reshape(CLASSES, MEMBERS)
    w = {
        "token": draw.normal(0, 0.3, (n + 1, d)), "place": draw.normal(0, 0.1, (WINDOW, d)), "qkv": draw.normal(0, d**-0.5, (d, 3 * d)), "out": draw.normal(0, d**-0.5, (d, d)),
        "class": draw.normal(0, 0.1, (d, CLASSES + 1)), "class_bias": np.log(classes / classes.sum()), "member": draw.normal(0, 0.1, (CLASSES, d, MEMBERS)), "member_bias": np.log(members / members.sum(axis=1, keepdims=True)),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    return Attention(slot, rare, w)


def train(texts: list[np.ndarray], counts: np.ndarray, seed: int = 1) -> Attention:
    """The model of a few texts (subword ids), in one process; counts: of each subword and the end, in the whole training corpus."""
    texts, end, n, first = texts[:SAMPLE], len(counts) - 1, CLASSES * MEMBERS, _first(counts)
    size = np.array([*map(len, texts)])
    target, given = _stream(np.concatenate(texts), size, end)
    seen = np.zeros((n + 1, n + 1))
    np.add.at(seen, (first[target], first[given]), 1)
    model, draw = begun(counts, seen, seed), np.random.default_rng(seed)
    at, own = windows(size + 1)
    np.minimum(at, len(target) - 1, out=at)
    picks = (draw.integers(0, len(at), BATCH) for _ in range(STEPS))
    rates = (0.02 * min(1, t / 50) * (1 - 0.95 * t / STEPS) for t in range(1, STEPS + 1))
    for _ in _adam(model, ((given[at[x]], target[at[x]], own[x]) for x in picks), rates):
        pass
    return model


def _adam(model: Attention, batches: Iterable[tuple[np.ndarray, ...]], rates: Iterable[float]) -> Iterator[np.ndarray]:
    """Changes the model's weights batch by batch, and gives each batch's log probabilities from before its step."""
    names, flat = [*model.weights], np.concatenate([x.ravel() for x in model.weights.values()])
    ends = np.cumsum([x.size for x in model.weights.values()])
    # One array of all weights, of which the model's are views: a step is a few passes over it.
    model.weights.update({k: x.reshape(model.weights[k].shape) for k, x in zip(names, np.split(flat, ends[:-1]), strict=True)})
    m, s, part = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    for t, (batch, rate) in enumerate(zip(batches, rates, strict=False), 1):
        grad, log_p = _gradient(model, *batch)
        g = np.concatenate([grad[k].ravel() for k in names])
        np.subtract(g, m, out=part)
        part *= np.float32(0.1)
        m += part
        g *= g
        g -= s
        g *= np.float32(0.01)
        s += g
        np.multiply(s, np.float32(1 / (1 - 0.99**t)), out=part)
        np.sqrt(part, out=part)
        part += np.float32(1e-6)
        np.divide(m, part, out=part)
        part *= np.float32(rate / (1 - 0.9**t))
        flat -= part
        yield log_p


def learn(model: Attention, ids: np.ndarray, size: np.ndarray, end: int, context: Context, rates: tuple[float, float], passes: int, seed: int) -> np.ndarray:
    """Passes over all windows of texts, each target once a pass; and which ratios the last pass met (see Context.met).

    Each target's probability is that before the step that learns from it. The rate goes from the first of rates to the second.
    """
    draw, met = np.random.default_rng(seed), np.zeros(64 * BINS)
    target, given = _stream(ids, size, end)
    at, own = windows(size + 1, 0)
    np.minimum(at, len(target) - 1, out=at)
    batch = BATCH if passes > 1 else LARGE
    steps = -(-len(at) // batch)
    picks = [x for _ in range(passes) for order in [draw.permutation(len(at))] for x in np.array_split(order, steps)]
    speed = (min(1, t / 50) * (rates[0] + (rates[1] - rates[0]) * t / len(picks)) for t in range(1, len(picks) + 1))
    for t, log_p in enumerate(_adam(model, ((given[at[x]], target[at[x]], own[x]) for x in picks), speed)):
        if t >= len(picks) - steps:
            which = at[picks[t]][own[picks[t]]]
            met += context.met(model.slot[given[which]], model.slot[target[which]], log_p)
    return met


def _gradient(model: Attention, ids: np.ndarray, target: np.ndarray, wanted: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of the mean loss over the positions wanted; and their log probabilities, without the rare subwords' own.

    Products with weights are made once a slot (see Attention._wide). So gradients of these products are summed by slot and by
    place first, and come to the weights from there.
    """
    w, d, total, (n, length), slots = model.weights, WIDTH, np.float32(1 / max(1, wanted.sum())), ids.shape, model.slot[ids]
    by, each, place = model._products()
    parts, ones = [slice(i, i + CACHED) for i in range(0, n, CACHED)], np.ones(length, each.dtype)
    x, hidden, shares = np.empty((n, length, 4 * d), each.dtype), np.ones((n, length, d + 1), each.dtype), []
    for part in parts:
        own = np.take(each, slots[part], axis=0, out=x[part], mode="clip")
        own += place
        a = _shares(own[:, :, :d] @ own[:, :, d : 2 * d].transpose(0, 2, 1), np.float32(1))
        a /= (a.reshape(-1, length) @ ones).reshape(-1, length, 1)
        np.add(a @ own[:, :, 2 * d : 3 * d], own[:, :, 3 * d :], out=hidden[part, :, :d])
        shares.append(a)
    at = np.flatnonzero(wanted)
    slot = model.slot[target.ravel()[at]]
    order = np.argsort(slot.astype(np.int16), kind="stable")
    at, slot = at[order], slot[order]
    h, kind, (by_class, by_member) = np.take(hidden.reshape(-1, d + 1), at, axis=0), slot // MEMBERS, model._outer()

    def softmax(logit: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Log probabilities of goal; logit turns into the gradient."""
        _lower(logit)
        whole, where = logit.reshape(-1), np.arange(0, logit.size, logit.shape[1]) + goal
        own = whole[where]
        np.exp(logit, out=logit)
        sums = logit @ np.ones(logit.shape[1], logit.dtype)
        own -= np.log(sums)
        logit *= (total / sums)[:, None]
        whole[where] -= total
        return np.maximum(own, np.float32(np.log(1e-30)))

    p = h @ by_class
    log_p = softmax(p, kind)
    to_class = h.T @ p
    dh = p @ w["class"].T
    ends = np.searchsorted(kind, np.arange(CLASSES + 1))
    p, few = model._members(h, by_member, ends), slice(ends[CLASSES])
    log_p[few] += softmax(p, slot[few] - kind[few] * MEMBERS)
    to_member, more = np.zeros_like(by_member), np.empty((ends[CLASSES], d), dh.dtype)
    for c in np.flatnonzero(np.diff(ends)):
        some = slice(ends[c], ends[c + 1])
        np.matmul(h[some].T, p[some], out=to_member[c])
        np.matmul(p[some], w["member"][c].T, out=more[some])
    dh[few] += more
    back = np.empty_like(log_p)
    back[order] = log_p
    # Gradients take the places of what they are of, once that is not needed any more.
    x.reshape(-1, 4 * d)[at, 3 * d :] = dh
    x[~wanted, 3 * d :] = 0
    to_place = np.zeros(length * 4 * d, x.dtype)
    for part, a in zip(parts, shares, strict=True):
        own = x[part]
        query, key, value, to = (own[:, :, i : i + d] for i in range(0, 4 * d, d))
        da = to @ value.transpose(0, 2, 1)
        da -= ((da * a).reshape(-1, length) @ ones).reshape(-1, length, 1)
        da *= a
        to_query = da @ key
        key[:] = da.transpose(0, 2, 1) @ query
        query[:] = to_query
        value[:] = a.transpose(0, 2, 1) @ to
        to_place += np.ones(len(a), x.dtype) @ own.reshape(len(a), -1)
    to_place = to_place.reshape(length, 4 * d)
    to_slot = _sums(x.reshape(-1, 4 * d), slots.ravel(), len(each))
    to_by = w["token"].T @ to_slot + w["place"].T @ to_place
    value = to_by[:, 2 * d : 3 * d]
    g = {
        "token": to_slot @ by.T, "place": to_place @ by.T, "qkv": np.concatenate([to_by[:, :d] * np.float32(d**-0.5), to_by[:, d : 2 * d], value @ w["out"].T], axis=1), "out": w["qkv"][:, 2 * d :].T @ value,
        "class": to_class[:d], "class_bias": to_class[d], "member": to_member[:, :d], "member_bias": to_member[:, d],
    }
    return g, back


def _sums(rows: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each of n groups. Groups of equal size are summed together: reduceat takes several times as long."""
    size = np.bincount(of, minlength=n)
    turn = np.argsort(size, kind="stable")
    place = np.empty(n, np.int16)
    place[turn] = np.arange(n)
    order, out, sizes = np.argsort(place[of], kind="stable"), np.zeros((n, rows.shape[1]), rows.dtype), size[turn]
    first = np.flatnonzero(np.diff(sizes, prepend=0))
    done, ones = 0, np.ones(len(rows), rows.dtype)
    for k, last in zip(first, [*first[1:], n], strict=True):
        many = (last - k) * sizes[k]
        out[turn[k:last]] = ones[: sizes[k]] @ np.take(rows, order[done : done + many], axis=0).reshape(last - k, sizes[k], -1)
        done += many
    return out


# On Spark


def _training(column: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 != 1, F.lit(True))


_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("places", pa.binary()), ("hashes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("pieces", pa.binary()), ("lengths", pa.binary()), ("piece_ids", pa.list_(pa.int32())), ("piece_counts", pa.list_(pa.int64()))])


def _blocks(docs: DataFrame, ranks: str) -> DataFrame:
    """Texts in blocks: each text as places in its block's list of distinct words, and the words' hashes, counts and subwords."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, n = _subwords(shared.value), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        train: list[bool] = []
        texts: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal n
            n += 1
            each, whole, distinct = listed(texts)
            pa.default_memory_pool().release_unused()  # else each worker keeps what a block's split took
            counts = np.bincount(whole[np.repeat(np.array(train), each)], minlength=len(distinct))
            pieces, begins = coder.of(distinct)
            many = np.diff(np.append(begins, len(pieces)))
            of = np.bincount(pieces, np.repeat(counts, many), coder.end + 1).astype(np.int64)
            of[coder.end] = sum(train)
            some = np.flatnonzero(of)
            row = [task << 32 | n, ids, train, each.astype(np.int32), packed(whole, 4), signed(hashed(distinct)), counts.astype(np.int64), packed(pieces, 3), packed(many, 4), some.astype(np.int32), of[some]]
            return pa.record_batch([pa.array([x], f.type) for x, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in batches:
            for doc_id, learn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch), strict=True):
                texts.append((text or b"").lower())
                ids.append(doc_id)
                train.append(learn)
                size += len(text or b"")
                if size >= BLOCK:
                    yield block()
                    ids, train, texts, size = [], [], [], 0
        if ids:
            yield block()

    schema = "block long, doc_ids array<long>, train array<boolean>, sizes array<int>, places binary, hashes array<long>, counts array<long>, pieces binary, lengths binary, piece_ids array<int>, piece_counts array<long>"
    return docs.select(F.col("doc_id").cast("long"), _training().alias("train"), "text").mapInArrow(gather, schema)


def _subwords_of(size: np.ndarray, places: np.ndarray, pieces: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of a block's texts, one text after another, and how many each has."""
    begins, after = np.cumsum(many) - many, np.cumsum(size)
    whole = pieces[_rows(begins[places].astype(np.int64), many[places])] if len(places) else pieces[:0]
    lengths = np.concatenate([[0], np.cumsum(many[places])])
    return whole, lengths[after] - lengths[after - size]


def _training_stream(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of a block's training texts, and how many each has; row: train, sizes, places, pieces, lengths."""
    train, many = row.column(0).flatten().to_numpy(zero_copy_only=False).astype(bool), row.column(1).flatten().to_numpy().astype(np.int64)
    ids, many = _subwords_of(many, *(unpacked(row.column(c)[0], planes) for c, planes in ((2, 4), (3, 3), (4, 4))))
    return ids[np.repeat(train, many)], many[train]


def _contexts(blocks: DataFrame, numbers: np.ndarray, end: int) -> np.ndarray:
    """Over all training rows, how often each number follows each; numbers: of each subword, as _first has them.

    Each task adds up its blocks and Spark sums the tasks' counts by slices; their number is fixed by the vocabulary.
    """
    n = CLASSES * MEMBERS + 1
    width, shared = -(-n * n // SLICES), blocks.sparkSession.sparkContext.broadcast(numbers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, out = shared.value, np.zeros(width * SLICES, np.int64)
        for row in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            target, given = _stream(*_training_stream(row), end)
            out[: n * n] += np.bincount(numbers[given].astype(np.int64) * n + numbers[target], minlength=n * n)
        for k in range(SLICES):
            some = out[k * width : (k + 1) * width]
            if some.any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([packed(some, 4)], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own[k] = own.get(k, 0) + unpacked(x, 4).view(np.uint32).astype(np.int64)
        for k, x in own.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["slice", "counts"])

    schema, out = "slice int, counts binary", np.zeros(width * SLICES, np.int64)
    parts = blocks.select("train", "sizes", "places", "pieces", "lengths").mapInArrow(count, schema).repartition(SLICES, "slice")
    for k, x in parts.mapInArrow(add, schema).collect():
        out[k * width : (k + 1) * width] = np.frombuffer(x, np.int64)
    return out[: n * n].reshape(n, n)


def _renumbered(pairs: np.ndarray, numbers: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """What _contexts counts by numbers, by slots: both tell the same subwords apart."""
    back = np.zeros(len(pairs), np.int64)
    back[slot] = numbers
    return pairs[np.ix_(back, back)]


def _learned(blocks: DataFrame, model: Attention, counts: np.ndarray, end: int, positions: float) -> tuple[Attention, np.ndarray, np.ndarray]:
    """The model trained on all training rows, the ratios met there (see Context), and how often each rare subword follows each class.

    counts: of slots after slots; positions: targets of all training rows.
    One block is learned first. Then rounds of the others begin at the weights so far; each block is learned by itself, and the
    weights that blocks come to are averaged by their numbers of targets. Each block has its turn in one round, so all rows are
    learned from equally often. What tasks return is of fixed size, and Spark sums it by slices.
    """
    context, names = Context.of(counts), [*model.weights]
    ends = np.cumsum([model.weights[k].size for k in names])
    size, many_rare, spark = int(ends[-1]) + 1 + 64 * BINS, (CLASSES + 1) * (end + 1), blocks.sparkSession
    width, rare_width, met = -(-size // SLICES), -(-many_rare // SLICES), np.zeros(64 * BINS)
    all_rare = np.zeros(rare_width * SLICES, np.int64)
    context = spark.sparkContext.broadcast(context)
    (least, many), turn = blocks.agg(F.min("block"), F.count("*")).first(), F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF)
    passes = max(1, min(STEPS // max(1, many), -int(-STEPS * BATCH * WINDOW // max(1, positions))))
    turns = [F.col("block") == least, *((F.col("block") != least) & (turn % ROUNDS == r) for r in range(ROUNDS))]

    def part_of(k: int, sums: np.ndarray, rare: bytes) -> pa.RecordBatch:
        return pa.record_batch([pa.array([k], pa.int32()), pa.array([sums.tobytes()], pa.binary()), pa.array([rare], pa.binary())], names=["slice", "sums", "rare"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                sums, rare = own.get(k, (0, 0))
                own[k] = sums + np.frombuffer(x.as_buffer(), np.float64), rare + unpacked(y, 4).view(np.uint32).astype(np.int64)
        for k, (x, y) in own.items():
            yield part_of(k, x, y.tobytes())

    for r, mine in enumerate(turns if least is not None else []):
        shared, rates = spark.sparkContext.broadcast(model), ((0.02, 0.01), (0.01, 0.006), (0.006, 0.003), (0.003, 0.0005))[r]

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rates=rates) -> Iterator[pa.RecordBatch]:
            out, rare, slot = np.zeros(width * SLICES), np.zeros(rare_width * SLICES, np.int64), shared.value.slot
            for row in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
                ids, many = _training_stream(row)
                if len(many):
                    own = replace(shared.value, weights={k: v.copy() for k, v in shared.value.weights.items()})
                    n = float(many.sum() + len(many))
                    out[ends[-1] + 1 : size] += learn(own, ids, many, end, context.value, rates, passes, row.column(5)[0].as_py() % (1 << 32))
                    out[: ends[-1]] += n * np.concatenate([own.weights[k].ravel() for k in names])
                    out[ends[-1]] += n
                    target, given = _stream(ids, many, end)
                    few = slot[target] == CLASSES * MEMBERS
                    rare[:many_rare] += np.bincount(slot[given[few]].astype(np.int64) // MEMBERS * (end + 1) + target[few], minlength=many_rare)
            if out[ends[-1]]:
                for k in range(SLICES):
                    yield part_of(k, out[k * width : (k + 1) * width], packed(rare[k * rare_width : (k + 1) * rare_width], 4))

        schema, sums = "slice int, sums binary, rare binary", np.zeros(width * SLICES)
        parts = blocks.where(mine).select("train", "sizes", "places", "pieces", "lengths", "block").mapInArrow(run, schema)
        for k, x, y in parts.repartition(SLICES, "slice").mapInArrow(add, schema).collect():
            sums[k * width : (k + 1) * width] = np.frombuffer(x, np.float64)
            all_rare[k * rare_width : (k + 1) * rare_width] += np.frombuffer(y, np.int64)
        if n := sums[ends[-1]]:
            each = np.split((sums[: ends[-1]] / n).astype(np.float32), ends[:-1])
            model = replace(model, weights={k: x.reshape(model.weights[k].shape) for k, x in zip(names, each, strict=True)})
            met += sums[ends[-1] + 1 : size]
    return model, met, all_rare[:many_rare]


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    Tokens are lower-cased (A-Z) words and one end. The base is a unigram model over all training rows: each block of texts
    lists its distinct words by a 64-bit hash; their counts are summed over the corpus and joined back to the blocks.
    The model reads subwords. All of it comes from all training rows: frequencies, classes, the counts of what follows what
    that its output is mixed with (see Seen), the mixture and the attention's weights (see _learned). It is trained by tasks, and
    broadcast with the vocabulary, both of fixed size. Each text is scored whole, in windows that overlap, each subword once.
    Defined results: a null or empty text is its end alone. A null doc_id is not held out. Rows that repeat count each time
    and score alike (to the last places: windows of different blocks are multiplied in other groups). Very long texts are
    scored whole; bytes that are no UTF-8 are words like any others, and their subwords are of U+FFFD. Other columns,
    whatever their names, are not read. Without training rows every weight is a prior. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    with open(path or default_vocabulary()) as f:
        ranks = f.read()
    blocks = written(_blocks(docs, ranks))
    counts = blocks.select(F.explode(F.arrays_zip("hashes", "counts")).alias("w")).select(F.col("w.hashes").alias("hash"), F.col("w.counts").alias("n")).where("n > 0").groupBy("hash").agg(F.sum("n").alias("n"))
    counts = written(counts)
    ends = blocks.agg(F.sum(F.size(F.filter("train", lambda x: x)))).first()[0] or 0
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = total + ends, kinds + (ends > 0)

    coder = _subwords(ranks)
    of = np.zeros(coder.end + 1)
    # A row for each entry of the vocabulary at most.
    for k, n in blocks.select(F.explode(F.arrays_zip("piece_ids", "piece_counts")).alias("p")).groupBy("p.piece_ids").agg(F.sum("p.piece_counts")).collect():
        of[k] = n
    numbers = _first(of)
    pairs = _contexts(blocks, numbers, coder.end)
    model = begun(of, pairs.T)
    pairs = _renumbered(pairs, numbers, model.slot).ravel()
    model, met, rare = _learned(blocks, model, pairs, coder.end, float(of.sum()))
    model.seen = Seen.mixed(model, np.concatenate([pairs, rare]), met, coder.end)
    # Made once: last places of sums may differ between processes.
    alone = float(scores(model, np.zeros(0, np.int32), np.zeros(1, np.int64), coder.end)[0])
    model = spark.sparkContext.broadcast(model)

    known = blocks.select("block", F.posexplode("hashes").alias("at", "hash")).join(counts, "hash").groupBy("block").agg(F.collect_list(F.struct("at", "n")).alias("known"))
    rows = blocks.select("block", "doc_ids", "train", "sizes", "places", "pieces", "lengths").join(known, "block", "left").drop("block")
    end, low = coder.end, float(total) + 0.5 * (kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            ids, learn, size, places, pieces, many, found = row.columns
            size = size.flatten().to_numpy().astype(np.int64)
            places, pieces, many = (unpacked(x[0], n) for x, n in ((places, 4), (pieces, 3), (many, 4)))
            c = np.zeros(len(many))
            if found[0].is_valid:
                at, n = found.flatten().flatten()
                c[at.to_numpy()] = n.to_numpy()
            after, own = np.cumsum(size), np.log10((c + 0.5) / low)
            seen = np.concatenate([[0], np.cumsum(c[places] > 0)])
            # Summed text by text, so that equal texts have equal sums wherever they stand.
            base, some = np.full(len(size), np.log10((ends + 0.5) / low)), size > 0
            base[some] += np.add.reduceat(own[places], (after - size)[some]) if some.any() else 0
            seen = seen[after] - seen[after - size] + (ends > 0)
            got = scores(model.value, *_subwords_of(size, places, pieces, many), end, alone)
            out = [ids.flatten(), pa.array(~learn.flatten().to_numpy(zero_copy_only=False)), pa.array(size + 1), pa.array(seen.astype(np.int64)), pa.array(np.full(len(size), total, np.int64)), pa.array(base), pa.array(got)]
            yield pa.record_batch(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
