"""The corpus operators against brute force, round trips and held-out accuracy, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann, bpe, licenses, lm, minhash, mixing, mpeg, quality, queries, substring, toxicity

DATA = "/root/testdata/sf0.001"
#: A very long text of distinct words.
LONG = " ".join(f"q{i}x" for i in range(40_000))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(x):
    return WORD.findall((x or "").encode())


def near_components(texts, k):
    """Set sizes and least reachable ids of {id: text}, by comparing all that share a shingle."""
    sets, index = {}, defaultdict(list)
    for i, text in texts.items():
        w = words((text or "").encode().lower().decode())
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        for x in sets[i]:
            index[x].append(i)
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, own in sets.items():
        for j, n in Counter(j for x in own for j in index[x] if j > i).items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(own), top(i)) for i, own in sets.items()}


def left_words(rows):
    """For each (id, text): its words and which of them stand in a window of 50 that starts in a smaller id's text."""
    first = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = [True] * 50
        out.append((w, gone))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, very long and repeated texts, and columns named like those that operators add."""
    w = " ".join(f"w{i}" for i in range(120))
    rows = [(8, LONG, "es", "c", 1, 2, 0.5), (1, w, "en", "a", 9, 5, 1.0), (1, w, "en", "a", 9, 5, 1.0), (2, None, None, None, None, None, None), (3, "", "de", "b", 0, 1, 0.0), (None, w, "en", None, 9, 1, 0.0), (5, w + " tail end", "en", "b", 9, 1, 0.0), (6, "long " * 30000, "fr", "a", 1, 1, 0.0), (7, " \n\t ", "en", "b", 3, 1, 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, score double")


def test_bpe(spark, docs):
    tokenizers, P = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    extra = ["", None, "İstanbul ΑΣ <|endoftext|> x", "a b\x1cc", "'s they'll 123 !!! ñandú", "é"]
    mine = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, x) for i, x in enumerate(extra)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in mine.collect()}
    for r in bpe.encode(mine, with_ids=True).collect():
        want = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (want, len(want))
        assert r.decoded == t.decode(want, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()


def test_near_duplicates(docs):
    want = near_components({r.doc_id: r.text for r in docs.collect()}, 4)
    for r in minhash.near_duplicates(docs, k=4).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """A crowd around one base, whose members are alike only in pairs: each pair must be one component."""
    monkeypatch.setattr(minhash, "TILE", 16)
    draw = np.random.default_rng(0)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for k in range(60):
        own = base[:]
        for i in draw.choice(100, 9, replace=False):
            own[i] = f"x{k}_{i}"
        twin = [*own]
        twin[50] = f"t{k}"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(twin))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert all(got[2 * k] == got[2 * k + 1] for k in range(60))


@pytest.mark.parametrize("block", [4000, 2])
def test_substrings(docs, monkeypatch, block):
    monkeypatch.setattr(substring, "BLOCK", block)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i: (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()) for (i, _), (w, gone) in zip(rows, left_words(rows))}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_duplicates(docs).collect()} == want


def test_factors_follow_the_reference():
    ref = substring.Reference(5)
    text = [f"w{i}".encode() for i in range(30)]
    assert ref.parse(b" ".join(text), b"", 1) == []
    # One long factor; a strange word ends it; what follows is too short; then the boundary's windows are looked up again.
    mine = [*text[3:15], b"other", *text[16:19], b"other", *text[20:30]]
    assert ref.parse(b" ".join(mine), b"", 2) == [(0, 12, 1), (17, 10, 1)]
    # Two sources that overlap by less than a window: the windows across the boundary are found in a third document only.
    ref = substring.Reference(5)
    for k, part in ((1, text[:10]), (2, text[10:20]), (3, text[6:14])):
        ref.parse(b" ".join(part), b"", k)
    got = ref.parse(b" ".join(text[:20]), b"", 4)
    assert got[0] == (0, 10, 1) and {d for _, _, d in got} == {1, 2, 3} and {j for i, n, _ in got for j in range(i, i + n - 4)} == set(range(16))
    # A document's own earlier words are no source for it, and hide no other's.
    assert ref.parse(b" ".join([b"new", *text[:6]]), b"", 1) == []
    # Hashes only find: words decide.
    ref = substring.Reference(2)
    ref.parse(b"a b", b"", 1)
    ref.index = {hash(b"c d"): (0, 0)}
    assert ref.parse(b"c d", b"", 2) == []


def test_mixing(spark, docs):
    odd = spark.createDataFrame([(10**6 + k, t, "en", x, 1) for k, (t, x) in enumerate([(None, None), ("", "b"), ("one", "empty"), (None, "nothing"), ("a b c", None), ("a b c", None)])], docs.schema)
    docs = docs.union(odd).union(odd.where("source IS NULL"))
    got = mixing.mix(docs).collect()
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, got))
    by, rows = defaultdict(list), Counter()
    for r in got:
        assert r.size == len(words(r.text)) and r.taken == r.size * r.copies <= 3 * r.size
        by[r.source].append(r)
        rows[r.doc_id] += 1
    assert rows == Counter(r.doc_id for r in docs.collect())
    # Targets by pouring: all words by weight, what exceeds three times a source's size again, until nothing does.
    own = {k: sum(r.size for r in v) for k, v in by.items()}
    weight = {k: i % 3 + 1 for i, k in enumerate(sorted((k for k in own if k is not None), key=lambda k: [*map(ord, k)]) + [None])}
    want, full = {}, set()
    while True:
        left = sum(own.values()) - sum(3 * own[k] for k in full)
        want = {k: 3 * own[k] if k in full else left * weight[k] / sum(weight[j] for j in own if j not in full) for k in own}
        over = {k for k in own if k not in full and want[k] > 3 * own[k]}
        if not over:
            break
        full |= over
    for k, v in by.items():
        assert {r.source_size for r in v} == {own[k]} and all(r.target == pytest.approx(want[k]) for r in v)
        assert abs(sum(r.taken for r in v) - want[k]) <= max(r.size for r in v)


def test_mixing_is_a_pareto_sample(spark):
    """The plain way: chances by pouring, ranks by odds, the least ranks until the need is filled."""
    draw = np.random.default_rng(4)
    sizes = {k: int(2 ** draw.uniform(0, 7)) for k in range(300)}
    rows = [(k, " ".join([f"w{k}"] * n), "abcd"[k % 4]) for k, n in sizes.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    u = {k: (int(hashlib.md5(f"4 {k} {text}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for k, text, _ in rows}
    got, unequal = {r.doc_id: r for r in mixing.mix(docs).collect()}, 0
    for source in "abcd":
        ids = [k for k, _, s in rows if s == source]
        whole, need = divmod(got[ids[0]].target, got[ids[0]].source_size)
        g = {k: 2 ** (int(np.floor(np.log2(sizes[k]) * mixing.STEPS)) * 0.5 / mixing.STEPS) for k in ids}
        low, high = 0.0, 1e6
        for _ in range(200):
            level = (low + high) / 2
            low, high = (level, high) if sum(min(1, level * g[k]) * sizes[k] for k in ids) < need else (low, level)
        p = {k: min(1, level * g[k]) for k in ids}
        rank = {k: 0.0 if p[k] > 1 - 1e-9 else u[k] / (1 - u[k]) / (p[k] / (1 - p[k])) for k in ids}
        taken, total = set(), 0
        for k in sorted(ids, key=rank.get):
            if rank[k] and total + sizes[k] / 2 > need:
                break
            taken.add(k)
            total += sizes[k]
        assert {k: got[k].copies for k in ids} == {k: int(whole) + (k in taken) for k in ids}
        plain = sorted(ids, key=u.get)[: len(taken)]
        unequal += 0 < len(taken) < len(ids) and {*plain} != taken
    assert unequal >= 2  # the odds change who is taken


def test_mixing_takes_documents_as_often_as_their_chances_say(spark):
    sizes = [1, 1, 2, 4, 8, 16, 32, 64] * 40
    docs = spark.createDataFrame([(k, " ".join([f"w{k}"] * n), "ab"[k % 2]) for k, n in enumerate(sizes)], "doc_id long, text string, source string")
    seen, many = Counter(), 6
    for seed in range(many):
        for r in mixing.mix(docs, lean=1.0, seed=seed).where("source = 'a'").collect():
            seen[r.size] += r.copies
    per = {n: seen[n] / many / sum(x == n and k % 2 == 0 for k, x in enumerate(sizes)) for n in {*sizes[::2]}}
    # Chances in proportion to size: each class is taken about twice as often as that of half the size.
    own = sum(sizes[::2])
    level = min(1.0, (sum(sizes) / 3) / own)
    need = level * own
    want = {n: None for n in per}
    low, high = 0.0, 10.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(1, mid * n) * n for n in sizes[::2]) < need else (low, mid)
    for n in per:
        want[n] = min(1, mid * n)
        assert abs(per[n] - want[n]) < 4 * (max(want[n] * (1 - want[n]), 0.01) / (many * 20)) ** 0.5 + 0.03, (n, per, want)


def test_lm(docs):
    import math

    toks = {r.doc_id: [*words(r.text.encode().lower().decode()), None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in toks}
    c = Counter(w for i, t in toks.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for r in lm.score(docs).collect():
        t = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert math.isfinite(r.score) and r.score < 0


def test_lm_is_a_distribution_and_learns(monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 300)
    draw = np.random.default_rng(0)
    texts = [np.array([draw.integers(0, 50) * 2 + (k % 2) for _ in range(30)], np.int32) for k in range(200)]
    counts = np.bincount(np.concatenate([*texts, [2000]]), minlength=2001)
    model = lm.train(texts, counts)
    given = np.full((1, lm.WINDOW), 2000)
    total = sum(np.exp(model.log_probs(given, np.full((1, lm.WINDOW), k), np.ones((1, lm.WINDOW), bool))[3]) for k in range(2001))
    assert total == pytest.approx(1, abs=1e-3)
    whole, odd = (lm.scores(model, np.concatenate([x]), np.array([len(x)]), 2000)[0] for x in (texts[0], np.where(np.arange(30) % 2, texts[0], texts[1]).astype(np.int32)))
    assert whole > odd  # texts of even subwords, or of odd ones, are likelier than a mixture


def test_lm_learns_from_rows_outside_its_sample(spark, monkeypatch):
    """Each word has one that follows it: the more rows, the more of these are known, though the sample is of ten rows."""
    monkeypatch.setattr(lm, "SAMPLE", 10)
    monkeypatch.setattr(lm, "STEPS", 100)
    draw = np.random.default_rng(0)
    follows, texts = draw.permutation(400), []
    for k in range(900):
        chain = [int(draw.integers(0, 400))]
        while len(chain) < 12:
            chain.append(int(follows[chain[-1]]))
        texts.append((k, " ".join(f"{'abcdefghijklmnopqrst'[x // 20]}{'abcdefghijklmnopqrst'[x % 20]}" for x in chain)))

    def held_out(rows):
        got = [r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out and r.doc_id < 60]
        return sum(r.score for r in got) / sum(r.n_tokens for r in got)

    assert held_out(texts) > held_out(texts[:60]) + 0.3


def test_lm_attention_learns_from_all_training_rows(spark, monkeypatch):
    """Every target of the training rows is met once by what fits weights and mixture, however rows are split, and no other."""
    monkeypatch.setattr(lm, "STEPS", 20)
    monkeypatch.setattr(lm, "BLOCK", 400)
    monkeypatch.setattr(lm, "SAMPLE", 2)
    targets, met, learned = [], [], lm._learned
    monkeypatch.setattr(lm, "_learned", lambda blocks, model, counts, end, positions: [targets.append(positions), out := learned(blocks, model, counts, end, positions), met.append(out[1].sum())] and out)
    rows = [(k, " ".join(f"w{k * j % 37}" for j in range(k % 50))) for k in range(200)] + [(None, "x y"), (201, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    coder = lm._subwords(open(lm.default_vocabulary()).read())
    whole = sum(len(coder.of(words(t))[0]) + 1 for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1)
    for n in (1, 3):
        assert lm.score(docs.repartition(n)).count() == len(rows)
    assert targets == met == [whole, whole]


def test_lm_makes_products_once_a_slot(monkeypatch):
    draw = np.random.default_rng(9)
    counts = draw.integers(1, 50, 2001).astype(float)
    n = lm.CLASSES * lm.MEMBERS + 1
    model, shapes = lm.begun(counts, draw.poisson(0.2, (n, n)).astype(float)), []
    ids = draw.integers(0, 2001, (3 * lm.CACHED // 2, lm.WINDOW))
    x = model.weights["token"][model.slot[ids]] + model.weights["place"]
    assert model._hidden(model.slot[ids]) == pytest.approx(model._attend(x)[-1].reshape(-1, lm.WIDTH), abs=1e-5)
    shares = lm._shares
    monkeypatch.setattr(lm, "_shares", lambda a, scale: [shapes.append(len(a)), shares(a, scale)][1])
    model.log_probs(ids, ids, np.ones(ids.shape, bool))
    assert shapes == [lm.CACHED, lm.CACHED // 2]


def test_lm_gradient_is_that_of_the_loss():
    draw = np.random.default_rng(10)
    n = lm.CLASSES * lm.MEMBERS + 1
    model = lm.begun(draw.integers(1, 50, 2001).astype(float), draw.poisson(0.2, (n, n)).astype(float))
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    ids, target = draw.integers(0, 2001, (2, lm.CACHED + 3, lm.WINDOW))
    wanted = draw.random(ids.shape) < 0.8
    grad, log_p = lm._gradient(model, ids, target, wanted)
    seen = model.log_probs(ids, target, wanted) - np.where(model.slot[target[wanted]] == n - 1, model.rare[target[wanted]], 0)
    assert log_p == pytest.approx(seen, abs=1e-4)
    for k, g in grad.items():
        way = draw.normal(size=g.shape)
        loss = []
        for step in (1e-3, -1e-3):
            moved = lm.Attention(model.slot, model.rare, model.weights | {k: model.weights[k] + step * way})
            loss.append(-(moved.log_probs(ids, target, wanted).astype(float)).mean())
        assert (loss[0] - loss[1]) / 2e-3 == pytest.approx((g * way).sum(), rel=0.02, abs=1e-4), k


def test_lm_scores_texts_without_words_alike():
    draw = np.random.default_rng(11)
    n = lm.CLASSES * lm.MEMBERS + 1
    model = lm.begun(draw.integers(1, 50, 2001).astype(float), draw.poisson(0.2, (n, n)).astype(float))
    got = lm.scores(model, np.array([3, 5], np.int32), np.array([0, 2, 0]), 2000, alone=-0.5959721550397342)
    assert got[0] == got[2] == -0.5959721550397342 and got[1] != got[0]


def test_lm_later_windows_are_scored_without_their_overlap(monkeypatch):
    draw, shapes, shares = np.random.default_rng(12), [], lm._shares
    n = lm.CLASSES * lm.MEMBERS + 1
    model = lm.begun(draw.integers(1, 50, 2001).astype(float), draw.poisson(0.2, (n, n)).astype(float))
    monkeypatch.setattr(lm, "_shares", lambda a, scale: [shapes.append(a.shape[1]), shares(a, scale)][1])
    many = lm.CACHED * 3
    texts = [draw.integers(0, 2000, 3 * lm.WINDOW).astype(np.int32) for _ in range(many)]
    lm.scores(model, np.concatenate(texts), np.array([*map(len, texts)]), 2000)
    assert Counter(shapes) == {lm.WINDOW: 3, lm.WINDOW - lm.OVERLAP: 3 * (len(lm.windows(np.array([3 * lm.WINDOW + 1]))[0]) - 1)}


def test_lm_gradients_are_summed_by_slot_before_weights():
    """Rows are added up by slot; what a training step multiplies by weights has a row a slot, not a row a position."""
    draw = np.random.default_rng(13)
    rows, of = draw.normal(size=(5000, 7)), np.minimum(draw.geometric(0.01, 5000), 900) % 701
    want = np.zeros((750, 7))
    np.add.at(want, of, rows)
    assert lm._sums(rows, of, 750) == pytest.approx(want)


def test_lm_gradient_holds_one_array_of_products():
    """A step's products with slots' vectors are its largest arrays: their gradients take their places."""
    import tracemalloc

    draw, n = np.random.default_rng(16), lm.CLASSES * lm.MEMBERS + 1
    model = lm.begun(draw.integers(1, 50, 2001).astype(float), draw.poisson(0.2, (n, n)).astype(float))
    ids, target = draw.integers(0, 2001, (2, 4 * lm.LARGE, lm.WINDOW))
    tracemalloc.start()
    lm._gradient(model, ids, target, np.ones(ids.shape, bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * ids.size * 4 * lm.WIDTH * 4


def test_lm_lists_words_as_a_loop_does():
    draw = np.random.default_rng(14)
    odd = np.array([9, 10, 11, 12, 13, 32, 0, 28, 31, 97, 98, 133, 160, 194, 255], np.uint8)
    for texts in ([b""], [b" \t", b"", b"\xc2\xa0 a\x85b \xff"], [draw.choice(odd, draw.integers(0, 40)).tobytes() for _ in range(300)]):
        own: dict = {}
        places = [[own.setdefault(w, len(own)) for w in WORD.findall(x)] for x in texts]
        size, whole, distinct = lm.listed(texts)
        assert (size.tolist(), whole.tolist(), distinct) == ([*map(len, places)], [k for x in places for k in x], [*own])


def test_lm_reads_texts_once_for_contexts(spark, monkeypatch):
    """Counts by slots are those by numbers in another order, and rare subwords are counted while the weights are learned."""
    monkeypatch.setattr(lm, "STEPS", 20)
    monkeypatch.setattr(lm, "BLOCK", 3000)
    draw, calls, mixed, contexts = np.random.default_rng(15), [], [], lm._contexts
    monkeypatch.setattr(lm, "_contexts", lambda *a: [calls.append(1), contexts(*a)][1])
    monkeypatch.setattr(lm.Seen, "mixed", classmethod(lambda cls, *a, own=lm.Seen.mixed: [mixed.append(a), own(*a)][1]))
    rows = [(k, " ".join("".join(chr(97 + c) for c in draw.integers(0, 26, 1 + draw.integers(0, 6))) for _ in range(60))) for k in range(150)]
    assert lm.score(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)
    (model, counts, _, end), coder, n = mixed[0], lm._subwords(open(lm.default_vocabulary()).read()), lm.CLASSES * lm.MEMBERS + 1
    want = np.zeros(n * n + (lm.CLASSES + 1) * (end + 1), np.int64)
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            last = model.slot[end]
            for k in [*coder.of(words(text))[0].tolist(), end]:
                want[last * n + model.slot[k]] += 1
                want[n * n + last // lm.MEMBERS * (end + 1) + k] += model.slot[k] == n - 1
                last = model.slot[k]
    assert len(calls) == 1 and want[n * n :].any() and (counts == want).all()


def test_lm_mixed_with_counts_is_a_distribution(monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 50)
    draw = np.random.default_rng(0)
    texts = [draw.integers(0, 1500, 40).astype(np.int32) for _ in range(100)]
    model = lm.train(texts, np.bincount(np.concatenate([*texts, [2000]]), minlength=2001))
    n = lm.CLASSES * lm.MEMBERS + 1
    counts = np.concatenate([draw.poisson(0.5, n * n), (draw.poisson(0.2, (lm.CLASSES + 1, 2001)) * (model.slot == n - 1)).ravel()])
    model.seen = lm.Seen.fitted(model, counts, texts, 2000)
    given = np.concatenate([[2000], texts[0][: lm.WINDOW - 1]])[None]
    total = sum(np.exp(model.log_probs(given, np.full((1, lm.WINDOW), k), np.ones((1, lm.WINDOW), bool))) for k in range(2001))
    assert total == pytest.approx(np.ones(lm.WINDOW), abs=1e-3)


def plain_score(model, ids, end):
    """Window by window, position by position; natural logarithms."""
    w, n = {k: v.astype(float) for k, v in model.weights.items()}, lm.CLASSES * lm.MEMBERS
    target, given, total, start = [*ids, end], [end, *ids], 0.0, 0

    def log_softmax(x):
        return x - x.max() - np.log(np.exp(x - x.max()).sum())

    while True:
        g, t = given[start : start + lm.WINDOW], target[start : start + lm.WINDOW]
        x = w["token"][model.slot[g]] + w["place"][: len(g)]
        q, k, v = np.split(x @ w["qkv"], 3, axis=1)
        for i in range(lm.OVERLAP if start else 0, len(g)):
            h = x[i] + np.exp(log_softmax(q[i] @ k[: i + 1].T * lm.WIDTH**-0.5)) @ v[: i + 1] @ w["out"]
            slot, before = model.slot[t[i]], model.slot[g[i]]
            kind = slot // lm.MEMBERS
            p = log_softmax(h @ w["class"] + w["class_bias"])[kind]
            if slot < n:
                p += log_softmax(h @ w["member"][kind] + w["member_bias"][kind])[slot - kind * lm.MEMBERS]
            if model.seen:
                p = np.log(model.seen.pairs[before, slot] + model.seen.rest[before] * np.exp(p))
            total += p + ((model.seen.rare[before // lm.MEMBERS, t[i]] if model.seen else model.rare[t[i]]) if slot == n else 0)
        if start + lm.WINDOW >= len(target):
            return total
        start += lm.WINDOW - lm.OVERLAP


@pytest.mark.parametrize("mixed", [False, True])
def test_lm_scores_as_a_plain_loop_does(monkeypatch, mixed):
    monkeypatch.setattr(lm, "STEPS", 60)
    draw = np.random.default_rng(5)
    texts = [draw.integers(0, 1500, n).astype(np.int32) for n in (0, 1, 15, 16, 17, 28, 29, 30, 200)]
    model = lm.train([t for t in texts for _ in range(20)], np.bincount(np.concatenate([*texts, [2000]]), minlength=2001))
    if mixed:
        n = lm.CLASSES * lm.MEMBERS + 1
        counts = np.concatenate([draw.poisson(0.5, n * n), (draw.poisson(0.2, (lm.CLASSES + 1, 2001)) * (model.slot == n - 1)).ravel()])
        model.seen = lm.Seen.fitted(model, counts, texts, 2000)
    got = lm.scores(model, np.concatenate(texts), np.array([*map(len, texts)]), 2000)
    assert got == pytest.approx([plain_score(model, t, 2000) / np.log(10) for t in texts], rel=1e-4)


def test_windows_score_each_once():
    size = np.array([1, 5, 16, 17, 40])
    at, own = lm.windows(size)
    assert sorted(at[own]) == list(range(size.sum()))


def test_classifiers_on_held_out_rows(spark):
    """A constant has recall 0 on the rarer label, or false alarms 1."""
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{x}.parquet") for x in ("documents", "labels"))
    truth = {r.doc_id: r for r in labels.collect()}
    for rows, name, rare in ((toxicity.score(docs, labels).collect(), "toxic", 1), (quality.score(docs, labels).collect(), "quality", 0)):
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
        own = [r for r in rows if r.held_out and r.doc_id in truth]
        found = [r.predicted == rare for r in own if truth[r.doc_id][name] == rare]
        alarms = [r.predicted == rare for r in own if truth[r.doc_id][name] != rare]
        assert len(found) >= 5 and sum(found) / len(found) >= 0.8 and sum(alarms) / len(alarms) <= 0.05


def test_toxicity_learns_nothing_from_held_out_rows(spark, docs, labels):
    wrong = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic", "quality")
    a, b = ({(r.doc_id, r.score) for r in toxicity.score(docs, x).collect()} for x in (labels, wrong))
    assert a == b


def test_toxicity_fit_of_very_long_texts_is_bounded():
    import tracemalloc

    texts = [" ".join(f"{'ab'[k % 2]}{i * (k + 1) % 9973}" for i in range(20_000)) for k in range(24)]
    tracemalloc.start()
    toxicity.fit(texts, np.arange(24) % 2, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6
    assert all(len(part) == 1 or weight[part].sum() <= toxicity.STEP for weight in (np.array([10.0, 2e5, 1e5, 4e4, 5.0]),) for part in toxicity.steps(np.arange(5), weight))


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CHARACTERS", 100)
    monkeypatch.setattr(toxicity, "LONGEST", 40)
    docs = spark.createDataFrame([(k, "x" * (10 + k % 50)) for k in range(100)] * 3 + [(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, toxic int")
    texts, toxic = toxicity.sample(docs, labels)
    assert 0 < len(texts) < 20 and all(len(t) <= 40 for t in texts)
    assert all(sum(len(t) for t, y in zip(texts, toxic) if y == k) <= 100 for k in (0, 1))


def test_co_training_exchanges_labels():
    """Few labels, two views that each tell the classes apart: what a view is surest of teaches the other."""
    draw = np.random.default_rng(3)
    y = draw.integers(0, 2, 3000)
    x = [np.column_stack([y + 0.3 * draw.normal(size=3000), *draw.normal(size=(6, 3000))]) for _ in (0, 1)]
    given, free = np.arange(60), np.arange(60, 2000)
    told = []

    def surest(models, taught):
        out = []
        for v in (0, 1):
            p = models[v].score(x[v][free])
            at = free[(np.abs(p - 0.5) > 0.45) & ~np.isin(free, taught[1 - v])][:300]
            told.append((y[at] == (models[v].score(x[v][at]) > 0.5)).mean())
            out.append((at, [x[0][at], x[1][at]], (models[v].score(x[v][at]) > 0.5).astype(float)))
        return out

    with_, without = (quality.co_train([v[given] for v in x], y[given].astype(float), surest, rounds=n) for n in (4, 0))
    right = [((m.scores([v[2000:] for v in x])[2] >= 0.5) == y[2000:]).mean() for m in (with_, without)]
    assert min(told) > 0.9 and right[0] >= right[1] and right[0] > 0.95


def test_toxicity_of_unseen_misspellings():
    words_, rng = ["calm", "tree", "river", "stone", "light", "green"], np.random.default_rng(0)
    texts = [" ".join(rng.choice(words_, 20)) for _ in range(200)]
    texts = [t + " disgusting" if k % 2 else t for k, t in enumerate(texts)]
    model = toxicity.fit(texts, np.arange(200) % 2)
    a, b = model.scores([texts[0] + " disgustingg", texts[0]])
    assert a > 0.5 > b


def test_nearest(spark):
    draw = np.random.default_rng(0)
    v = draw.normal(size=(3000, 8))
    v[1000:1400] = v[1000]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(5000, None), (5100, [0.0] * 8), (5200, [float("nan")] * 8), (5300, [None] * 8)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10].tolist()
        hit += len({*want} & {x[1] for x in found})
        assert [x[0] for x in sorted(found)] == list(range(1, 11))
        if 1000 <= q < 1400:
            assert [x[1] for x in sorted(found)] == want
    assert hit / len(got) / 10 >= 0.9
    assert ann.nearest(spark.createDataFrame(rows[3000:], "vec_id long, embedding array<double>")).count() == 0
    few = ann.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.rank) for r in sorted(few)] == [(0, 1), (0, 2)]


def ten_nearest(spark, v, **options):
    """Queries, and those whose ten neighbours are exactly brute force's."""
    got = defaultdict(list)
    for r in sorted(ann.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), **options).collect()):
        got[r.query_id].append(r.vec_id)
    right = 0
    for q, found in got.items():
        d = np.sqrt(ann.squares(v, np.broadcast_to(v[q], v.shape)))
        d[q] = np.inf
        right += found == np.lexsort((np.arange(len(v)), d))[:10].tolist()
    return len(got), right


def test_nearest_outside_the_curves_windows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "ASKED", 20)
    draw = np.random.default_rng(1)
    spread, centres = draw.normal(size=(3000, 24)), 20 * draw.normal(size=(30, 24))
    assert ten_nearest(spark, spread, curves=1) == (30, 30)
    assert ten_nearest(spark, centres[np.arange(3000) % 30] + spread, curves=1) == (30, 30)


def test_nearest_in_a_tight_group(spark):
    draw = np.random.default_rng(2)
    tight = np.where(np.arange(900)[:, None] < 300, 1 + 1e-5 * draw.normal(size=(900, 16)), draw.normal(size=(900, 16)))
    assert ten_nearest(spark, 10_000 + tight) == (9, 9)


def test_nearest_among_vectors_of_several_lengths_and_other_columns(spark):
    draw = np.random.default_rng(3)
    rows = [(k, draw.normal(size=(8, 8, 8, 5)[k % 4]).tolist(), k, 0.5) for k in range(0, 1200, 5)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame([*rows, (7, None, 0, None), (None, [1.0], 0, None)], "vec_id long, embedding array<double>, rank int, score double")).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    assert sorted(got) == list(range(0, 1200, 100))
    for q, found in got.items():
        own = np.array(next(r[1] for r in rows if r[0] == q))
        far = sorted((((own - np.array(r[1])) ** 2).sum(), r[0]) for r in rows if len(r[1]) == len(own) and r[0] != q)[:10]
        assert [v for _, v in sorted(found)] == [v for _, v in far]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_hilbert_steps_are_of_one():
    grid = np.stack(np.meshgrid(range(8), range(8), range(8)), axis=-1).reshape(-1, 3)
    order = grid[np.argsort(ann.hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_licenses(spark):
    import textwrap

    rows = [(1, "x y z\nLicensed under the Apache License, Version 2.0.\n"), (2, "released under the MIT license"), (3, "nothing of that kind here at all"), (4, None), (5, ""), (6, "license"), (None, "all RIGHTS reserved. Licensed under CC BY 4.0."), (2, "released under the MIT license")]
    got = [(r.doc_id, r.n_words, r.n_matches, r.licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 11, 1, "Apache-2.0"), (2, 5, 1, "MIT"), (2, 5, 1, "MIT"), (3, 7, 0, ""), (4, 0, 0, ""), (5, 0, 0, ""), (6, 1, 0, ""), (None, 9, 2, "CC-BY-4.0-short,proprietary")], key=str)
    # Every template, wrapped as in a file's head, within prose, with a word changed; and two in one text, one after the other.
    names, rows = sorted(licenses.TEMPLATES), []
    for k, n in enumerate(names):
        wrapped = "\n".join(f" * {x}" for x in textwrap.wrap(licenses.TEMPLATES[n], 72))
        rows += [(4 * k, wrapped), (4 * k + 1, f"prose goes first {wrapped}\nprose comes last"), (4 * k + 2, f"{wrapped}\n{licenses.TEMPLATES['MPL-2.0']}")]
        if len(licenses.TEMPLATES[n].split()) > 20:
            rows.append((4 * k + 3, licenses.TEMPLATES[n].replace("software", "library", 1)))
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = {names[r.doc_id // 4]} | ({"MPL-2.0"} if r.doc_id % 4 == 2 else set())
        assert {*r.licenses.split(",")} == want and r.n_matches == (2 if r.doc_id % 4 == 2 else 1), (r, want)
        assert r.doc_id % 4 > 2 or r.best_dice == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want.project(", ".join(df.columns)).fetchall()))


def test_mpeg(docs):
    for n in (64, 1024, 6400, 128_000):
        payload = np.random.default_rng(n).bytes(n)
        media = mpeg.store(payload)
        s = mpeg.parse(media)
        assert mpeg.load(media) == payload and s.skipped == s.wrong == 0 and s.vbr_frames == len(s.frames)
    at = s.frames[3][0]
    junk = mpeg.parse(media[:at] + b"\xff\xfbjunk\xff" * 3 + media[at:])
    assert len(junk.frames) == len(s.frames) and junk.skipped == 21
    bad = bytearray(media)
    bad[s.frames[5][0] + 10] ^= 1
    assert mpeg.parse(bytes(bad)).wrong == 1
    assert len(mpeg.parse(media[:-5]).frames) == len(s.frames) - 1
    assert mpeg.parse(b"").frames == [] and mpeg.parse(b"\xff" * 500).frames == []
    for r in mpeg.digest(docs, with_media=True).limit(50).collect():
        assert hashlib.sha256(mpeg.load(r.media)).hexdigest() == r.payload_sha256 and r.payload_bytes % 64 == 0


def test_mpeg_digest_by_hand(docs):
    """What the contract says of payloads, from the texts; the stored form by its own bytes."""
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in mpeg.digest(docs, with_media=True).collect():
        text = texts[r.doc_id]
        payload = text + b"\0" * (-len(text) % 64 if text else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())


def plain_crc(bits):
    c = 0xFFFF
    for b in bits:
        c = (c << 1 ^ (0x8005 if (c >> 15) ^ int(b) else 0)) & 0xFFFF
    return c


@pytest.mark.parametrize("layer", [1, 2])
def test_mpeg_checksums_of_layers_one_and_two(layer):
    """Frames of random allocations; the bits that a checksum covers are counted here by the standard's own loops."""
    draw, out, bad = np.random.default_rng(layer), b"", 0
    for k in range(12):
        mode, rate = ((0, 1, 3)[k % 3], 8) if layer == 1 else ((0, 1, 3)[k % 3], 10)
        two = bytes([rate << 4, mode << 6 | (k % 4) << 4])
        h = mpeg.header(b"\xff" + bytes([0xFE if layer == 1 else 0xFC]) + two)
        body = draw.bytes(h.size - 6)
        bits = "".join(f"{b:08b}" for b in body)
        channels, bound = (1 if mode == 3 else 2), (4 * (k % 4 + 1) if mode == 1 else 32)
        if layer == 1:
            many = sum(4 * (channels if sb < bound else 1) for sb in range(32))
        else:
            # 192 kbit/s at 44.1 kHz: table a for a mono channel's 192, as for 96 a channel: 30 subbands.
            many, some = 0, []
            for sb in range(30):
                n = 4 if sb < 11 else 3 if sb < 23 else 2
                if sb < bound:
                    for _ in range(channels):
                        some.append(int(bits[many : many + n], 2) > 0)
                        many += n
                else:
                    some += [int(bits[many : many + n], 2) > 0] * channels
                    many += n
            many += 2 * sum(some)
        crc = plain_crc(f"{two[0]:08b}{two[1]:08b}" + bits[:many])
        if k % 5 == 4:
            crc, bad = crc ^ 1, bad + 1
        assert mpeg.verified(h, b"\xff" + bytes([0xFE if layer == 1 else 0xFC]) + two + crc.to_bytes(2, "big") + body) == (k % 5 != 4)
        if mode == 0:
            out += b"\xff" + bytes([0xFE if layer == 1 else 0xFC]) + two + crc.to_bytes(2, "big") + body
    s = mpeg.parse(out)
    assert len(s.frames) == s.checked == 4 and s.wrong == (1 if bad else 0) * sum(k % 5 == 4 for k in range(0, 12, 3))


def test_mpeg_inspect(spark):
    media = mpeg.store(bytes(5000))
    rows = spark.createDataFrame([(1, media, "x"), (2, None, None), (3, b"", None), (4, b"junk" * 50, None), (1, media, "x")], "k int, media binary, tags string")
    got = sorted(mpeg.inspect(rows).collect(), key=lambda r: r.k)
    assert got[0] == got[1] and [r.frames for r in got] == [4, 4, 0, 0, 0] and got[0].tags == ["ID3v2", "Xing"]
    assert got[0].duration_s == 4 * 1152 / 32000 and got[0].frames_checked == 4 + 1 and got[0].frames_wrong == 0
    assert all(media[at] == 0xFF for at in got[0].frame_offsets) and got[0].seek_offsets == got[0].frame_offsets[:1]
    assert [r.duration_s for r in got[2:]] == [None] * 3 and mpeg.inspect(rows.limit(0)).collect() == []


def test_mpeg_payload_is_no_tag(spark):
    texts = []
    for n in (1024, 1344, 1408, 2816):
        for mark in ("TAG", "APETAGEX" + "\0" * 4 + "@" + "\0" * 11):
            texts += ["x" * at + mark + "y" * (n - at - len(mark)) for at in range(n - 200, n - len(mark))]
    rows = mpeg.digest(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), with_media=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert mpeg.load(r.media) == texts[r.doc_id].encode() and r.payload_bytes == len(texts[r.doc_id]) and "skipped=0;tags=ID3v2+Xing" in r.feature
    with pytest.raises(ValueError):
        mpeg.load(rows[0].media[:-5])


@pytest.mark.parametrize("f", ["bpe", "lm", "mixing", "mpeg", "minhash", "substring", "licenses", "toxicity", "quality"])
def test_odd_rows(spark, odd, labels, f):
    """Nulls, empty, very long, repeated rows, clashing columns, empty tables: equal texts have equal results, row by row."""
    run = {"bpe": bpe.encode, "lm": lm.score, "mixing": mixing.mix, "mpeg": mpeg.digest, "minhash": minhash.near_duplicates, "substring": substring.remove_duplicates, "licenses": licenses.scan, "toxicity": lambda d: toxicity.score(d, labels), "quality": lambda d: quality.score(d, labels)}[f]
    rows = run(odd).collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 1, 2, 3, 5, 6, 7, 8]
    assert run(odd.limit(0)).collect() == []
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append({k: v for k, v in r.asDict().items() if k != "doc_id"})
    assert by[1][0] == (pytest.approx(by[1][1], rel=1e-6) if f == "lm" else by[1][1])
    if f in ("bpe", "mpeg", "licenses", "toxicity", "quality"):
        same = [{k: v for k, v in x.items() if k != "held_out"} for x in (by[1][0], by[None][0])]
        assert f == "quality" or same[0] == same[1]
    if f in ("bpe", "mpeg", "toxicity"):
        assert {k: v for k, v in by[2][0].items() if k != "held_out"} == {k: v for k, v in by[3][0].items() if k != "held_out"}
    if f == "bpe":
        assert by[2][0]["n_tokens"] == 0 and by[2][0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest() and by[6][0]["n_tokens"] == 30000
    if f == "mixing":
        assert by[2][0]["size"] == by[3][0]["taken"] == 0 and by[6][0]["size"] == 30000 and by[None][0]["source_size"] == 120
    if f == "mpeg":
        assert by[2][0]["payload_bytes"] == 64 and by[6][0]["n_bytes"] == 150_000 and by[8][0]["n_bytes"] == len(LONG)
    if f == "minhash":
        assert by[1][0]["n_shingles"] == 116 and by[1][0]["kept"] and by[5][0]["component_id"] == 1 and not by[5][0]["kept"] and by[2][0]["n_shingles"] == 0 and by[None][0]["component_id"] is None and by[None][0]["kept"] and by[8][0]["n_shingles"] == 39_996
    if f == "substring":
        assert {k: v[0]["n_removed"] for k, v in by.items()} == {1: 0, 2: 0, 3: 0, None: 0, 5: 120, 6: 0, 7: 0, 8: 0} and by[8][0]["n_words"] == 40_000
    if f == "lm":
        assert by[2][0]["n_tokens"] == by[3][0]["n_tokens"] == by[7][0]["n_tokens"] == 1 and by[8][0]["n_tokens"] == 40_001 and not by[None][0]["held_out"] and by[2][0]["score"] == by[7][0]["score"]


def test_keep_survives_clashing_names(odd, labels):
    odd = odd.selectExpr("doc_id", "text", "lang", "source", "n_chars", "score AS `_text`", "size AS `a.b`", "size AS Score")
    got = toxicity.score(odd, labels, keep=["doc_id", "text", "_text", "a.b", "Score"])
    assert got.columns == ["doc_id", "text", "_text", "a.b", "held_out", "score", "predicted"]
    assert sorted(str(r[:4]) for r in got.collect()) == sorted(str(r[:4]) for r in odd.select("doc_id", "text", "_text", "`a.b`").collect())
    got = quality.score(odd, labels, keep=["_text", "a.b"])
    assert got.columns[:2] == ["_text", "a.b"] and got.count() == 9
    assert mixing.mix(odd.withColumnRenamed("Score", "u").withColumnRenamed("_text", "class")).columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "class", "a.b"]


def test_bytes_that_are_no_text(spark):
    bad = spark.createDataFrame([(1, b"a \xff\xfe b " + b"w " * 60), (2, b"a \xff\xfe b " + b"w " * 60)], "doc_id long, x binary").selectExpr("doc_id", "cast(x AS string) AS text", "'en' AS lang", "'s' AS source")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for f in (bpe.encode, lm.score, mixing.mix, mpeg.digest, minhash.near_duplicates, lambda d: substring.remove_duplicates(d, with_text=True), licenses.scan, lambda d: toxicity.score(d, labels)):
        assert f(bad).count() == 2
    assert bpe.encode(bad, with_ids=True).first().decoded.startswith("a")


# The pipeline


@pytest.fixture(scope="module")
def clashing(spark, docs):
    """documents with columns named like everything that operators add, and rows of each awkward kind."""
    names = ["score", "size", "held_out", "taken", "row_key", "_text", "_id", "kept_text", "copies", "u", "class", "_given_3", "component_id", "a.b"]
    w = " ".join(f"w{i}" for i in range(120))
    odd = spark.createDataFrame([(10**6, w, "en", "a", 9), (10**6, w, "en", "a", 9), (10**6 + 1, None, None, None, None), (10**6 + 2, "", "de", "b", 0), (None, w, "en", None, 9), (10**6 + 3, "pre " * 3 + w + " tail " + LONG, "en", "b", 9), (10**6 + 4, LONG, "fr", "a", 1)], docs.schema)
    rows = docs.limit(80).union(odd)
    for k, n in enumerate(names):
        rows = rows.withColumn(n, F.concat_ws("-", F.lit(k), "doc_id"))
    return rows


def test_pipeline_stages(spark, clashing):
    """Each stage on the same rows, against brute force; other columns come back as they were."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    given = [tuple(r) for r in clashing.collect()]
    own = lambda df: sorted(map(str, map(tuple, df.collect())))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, clashing.limit(0), DATA).collect() == [], name
        if name != "bpe":
            assert stage(spark, clashing, DATA).schema.names == clashing.columns, name

    model = toxicity.fit(*toxicity.sample(clashing, spark.read.parquet(f"{DATA}/labels.parquet")))
    want = [r for r in given if model.scores([r[1] or ""])[0] < 0.5]
    assert own(stages["toxicity"](spark, clashing, DATA)) == sorted(map(str, want)) and 0 < len(want)

    group = near_components({r[0]: r[1] for r in given if r[0] is not None}, 5)
    want = [r for r in given if r[0] is None or group[r[0]][1] == r[0]]
    assert own(stages["minhash_near_dedup"](spark, clashing, DATA)) == sorted(map(str, want)) and len(want) < len(given)

    known = [r for r in given if r[0] is not None]
    want = [r for r in given if r[0] is None]
    for r, (w, gone) in zip(known, left_words([(r[0], r[1]) for r in known])):
        text = b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else r[1]
        want.append((r[0], text, r[2], r[3], len(text) if any(gone) else r[4], *r[5:]))
    assert own(stages["substring_dedup"](spark, clashing, DATA)) == sorted(map(str, want)) and sorted(map(str, want)) != sorted(map(str, given))

    copies = {(r.doc_id, r.text): r.copies for r in mixing.mix(clashing.select("doc_id", "text", "source")).collect()}
    want = [r for r in given for _ in range(copies[r[0], r[1]])]
    assert own(stages["mixing"](spark, clashing, DATA)) == sorted(map(str, want)) and len({*copies.values()}) > 1

    tokenizers, P = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids) for r in given]
    want = [(i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in ids]
    assert own(stages["bpe"](spark, clashing, DATA)) == sorted(map(str, want))


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "mixing", "bpe"]
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 100 < got.count() < 400
