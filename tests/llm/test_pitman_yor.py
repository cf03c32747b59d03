"""The Pitman-Yor model: counts and base scores against a plain version, normalisation, held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from talus.llm import pitman_yor
from talus.session import table
from tests.llm.cases import SCHEMA, frame, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("small", [False, True])
def test_base_scores(spark, monkeypatch, small):
    if small:  # so that some words stay outside the vocabulary and some contexts are split
        monkeypatch.setattr(pitman_yor, "VOCABULARY", 50)
        monkeypatch.setattr(pitman_yor, "SHARD_TOKENS", 400)
    data = rows()
    tokens = {d: WORD.findall(low(t or "")) + ["</s>"] for d, t, *_ in data}
    count = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in pitman_yor.pitman_yor_scores(frame(spark)).collect()}
    assert set(got) == set(tokens)
    for d, ws in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(d).encode()) % 10 == 0, len(ws), sum(w in count for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert r.score < 0


def test_better_than_base_on_held_out_texts(spark):
    got = pitman_yor.pitman_yor_scores(table(spark, SF, "documents")).where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum()


def parts(texts, counts=None):
    """(u, w, c) of the pairs of texts, with words by rank, and the words' counts by rank."""
    pairs = Counter(p for t in texts for p in zip(["</s>", *t], [*t, "</s>"]))
    c = Counter(w for t in texts for w in [*t, "</s>"])
    ranked = sorted(c, key=lambda w: (-c[w], w))
    return pairs, ranked, np.array([c[w] for w in ranked])


def fitted(pairs, ranked, counts, seed=0, shards=1, split=0):
    """The model's chain on plain pairs, all of which stand for held-out pairs as well; what the driver does, without Spark."""
    rank = {w: i for i, w in enumerate(ranked)}
    grid = sorted((rank[u], rank.get(w, -1)) for u in ranked for w in [*ranked, None])
    u = np.array([x[0] for x in grid], np.uint64)
    w = np.array([x[1] if x[1] >= 0 else 0 for x in grid], np.uint64)
    w[[i for i, x in enumerate(grid) if x[1] < 0]] = np.uint64(99) | pitman_yor.COLD
    order = np.lexsort((w, u))
    u, w = u[order], w[order]
    c = np.array([pairs.get((ranked[int(a)], ranked[int(b)]) if b < pitman_yor.COLD else None, 0) for a, b in zip(u, w)])
    given = pitman_yor.Parameters(counts, split, 0.5, seed)
    which = pitman_yor.shard_of(u, w, split, shards)
    rooms = [pitman_yor.Restaurants(u[which == s], w[which == s], c[which == s], given, s) for s in range(shards)]
    n, types = len(ranked) + 1, len(ranked)
    first = sum(r.first_sums() for r in rooms)
    p = (first[:n] + 1.0) / (first[:n].sum() + n)
    given.parent, given.tables = [p], [first[n : n + split]]
    for turn in range(pitman_yor.ROUNDS):
        found = sum(r.sums(r.chain(turn + 1)) for r in rooms).reshape(-1, n + split)
        got = [pitman_yor.seat_parent(x[:n], types, 0.5, np.random.default_rng(turn)) for x in found]
        given.parent.append(sum(got) / len(got))
        given.tables.append(found[:, n:] if turn == pitman_yor.ROUNDS - 1 else found[0, n:])
    out = np.zeros(len(u))
    for s, r in enumerate(rooms):
        out[which == s] = r.predictive()
    return u, w, c, out, given


@pytest.mark.parametrize("shards,split", [(1, 0), (3, 4)])
def test_probabilities_sum_to_one(shards, split):
    texts = [WORD.findall(low(t)) for _, t, *_ in rows() if t]
    u, w, c, p, given = fitted(*parts(texts), shards=shards, split=split)
    for parent in given.parent:
        assert parent.sum() == pytest.approx(1)
    assert np.bincount(u.astype(int), p) == pytest.approx(np.ones(int(u.max()) + 1), abs=1e-9)


def plain_sampler(pairs, ranked, sweeps, seed):
    """Customers one by one at tables of explicit sizes, in both restaurants; predictive probabilities of the pairs, averaged."""
    import random

    r, d, theta, base = random.Random(seed), 0.5, 1.0, 1 / (len(ranked) + 1)
    child = {u: {} for u in ranked}
    root: dict = {}
    total = lambda room: sum(map(sum, room.values()))
    many = lambda room: sum(map(len, room.values()))

    def prob(room, w, below):
        t = room.get(w, [])
        return (sum(t) - d * len(t) + (theta + d * many(room)) * below) / (theta + total(room))

    def sit(room, w, below):
        """Whether a new table opened."""
        tables = room.setdefault(w, [])
        weights = [n - d for n in tables] + [(theta + d * many(room)) * below]
        k = r.choices(range(len(weights)), weights)[0]
        if k == len(tables):
            tables.append(1)
            return True
        tables[k] += 1
        return False

    def leave(room, w):
        tables = room[w]
        k = r.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    customers = [p for p, n in pairs.items() for _ in range(n)]
    for u, w in customers:
        if sit(child[u], w, prob(root, w, base)):
            sit(root, w, base)
    out, taken = Counter(), 0
    for sweep in range(sweeps):
        for u, w in customers:
            if leave(child[u], w):
                leave(root, w)
            if sit(child[u], w, prob(root, w, base)):
                sit(root, w, base)
        if sweep >= sweeps // 3:
            taken += 1
            for u, w in pairs:
                out[u, w] += prob(child[u], w, prob(root, w, base))
    return {k: v / taken for k, v in out.items()}


def test_agrees_with_a_plain_sampler():
    import random

    r = random.Random(2)
    texts = [[r.choice("aaaabbbccd") + r.choice("xy") for _ in range(12)] for _ in range(16)]
    pairs, ranked, counts = parts(texts)
    want = plain_sampler(pairs, ranked, 45, 1)
    got = Counter()
    for seed in range(8):
        u, w, c, p, _ = fitted(pairs, ranked, counts, seed)
        for a, b, n, x in zip(u, w, c, p):
            if n:
                got[ranked[int(a)], ranked[int(b)]] += x / 8
    mine, theirs = (np.array([math.log10(x[k]) for k in pairs]) for x in (got, want))
    assert np.abs(mine - theirs).max() < 0.08 and abs((mine - theirs).mean()) < 0.01


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    arrays = [np.zeros(0, np.int64), rng.integers(0, 1 << 62, 1000), np.array([0, 1 << 63], np.uint64), np.arange(300)]
    for a, b in zip(arrays, pitman_yor.unpack(pitman_yor.pack(*arrays)), strict=True):
        assert (a.astype(np.uint64) == b).all()
    assert pitman_yor.unpack(pitman_yor.pack(np.zeros(0)))[0].size == 0


def test_alone_is_the_share_of_seatings():
    table_ = pitman_yor.alone(0.3)
    # three customers at two tables: (2 seatings with customer 3 at one's table, weight .7 each) and 1 alone
    assert table_[3, 2] == pytest.approx(0.7 / (0.7 + 1.4))
    assert table_[1, 1] == 1 and table_[5, 5] == pytest.approx(1) and table_[5, 1] == 0


def test_gibbs_keeps_the_exact_distribution():
    c, p, d = 6, 0.2, 0.4
    rng = np.random.default_rng(0)
    n = 40_000
    t = pitman_yor.gibbs(np.full(n, c), np.ones(n, np.int64), np.full(n, p), d, 60, rng, total=10.0)
    mass = (pitman_yor.STRENGTH + d * 10.0) * p
    s = {0: {0: 1.0}}
    for k in range(1, c + 1):
        s[k] = {j: s[k - 1].get(j - 1, 0) + (k - 1 - d * j) * s[k - 1].get(j, 0) for j in range(1, k + 1)}
    weight = np.array([s[c][j] * mass**j for j in range(1, c + 1)])
    assert np.bincount(t, minlength=c + 1)[1:] / n == pytest.approx(weight / weight.sum(), abs=0.012)


def test_empty(spark):
    assert pitman_yor.pitman_yor_scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_preceding_word_has_a_restaurant(spark, monkeypatch):
    """Words that only their context tells apart are predicted from it, also where both stand outside the vocabulary."""
    data = [(i, " ".join(f"a{j} b{j}" for j in range(i % 7, 60, 3)), "en", "s", 0) for i in range(200)]
    for most in (1 << 20, 30):
        monkeypatch.setattr(pitman_yor, "VOCABULARY", most)
        got = pitman_yor.pitman_yor_scores(spark.createDataFrame(data, SCHEMA)).where("held_out").toPandas()
        assert (got["score"] / got["n_tokens"]).mean() > (got["base_score"] / got["n_tokens"]).mean() + 1


def test_only_held_out_texts(spark):
    held = [i for i in range(400) if not pitman_yor.is_training(i)]
    got = pitman_yor.pitman_yor_scores(spark.createDataFrame([(i, "a b", "en", "s", 0) for i in held], SCHEMA)).collect()
    assert len(got) == len(held) and all(r.n_known == 0 and r.score == pytest.approx(0) and r.base_score == pytest.approx(0) for r in got)


def test_words_outside_the_vocabulary_have_dishes_of_their_own(spark, monkeypatch):
    """After a word never seen, a word is likely by how many contexts it had, whether it stands in the vocabulary or not."""
    train = [i for i in range(2000) if pitman_yor.is_training(i)]
    held = [i for i in range(400) if not pitman_yor.is_training(i)]
    data = [(i, f"c{i} " + ("often" if i % 8 else "seldom" if i % 40 else f"once{i}"), "en", "s", 0) for i in train]
    data += [(i, f"new{i} " + ("often", "seldom", "never")[n % 3], "en", "s", 0) for n, i in enumerate(held)]
    got = {}
    for most, words, tokens in ((1 << 20, 500_000, 2_500_000), (2, 500_000, 2_500_000), (2, 50, 300)):
        monkeypatch.setattr(pitman_yor, "VOCABULARY", most)
        monkeypatch.setattr(pitman_yor, "COLD_WORDS", words, raising=False)
        monkeypatch.setattr(pitman_yor, "SHARD_TOKENS", tokens)
        scores = {r.doc_id: r.score for r in pitman_yor.pitman_yor_scores(spark.createDataFrame(data, SCHEMA)).collect()}
        got[most, words] = [np.mean([scores[i] for i in held[n::3]]) for n in range(3)]
    whole = got.pop((1 << 20, 500_000))
    assert whole[0] > whole[1] + 0.5 > whole[2] + 1
    for some in got.values():
        assert some == pytest.approx(whole, abs=0.1)


def test_probabilities_of_words_outside_the_vocabulary_sum_to_one():
    rng = np.random.default_rng(4)
    k = rng.integers(1, 200, 300)
    outside = np.bincount(k[100:])
    p = pitman_yor.seat_parent(np.append(k[:100], k[100:].sum()), 300, 0.6, rng, outside)
    assert p[:101].sum() + outside[1:] @ p[101:] == pytest.approx(1, abs=1e-12)
    # nearly as if all were in the vocabulary, and rising with the customers
    whole = pitman_yor.seat_parent(np.append(k, 0), 300, 0.6, rng)
    assert p[100 + k[100:]] == pytest.approx(whole[100:300], rel=0.1, abs=2e-4) and (np.diff(p[100:]) > 0).all()


def test_mean_tables():
    c, mass, d = 6, 3.0, 0.4
    s = {0: {0: 1.0}}
    for k in range(1, c + 1):
        s[k] = {j: s[k - 1].get(j - 1, 0) + (k - 1 - d * j) * s[k - 1].get(j, 0) for j in range(1, k + 1)}
    weight = np.array([s[c][j] * mass**j for j in range(1, c + 1)])
    got = pitman_yor.mean_tables(3000, mass, d)
    assert got[:2].tolist() == [0, 1] and got[c] == pytest.approx(weight @ np.arange(1, c + 1) / weight.sum())
    assert got[3000] == pytest.approx(1 + mass / d, rel=0.1)  # its limit is one more than a Poisson number of that mean
