"""Near-duplicates against a comparison of all pairs."""

import random
import re

import numpy as np
import pytest

from talus.llm import minhash
from talus.llm.components import components
from tests.llm.cases import SCHEMA, frame, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(data, size):
    sets = {}
    for doc, text, *_ in data:
        w = WORD.findall(low(text or ""))
        sets[doc] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def groups(seed):
    """Chains and clouds of near copies, so that stars alone do not find every link."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    data, doc = [], 0
    for g in range(8):
        base = [r.choice(vocabulary) for _ in range(r.choice([8, 30, 120, 200]))]
        for _ in range(25):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 30))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            if g % 3 == 0:
                base = words  # a chain
            data.append((doc, " ".join(words), "en", "s", 0))
            doc += 7
    r.shuffle(data)
    return data


@pytest.mark.parametrize("seed,size", [(0, 4), (1, 4), (2, 5)])
def test_components_match_all_pairs(spark, seed, size):
    data = rows(seed=seed) if seed == 0 else [(d + 10_000, *x) for d, *x in groups(seed)]
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, data), size).collect()}
    want = plain(data, size)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (r.component_id == d) for d, r in got.items())


def test_blocks_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LISTED", 1)
    monkeypatch.setattr(minhash, "STARS", 0)
    monkeypatch.setattr(minhash, "BLOCK_FEW", 3)
    monkeypatch.setattr(minhash, "BLOCK_MANY", 5)
    data = groups(3)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, data), 4).collect()}
    assert got == {d: c for d, (_, c) in plain(data, 4).items()}


def test_signature_agreement_estimates_likeness():
    r = np.random.default_rng(1)
    for n in (3, 40, 4000):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: int(n * 0.9)], r.integers(0, 1 << 63, n - int(n * 0.9), dtype=np.uint64)]))
        same = (minhash.signature(a) == minhash.signature(b)).mean()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(same - true) < (0.5 if n == 3 else 0.16)


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(700, i) for i in range(701, 760)]
    got = {x.a: x.root for x in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    root = {x: x for p in links for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    assert got == {a: c for a, c in root.items() if a != c}


def test_drop(spark):
    docs = frame(spark)
    out = minhash.drop_near_duplicates(docs, 5)
    assert out.dtypes == docs.dtypes
    assert {r.doc_id for r in out.collect()} == {d for d, (_, c) in plain(rows(), 5).items() if d == c}
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
