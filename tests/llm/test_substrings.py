"""Suffix-array and automaton deduplication against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest

from talus.llm import anchors, automaton_dedup, suffix_dedup
from tests.llm.cases import SCHEMA, frame, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_bytes(data, window):
    raw = {d: (t or "").encode() for d, t, *_ in data}
    seen, gone = {}, {d: np.zeros(len(b), bool) for d, b in raw.items()}
    for d in sorted(raw):
        for i in range(len(raw[d]) - window + 1):
            s = raw[d][i : i + window]
            if s in seen:
                gone[d][i : i + window] = True
            seen[s] = True
    return {d: (len(b), int(gone[d].sum()), int((np.diff(np.concatenate([[0], gone[d].astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[d]])).hexdigest()) for d, b in raw.items()}


def plain_words(data, window):
    words = {d: WORD.findall(t or "") for d, t, *_ in data}
    first, out = {}, {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def patchwork(seed):
    """Documents cut and pasted from few passages, with periodic stretches and hot lines."""
    r = random.Random(seed)
    passages = [" ".join("".join(r.choice("ab\0é") for _ in range(r.randint(1, 4))) for _ in range(r.randint(30, 130))) for _ in range(12)]
    passages += ["ab " * 200, "a" * 333, "x y " * 90, "\n".join(["the same line again and again"] * 20)]
    data = []
    for i in range(70):
        parts = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            parts.append(p[a : a + r.randint(20, 400)] if r.random() < 0.7 else p)
            if r.random() < 0.4:
                parts.append(f"unique{r.random()}")
        data.append((5 * i - 60, " ".join(parts), "en", "s", 0))
    r.shuffle(data)
    return data


@pytest.mark.parametrize("seed,window,gram,shard", [(0, 100, 24, 10**6), (1, 100, 24, 500), (2, 20, 5, 10**6), (3, 100, 24, 10**6)])
def test_suffix_dedup(spark, seed, window, gram, shard):
    data = rows() if seed == 0 else patchwork(seed)
    got = suffix_dedup.suffix_dedup(frame(spark, data), window, gram, shard).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain_bytes(data, window)


@pytest.mark.parametrize("hot", [0, 3])
def test_salted_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT_CLASSES", hot)
    data = patchwork(7)
    got = suffix_dedup.suffix_dedup(frame(spark, data)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain_bytes(data, 100)
    got = automaton_dedup.automaton_dedup(frame(spark, data), 10, 3).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == plain_words(data, 10)


@pytest.mark.parametrize("seed,window,gram,shard", [(0, 50, 8, 60_000), (1, 50, 8, 200), (2, 10, 3, 60_000)])
def test_automaton_dedup(spark, seed, window, gram, shard):
    data = rows() if seed == 0 else patchwork(seed)
    got = automaton_dedup.automaton_dedup(frame(spark, data), window, gram, shard).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == plain_words(data, window)


def test_suffix_order_is_the_sorted_order():
    r = np.random.default_rng(2)
    for letters, n in ((2, 300), (4, 2000), (200, 500), (1, 90)):
        body = r.integers(0, letters, n).astype(np.uint8)
        text = np.concatenate([body, np.zeros(64, np.uint8)])
        for wanted in (np.ones(n + 1, bool), np.append(r.random(n) < 0.4, False)):
            got = suffix_dedup.suffix_order(text, suffix_dedup.byte_keys(text), wanted, 40)
            raw = text.tobytes()
            assert sorted(got.tolist()) == np.flatnonzero(wanted).tolist()
            keys = [raw[i : i + 40] for i in got.tolist()]
            assert all(a <= b for a, b in zip(keys, keys[1:]))


def test_automaton_knows_first_owners():
    r = random.Random(5)
    strings = [([r.randrange(3) for _ in range(r.randint(1, 40))], r.randrange(100)) for _ in range(40)]
    machine = automaton_dedup.SuffixAutomaton()
    for s, owner in strings:
        machine.add(s, owner)
    machine.finish()
    for s in [[r.randrange(3) for _ in range(30)] for _ in range(20)] + [x for x, _ in strings]:
        got = machine.first_owners(s, 5)
        for i, g in enumerate(got):
            want = [o for x, o in strings if any(x[j : j + 5] == s[i : i + 5] for j in range(len(x) - 4))]
            assert g == min(want, default=1 << 62)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.suffix_dedup(docs).count() == automaton_dedup.automaton_dedup(docs).count() == 0
