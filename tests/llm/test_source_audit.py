"""The divergence audit against a plain version with Python integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from talus.llm import source_audit as S
from tests.llm.cases import SCHEMA, frame, rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(data, least=3, top=200):
    held, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in data:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(AZ))
        groups[lang].add(source)
        held[lang].update(set(found))
        n[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in held[lang].items() if k >= least]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (n[lang, s][t] + 1) // (total[s] + len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(n[lang, s][t] for s in sources) + 1) // (sum(total.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            parts = {"pair": [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]}
            parts["term"] = [(t, f(p[s][t], q[t])) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items, 1) if part == "pair" or r <= top]
    return sorted(out)


def corpus(seed, sources=9, n=150):
    r = random.Random(seed)
    words = ["".join(r.choice("abÄé😀cZ") for _ in range(r.randint(1, 4))) for _ in range(300)]
    data = []
    for i in range(n):
        text = r.choice(["", " ", "-", "1 "]).join(r.choice(words) + r.choice([" ", "_", "[", "\x7f"]) for _ in range(r.choice([0, 3, 40, 200])))
        data.append((i, r.choice([text, text.lower()]), r.choice(["en", "en", "de", None, ""]), r.choice([None, "", "hot", "hot", *(f"s{k}" for k in range(sources))]), 0))
    data += [(500, None, "fr", "a", 0), (501, "", "fr", "b", 0), (502, "only here", "fr", "c", 0), (503, "lone", "it", "z", 0)]  # a lang without kept terms
    return data + data[10:20] + [(600, "long " * 300_000 + "x" * (3 << 20) + " long", "en", "s1", 0), (601, "x" * (3 << 20), "en", "s2", 0), (602, "x" * (3 << 20), "en", "s2", 0)]


def audited(spark, data, **more):
    return sorted(tuple(x) for x in S.source_audit(frame(spark, data), **more).collect())


def test_source_audit(spark):
    data = corpus(1)
    want = plain(data)
    assert {"pair", "term"} == {x[2] for x in want} and any(x[4] == 0 and x[0] == "fr" for x in want)
    assert audited(spark, data) == want


@pytest.mark.parametrize("small", [{"TERMS": 7, "CELLS": 50}, {"MATRICES": 30, "HEAPS": 20}, {"ENTRIES": 5, "PIECE": 64, "MATRICES": 130}])
def test_small_tiles_matrices_and_heaps(spark, monkeypatch, small):
    for name, x in small.items():
        monkeypatch.setattr(S, name, x)
    data = corpus(2, n=80)
    assert audited(spark, data, top=5, least=2) == plain(data, top=5, least=2)


def test_langs_in_turns(spark):
    data = corpus(3, n=60)
    assert audited(spark, data, most_groups=4) == plain(data)


def test_awkward_and_empty_tables(spark):
    assert audited(spark, None) == plain(rows())
    assert S.source_audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_beyond_64_bits():
    n = np.array([0, 5 * 10**9, 10**10 - 1, 9 * 10**17])
    assert S.shares(n, 10**18, 10).tolist() == [1 + 10**9 * (int(x) + 1) // (10**18 + 10) for x in n]
