"""Line deduplication against a plain version, and its two filters against sets."""

import random
from collections import defaultdict

import numpy as np
import pytest

from talus.llm import line_dedup as L
from tests.llm.cases import SCHEMA, frame, rows

WS = " \t\n\x0b\f\r"
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(data, shortest, documents, keep):
    held = defaultdict(set)
    key = lambda line: line.strip(WS).translate(AZ)
    for i, text, *_ in data:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= shortest:
                    held[key(line)].add(i)
    keeper = {k: (max if keep == "last" else min)(d) for k, d in held.items() if len(d) >= documents}
    out = []
    for i, text, *_ in data:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or keeper.get(key(x), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def corpus(seed=3):
    """Lines shared by two to all documents in other case and spacing, some at the length limit, some twice in a document."""
    r = random.Random(seed)
    shared = ["".join(r.choice("abcdeéñÄ ") for _ in range(r.choice([9, 10, 11, 30]))).strip() + "x" for _ in range(25)]
    data = []
    for i in range(60):
        lines = [f"own line number {i} {r.random()}"] + ["the line that every document holds"]
        for _ in range(r.randint(0, 8)):
            x = r.choice(shared[: 1 + i % 25])
            lines.append(r.choice(["", " ", "\t", "\x0b"]) + r.choice([x, x.upper() if x.isascii() else x]) + r.choice(["", "\r", " "]))
        r.shuffle(lines)
        data.append((2 * i - 40, "\n".join(lines), "en", "s", 0))
    data += [(2, data[21][1], "en", "s", 0), (None, data[3][1], "en", "s", 0), (999, None, "en", "s", 0), (1000, "", "en", "s", 0), (1001, "\n\n", "en", "s", 0)]
    data.append((1002, "\n".join([f"row {j} of one very long text" for j in range(30_000)] + ["the line that every document holds"] * 3), "en", "s", 0))
    return data


@pytest.mark.parametrize("keep", ["last", "first"])
@pytest.mark.parametrize("sizes", [{}, {"most_keys": 2}, {"most_keys": 1, "most_bits": 16}])
def test_line_dedup(spark, keep, sizes):
    data = corpus()
    got = sorted((tuple(x) for x in L.line_dedup(frame(spark, data), shortest=10, documents=4, keep=keep, **sizes).collect()), key=repr)
    want = plain(data, 10, 4, keep)
    assert got == want and sum(x[3] for x in want) > 100


def test_awkward_and_empty_tables(spark):
    got = sorted((tuple(x) for x in L.line_dedup(frame(spark), shortest=10, documents=2).collect()), key=repr)
    assert got == plain(rows(), 10, 2, "last")
    assert L.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_key_length_is_in_code_points():
    assert L.long_key("é".encode() * 39, 40) is None and L.long_key("é".encode() * 40, 40)
    assert L.long_key(b" " + b"A" * 40 + b"\r", 40) == L.long_key(b"a" * 40, 40)


@pytest.mark.parametrize("share", [7, 1 << 20])
def test_no_repeated_key_is_missed(spark, share, monkeypatch):
    """Whatever the shares, keys of two rows are suspected; with room in the filter one in fifty others is."""
    monkeypatch.setattr(L, "SHARE", share)
    r = np.random.default_rng(1)
    once, twice = r.bytes(16 * 3000), r.bytes(16 * 200)
    ks = lambda b: [b[i : i + 16] for i in range(0, len(b), 16)]
    data = [(i, k) for i, k in enumerate(ks(once))] + [(10_000 + i, k) for i, k in enumerate(ks(twice) * 2)]
    lines = spark.createDataFrame([(i, bytearray(k)) for i, k in data], "doc_id bigint, keys binary").repartition(5)
    seen, bits = L.twice_seen(lines)
    found = {bytes(x.key) for x in L.suspects(lines, seen, bits).collect()}
    assert set(ks(twice)) <= found and len(found - set(ks(twice))) < 60
    crowded, bits = L.twice_seen(lines, most_bits=16)
    assert set(ks(twice)) <= {bytes(x.key) for x in L.suspects(lines, crowded, bits).collect()}


def test_only_suspects_are_shuffled(spark):
    data = [(i, f"a line of its own, long enough to count: {i} {i * i}\n" * 3, "en", "s", 0) for i in range(500)]
    lines = L.line_keys(spark.createDataFrame(data, SCHEMA))
    assert L.suspects(lines, *L.twice_seen(lines)).count() < 30
