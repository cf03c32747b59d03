"""Chunking cases: termination, bounds, nothing lost."""

import random

import numpy as np
import pytest

from talus.operators import chunking as K


def test_pack_and_merge_cases():
    sizes = (185, 1155, 1172)
    made = K.merge_short([c * n for c, n in zip("abc", sizes)], 200, 1340)
    assert all(len(c) <= 1340 for c in made) and sum(len(c) < 200 for c in made) == 1
    assert sum(len(c.replace("\n", "")) for c in made) == sum(sizes)
    assert len(K.merge_short(["a" * 50, "b" * 500], 200, 1340)) == 1
    assert [len(c) for c in K.merge_short(["A" * 40, "B" * 40 + "\n" * 30], 50, 100)] == [81]
    assert len(K.merge_short(["x" * 95, "y" * 95], 100, 188)) <= 2


def test_split_pieces():
    assert K.split_pieces("") == [] and K.split_pieces("a\n\n\nb") == ["a", "b"]
    assert K.split_pieces("one two. three four! five", 12) == ["one two.", "three four!", "five"]
    assert K.split_pieces("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]


@pytest.mark.parametrize("seed", range(30))
def test_chunks_are_bounded_and_whole(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word ", "a", ". ", "\n\n", "long" * 20, "! "]) for _ in range(r.randint(0, 400)))
    for most, least in ((50, 20), (120, 100), (900, 200)):
        made = K.chunk_text(text, "H", most, most, least)
        assert all(len(c) <= most and c.startswith("H\n") for c in made)
        assert "".join("".join(c[2:] for c in made).split()) == "".join(text.split())
        assert made == K.chunk_text(text, "H", most, most, least)


def _merge_from_the_start(chunks, least, most):
    """``merge_short`` as it is told: after each step that leaves fewer chunks, all over again."""
    out, i = list(chunks), 0
    while i < len(out):
        if len(out[i]) >= least or len(out) == 1:
            i += 1
            continue
        a = max(i - 1, 0)
        joined = out[a] + "\n" + out[a + 1]
        made = [joined] if len(joined) <= most else K.pack(K.split_pieces(joined, most), min(len(joined) // 2 + 1, most))
        if len(made) < 2:
            out[a : a + 2], i = made, 0
            continue
        if len(made) == 2:
            out[a : a + 2] = made
        i = a + 2
    return out


@pytest.mark.parametrize("seed", range(40))
def test_merging_skips_only_what_is_settled(seed):
    r = random.Random(seed)
    for _ in range(20):
        least, most = r.choice([(20, 50), (60, 70), (100, 188)])
        chunks = ["".join(r.choice("ab. \n") for _ in range(r.randint(1, most))).strip() or "a" for _ in range(r.randint(0, 30))]
        assert K.merge_short(chunks, least, most) == _merge_from_the_start(chunks, least, most)


def test_windows_under_a_header():
    text = "".join(chr(97 + i % 26) for i in range(250))
    assert K.fixed_text(text, "", 0.0, 100, 0) == [text[:100], text[100:200], text[200:]]
    assert K.fixed_text(text, "H", 0.2, 102, 0) == ["H\n" + text[i : i + 100] for i in range(0, 250, 80)]
    assert K.fixed_text(text[:110], "", 0.0, 100, 20) == [text[:100], text[100:110]]  # no cut shares this out better
    assert [len(c) for c in K.fixed_text("ab " * 40, "", 0.0, 100, 30)] == [98, 21]  # a short tail takes what a space leaves to it
    assert K.fixed_text("", "H", 0.1, 100, 20) == K.fixed_text(" \n ", "H", 0.1, 100, 20) == []


def test_semantic_cuts():
    """Two subjects of two paragraphs each: one cut; no cut is ever made beyond the largest distance."""
    vectors = {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    model = lambda texts: [vectors[t.removeprefix(K.X.PASSAGE_PREFIX)[0]] for t in texts]
    text = "a one\n\na two\n\nb one\n\nb two"
    assert K.Pieces(text, model).distances(900).tolist() == [0.0, 1.0, 0.0]
    assert K.semantic_text(K.Pieces(text, model), 0.5, "H", 900, 0) == ["H\na one\na two", "H\nb one\nb two"]
    assert K.semantic_text(K.Pieces(text, model), 2.0, "", 900, 0) == [text.replace("\n\n", "\n")]
    assert K.semantic_text(K.Pieces(text, model), 2.0, "", 12, 0) == ["a one\na two", "b one\nb two"]  # over the limit: packed
    assert K.semantic_text(K.Pieces(text, model), 0.5, "", 900, 20) == [text.replace("\n\n", "\n")]  # short: merged
    assert K.semantic_text(K.Pieces("", model), 0.5, "H") == []


def test_grid_agrees_with_one_run_a_configuration(spark):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta.", "epsilon\n\n", "zeta;"]
    texts = [None, "", "  \n", "x" * 3000] + [" ".join(r.choice(words) for _ in range(r.randint(1, 900))) for _ in range(20)]
    units = spark.createDataFrame([(i, None if i == 5 else f"h{i}", t) for i, t in enumerate(texts)], "key bigint, header string, text string").repartition(3)
    sizes, shares = [300, 600], [0.3, 0.7]
    cuts = {}
    for n, found in K.distance_percentiles(units, sizes, shares).items():
        every = [K.Pieces(t or "", K.hash_embedder).distances(n - (0 if i == 5 else len(f"h{i}") + 1)) for i, t in enumerate(texts)]
        expected = np.percentile(np.concatenate(every), [30, 70])
        assert found == pytest.approx(expected.tolist(), abs=1e-9)
        cuts |= {(n, 100 * s): p for s, p in zip(shares, found, strict=True)}
    grid = [(n, way, s) for n in sizes for way, ss in (("structural", (0.6, 1.0)), ("fixed", (0.0, 0.2)), ("semantic", (30.0, 70.0))) for s in ss]
    rows = {(x.most, x.strategy, x.setting): x for x in K.run_grid(units, grid, cuts).collect()}
    assert set(rows) == set(grid)
    for (most, way, setting), got in rows.items():
        one = {"structural": lambda: K.structural_chunks(units, int(most * setting), most), "fixed": lambda: K.fixed_chunks(units, setting, most), "semantic": lambda: K.semantic_chunks(units, cuts[most, setting], K.hash_embedder, most)}[way]().collect()
        assert (got.texts, got.chunks, got.longest) == (len({x.key for x in one}), len(one), max(len(x.chunk) for x in one))
        assert got.longest <= most


def test_limits_that_cut_alike_share_pieces_and_distances():
    asked = []

    def model(texts):
        asked.append(len(texts))
        return K.hash_embedder(texts)

    text = "One two. Three;  four!\n\n\nFive" + " six" * 20 + ". Seven?\t\n8.9 .. end "
    pieces = K.Pieces(text, model)
    for room in (10, 40, 95, 97, 200, 300):
        assert pieces.split(room) == K.split_pieces(text, room) and "".join("".join(pieces.split(room)).split()) == "".join(text.split())
    assert pieces.split(200) is pieces.split(300) and pieces.distances(200) is pieces.distances(300)
    assert K.split_pieces("a.  b;c; d", 2) == ["a.", "b;", "c;", "d"]


def test_grid_of_nothing(spark):
    none = spark.createDataFrame([], "key bigint, header string, text string")
    assert K.distance_percentiles(none, [600], [0.5]) == {600: [float("inf")]}
    assert K.run_grid(none, [(600, "semantic", 50.0)], {(600, 50.0): 1.0}).count() == 0
