"""Containment joins against plain loops, with few and many names; no nested-loop join in any plan."""

import random

import pytest
from pyspark.sql import functions as F

from talus.functions.plain import normalize
from talus.operators import contain as C
from talus.operators import vectors as V


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abñ ") for _ in range(r.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("most", [C.MOST, 0])
def test_hits(spark, most):
    texts, names = words(1, 60) + ["aaaa", "ababab", "", None, "aaaa"], words(2, 50) + ["a", "aa", "ab", "", "abab", None, "ñ", "zzz", "zz", "aa"]
    got = {tuple(x) for x in C.hits(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in names], "name string"), most).collect()}
    want = {(t, n, t.count(n)) for t in texts if t is not None for n in names if n is not None and n in t}
    assert got == want


@pytest.mark.parametrize("most", [C.MOST, 0])
def test_named_by_itself(spark, most):
    catalogue = ["Grado en Minas", "Grado en Minas y Energía", "Doble Grado en Minas y Energía y Sol", "Minas", "grado en minas"]
    texts = [(1, "El Grado en Minas y Energía"), (2, "grado en minas, Grado en Minas y energía"), (3, "minas"), (4, "nada"), (5, None), (6, "Doble grado en MINAS y Energía y Sol y minas")]
    got = {tuple(r) for r in C.named_by_itself(spark.createDataFrame(texts, "k int, t string"), "k", "t", spark.createDataFrame([(c,) for c in catalogue], "name string"), most).collect()}
    want = set()
    for k, t in texts:
        said = normalize(t or "")
        for c in catalogue:
            n = said.count(normalize(c))
            if n:
                taken = sum(said.count(normalize(o)) * normalize(o).count(normalize(c)) for o in catalogue if o != c)
                want.add((k, c, n > taken))
    assert got == want


def test_unknown_names(spark):
    catalogue = ["Grado en Minas y Energía", "Grado en Sol"]
    named = ["Grado en Minas", "Grado en Sol y Mar", "Energía Minas", "Grado en Mar", "minas sol", "¡!", "Sol", ""]
    df = spark.createDataFrame(list(enumerate(named)), "k int, name string")
    unknown = lambda c: {r.name for r in C.unknown_names(df, spark.createDataFrame([(x,) for x in c], "name string"), "k").collect()}
    assert unknown(catalogue) == {"Grado en Mar", "minas sol"}
    assert unknown([]) == set(named) and unknown([" ", "x"]) == set()


def test_bounded(spark):
    cases = [("que tal es redes?", "redes", True), ("redes2", "redes", False), ("lasredes redes", "redes", True), ("año", "año", True), ("ñaño", "año", False), ("c++ y", "c++", True), ("", "", False), ("redesredes", "redes", False)]
    df = spark.createDataFrame([(t, n) for t, n, _ in cases], "t string, n string")
    assert [r.b for r in df.select(C.bounded(F.col("t"), F.col("n")).alias("b")).collect()] == [b for *_, b in cases]


def test_no_nested_loops(spark):
    names = spark.createDataFrame([("Grado en Sol",)], "name string")
    texts = spark.createDataFrame([(1, "Grado en Sol", "sol")], "k int, name string, wanted string")
    for df in (C.unknown_names(texts, names, "k"), C.named_by_itself(texts, "k", "name", names), C.named_by_itself(texts, "k", "name", names, 0), V.resolve_names(texts, names)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
