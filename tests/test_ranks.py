"""Exact ranks, first rows and running numbers against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from talus.operators import ranks as K


def groups(seed):
    r = random.Random(seed)
    data = [("normal", r.gauss(0, 1)) for _ in range(3000)] + [("heavy", 10 ** r.uniform(-300, 300) * r.choice([1, -1])) for _ in range(2000)]
    data += [("ties", float(r.randint(0, 3))) for _ in range(1000)] + [("one", 7.5)] + [("near", 1.0 + i * 2**-52) for i in range(50)] + [("wide", x) for x in (-1.7e308, 1.7e308, 0.0, -0.0, 5e-324, -5e-324)]
    data += [(None, float(i)) for i in range(10)] + [("gaps", None), ("gaps", 2.0), ("none", None)]
    data += [("odd", x) for x in (math.nan, math.inf, -math.inf, 1.0, 2.0, math.inf)]
    r.shuffle(data)
    return data


def test_ranked_values(spark):
    data = groups(1)
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    held = {}
    for k, v in data:
        held.setdefault(k, []).extend([v] if v is not None else [])
    for v in held.values():
        v.sort(key=lambda x: (math.isnan(x), x))
    want = {(k, r): v[r] for k, v in held.items() for r in sorted({0, len(v) // 3, len(v) // 2, len(v) - 1} & set(range(len(v))))}
    asked = spark.createDataFrame([*want, ("one", 5), ("one", -1), ("lost", 0)], "k string, rank bigint")
    got = {(x.k, x.rank): x.value for x in K.ranked_values(df, ["k"], "v", asked).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] or (math.isnan(got[k]) and math.isnan(want[k])) for k in want)


def test_quantiles_equal_the_built_in_ones(spark):
    data = [(k, v) for k, v in groups(2) if k not in ("odd", "wide", "heavy")]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    got = {r.k: r for r in K.quantiles(df, ["k"], "v", {"m": 0.5, "p": 0.9}, {"near": 0.9, "last": 1.0}).collect()}
    for r in df.groupBy("k").agg(F.median("v").alias("m"), F.percentile("v", 0.9).alias("p"), F.array_sort(F.collect_list("v")).alias("all")).collect():
        assert (got[r.k].m, got[r.k].p) == (pytest.approx(r.m), pytest.approx(r.p))
        n = len(r["all"])
        assert (got[r.k].near, got[r.k]["last"]) == ((r["all"][min(n - 1, int(0.9 * n))], r["all"][-1]) if n else (None, None))
    assert K.quantiles(df.where("false"), ["k"], "v", {"m": 0.5}).count() == 0


def test_no_group_in_an_array_or_window(spark):
    from talus.operators import evaluate as H

    df = spark.range(5000).selectExpr("'a' as model", "id", "id / 3 as seconds", "1.0d as precision", "1.0d as coverage")
    row = H.summary(df, "model").first()
    assert (row.n, row.median, row.p90, row.longest) == (5000, round(4999 / 6, 6), 1500.0, round(4999 / 3, 6))
    plan = H.summary(df, "model")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower() and "median(" not in plan


@pytest.mark.parametrize("n", [1, 3, 1000])
def test_first_rows(spark, n):
    r = random.Random(n)
    data = [(r.choice(["a", "a", "a", "b", None]), r.randint(0, 50), i) for i in range(700)]
    df = spark.createDataFrame(data, "k string, o int, i int").repartition(4)
    want = [x for k in ("a", "b", None) for x in sorted([x for x in data if x[0] == k], key=lambda x: x[1:])[:n]]
    assert sorted(map(tuple, K.first_rows(df, ["k"], ["o", "i"], n).collect()), key=repr) == sorted(want, key=repr)
    part = K.first_rows(df, ["k"], ["o", "i"], n)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in part
    assert [tuple(x) for x in K.first_rows(df, [], ["o", "i"], 2).collect()] == sorted(data, key=lambda x: x[1:])[:2]


def test_numbered(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 5000 as x", "cast(id as string) s").repartition(7)
    got = K.numbered(df, ["x"], "n", 1).collect()
    assert len(got) == 5000 and all(r.n == r.x + 1 for r in got)
    assert K.numbered(df.where("false"), ["x"]).count() == 0


def test_store_verdicts(spark):
    from talus.operators import evaluate as H

    m = [("a", 1.0, 500.0, 512.0, 3, 3, True), ("b", 0.999, 500.1, 512.1, 3, 4, True), ("c", 1.0, 1.0, 1024.1, 3, 3, False), ("d", 1.0, 1.0, 1024.0, None, None, None)]
    measures = spark.createDataFrame(m, "store string, fidelity double, median_ms double, memory_mb double, returned int, asked int, all_fit boolean")
    filters = spark.createDataFrame([("a", 5, 5, 0), ("a", 0, 0, 0), ("b", 5, 5, 0), ("b", 5, 6, 0), ("c", 5, 5, 1)], "store string, got int, expected int, false_positives int")
    got = {(r.store, r.threshold): r.verdict for r in H.store_verdicts(measures, filters).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "a"} == {"fidelity": "met", "filters": "met", "latency": "met", "memory": "met", "prefilter": "before"}
    assert {k[1]: v for k, v in got.items() if k[0] == "b"} == {"fidelity": "not met", "filters": "not met", "latency": "not met", "memory": "between", "prefilter": "after, or loses rows"}
    assert got["c", "filters"] == "not met" and got["c", "memory"] == "ruled out" and got["c", "prefilter"].startswith("after")
    assert ("d", "filters") not in got and ("d", "prefilter") not in got and got["d", "memory"] == "between"


def test_grades_by_six_criteria(spark):
    from talus.operators import evaluate as H

    catalogue = ["Grado en Minas", "Grado en Minas y Energía", "Grado en Sol"]
    cases = [
        ("conjunto", ["Álgebra"], [], "- Álgebra (6 ECTS)", True), ("conjunto", ["Álgebra"], [], "- Álgebra\n- Magia", False), ("conjunto", ["Álgebra", "Física"], [], "- Álgebra", False),
        ("escalar", ["6"], [], "Tiene 6,0 ECTS", True), ("escalar", ["6"], [], None, False), ("fija", ["Hola."], [], "Hola.", True), ("fija", ["Hola."], [], "Hola", False),
        ("sin_invencion", [], [], "Mira el Grado en Sol.", True), ("sin_invencion", [], [], "Mira el Grado en Magia y el Grado en Sol.", False), ("sin_invencion", [], [], "Ninguno.", False),
        ("rechazo", [], [], "Aquí no se estudia eso. Hay Grado en Sol.", True), ("rechazo", [], [], "Sí. Claro. No cuesta nada.", False), ("rechazo", [], [], "NO HAY CONTEXTO", True), ("rechazo", [], [], "No, haz el Grado en Magia", False),
        ("rechazo", [], [], "Vale. De las que hay, ninguna encaja.", True), ("ambito", ["Grado en Minas"], ["Grado en Sol"], "El Grado en Minas tiene ocho.", True),
        ("ambito", ["Grado en Minas"], [], "El Grado en Minas y Energía tiene ocho.", False), ("ambito", ["Grado en Minas"], ["Grado en Sol"], "Grado en Minas o Grado en Sol", False), ("ambito", [], None, "", True),
    ]
    bank = spark.createDataFrame([(i, c, "creditos", e, f) for i, (c, e, f, *_) in enumerate(cases)], "id int, criterion string, family string, expected array<string>, forbidden array<string>")
    answers = spark.createDataFrame([(10 + i, i, c[3]) for i, c in enumerate(cases)], "run int, id int, answer string")
    names = spark.createDataFrame([("Álgebra",), ("Física",)], "name string")
    got = {r.run - 10: r.passed for r in H.grade(answers, bank, names, spark.createDataFrame([(c,) for c in catalogue], "name string"), ["NO HAY CONTEXTO"]).collect()}
    assert got == {i: c[4] for i, c in enumerate(cases)}
    with pytest.raises(Exception, match="unknown criterion"):
        H.grade(answers, bank.withColumn("criterion", F.lit("otro")), names, names).collect()
