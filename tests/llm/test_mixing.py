"""Mixing against a plain version on the driver."""

import math
from collections import Counter

import pytest

from talus.llm import mixing
from tests.llm.cases import SCHEMA, frame, rows


def sources():
    sizes = {"big": 400, "mid": 90, "small": 30, "tiny": 11}
    return [(k * 1000 + i, "w " * (3 + (i * 7) % 40), "en", s, 0) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"target": 1.0, "max_repeats": 3.0}, {"budget": 2500.0}, {"target": 0.99, "max_repeats": 50.0}])
def test_budgets(spark, options):
    data = sources()
    docs = spark.createDataFrame(data, SCHEMA)
    made = mixing.plan(docs, **{"target": 0.95, "max_repeats": 4.0, **options})
    tokens = Counter()
    for _, text, _, s, _ in data:
        tokens[s] += len(text.split())
    raised = {s: n**made.exponent for s, n in tokens.items()}
    z = sum(raised.values())
    weight = {s: x / z for s, x in raised.items()}
    if not options:
        assert abs(-sum(w * math.log(w) for w in weight.values()) - 0.95 * math.log(4)) < 1e-6 or abs(max(weight[s] * made.budget / tokens[s] for s in tokens) - 4) < 1e-6
    size = {d: len(t.split()) for d, t, *_ in data}
    of = {d: s for d, _, _, s, _ in data}
    got = mixing.mix_sources(docs, **options).collect()
    spent, times = Counter(), Counter()
    for r in got:
        spent[r.source] += size[r.doc_id]
        times[r.doc_id] += 1
        assert of[r.doc_id] == r.source
    for s in tokens:
        assert weight[s] * made.budget - 43 <= spent[s] <= weight[s] * made.budget + 1
        most = {times[d] for d in of if of[d] == s}
        assert max(most) - min(most) <= 1
    if "budget" not in options:
        assert set(times) == set(of)


def test_awkward_rows(spark):
    docs = frame(spark)
    out = mixing.apply_mix(docs)
    assert out.dtypes == docs.dtypes
    got = Counter(r.doc_id for r in out.collect())
    assert set(got) == {d for d, *_ in rows()} and max(got.values()) <= 5
    assert mixing.mix_sources(frame(spark, [])).count() == 0


def test_many_sources_bisect_alike(spark, monkeypatch):
    docs = spark.createDataFrame(sources(), SCHEMA)
    here = mixing.plan(docs).exponent
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 1)
    assert abs(mixing.plan(docs).exponent - here) < 1e-9
