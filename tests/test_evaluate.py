"""Cases of the queries that evaluate."""

import numpy as np
import pytest

from talus.functions import fixed as X
from talus.operators import dialogue as D
from talus.operators import vectors as V
from talus.plans.evaluate import QUERIES

DOCUMENTS = [(3 * i, " ".join(f"w{(i * j) % 23}" for j in range(1, 2 + i % 7))) for i in range(150)] + [(1000, None), (1003, "w1 w2"), (1001, "w1 w2")]


def conversations():
    """(conv_id, turn, role, text): ids that 50 divides are few, some conversations have one question only, some questions are the same."""
    for conv in (1, 2, 7, 49, 50, 51, 99, 100, 149):
        for turn in range(conv % 5 + 1):
            yield conv, 2 * turn, "user", f"w{conv % 23} w{(conv + 5 * turn) % 23} w{7 * turn % 23}" + (" Grado en That" if turn == 1 else "")
            if turn % 2 == 0:
                yield conv, 2 * turn + 1, "assistant", "Grado en Der"


def plainly():
    """strategy: ranks of the texts sought, by one question after the other against all documents."""
    unit = lambda texts, prefix: V._unit(V.hash_embedder([prefix + (t or "") for t in texts]).astype(np.float32).astype(float))
    ids, vectors = [i for i, _ in DOCUMENTS], unit([t for _, t in DOCUMENTS], X.PASSAGE_PREFIX)
    ranking = lambda text: [i for _, i in sorted(zip(np.abs(np.round(1 - unit([text], X.QUERY_PREFIX) @ vectors.T, 6))[0], ids, strict=True))]
    cat = D.Catalogue(["Grado en Eauou", "Grado en That", "Grado en Der"])
    turns, ranks = {}, {"alone": [], "concatenated": [], "stateful": []}
    for conv, turn, role, text in conversations():
        if role == "user":
            turns.setdefault(conv, []).append([turn, text, "", False])
        else:
            turns[conv][-1][2] = text
    for asked in turns.values():
        state, said = D.State(), [t[1] for t in asked]
        for n, (_, question, answer, _) in enumerate(asked):
            state, query = D.step(state, question, answer, cat)
            if n:
                sought = ranking(" ".join(said[: n + 1]))[0]
                texts = {"alone": question, "concatenated": f"{said[n - 1]} {question}", "stateful": " ".join([query.text, *query.scope])}
                for strategy, text in texts.items():
                    ranks[strategy].append(ranking(text).index(sought) + 1)
    return ranks


def test_follow_up_strategies_ask_all_conversations(spark, tmp_path):
    spark.createDataFrame(list(conversations()), "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(DOCUMENTS, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.strategy: (r.n, r.hit_at_20, r.mrr) for r in QUERIES["follow_up_strategies"](spark, str(tmp_path)).collect()}
    wanted = {s: (len(r), round(sum(x <= 20 for x in r) / len(r), 6), round(sum(1 / x for x in r if x <= 20) / len(r), 6)) for s, r in plainly().items()}
    assert got == wanted and wanted["alone"][0] == 18
    assert any(x > 20 for r in plainly().values() for x in r)


@pytest.mark.parametrize("block", [3, 4096])
def test_rank_of_equals_the_ranking_in_small_tiles(spark, monkeypatch, block):
    emb = spark.createDataFrame([((i * 37) % 101, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "TILE", 7)
    probes = emb.where("vec_id % 4 = 0").selectExpr("vec_id as query_id", "embedding as query_vec")
    wanted = {(r.query_id, r.vec_id): r.rank for r in V.top_k(probes, emb, 60).collect()}
    ids = sorted({i for _, i in wanted})
    pick = {q: ids[(q * 13) % len(ids)] for q in {q for q, _ in wanted}}
    asked = probes.join(spark.createDataFrame(list(pick.items()), "query_id bigint, sought bigint"), "query_id")
    assert {(r.query_id, r.rank) for r in V.rank_of(asked, emb).collect()} == {(q, wanted[q, i]) for q, i in pick.items()}
    assert [(r.query_id, r.vec_id) for r in V.top_k(probes, emb, 1).orderBy("query_id").collect()] == sorted((q, i) for (q, i), n in wanted.items() if n == 1)


def test_the_one_sought_does_not_stand_before_itself():
    q = {"query_id": np.array([5, 6]), "d": np.array([0.5, 0.2]), "id": np.array([8, 8])}
    got = V._before(q, {"vec_id": np.array([9, 8, 3])}, np.array([[0.1, 0.499999, 0.5], [0.2, 0.2, 0.2]]))
    assert got["query_id"].tolist() == [5, 6] and got["n"].tolist() == [2, 1]
