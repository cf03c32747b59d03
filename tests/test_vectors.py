"""Cases of the vector operators."""

import tracemalloc
from uuid import uuid4

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.operators import vectors as V


def ranked(spark, values):
    return spark.createDataFrame([(0, i, d, i + 1) for i, d in enumerate(values)], "query_id bigint, vec_id bigint, distance double, rank int")


@pytest.mark.parametrize(
    "values,least,kept",
    [
        ([0.080, 0.081, 0.082, 0.104, 0.109, 0.110], 1, 3), ([0.107, 0.108, 0.110, 0.180], 1, 3), ([0.01, 0.90, 0.91, 0.92], 3, 3), ([0.10] * 30, 3, 20),
        ([0.170], 3, 0), ([0.30], 3, 0), ([0.137], 3, 1), ([0.1380], 3, 0), ([], 3, 0),
    ],
)
def test_band(spark, values, least, kept):
    assert V.band(ranked(spark, values), least=least).count() == kept


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def test_zero_vectors_rank_without_nan(spark):
    emb = vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0])])
    got = V.top_k(V.probe_set(emb), emb, 4).orderBy("rank").collect()
    assert [(r.vec_id, round(r.distance, 4)) for r in got] == [(0, 0.0), (2, 0.2929), (1, 1.0), (3, 2.0)]


def test_query_blocks(spark, monkeypatch):
    emb = vectors(spark, [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)])
    labelled = emb.withColumn("label", F.col("vec_id") % 4)
    whole, first = V.top_k(V.probe_set(emb, 3), emb, 5).collect(), V.first_relevant(V.probe_set(emb, 3), labelled, itself=False).collect()
    assert len(whole) == 100 and len(first) == 20
    monkeypatch.setattr(V, "BLOCK", 3)
    monkeypatch.setattr(V, "VECTORS", 16)
    assert sorted(V.top_k(V.probe_set(emb, 3), emb.repartition(4), 5).collect()) == sorted(whole)
    assert sorted(V.first_relevant(V.probe_set(emb, 3), labelled, itself=False).collect()) == sorted(first)
    assert V.top_k(V.probe_set(emb.where("false")), emb, 5).count() == 0


@pytest.mark.parametrize("block", [3, 4096])
def test_distances_come_a_few_queries_at_a_time(spark, monkeypatch, block):
    emb = vectors(spark, [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)])
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "CELLS", 120, raising=False)
    kernel = lambda q, v, distance: {"query_id": q["query_id"][:1], "n": np.array([distance.size])[: len(q["query_id"])]}
    sizes = [r.n for r in V.search(V.probe_set(emb, 3), emb, kernel, "query_id bigint, n bigint").collect()]
    assert sum(sizes) == 20 * 60 and max(sizes) <= 120


def test_the_nearest_relevant_is_looked_for_once(spark, monkeypatch, tmp_path):
    """In blocks, each search counts and reads its vectors; a first search that is planned anew leaves more marks."""

    def marked(batches):
        for batch in batches:
            (tmp_path / uuid4().hex).touch()
            yield batch

    plain = vectors(spark, [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]).withColumn("label", F.col("vec_id") % 4).coalesce(1)
    want = sorted(V.first_relevant(V.probe_set(plain, 3), plain).collect())
    emb = plain.mapInArrow(marked, plain.schema)
    monkeypatch.setattr(V, "BLOCK", 3)
    assert sorted(V.first_relevant(V.probe_set(plain, 3), emb).collect()) == want
    # labels of the queries thrice (to see how many there are, to count and to search), and two searches that count and read
    assert len(list(tmp_path.iterdir())) <= 7


def test_norms_make_no_second_matrix():
    m = np.ones((32_768, 64))
    tracemalloc.start()
    try:
        got = V._unit(m)
        assert tracemalloc.get_traced_memory()[1] < m.nbytes / 4
    finally:
        tracemalloc.stop()
    assert np.allclose(got, 1 / 8)


def test_best_rows_with_ties_and_missing_numbers():
    distance = np.array([[0.5, 0.1, 0.5, 0.5, np.nan], [np.nan, np.nan, 0.2, np.nan, np.nan]])
    got = V._best(3)({"query_id": np.array([7, 8])}, {"vec_id": np.array([9, 8, 3, 4, 1])}, distance)
    assert got["query_id"].tolist() == [7, 7, 7, 8, 8, 8] and got["vec_id"].tolist() == [8, 3, 4, 3, 1, 4]


def test_hash_embedder_counts_words():
    got = np.array(V.hash_embedder(["a b a", "", "c"]))
    assert got.shape == (3, 64) and not got[1].any() and np.allclose((got * got).sum(axis=1), [1, 0, 1])
    assert sorted(np.abs(got[0][got[0] != 0]).round(6)) == [0.447214, 0.894427]
    assert len(V.hash_embedder([])) == 0


def test_first_relevant_is_the_first_of_the_ranking(spark):
    emb = vectors(spark, [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]).withColumn("label", F.col("vec_id") % 9)
    order = V.top_k(V.probe_set(emb, 7), emb, 60).collect()
    want = {}
    for r in sorted(order, key=lambda r: r["rank"]):
        if r.vec_id % 9 == r.query_id % 9:
            want.setdefault(r.query_id, r["rank"])
    assert {r.query_id: r["rank"] for r in V.first_relevant(V.probe_set(emb, 7), emb).collect()} == want


def test_an_unknown_name_raises(spark):
    catalogue = spark.createDataFrame([("Grado en Informática",)], "name string")
    wanted = lambda x: spark.createDataFrame([(x,)], "wanted string")
    assert [r.name for r in V.resolve_names(wanted(" grado EN informatica"), catalogue).collect()] == ["Grado en Informática"]
    assert [r.name for r in V.resolve_names(wanted("informatica"), catalogue).collect()] == ["Grado en Informática"]
    with pytest.raises(Exception, match="not in the catalogue"):
        V.resolve_names(wanted("x'] OR 1=1 --"), catalogue).collect()


def test_prefilter_is_whole_elements_and_before_the_search(spark):
    rows = [(i, [1.0, i / 100], ["Doble Grado en A y B"] if i < 10 else ["Grado en A"], "Tercer o cuarto curso", "OB") for i in range(20)]
    c = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, degrees array<string>, year string, kind string")
    got = V.top_k(V.probe_set(c), V.prefilter(c, ["Grado en A"], "TERCER", "OB"), 5)
    assert [r.vec_id for r in got.orderBy("rank").collect()] == [10, 11, 12, 13, 14]
    assert V.prefilter(c, ["x'] OR 1=1 --"]).count() == 0


def test_interleave(spark):
    rows = [(0, f"{s}{i}", "guia", n, i, i + 1, k) for k, s in enumerate("AB") for i, n in enumerate(("uno", "dos"))]
    df = spark.createDataFrame([(*r[:3], r[1] if r[3] == "dos" else r[1], *r[4:]) for r in rows], "query_id bigint, id string, origin string, name string, chunk_index int, rank int, scope int")
    assert [r.id for r in V.interleave(df, ["origin", "name", "chunk_index"]).orderBy("position").collect()] == ["A0", "B0", "A1", "B1"]
    same = df.withColumn("name", F.lit("shared")).withColumn("chunk_index", F.lit(0))
    assert V.interleave(same, ["origin", "name", "chunk_index"]).count() == 1


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "hola mundo"), (2, None)], "id bigint, text string")
    V.write_index(V.embed(docs), str(tmp_path), "hash-64")
    assert V.read_index(spark, str(tmp_path), "hash-64").count() == 2
    with pytest.raises(ValueError):
        V.read_index(spark, str(tmp_path), "other")


def test_a_rebuild_is_seen_whole_or_not_at_all(spark, tmp_path):
    from talus.operators import vector_index as I

    path = str(tmp_path)
    df = lambda *ids: vectors(spark, [(i, [float(i), 1.0]) for i in ids])
    assert I.current(spark, path) is None
    V.write_index(df(1, 2), path, "m")
    old = V.read_index(spark, path, "m")
    for broken in (vectors(spark, [(1, [1.0, 2.0]), (2, [1.0])]), vectors(spark, [(1, [float("nan"), 2.0])]), vectors(spark, [(1, None)])):
        with pytest.raises(ValueError, match="stays as it was"):
            V.write_index(broken, path, "m")
    failing = df(3).select("*", F.raise_error(F.lit("gone")).alias("x"))
    with pytest.raises(Exception, match="gone"):
        V.write_index(failing, path, "m")
    assert sorted(r.vec_id for r in V.read_index(spark, path, "m").collect()) == [1, 2]
    V.write_index(df(3, 4, 5), path, "m2")
    assert old.count() == 2 and V.read_index(spark, path, "m2").count() == 3  # who has begun with the old one goes on
    with pytest.raises(RuntimeError, match="faster"):
        I._publish(spark, path, 2, {})
    V.write_index(df(6), path, "m2")
    assert [n for n, _ in I._manifests(spark, path)] == [3, 2, 1] and I.current(spark, path)[0]["rows"] == 1


def test_retrieve_ways(spark):
    chunks = vectors(spark, [(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, [0.0, 1.0])])
    near, far = [1.0, 0.0], [-1.0, 0.0]
    asked = spark.createDataFrame([(10, near, False), (11, far, False), (12, far, True), (13, far, False)], "query_id bigint, query_vec array<float>, advice boolean")
    before = spark.createDataFrame([(11, near), (12, near)], "query_id bigint, query_vec array<float>")
    got = {(r.query_id, r.way): 0 for r in V.retrieve(asked, chunks, before).collect()}
    assert set(got) == {(10, "own"), (11, "fallback"), (12, "advice")}
    assert {r.query_id for r in V.retrieve(asked, chunks).collect()} == {10, 12}


def test_incomplete_guides_named_as_whole_words(spark):
    part = "query_id bigint, origin string, name string, degrees array<string>, chunk_index int, total_chunks int"
    context = spark.createDataFrame(
        [(q, "guia", n, ["A"], 0, 2) for q in range(7) for n in ("Álgebra", "C++ (I)", "\\E.*")] + [(0, "plan", "Física", ["A"], 0, 9), (0, "guia", "Química", ["A"], 0, 2), (0, "guia", "Química", ["A"], 1, 2)], part
    )
    said = ["¿Qué tal es ÁLGEBRA? ¿Y Física, y Química?", "álgebras", "superálgebra", "créditos de Álgebra", "¿Qué es C++ (I)?", "", None]
    asked = spark.createDataFrame(list(enumerate(said)), "query_id bigint, question string")
    assert sorted(map(tuple, V.incomplete_guides(asked, context).collect())) == [(0, "Álgebra"), (4, "C++ (I)")]


def test_prompts(spark):
    asked = spark.createDataFrame(
        [(0, "q", None, None, None), (1, "q", ["G"], ["G"], list("abcde")), (2, None, [], ["G", "H"], ["a"])],
        "query_id bigint, question string, catalogue array<string>, scope array<string>, earlier array<string>",
    )
    context = spark.createDataFrame([(1, 2, "n2", ["G", "H"], "t2"), (1, 1, "n1", ["G"], "t1")], "query_id bigint, place int, name string, degrees array<string>, text string")
    got = dict(map(tuple, V.prompts(asked, context, "I").collect()))
    assert got[0] == "I\n\nCONTEXTO:\n(no se ha recuperado ningún fragmento)\n\nPREGUNTA: q\n\nRESPUESTA:"
    assert "PREGUNTAS ANTERIORES DEL ESTUDIANTE:\n- c\n- d\n- e\n\nCONTEXTO:\nn1 — G\nt1\n\nn2 — G, H\nt2\n\nPREGUNTA" in got[1]
    assert "ÁMBITO: la consulta es sobre el G.\n\n" in got[1] and "abarca estas titulaciones:\n- G\n- H\n\n" in got[2] and "TITULACIONES" not in got[2]
