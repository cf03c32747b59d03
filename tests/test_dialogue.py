"""Dialogue state, decisions, verification."""

import pytest

from talus.operators import dialogue as D
from talus.operators import verify as V

NAMES = ["Grado en Ingeniería Informática", "Grado en Ingeniería Mecánica", "Doble Grado en Ingeniería Eléctrica y Mecánica", "Grado en Geomática", "Grado en Ingeniería Civil"]
CAT = D.Catalogue(NAMES)


def talk(*turns, decide=None):
    state, queries = D.State(), []
    for t in turns:
        q, a = t if isinstance(t, tuple) else (t, "")
        state, query = D.step(state, q, a, CAT, decide)
        queries.append(query)
    return state, queries


def test_mentions():
    assert CAT.mentioned("¿y en informática?") == NAMES[:1]
    assert CAT.mentioned("¿y en mecánica?") == NAMES[1:3]
    assert CAT.mentioned("hola") == []


def test_named_in_full():
    short, double = "Grado en A", "Doble Grado en A y B"
    assert D.P.named_in_full("El Doble Grado en A y B.", [short, double]) == [double]
    assert D.P.named_in_full("El Doble Grado en A y B, y el Grado en A.", [short, double]) == [short, double]


def test_scope_is_inherited_and_predicate_follows():
    state, (first, second) = talk("¿Qué asignaturas de primero tiene Informática?", "¿Y en segundo?")
    assert first.scope == second.scope == NAMES[:1]
    assert "asignaturas" in second.text and "primero" not in second.text and second.text.endswith("¿Y en segundo?")
    assert state.scope == NAMES[:1]


def test_two_full_names_override_the_decision():
    decide = lambda q, s, l: (D.CHANGE, [NAMES[3]])
    _, (q,) = talk(f"Compara {NAMES[0]} y {NAMES[3]}", decide=decide)
    assert q.scope == [NAMES[0], NAMES[3]]


def test_decisions():
    assert D.parse_decision("\n  SIGUE, claro\nx", NAMES) == (D.FOLLOW, [])
    assert D.parse_decision("**Todas**", NAMES) == (D.ALL, [])
    assert D.parse_decision("", NAMES) == (D.NONE, [])
    assert D.parse_decision("grado en geomática; ingeniería eléctrica y mecánica", NAMES) == (D.CHANGE, NAMES[2:4])
    assert D.parse_decision("corto", NAMES) == (D.NONE, [])
    calls = []

    def fails(request):
        calls.append(request)
        raise OSError

    assert D.ask(fails, NAMES)("q", [], None) is None and len(calls) == 2


def test_plural_demonstratives_are_not_open():
    decide = lambda q, s, l: (D.ALL, [])
    _, (a, b) = talk("¿Qué grados hay?", "¿Y cómo se evalúan estas asignaturas?", decide=decide)
    assert a.open and not b.open


def test_only_the_last_questions_are_kept():
    state, _ = talk(*[(f"pregunta {i} sobre becas", "respuesta secreta") for i in range(5)])
    assert state.questions == [f"pregunta {i} sobre becas" for i in (2, 3, 4)]
    same, _ = D.step(state, "muchas gracias", "de nada", CAT)
    assert same == state


def fed(spark, tmp_path, name, schema, made, batches):
    """The rows that a stream's query gives when its input comes in these batches, the query being stopped and started again after each."""
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out-{name}/batch={number}")

    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
        query = made(stream).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/c-{name}").outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(90)
    return sorted(map(str, spark.read.parquet(f"{tmp_path}/out-{name}").drop("batch").collect()))


TURNS = "conv_id bigint, turn bigint, question string, answer string, ts timestamp, reset boolean"


@pytest.mark.parametrize("cut", [1])
def test_conversations_of_a_stream_equal_the_batch_in_any_cut(spark, tmp_path, cut):
    """Turns out of order within the allowed delay, resets, a turn that comes too late."""
    import datetime as dt
    import random

    from talus.session import table
    from talus.streaming.dialogue import prepare_stream

    r = random.Random(cut)
    names = ["Grado en Eauou", "Grado en That", "Grado en Der"]
    turns = D.turns_of(table(spark, "/root/testdata/sf0.001", "conversations")).where("conv_id < 12").orderBy("turn", "conv_id").collect()
    start = dt.datetime(2024, 1, 1)
    rows = [(t.conv_id, t.turn, t.question, t.answer, start + dt.timedelta(seconds=10 * t.turn + t.conv_id), t.turn == 4 and t.conv_id % 3 == 0) for t in turns]
    want = sorted(map(str, D.prepare(spark.createDataFrame(rows, TURNS), names).collect()))
    rows = [x for i in range(0, len(rows), 8) for x in r.sample(rows[i : i + 8], len(rows[i : i + 8]))]
    ends = sorted(r.sample(range(1, len(rows)), cut * 2))
    batches = [rows[a:b] for a, b in zip([0, *ends], [*ends, len(rows)])]
    end = (99, 0, "fin", "", start + dt.timedelta(days=3), False)
    late = (rows[0][0], 1000, "late", "", start, False)
    got = fed(spark, tmp_path, f"turns{cut}", TURNS, lambda s: prepare_stream(s, names), [*batches, [end], [late], [(98, 0, "x", "", start + dt.timedelta(days=6), False)]])
    assert [x for x in got if "conv_id=99" not in x and "conv_id=98" not in x] == want and len(want) > 20


def test_idle_conversations_are_forgotten(spark, tmp_path):
    import datetime as dt

    from talus.streaming.dialogue import prepare_stream

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, 0, "Grado en Minas: optativas", "a", at(0), None), (1, 1, "¿y los profesores?", "b", at(50), None), (1, 2, "¿y las becas?", "c", at(1000), None)]
    got = fed(spark, tmp_path, "idle", TURNS, lambda s: prepare_stream(s, ["Grado en Minas", "Grado en Sol", "Grado en Mar"], idle_ms=100_000), [[x] for x in rows] + [[(2, 0, "z", "", at(99_999), None)], [(3, 0, "z", "", at(199_999), None)]])
    of = [x for x in got if "conv_id=1," in x]
    assert "remembered=[]" in of[0] and "remembered=['Grado en Minas: optativas']" in of[1] and "scope=['Grado en Minas']" in of[1]
    assert "remembered=[]" in of[2] and "scope=[]" in of[2]


@pytest.mark.parametrize("seed", [1])
def test_verified_answers_of_a_stream_equal_the_batch(spark, tmp_path, seed):
    """Parts in any order, cut into batches in any way, some twice and some after the end."""
    import datetime as dt
    import random

    from talus.streaming.dialogue import verify_stream

    r = random.Random(seed)
    texts = ["«Física» se da en tercer curso. Tiene 9 ECTS.\nMira el Grado en Jaén. Y más", "Mira el Grado en Magia Negra. Y luego otra cosa.", "", "sin final", "Uno! Dos? El Grado en Magia"]
    schema = "key bigint, seq int, text string, last boolean, ts timestamp"
    rows = []
    for k, text in enumerate(texts):
        ends = sorted(r.sample(range(len(text) + 1), min(len(text), r.randint(1, 9))))
        parts = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]
        rows += [(k, i, p or None, i == len(parts) - 1, dt.datetime(2024, 1, 1, 0, 0, i)) for i, p in enumerate(parts)]
    want = sorted(map(str, V.verify_streams(spark.createDataFrame(rows, schema), "key", "seq", "text", FACTS, ["Grado en Jaén"], "no").collect()))
    sent = r.sample(rows, len(rows)) + r.sample(rows, 5)
    ends = sorted(r.sample(range(1, len(sent)), 2))
    got = fed(spark, tmp_path, f"answers{seed}", schema, lambda s: verify_stream(s, FACTS, ["Grado en Jaén"], "no"), [sent[a:b] for a, b in zip([0, *ends], [*ends, len(sent)])])
    assert got == want and any("retract" in x for x in got)


def test_an_answer_that_stops_is_said_after_a_while(spark, tmp_path):
    import datetime as dt

    from talus.streaming.dialogue import verify_stream

    schema = "key bigint, seq int, text string, last boolean, ts timestamp"
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    batches = [[(1, 0, "One. Two", False, at(0)), (1, 2, "lost.", False, at(1))], [(2, 0, "b.", True, at(5000))], [(1, 1, " more.", True, at(4900)), (2, 1, "again", True, at(5001))]]
    got = fed(spark, tmp_path, "stopped", schema, lambda s: verify_stream(s, {}, [], "no"), batches)
    assert [x for x in got if "key=1," in x] == ["Row(key=1, seq=0, kind='part', text='One.')", "Row(key=1, seq=1, kind='part', text=' Two')"]
    assert [x for x in got if "key=2," in x] == ["Row(key=2, seq=0, kind='part', text='b.')"]


def test_log_and_windows(spark, tmp_path):
    from talus.session import table
    from talus.streaming.dialogue import append_log, read_log, windowed_counts

    sf = "/root/testdata/sf0.001"
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    turns.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(turns.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run has nothing new
        append_log(stream, f"{tmp_path}/log", f"{tmp_path}/c2").start().awaitTermination(60)
    assert read_log(spark, f"{tmp_path}/log", "conv_id bigint, turn bigint").count() == turns.count()
    # a batch that runs again, as after a failure, replaces its lines
    append_log(stream, f"{tmp_path}/log", f"{tmp_path}/c3").start().awaitTermination(60)
    assert read_log(spark, f"{tmp_path}/log", "conv_id bigint, turn bigint").count() == turns.count()

    def failing(batch, number):
        raise OSError("full")

    bad = stream.writeStream.foreachBatch(failing).option("checkpointLocation", f"{tmp_path}/c4").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="full"):
        bad.awaitTermination(60)
    append_log(stream, f"{tmp_path}/log4", f"{tmp_path}/c4").start().awaitTermination(60)  # what had failed is not lost
    assert read_log(spark, f"{tmp_path}/log4", "conv_id bigint, turn bigint").count() == turns.count()
    table(spark, sf, "events").write.parquet(f"{tmp_path}/events")
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{tmp_path}/events")
    w = windowed_counts(events).writeStream.format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/c5").outputMode("update").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert spark.table("windows").agg({"n": "sum"}).first()[0] == table(spark, sf, "events").count()


def test_late_events_are_left_out_of_windows(spark, tmp_path):
    import datetime as dt

    from talus.streaming.dialogue import windowed_counts

    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    schema = "event_id bigint, ts timestamp_ntz, event_type string, value double"
    got = fed(spark, tmp_path, "late", schema, windowed_counts, [[(1, at(1, 5), "a", 1.0)], [(2, at(2, 3), "a", 1.0)], [(3, at(1, 59), "a", 1.0)], [(4, at(9), "a", 1.0)], [(5, at(2, 5), "a", 1.0)], [(6, at(20), "a", 1.0)]])
    # the third comes within ten minutes, the fifth far too late
    assert [x.split("n=")[1] for x in got][:2] == ["2, value=2.0)", "1, value=1.0)"] and len(got) == 3


def test_phrases_across_parts(spark):
    import itertools

    match = V.PhraseMatch(["abab", "ba c", "x"])
    for text in ("aabab", "abba c", "aba", "bbx", "", "ababab"):
        for cut in itertools.product(range(len(text) + 1), repeat=2):
            a, b = sorted(cut)
            node, found = 0, False
            for part in (text[:a], text[a:b], text[b:]):
                if not found:
                    node, found = match.feed(node, part)
            assert found == any(p in text for p in ("abab", "ba c", "x"))
    rows = [(1, 0, "ha"), (1, 1, "in"), (1, 2, "ti y"), (1, 3, "z"), (2, 0, None), (2, 1, "hain"), (2, 2, "tx"), (3, 0, "hainti")]
    got = V.retractions(spark.createDataFrame(rows, "k int, i int, t string"), "k", "i", "t", ["hainti"])
    assert sorted(map(tuple, got.collect())) == [(1, 0, "part"), (1, 1, "part"), (1, 2, "retract"), (2, 0, "part"), (2, 1, "part"), (2, 2, "part"), (3, 0, "retract")]
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


FACTS = {"fisica": {"term": 1, "year": 2, "ects": "6"}, "quimica": {"term": 2, "year": 1, "ects": "4,5"}}


def test_correct_attributes():
    text, warnings = V.correct_attributes("«Física» se imparte en el segundo cuatrimestre de tercer curso y tiene 9 ECTS.\n- Química: 4.5 ECTS, primer curso", FACTS)
    assert text == "«Física» se imparte en el primer cuatrimestre de segundo curso y tiene 6 ECTS.\n- Química: 4.5 ECTS, primer curso"
    assert len(warnings) == 3
    both = "«Física» y «Química» en tercer curso"
    assert V.correct_attributes(both, FACTS) == (both, [])
    assert V.correct_attributes("en 3º curso\nen 3º curso", FACTS, "fisica")[0] == "en segundo curso\nen 3º curso"
    assert V.correct_attributes("x", {}) == ("x", [])


def test_list_elements(spark):
    lines = ["1. **Álgebra** - 6 ECTS", "* Interacción persona-ordenador (OB)", "• Física, optativa", "Primer curso:", "- Segundo:", "texto", "Grado en:", "- Geomática"]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "k int, pos int, line string")
    got = [r.element for r in V.list_elements(df, "k", "pos", "line").orderBy("pos").collect()]
    assert got == ["Álgebra", "Interacción persona-ordenador", "Física", "Grado en Geomática"]


def test_invented(spark):
    cat = spark.createDataFrame([("Grado en Ingeniería Informática",)], "name string")
    named = spark.createDataFrame([(1, "Grado en Ingeniería"), (2, "Grado en Piratería"), (3, "Grado en Informática")], "k int, name string")
    assert [r.name for r in V.invented(named, cat, "k").collect()] == ["Grado en Piratería"]


def test_verified_stream_does_not_depend_on_the_parts():
    import random

    facts = {"algebra": {"year": 2, "ects": "6"}, "fisica": {"year": 1}}
    text = "«Álgebra» es de primer curso. Tiene 9 ECTS.\nSon 9 ECTS. «Física» va en 3º curso! Mira el Grado en Magia Negra. Y más"
    expected = [("part", "«Álgebra» es de segundo curso."), ("part", " Tiene 6 ECTS."), ("part", "\n"), ("part", "Son 9 ECTS."), ("part", " «Física» va en primer curso!")]
    names = V.Catalogue(["Grado en Ingeniería Informática"])
    for seed in range(200):
        r = random.Random(seed)
        cuts = sorted(r.sample(range(len(text) + 1), r.randint(0, 20)))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        assert list(V.verified(parts, facts, names, "no")) == [*expected, ("retract", None), ("fixed", "no")]
        kept = list(V.verified(parts, facts, V.Catalogue([]), "no"))
        assert kept[:5] == expected and kept[5:] == [("part", " Mira el Grado en Magia Negra."), ("part", " Y más")]
    assert list(V.verified([], facts, names, "no")) == list(V.verified(["", ""], facts, names, "no")) == []
    assert names.invented("el Grado en Ingeniería, y el grado en Ingeniería Informática de Jaén") == []


def test_verified_streams_of_nulls(spark):
    rows = [(1, 2, "b."), (1, 1, "a"), (2, 1, None), (None, 1, "x")]
    parts = spark.createDataFrame(rows, "k bigint, i int, t string")
    got = sorted(map(tuple, V.verify_streams(parts, "k", "i", "t", {}, [], "no").collect()), key=str)
    assert got == [(1, 0, "part", "ab."), (None, 0, "part", "x")]


def test_listed_names_and_scores_anew(spark):
    from talus.operators import evaluate as H

    answers = [(1, "Son:\n- **Álgebra** (6 ECTS)\n* Cálculo - 6 ECTS"), (2, "puedes cursar Álgebra (6 ECTS), Cálculo (6 créditos)."), (3, ""), (4, None)]
    rows = spark.createDataFrame(answers, "run bigint, answer string")
    assert sorted(map(tuple, V.listed_names(rows, "run", "answer").collect())) == [(r, n) for r in (1, 2) for n in ("Cálculo", "Álgebra")]
    ledger = spark.createDataFrame([(r, 1, a) for r, a in answers] + [(5, 2, "Tiene 6,0 créditos"), (6, 2, None), (7, 3, "en Cuarto")], "run bigint, id int, answer string")
    bank = spark.createDataFrame(
        [(1, "conjunto", "asignaturas", ["Álgebra", "Física"]), (2, "escalar", "creditos", ["6"]), (3, "escalar", "curso", ["Tercer o cuarto curso"])],
        "id int, kind string, family string, expected array<string>",
    )
    known = spark.createDataFrame([("Álgebra",), ("Física",)], "name string")
    got = {r.run: tuple(r)[1:] for r in H.rescore(ledger, bank, known).collect()}
    assert got[1] == got[2] == (None, 0.5, 0.5, 1, 1)
    assert got[3] == got[4] == (None, None, 0.0, 0, 2)
    assert (got[5][0], got[6][0], got[7][0]) == (True, False, True)


def test_context_attributes(spark):
    """Headers that agree, whose text is written out once in the plan, however often it is asked."""
    from pyspark.sql import functions as F

    from talus.functions import text as T

    units = [
        ("Álgebra", ["A"], "Primer cuatrimestre", "Segundo curso", "6"), ("Álgebra", ["A"], "Primer cuatrimestre", "Segundo curso", "6"), ("ÁLGEBRA", ["A", "B"], "Primer cuatrimestre", "Segundo curso", "6"),
        ("Física", ["A"], "Primer cuatrimestre", None, "6"), ("Física", ["B"], "Segundo cuatrimestre", None, "6"),
        ("Redes", ["A", "B"], "Primer cuatrimestre", None, "6"), ("Lógica", ["A"], None, None, None), ("Lógica", ["B"], None, "Tercer curso", None), ("", ["A"], "Primer cuatrimestre", None, "6"), ("Nada", ["A"], None, None, None),
    ]
    df = spark.createDataFrame(units, "name string, degrees array<string>, term string, year string, ects string")
    head = T.subject_header(F.col("name"), F.lit("OB"), F.col("ects"), F.col("degrees"), F.array(F.lit("M")), F.col("term"), F.col("year"), F.lit(True))
    out = V.context_attributes(df.select(F.concat(head, F.lit("\nSe imparte en el quinto curso")).alias("text")))
    assert sorted(map(tuple, out.collect())) == [("algebra", 1, 2, "6"), ("logica", None, 3, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") < 20 and plan.count("titulaciones: ") < 3


def test_ordinal(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("Primer",), ("3º",), ("sexto",), (None,)], "w string").select(V.ordinal(F.col("w"))).collect()
    assert [r[0] for r in got] == [1, 3, None, None]
