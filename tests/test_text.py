"""Acceptance cases of the text functions."""

import time

import pytest
from pyspark.sql import functions as F

from talus.functions import plain as P
from talus.functions import text as T


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, *values):
        df = spark.createDataFrame([(v,) for v in values], "x string")
        return [r[0] for r in df.select(function(F.col("x"))).collect()]

    return run


CASES = [
    (T.normalize, "  Grado   en\nMecánica ", "grado en mecanica"),
    (T.normalize, "Ingeniería — 60 €", "ingenieria — 60 €"),
    (T.normalize_label, "Ingeniería — 60 €", "ingenieria 60"),
    (T.clean, "a b​c", "a bc"),
    (T.clean, None, ""),
    (T.repair_url, "http://u/a.html#x.html", "http://u/a.html"),
    (T.repair_url, "http://u/a", "http://u/a"),
    (T.repair_url, "", ""),
    (T.repair_url, None, None),
    (T.strip_footnote, "Física **", "Física"),
    (T.strip_footnote, None, None),
    (lambda c: T.split_offer(c)["name"], "Química (plan antiguo)", "Química (plan antiguo)"),
    (lambda c: T.split_offer(c)["offered"], "Química (No ofertada en 2024)", False),
    (lambda c: T.split_offer(c)["offered"], "", True),
    (lambda c: T.split_offer(c)["name"], None, None),
    (T.normalize_type, " OBL ", "OB"),
    (T.normalize_type, "TFG", "TFG"),
    (T.normalize_type, None, ""),
    (T.is_placeholder, "Optativa 12", True),
    (T.is_placeholder, "Optativas", False),
    (T.year_of_url, "http://u/2024-25/g.pdf", "2024-25"),
    (T.year_of_url, "http://u/", None),
    (T.core, "TFG (Ing. Civil) Ing. Mecánica", "tfg ingenieria mecanica"),
    (T.asks_advice, "No sé qué estudiar", True),
    (T.asks_advice, "¿Qué asignaturas tiene Ingeniería Informática?", False),
    (T.asks_advice, "Traduce «me gusta elegir»", False),
    (T.courtesy, "¡Hola!", "greeting"),
    (T.courtesy, "¿Y tú qué tal?", "greeting"),
    (T.courtesy, "muchas gracias", "farewell"),
    (T.courtesy, "vale", None),
    (T.closes, "gracias, ¿y qué asignaturas tiene?", False),
    (T.other_centre, "la Universidad de Granada", True),
    (T.other_centre, "la Universidad de Jaén", False),
    (T.narrows, "¿Cuáles de esas son optativas?", True),
    (T.close_sentence, "Uno. Dos", "Uno."),
    (T.close_sentence, "sin final", "sin final"),
    (T.as_written, "CÁLCULO NUMÉRICO (GIE)", "Cálculo numérico (GIE)"),
    (T.as_written, "Cálculo", "Cálculo"),
    (T.redact_personal, "a.b@c.es y 953123456.", " y ."),
    (T.safe_name, "¿?", "sin_codigo"),
    (T.list_prefix, "**Grado en:**", "Grado en"),
    (T.list_prefix, "Primer curso:", ""),
    (T.year_order, "Tercer o cuarto curso", 2),
    (T.year_order, " ", 99),
    (T.year_order, "Libre", 98),
    (T.highest_year, "Tercer o cuarto curso", 4),
    (T.core, "marketing. digital", "marketing. digital"),
    (T.year_of_listing, "Asignaturas de primer curso", 1),
    (T.year_of_listing, "Asignaturas optativas", 7),
    (T.courtesy_without_context, "si claro", "greeting"),
    (T.courtesy_without_context, "hola q tal tio", "greeting"),
    (T.courtesy_without_context, "resúmeme la guerra", None),
    (T.courtesy_without_context, "gracias dime algo", "farewell"),
    (T.courtesy_without_context, "¿y ahora?", None),
    (T.other_centre, "campus de las Lagunillas", False),
    (T.other_centre, "Universidad Politécnica de Valencia", True),
    (T.other_centre, "la Escuela Politécnica Superior de Linares", True),
    (T.other_centre, "la Escuela Politécnica Superior de Jaén", False),
    (T.other_centre, "Universitat de Girona", True),
    (T.close_sentence, "Uno. \n Dos", "Uno."),
    (T.admissible_years, "Tercer o cuarto curso", ["tercer", "cuarto"]),
    (T.admissible_years, " Cuarto  o  tercer curso ", ["cuarto", "tercer"]),
    (T.as_written, "A" * 1500, "A" + "a" * 1499),
    (T.as_written, "(GIE) CÁLCULO", "(GIE) cálculo"),
    (T.looks_binary, "a\x0b\x0cb", True),
    (T.looks_binary, "a\n\r\tb", False),
    (T.redact_personal, "612345678 698765432", " "),
    (T.redact_personal, "á.ñ@c.es,x612345678 é612345678", ",x612345678 é612345678"),
    (T.credits, "4,5", " (4,5 ECTS)"),
    (T.credits, None, " (créditos no publicados)"),
]


def test_headers(spark):
    schema = "name string, kind string, ects string, degrees array<string>, mentions array<string>, term string, year string, offered boolean"
    rows = [
        ("Física", "FB", "6", ["Grado A"], ["M1", "M2"], "Primer cuatrimestre", "Primer curso", True),
        ("Física", "OB", "", ["Grado A", "Grado B"], ["M1"], "Segundo cuatrimestre", "", False),
        ("Física", "XX", None, ["Grado A"], [], "", " Tercer curso ", None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = df.select(T.subject_header(*map(F.col, schema.replace(",", "").split()[::2])).alias("h"), T.plain_header(F.col("name"), F.col("degrees")).alias("p")).collect()
    assert [r.h for r in got] == [
        "«Física», asignatura de formación básica de 6 ECTS del Grado A (mención: M1, M2). Se imparte en el primer cuatrimestre de primer curso.",
        "«Física», asignatura obligatoria impartida en 2 titulaciones: Grado A; Grado B. Se imparte en el segundo cuatrimestre, sin curso asignado en el plan. "
        "No ofertada en el curso rastreado. La web de la EPSJ no publica sus créditos.",
        "«Física», asignatura (XX) del Grado A. Se imparte en el tercer curso. La web de la EPSJ no publica sus créditos.",
    ]
    assert [r.p for r in got[:2]] == ["«Física», asignatura del Grado A.", "«Física», asignatura impartida en: Grado A; Grado B."]


@pytest.mark.parametrize("text", ["campus de las Lagunillas", "Universidad Politécnica de Valencia", "hola", "si claro", "Universidad de Jaén"])
def test_fixed_reply_twin_agrees(apply, text):
    assert P.fixed_reply(text) == (apply(T.fixed_reply, text)[0] is not None)


@pytest.mark.parametrize("function,value,want", CASES)
def test_text(apply, function, value, want):
    assert apply(function, value) == [want]


def test_tokens_and_units(apply):
    assert [sorted(x) for x in apply(T.tokens, "¿Informática?, ¡sí!", "hola — ...", "")] == [["informatica", "si"], ["hola"], []]
    assert apply(T.units, "Uno. Dos!tres\nfin") == [["Uno.", " Dos!", "tres\n", "fin"]]
    assert apply(T.units, "a.. b", "", "x", "é\U0001F600!?", None) == [["a.", ".", " b"], [], ["x"], ["é\U0001F600!", "?"], None]
    assert apply(T.split_mentions, "A / B/ A /") == [["A", "B"]]


def test_units_of_a_long_rest(apply):
    """A text without a boundary is looked at once, not once from each of its characters."""
    text, began = "x " * 150_000, time.monotonic()
    assert apply(T.units, "a." + text) == [["a.", text]] and time.monotonic() - began < 10


@pytest.mark.parametrize("text", ["¿Informática?, ¡sí!", "Ácido  ñandú — 6", "", "a-b c_d"])
def test_plain_functions_agree(apply, text):
    assert apply(T.normalize, text) == [P.normalize(text)]
    assert set(apply(T.tokens, text)[0]) == P.tokens(text)
