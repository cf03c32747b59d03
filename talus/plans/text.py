"""Queries on the text functions: each over a whole table, with the same expression for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus.functions import fixed as X
from talus.functions import text as T
from talus.session import table

C = F.col
#: Array results are compared as sorted text.
joined = lambda a: F.array_join(F.array_sort(a), "|")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_quote, values)) + "]"


def case_of(value: str, mapping: dict[str, object], default: str) -> str:
    return "case " + " ".join(f"when {value} = {_quote(k)} then {_quote(v)}" for k, v in mapping.items()) + f" else {default} end"


WS = "[ \\t\\n\\x0B\\f\\r]+"
SQUEEZE = f"trim(regexp_replace({{0}}, '{WS}', ' ', 'g'))"
MARKS = f"translate(lower({{0}}), '{X.ACCENTED}', '{X.PLAIN}')"
NORMAL = SQUEEZE.format(MARKS)
LABEL = SQUEEZE.format(f"regexp_replace({MARKS}, '[^\\x00-\\x7F]', '', 'g')")
TOKENS = "list_distinct(list_filter(list_transform(string_split(" + NORMAL + ", ' '), lambda w: regexp_replace(w, '[^a-z0-9ß]', '', 'g')), lambda w: w <> ''))"
SORTED = "array_to_string(list_sort({0}), '|')"


def sql_tokens(e: str) -> str:
    return TOKENS.format(e)


def sql_subset(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda z: not list_contains({b}, z))) = 0"


_SAID = sql_tokens("text")
_CLOSES = f"(list_has_any({_SAID}, {_list(X.FAREWELL)}) and not contains(text, '?') and not list_has_any({_SAID}, {_list(X.INTERROGATIVES)}))"
_PAIRS = " or ".join(f"list_has_all({_SAID}, {_list(p)})" for p in X.GREETING_PAIRS)
_COURTESY = (
    f"case when len({_SAID}) > 0 and {sql_subset(_SAID, _list(X.COURTESY))} then case when list_has_any({_SAID}, {_list(X.FAREWELL)}) then 'farewell' "
    f"when list_has_any({_SAID}, {_list(X.GREETING)}) or {_PAIRS} then 'greeting' end end"
)
_LADDER = (
    f"case when list_has_any({_SAID}, {_list(X.FAREWELL)}) and not contains(text, '?') then 'farewell' when list_has_any({_SAID}, {_list(X.GREETING)}) then 'greeting' "
    f"when contains(text, '?') or list_has_any({_SAID}, {_list(X.INTERROGATIVES)}) then null when len({_SAID}) <= 2 then 'greeting' end"
)
_PLACES = f"regexp_extract_all({NORMAL.format('text')}, '{X.CENTRE}', 1)"
_OTHER = f"len(list_filter({_PLACES}, lambda p: not list_contains({_list(X.OWN_PLACES)}, p))) > 0"
_BARE = f"regexp_replace(text, {_quote(X.QUOTED)}, ' ', 'g')"
_ADVICE = f"(list_has_any({sql_tokens(_BARE)}, {_list(X.ADVICE)}) or len(list_filter({_list(X.ADVICE_PHRASES)}, lambda p: contains({NORMAL.format(_BARE)}, p))) > 0)"

#: Sentences that the courtesy, advice and scope functions tell apart, joined to what users say in ``conversations``.
SAMPLES = [
    "¡Hola!", "Hola, ¿qué tal?", "Muchas gracias", "gracias, ¿y qué asignaturas tiene?", "me gusta la idea, muchas gracias", "Buenos días", "¿Cómo va?",
    "vale", "buen día", "No sé qué estudiar", "¿Qué asignaturas tiene Ingeniería Informática?", 'Traduce "qué carrera me recomiendas"', "Me gustan las matemáticas",
    "¿Y la Universidad de Granada?", "Háblame de la Universidad de Jaén", "la facultad de derecho", "¿Cuáles de esas son optativas?", "¿Y en segundo?", "",
    "hasta luego", "hey", "q tal", "Explícame los créditos de Física", "si claro", "hola q tal tio", "campus de las Lagunillas", "Universidad Politécnica de Valencia",
    "la Escuela Politécnica Superior de Linares", "Universitat de Girona", "resúmeme la guerra", "gracias dime algo",
]
_SAMPLE_SQL = f"(select conv_id, turn, text from conversations union all select -1 - i as conv_id, 0 as turn, s as text from (select unnest({_list(SAMPLES)}) as s, unnest(range({len(SAMPLES)})) as i))"


def messages(spark, sf_dir):
    """What ``conversations`` holds and the samples."""
    own = spark.createDataFrame([(-1 - i, 0, s) for i, s in enumerate(SAMPLES)], "conv_id bigint, turn bigint, text string")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").union(own)


#: Subject names, types and labels made from ``part`` by rule, so that every branch is met.
_NAME = "case when p_size % 7 = 0 then p_name || ' (no ofertada en 2024)' when p_size % 7 = 1 then p_name || ' **' when p_size % 7 = 2 then 'Optativa ' || cast(p_size as varchar) when p_size % 7 = 3 then upper(p_name) || ' (GIE)' when p_size % 7 = 4 then 'Grado en Ing. ' || p_name when p_size % 7 = 5 then '' else p_name end"
_KIND = "case when p_size % 5 = 0 then 'Formación básica' when p_size % 5 = 1 then 'obl' when p_size % 5 = 2 then ' Optativa ' when p_size % 5 = 3 then 'tfg' else p_type end"
_YEAR = "case when p_size % 8 = 7 then '' when p_size % 8 = 6 then 'Tercer o cuarto curso' when p_size % 8 = 5 then 'Libre' when p_size % 8 = 4 then 'Quinto curso' when p_size % 8 = 3 then 'Cuarto curso' when p_size % 8 = 2 then 'Segundo curso' when p_size % 8 = 1 then 'Primer curso' end"
_TERM = "case when p_size % 3 = 0 then '' when p_size % 3 = 1 then 'Primer cuatrimestre' else 'Segundo cuatrimestre' end"
_ECTS = "case when p_size % 4 = 0 then '' when p_size % 4 = 1 then '4,5' else '6' end"
SUBJECTS_SQL = f"(select *, {_NAME} as name, {_KIND} as kind, {_YEAR} as year, {_TERM} as term, {_ECTS} as ects from part)"


def subjects(spark, sf_dir):
    """``part`` as a table of subjects."""
    fit = lambda e: F.expr(e.replace("varchar", "string"))
    return table(spark, sf_dir, "part").select("*", fit(_NAME).alias("name"), fit(_KIND).alias("kind"), fit(_YEAR).alias("year"), fit(_TERM).alias("term"), fit(_ECTS).alias("ects"))


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


QUERIES, ORACLES = {}, {}


def add(name: str, source, keys: list[str], columns: dict[str, tuple[Callable[[], Column], str]], from_: str) -> None:
    """Register one projection and its SQL."""

    def query(spark, sf_dir):
        return source(spark, sf_dir).select(*keys, *[make().alias(a) for a, (make, _) in columns.items()])

    QUERIES[name] = query
    ORACLES[name] = "select " + ", ".join([*keys, *[f"{sql} as {a}" for a, (_, sql) in columns.items()]]) + f" from {from_}"


D, M, S, P = (documents, ["doc_id"], "documents"), (messages, ["conv_id", "turn"], _SAMPLE_SQL), (subjects, ["p_partkey"], SUBJECTS_SQL), (pages, ["page_id"], "pages")


def on(where, name, columns):
    add(name, where[0], where[1], columns, where[2])


_UNITS = "list_concat(regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]'), list_filter([regexp_extract(text, '[^.!?\\n]+$')], lambda r: r <> ''))"
_MENTION_CELL = "p_name || ' / ' || p_brand || '/ ' || p_name || ' /'"
_ORDER_SQL = "case when trim(coalesce(year, '')) = '' then 99 " + " ".join(f"when starts_with(lower(trim(year)), '{o}') then {i}" for i, o in enumerate(X.YEAR_ORDER)) + " else 98 end"
_DEGREES = "case when p_size % 2 = 0 then [p_brand] else [p_brand, p_type] end"
#: The sentences as a reader of the rule would write them, case by case.
_PLACE_SQL = (
    "case when coalesce(year, '') <> '' and term <> '' then 'el ' || lower(term) || ' de ' || lower(year) when coalesce(year, '') <> '' then 'el ' || lower(year) "
    "when term <> '' then 'el ' || lower(term) || ', sin curso asignado en el plan' else '' end"
)
_CREDITS_SQL = "case when ects = '' then ' (créditos no publicados)' else ' (' || ects || ' ECTS)' end"
_WHERE_SQL = f"case when len({_DEGREES}) = 1 then ' del ' || p_brand || ' (mención: ' || p_type || ')' else ' impartida en 2 titulaciones: ' || p_brand || '; ' || p_type end"
_LABEL_SQL = case_of("upper(trim(kind))", X.TYPE_LABELS, "'asignatura (' || upper(trim(kind)) || ')'")
_HEAD_SQL = (
    f"'«' || name || '», ' || {_LABEL_SQL} || case when ects = '' then '' else ' de ' || ects || ' ECTS' end || {_WHERE_SQL} "
    f"|| case when {_PLACE_SQL} = '' then '' else '. Se imparte en ' || {_PLACE_SQL} end || case when p_size % 7 = 0 then '. No ofertada en el curso rastreado' else '' end "
    "|| case when ects = '' then '. La web de la EPSJ no publica sus créditos' else '' end || '.'"
)
_MAIL = "regexp_replace({0}, '[\\p{{L}}\\p{{Nd}}_.-]+@[\\p{{L}}\\p{{Nd}}_.-]+\\.[\\p{{L}}\\p{{Nd}}_]+', '', 'g')"
_PHONE = "regexp_replace({0}, '(^|[^\\p{{L}}\\p{{Nd}}_])[0-9]{{9}}($|[^\\p{{L}}\\p{{Nd}}_])', '\\1\\2', 'g')"


def redacted_sql(e: str) -> str:
    """A number of nine digits takes its neighbours along, so a second pass meets those that share one."""
    return _PHONE.format(_PHONE.format(_MAIL.format(e)))


def _degrees():
    return F.when(C("p_size") % 2 == 0, F.array("p_brand")).otherwise(F.array("p_brand", "p_type"))


on(D, "b01_normalize", {"normalized": (lambda: F.md5(T.normalize(C("text"))), f"md5({NORMAL.format('text')})")})
on(D, "b02_normalize_label", {"label": (lambda: F.md5(T.normalize_label(C("text"))), f"md5({LABEL.format('text')})")})
on(D, "b03_tokens", {"n_tokens": (lambda: F.size(T.tokens(C("text"))), f"len({sql_tokens('text')})"), "tokens": (lambda: F.md5(joined(T.tokens(C("text")))), f"md5({SORTED.format(sql_tokens('text'))})")})
on(P, "b04_clean", {"cleaned": (lambda: F.md5(T.clean(F.concat(F.lit("  a​b"), C("html")))), "md5(" + SQUEEZE.format("replace(replace('  a​b' || html, ' ', ' '), '​', '')") + ")")})
on(P, "b05_repair_url", {"url": (lambda: T.repair_url(F.concat(C("url"), F.lit("/guia.html"), C("url"))), "regexp_extract(url || '/guia.html' || url, '^.*?\\.html')"), "same": (lambda: T.repair_url(C("url")), "case when contains(url, '.html') then regexp_extract(url, '^.*?\\.html') else url end")})
on(S, "b06_strip_footnote", {"name": (lambda: T.strip_footnote(C("name")), "trim(regexp_replace(name, '[ \\t]*\\*+[ \\t]*$', ''))")})
on(S, "b07_split_offer", {"name": (lambda: T.split_offer(C("name"))["name"], "case when p_size % 7 = 0 then p_name else name end"), "offered": (lambda: T.split_offer(C("name"))["offered"], "p_size % 7 <> 0")})
on(S, "b08_normalize_type", {"kind": (lambda: T.normalize_type(C("kind")), case_of("lower(trim(kind))", X.TYPE_SYNONYMS, "trim(kind)"))})
on(S, "b09_placeholder", {"placeholder": (lambda: T.is_placeholder(C("name")), "regexp_matches(trim(name), '(?i)^optativa[ \\t]+[0-9]+$')")})
on(S, "b10_valid_subject", {"valid": (lambda: T.is_valid_subject(C("name"), T.normalize_type(C("kind"))), f"name <> '' and not regexp_matches(trim(name), '(?i)^optativa[ \\t]+[0-9]+$') and upper({case_of('lower(trim(kind))', X.TYPE_SYNONYMS, 'trim(kind)')}) in {tuple(X.VALID_TYPES)}")})
on(P, "b11_year_of_url", {"none": (lambda: T.year_of_url(C("url")), "nullif(regexp_extract(url, '/([0-9]{4}-[0-9]{2})/', 1), '')"), "year": (lambda: T.year_of_url(F.concat(C("url"), F.lit("/2024-25/guia"))), "regexp_extract(url || '/2024-25/guia', '/([0-9]{4}-[0-9]{2})/', 1)")})
on(S, "b12_split_mentions", {"mentions": (lambda: F.array_join(T.split_mentions(F.expr(_MENTION_CELL)), "|"), "p_name || '|' || p_brand")})
on(S, "b13_core_name", {"core": (lambda: T.core(C("name")), "array_to_string(list_transform(string_split(" + NORMAL.format("regexp_replace(name, '[ \\t]*\\([^)]*\\)', ' ', 'g')") + ", ' '), lambda w: case when w = 'ing.' then 'ingenieria' else w end), ' ')")})
on(S, "b14_without_study_type", {"name": (lambda: T.without_study_type(T.normalize(C("name"))), f"regexp_replace({NORMAL.format('name')}, '^(doble +)?grado +en +', '')")})
on(S, "b15_credits_placement", {"credits": (lambda: T.credits(C("ects")), _CREDITS_SQL), "placement": (lambda: T.placement(C("term"), C("year")), _PLACE_SQL)})
on(S, "b16_subject_header", {"header": (lambda: T.subject_header(C("name"), F.upper(F.btrim("kind")), C("ects"), _degrees(), F.array("p_type"), C("term"), C("year"), C("p_size") % 7 != 0), _HEAD_SQL)})
on(S, "b17_plain_header", {"header": (lambda: T.plain_header(C("name"), _degrees()), f"'«' || name || '», asignatura ' || case when len({_DEGREES}) = 1 then 'del ' || p_brand else 'impartida en: ' || p_brand || '; ' || p_type end || '.'")})
on(S, "b18_year_order", {"place": (lambda: T.year_order(C("year")), _ORDER_SQL)})
on(S, "b19_duration", {"highest": (lambda: T.highest_year(C("year")), "greatest(" + ", ".join(f"case when contains(lower(coalesce(year, '')), '{o}') then {i + 1} else 0 end" for i, o in enumerate(X.YEAR_ORDER)) + ")")})
on(S, "b20_year_of_listing", {"place": (lambda: T.year_of_listing(F.concat(F.lit("Asignaturas de "), F.coalesce("year", F.lit("")))), "case " + " ".join(f"when contains(lower('Asignaturas de ' || coalesce(year, '')), 'de {o}') then {i + 1}" for i, o in enumerate(X.YEAR_ORDER)) + " else 7 end")})
on(D, "b22_prefix", {"passage": (lambda: F.md5(F.concat(F.lit(X.PASSAGE_PREFIX), C("text"))), "md5('passage: ' || text)"), "query": (lambda: F.md5(F.concat(F.lit(X.QUERY_PREFIX), C("text"))), "md5('query: ' || text)")})
on(M, "b23_expand", {"expanded": (lambda: F.md5(T.expand(C("text"))), f"md5(text || ' ' || {_quote(X.DOMAIN_SENTENCE)})")})
on(M, "b24_asks_advice", {"advice": (lambda: T.asks_advice(C("text")), _ADVICE)})
on(M, "b25_courtesy", {"courtesy": (lambda: T.courtesy(C("text")), _COURTESY)})
on(M, "b26_closes", {"closes": (lambda: T.closes(C("text")), _CLOSES)})
on(M, "b27_courtesy_without_context", {"courtesy": (lambda: T.courtesy_without_context(C("text")), _LADDER)})
on(M, "b28_other_centre", {"other": (lambda: T.other_centre(C("text")), _OTHER)})
on(M, "b29_fixed_reply", {"reply": (lambda: T.fixed_reply(C("text")), f"coalesce({_COURTESY}, case when {_CLOSES} then 'farewell' end, case when {_OTHER} then 'other_centre' end)")})
on(M, "b30_narrows", {"narrows": (lambda: T.narrows(C("text")), f"len(list_filter({_list(X.ANAPHORA)}, lambda p: contains({NORMAL.format('text')}, p))) > 0")})
on(M, "b31_content", {"content": (lambda: joined(T.content(C("text"))), SORTED.format(f"list_filter({_SAID}, lambda z: not list_contains({_list(X.STOPWORDS + X.ORDINALS)}, z))"))})
on(D, "b32_close_sentence", {"cut": (lambda: F.md5(T.close_sentence(F.concat(C("text"), F.lit(". \n and more")))), "md5(rtrim(text || '. ' || chr(10), ' ' || chr(10)))")})
on(D, "b33_units", {"n_units": (lambda: F.size(T.units(C("text"))), f"len({_UNITS})"), "units": (lambda: F.md5(F.array_join(T.units(C("text")), "|")), f"md5(array_to_string({_UNITS}, '|'))")})
on(S, "b34_admissible_years", {"years": (lambda: F.array_join(T.admissible_years(C("year")), "|"), "case when p_size % 8 = 7 then '' when p_size % 8 = 6 then 'tercer|cuarto' when p_size % 8 = 5 then 'libre' when year is not null then lower(replace(year, ' curso', '')) end")})
on(S, "b35_as_written", {"name": (lambda: T.as_written(C("name")), "case when p_size % 7 = 3 then upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) || ' (GIE)' else name end")})
on(D, "b36_looks_binary", {"binary": (lambda: T.looks_binary(C("text")), "contains(text, '%PDF') or length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) > 0.02 * length(text)"), "sniffed": (lambda: T.looks_binary(F.concat(F.lit("%PDF-1.4"), C("text"))), "true")})
on(D, "b37_position_of_id", {"chunk_id": (lambda: F.format_string("chunk-%04d", C("doc_id")), "printf('chunk-%04d', doc_id)"), "position": (lambda: T.position_of_id(F.format_string("chunk-%04d", C("doc_id"))), "cast(doc_id as integer)")})
on(S, "b38_labels", {"label": (lambda: T.label(C("p_name"), _degrees()), f"p_name || ' — ' || array_to_string({_DEGREES}, ' · ')"), "source": (lambda: T.source_label(F.when(C("p_size") % 3 == 0, F.lit("guia")).when(C("p_size") % 3 == 1, F.lit("salidas")).otherwise(C("p_type"))), "case when p_size % 3 = 0 then 'Guía docente' when p_size % 3 = 1 then 'Salidas profesionales' else p_type end")})
on(S, "b39_list_ornaments", {
    "prefix": (lambda: T.list_prefix(F.expr("case when p_size % 2 = 0 then '**Grado en:**' else p_name end")), "case when p_size % 2 = 0 then 'Grado en' else '' end"),
    "from_capital": (lambda: T.from_capital(F.expr("'la asignatura ' || upper(substr(p_name, 1, 1)) || substr(p_name, 2)")), "regexp_extract('la asignatura ' || upper(substr(p_name, 1, 1)) || substr(p_name, 2), '(?:^| )([A-ZÁÉÍÓÚÑ].*)$', 1)"),
    "bare": (lambda: T.unadorned(F.expr("'** `' || p_name || '` **'")), "p_name"),
})
_CALLS = "' 612345678 698765432,600000001 x612345670 é612345671 á.b@c.es 6123456789'"
on(D, "a14_redact_personal", {
    "redacted": (lambda: F.md5(T.redact_personal(C("text"))), f"md5({redacted_sql('text')})"),
    "called": (lambda: F.md5(T.redact_personal(F.concat("text", F.expr(_CALLS)))), f"md5({redacted_sql('text')} || '  , x612345670 é612345671  6123456789')"),
})
on(P, "a18_safe_name", {"name": (lambda: T.safe_name(C("url")), "coalesce(nullif(regexp_replace(url, '[^A-Za-z0-9_-]', '', 'g'), ''), 'sin_codigo')"), "none": (lambda: T.safe_name(F.lit("¿?")), "'sin_codigo'")})

