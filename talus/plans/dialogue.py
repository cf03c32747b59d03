"""Queries on dialogue state and verification; degrees are made of market segments, answers of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.functions import fixed as X
from talus.functions import text as T
from talus.operators import catalog as G
from talus.operators import contain as C
from talus.operators import dialogue as D
from talus.operators import verify as V
from talus.plans.text import NORMAL, SUBJECTS_SQL, _HEAD_SQL, _degrees, sql_tokens, subjects
from talus.session import table

NAMES = ["Grado en Automobile", "Grado en Building", "Doble Grado en Building y Machinery", "Grado en Machinery", "Grado en Household", "Doble Grado en Furniture y Household"]
_CAT = "(select unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) as name)"
_SEG = "upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))"
_ANSWER = f"case when c_custkey % 3 = 0 then 'Puedes estudiar el Grado en ' || {_SEG} || ' o el Doble Grado en Building y ' || {_SEG} || '.' when c_custkey % 3 = 1 then 'No hay más que el Grado en ' || {_SEG} || ' de Jaén y el Grado en Piratería.' else 'Pregunta por ' || lower(c_mktsegment) || ' en segundo.' end"
ANSWERS = f"(select c_custkey, {_ANSWER} as text from customer)"


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in NAMES], "name string")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(_ANSWER).alias("text"))


def names_in_text(spark, sf_dir):
    """Degrees that share a distinctive word with a question."""
    c = catalogue(spark)
    q = answers(spark, sf_dir).select(F.col("c_custkey").alias("conv_id"), F.lit(0).alias("turn"), "text")
    return D.mentions(q, c, G.distinctive_words(c)).select(F.col("conv_id").alias("c_custkey"), "name")


def named_by_itself(spark, sf_dir):
    """Occurrences of a name that no longer name explains."""
    return C.named_by_itself(answers(spark, sf_dir), "c_custkey", "text", catalogue(spark))


def degrees_in_answer(spark, sf_dir):
    return named_by_itself(spark, sf_dir).where("by_itself").select("c_custkey", "name")


_OUTPUT = "case when c_custkey % 5 = 0 then '  SIGUE, claro' when c_custkey % 5 = 1 then '**Todas**' when c_custkey % 5 = 2 then 'ninguna' when c_custkey % 5 = 3 then 'Grado en Machinery; furniture y household' else 'quizá' end"


def scope_decision_parse(spark, sf_dir):
    """A decider's first line: keyword, or names between semicolons, exact before partial."""
    said = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_OUTPUT).alias("line"))
    bare = T.normalize(F.btrim("line", F.lit(D.EDGES)))
    kind = F.when(F.startswith(bare, F.lit("sigue")), D.FOLLOW).when(F.startswith(bare, F.lit("todas")), D.ALL).when(F.startswith(bare, F.lit("ninguna")), D.NONE)
    parts = said.withColumn("kind", kind).withColumn("part", F.explode(F.transform(F.split("line", ";"), lambda p: T.normalize(F.btrim(p, F.lit(D.EDGES))))))
    c = F.broadcast(catalogue(spark).select("name", T.normalize(F.col("name")).alias("n")))
    hit = parts.join(c, F.col("kind").isNull() & ((F.col("n") == F.col("part")) | ((F.char_length("part") >= D.SHORTEST_PART) & F.contains("n", F.col("part")))), "left")
    best = hit.withColumn("exact", F.max((F.col("n") == F.col("part")).cast("int")).over(Window.partitionBy("c_custkey", "part")))
    kept = best.withColumn("name", F.when((F.coalesce("exact", F.lit(0)) == 0) | (F.col("n") == F.col("part")), F.col("name")))
    return kept.groupBy("c_custkey").agg(F.max("kind").alias("k"), F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names")).select("c_custkey", F.coalesce("k", F.when(F.col("names") != "", D.CHANGE).otherwise(D.NONE)).alias("kind"), "names")


def prepare_queries(spark, sf_dir):
    """The queries of all conversations, with sequential state by conversation."""
    return D.prepare(D.turns_of(table(spark, sf_dir, "conversations")), NAMES)


def last_three_turns(spark, sf_dir):
    """The questions remembered before each one."""
    u = table(spark, sf_dir, "conversations").where("role = 'user'")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    return u.select("conv_id", "turn", F.size(F.collect_list("text").over(w)).alias("held"), F.md5(F.array_join(F.collect_list("text").over(w), "\n")).alias("remembered"))


def turn_log(spark, sf_dir):
    """Nested log lines as JSON."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(F.to_json(F.struct(F.col("role").alias("rol"), F.struct("conv_id", "turn").alias("consulta"), F.char_length("text").alias("largo")))).alias("line"))


def named_degrees(spark, sf_dir):
    return answers(spark, sf_dir).select("c_custkey", F.array_join(F.array_sort(V.named_degrees(F.col("text"))), "|").alias("degrees"))


def invented_degrees(spark, sf_dir):
    named = answers(spark, sf_dir).select("c_custkey", F.explode(V.named_degrees(F.col("text"))).alias("name"))
    return V.invented(named, catalogue(spark), "c_custkey")


_LINE = "case when p_size % 5 = 0 then '- **' || p_name || '** (6 ECTS)' when p_size % 5 = 1 then '* ' || p_name || ' - ' || p_type when p_size % 5 = 2 then '3. ' || p_name || ', optativa' when p_size % 5 = 3 then 'Grado en:' else '- ' || p_type || ':' end"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.expr(_LINE).alias("line"))


def list_elements(spark, sf_dir):
    return V.list_elements(_lines(spark, sf_dir), "p_brand", "p_partkey", "line")


def enumerated_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr("concat('puedes cursar ', upper(substr(p_name, 1, 1)), substr(p_name, 2), ' (6 ECTS), ', p_type, ' libre (4,5 créditos).')").alias("t"))
    return p.select("p_partkey", F.array_join(V.enumerated(F.col("t")), "|").alias("names"))


def list_scoring(spark, sf_dir):
    """What small parts of a brand list against the brand's names."""
    p = table(spark, sf_dir, "part")
    listed = p.where("p_size <= 12").select("p_brand", F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("inventada "), "p_type", F.lit(" x"))).otherwise(F.concat(F.lit("incluye "), "p_name")).alias("name")).distinct()
    out = V.score_lists(listed, p.select("p_brand", F.col("p_name").alias("name")).distinct(), p.select(F.col("p_name").alias("name")), "p_brand")
    return out.withColumn("precision", F.round("precision", 6)).withColumn("coverage", F.round("coverage", 6))


def _headers(spark, sf_dir):
    """The different headers: parts that differ in what no header holds have one."""
    s = subjects(spark, sf_dir).select(F.concat("name", F.lit(" "), "p_type").alias("name"), F.upper(F.btrim("kind")).alias("kind"), "ects", _degrees().alias("degrees"), F.array("p_type").alias("mentions"), "term", "year").distinct()
    return s.select(T.subject_header(*map(F.col, ("name", "kind", "ects", "degrees", "mentions", "term", "year")), F.lit(True)).alias("text"))


def unambiguous_attributes(spark, sf_dir):
    return V.context_attributes(_headers(spark, sf_dir))


_SEGMENT = "case when p_size % 3 = 0 then 'La asignatura **' || p_name || '** es de ' || p_type when p_size % 3 = 1 then '«' || p_name || '» y «red widget»' else p_name end"


def segment_subject(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return V.segment_subjects(p.select("p_partkey", F.expr(_SEGMENT).alias("segment")), p.select(F.col("p_name").alias("name")), "p_partkey", "segment")


def correct_attributes(spark, sf_dir):
    """Contradictions with the context put right, line by line."""
    facts = {"blue bolt": {"term": 1, "year": 2, "ects": "6"}, "red widget": {"term": 2, "year": 1, "ects": "4,5"}}
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.expr("concat('**', p_name, '** se imparte en el tercer cuatrimestre de segundo curso, con 9 ECTS')").alias("text"))
    return V.correct_answers(p, facts)


_PARTS = "(select conv_id, turn, text from conversations)"


def stream_retraction(spark, sf_dir):
    """Parts of an answer until what has been said holds a phrase that it must not."""
    parts = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return V.retractions(parts, "conv_id", "turn", "text", ["hainti"])


INSTEAD = "No puedo darte esa respuesta."
_STREAM = "case turn % 3 when 0 then '**blue bolt** se da en el ter' when 1 then 'cer curso. Son 9 ECTS. ' else case when conv_id % 3 = 0 then 'Mira el Grado en Magia. ' else 'Mira el Grado en Jaén. ' end end"


def verified_stream(spark, sf_dir):
    """Answers in parts that break inside words: corrected by sentence, withdrawn where they name a degree that does not exist."""
    facts = {"blue bolt": {"term": 1, "year": 2, "ects": "6"}}
    parts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_STREAM).alias("text"))
    return V.verify_streams(parts, "conv_id", "turn", "text", facts, ["Grado en Jaén"], INSTEAD)


def drop_greeting(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("case when turn = 0 and conv_id % 2 = 0 then '¡Hola!' else text end").alias("text"))
    return V.drop_greeting(c, "conv_id", "turn", "text").select("conv_id", "turn")


QUERIES = {f.__name__: f for f in (names_in_text, named_by_itself, degrees_in_answer, scope_decision_parse, prepare_queries, last_three_turns, turn_log, named_degrees, invented_degrees, list_elements, enumerated_names, list_scoring, unambiguous_attributes, segment_subject, correct_attributes, stream_retraction, verified_stream, drop_greeting)}
_q = lambda s: s.replace("'", "''")
_NAMED = f"list_distinct(list_transform(regexp_extract_all(text, '{_q(V.DEGREE)}'), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))))"
_OCC = "((length({0}) - length(replace({0}, {1}, ''))) // length({1}))"
_SELF = (
    f"(select c_custkey, c.name, {_OCC.format('said', 'c.n')} > (select coalesce(sum({_OCC.format('said', 'o.n')} * {_OCC.format('o.n', 'c.n')}), 0) from (select name, {NORMAL.format('name')} as n from {_CAT}) o where o.name <> c.name and contains(o.n, c.n)) as by_itself "
    f"from (select c_custkey, {NORMAL.format('text')} as said from {ANSWERS}) a, (select name, {NORMAL.format('name')} as n from {_CAT}) c where contains(said, c.n))"
)
_W = f"(select name, unnest({sql_tokens('name')}) as word from {_CAT})"
_DW = f"(select word from {_W} group by word having count(*) < {len(NAMES)} / 2 and length(word) >= 4)"
_ELEMENT = f"trim(regexp_replace(raw, '{_q(V.TAIL)}', ''), ' .;:')"
_ORDCASE = lambda e: "case lower(" + e + ") " + " ".join(f"when '{k}' then {v}" for k, v in V.ORDINALS.items()) + " end"
_PLACE = f"(?i)se imparte en el ({V._ORD})[ \\t]+cuatrimestre(?:[ \\t]+de[ \\t]+({V._ORD})[ \\t]+curso)?"
_HEADERS = "(select " + _HEAD_SQL.replace("'«' || name || '», '", "'«' || name || ' ' || p_type || '», '").replace("p_size % 7 = 0 then '. No", "false then '. No") + f" as text, name || ' ' || p_type as n0 from {SUBJECTS_SQL})"
_TERM = _ORDCASE(f"regexp_extract(text, '{_PLACE}', 1)")
ORACLES = {
    "names_in_text": f"select distinct c_custkey, name from (select c_custkey, unnest({sql_tokens('text')}) as word from {ANSWERS}) q join {_W} w using (word) where word in {_DW}",
    "named_by_itself": f"select * from {_SELF}",
    "degrees_in_answer": f"select c_custkey, name from {_SELF} where by_itself",
    "scope_decision_parse": "select c_custkey, case c_custkey % 5 when 0 then 'SIGUE' when 1 then 'TODAS' when 3 then 'CAMBIA' else 'NINGUNA' end as kind, case when c_custkey % 5 = 3 then 'Doble Grado en Furniture y Household|Grado en Machinery' else '' end as names from customer",
    "last_three_turns": "select conv_id, turn, count(*) over w as held, md5(coalesce(string_agg(text, chr(10)) over w, '')) as remembered from conversations where role = 'user' window w as (partition by conv_id order by turn rows between 3 preceding and 1 preceding)",
    "turn_log": "select conv_id, turn, md5('{\"rol\":\"' || role || '\",\"consulta\":{\"conv_id\":' || conv_id || ',\"turn\":' || turn || '},\"largo\":' || length(text) || '}') as line from conversations",
    "named_degrees": f"select c_custkey, array_to_string(list_sort({_NAMED}), '|') as degrees from {ANSWERS}",
    "invented_degrees": f"select c_custkey, name from (select c_custkey, unnest({_NAMED}) as name from {ANSWERS}) a where not exists (select 1 from (select name as r from {_CAT}) c where starts_with({NORMAL.format('r')}, {NORMAL.format('a.name')}) or starts_with({NORMAL.format('a.name')}, {NORMAL.format('r')}) or list_has_all({sql_tokens('r')}, {sql_tokens('a.name')}))",
    "list_elements": f"with l as (select p_brand, p_partkey, {_LINE} as line from part), r as (select *, trim(regexp_replace(regexp_extract(line, '{_q(V.BULLET)}', 1), '[*_`]+', '', 'g')) as raw, last_value(case when line = 'Grado en:' then 'Grado en' end ignore nulls) over (partition by p_brand order by p_partkey) as prefix from l), e as (select *, {_ELEMENT} as el from r) select p_brand, p_partkey, concat_ws(' ', prefix, el) as element from e where raw <> '' and not ends_with(raw, ':') and el <> ''",
    "enumerated_names": "select p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) || '|' || p_type || ' libre' as names from part",
    "list_scoring": (
        "with l as (select distinct p_brand, case when p_size % 4 = 0 then 'inventada ' || p_type || ' x' else 'incluye ' || p_name end as name, p_name, p_size % 4 = 0 as bad from part where p_size <= 12), j as (select p_brand, count(distinct name) as listed, count(distinct name) filter (where bad) as invented from l group by p_brand), "
        "e as (select p_brand, count(*) as expected, count(*) filter (where exists (select 1 from l where l.p_brand = x.p_brand and not bad and l.p_name = x.p_name)) as found from (select distinct p_brand, p_name from part) x group by p_brand) "
        "select p_brand, coalesce(listed, 0) as listed, coalesce(invented, 0) as invented, expected - found as omitted, round((listed - invented) / listed, 6) as precision, round(found / expected, 6) as coverage from e left join j using (p_brand)"
    ),
    "unambiguous_attributes": (
        f"with h as (select {NORMAL.format('n0')} as name, {_TERM} as term, coalesce({_ORDCASE(f'regexp_extract(text, {chr(39)}{_PLACE}{chr(39)}, 2)')}, case when {_TERM} is null then {_ORDCASE(f'regexp_extract(text, {chr(39)}(?i)se imparte en el ({V._ORD})[ ]+curso{chr(39)}, 1)')} end) as year, "
        f"nullif(regexp_extract(text, '(?i)de[ ]+([0-9]+(?:[.,][0-9]+)?)[ ]+ECTS', 1), '') as ects, contains(text, 'impartida en') as shared from {_HEADERS}) "
        "select name, max(term) as term, max(year) as year, max(ects) as ects from h where term is not null or year is not null or ects is not null group by name having count(distinct coalesce(term::varchar, '-') || '/' || coalesce(year::varchar, '-') || '/' || coalesce(ects, '-')) = 1 and count(*) filter (where not shared) > 0"
    ),
    "correct_attributes": (
        "select p_partkey as key, '**' || p_name || '** se imparte en el ' || case p_name when 'blue bolt' then 'primer cuatrimestre de segundo curso, con 6' when 'red widget' then 'segundo cuatrimestre de primer curso, con 4,5' "
        "else 'tercer cuatrimestre de segundo curso, con 9' end || ' ECTS' as corrected, case p_name when 'blue bolt' then 2 when 'red widget' then 3 else 0 end as warnings from part"
    ),
    "segment_subject": (
        "with k as (select distinct p_name as n from part), has as (select count(*) > 0 as red from k where n = 'red widget') "
        "select p_partkey, case when p_size % 3 = 0 then p_name when p_size % 3 = 1 and (p_name = 'red widget' or not red) then p_name end as subject from part, has"
    ),
    "stream_retraction": f"with s as (select conv_id, turn, contains(string_agg(text, '') over (partition by conv_id order by turn), 'hainti') as bad from {_PARTS}), f as (select *, sum(bad::int) over (partition by conv_id order by turn) as n from s) select conv_id, turn, case when bad then 'retract' else 'part' end as kind from f where n = 0 or (n = 1 and bad)",
    "verified_stream": (
        f"with t as (select conv_id, string_agg({_STREAM}, '' order by turn) as s from conversations group by conv_id), f as (select conv_id, s, regexp_extract_all(s, '[^.!?\\n]*[.!?\\n]') as f from t), "
        "w as (select conv_id, f, substr(s, length(array_to_string(f, '')) + 1) as rest from f), u as (select conv_id, case when rest = '' then f else list_append(f, rest) end as us from w), "
        "x as (select conv_id, unnest(range(len(us))) as seq, unnest(us) as text from u), b as (select conv_id, min(seq) as bad from x where contains(text, 'Magia') group by conv_id) "
        "select x.conv_id as key, seq, 'part' as kind, replace(replace(text, 'tercer curso', 'segundo curso'), '9 ECTS', '6 ECTS') as text from x left join b using (conv_id) where bad is null or seq < bad "
        f"union all select conv_id, bad, 'retract', null from b union all select conv_id, bad + 1, 'fixed', '{INSTEAD}' from b"
    ),
    "drop_greeting": "select conv_id, turn from (select *, count(*) over (partition by conv_id) as n from conversations) where not (turn = 0 and conv_id % 2 = 0 and n > 1)",
}
