"""Queries on the catalogue operators; the star schema stands for a university's catalogue.

A nation is a degree (every third one a double degree), a part a subject, a brand and a type its mentions,
and an order line of a supplier's nation the row of a degree's subject table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.functions import fixed as X
from talus.functions import text as T
from talus.operators import catalog as G
from talus.operators.ranks import numbered
from talus.plans.text import NORMAL, SUBJECTS_SQL, subjects, sql_tokens
from talus.session import table

_DOUBLE = "n_nationkey % 3 = 0"
DEGREES_SQL = f"(select n_nationkey, case when {_DOUBLE} then 'Doble Grado en ' || n_name else 'Grado en ' || n_name end as degree, {_DOUBLE} as is_double, case when n_nationkey % 4 = 0 then null else 'http://u/' || n_nationkey || '/asignaturas' end as subjects_url, case when n_nationkey % 5 = 0 then null else 'http://u/' || n_nationkey || '/salidas' end as careers_url from nation)"
#: Rows of the degrees' subject tables, some repeated, some with blanks: line numbers give the order.
ROWS_SQL = f"(select degree, is_double, p_partkey as code, l_orderkey * 10 + l_linenumber as ord, s.name, upper(trim(s.kind)) as kind, s.ects, case when l_linenumber % 2 = 0 then '' else coalesce(s.year, '') end as year, case when l_linenumber % 3 = 0 then '' else s.term end as term, case when l_linenumber % 2 = 0 then p_brand else p_type end as mention from lineitem join supplier on l_suppkey = s_suppkey join {DEGREES_SQL} d on s_nationkey = d.n_nationkey join {SUBJECTS_SQL} s on l_partkey = p_partkey)"
TABLE_SQL = f"(select degree, is_double, code, min(name) as name, min(kind) as kind, min(ects) as ects, coalesce(min(nullif(year, '')), '') as year, coalesce(min(nullif(term, '')), '') as term, min(mention) as mention from {ROWS_SQL} group by degree, is_double, code)"


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        "n_nationkey", F.expr(f"case when {_DOUBLE} then concat('Doble Grado en ', n_name) else concat('Grado en ', n_name) end").alias("degree"), F.expr(_DOUBLE).alias("is_double"),
        F.expr("case when n_nationkey % 4 = 0 then null else concat('http://u/', n_nationkey, '/asignaturas') end").alias("subjects_url"),
        F.expr("case when n_nationkey % 5 = 0 then null else concat('http://u/', n_nationkey, '/salidas') end").alias("careers_url"),
    )


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = subjects(spark, sf_dir).select("p_partkey", "name", F.upper(F.btrim("kind")).alias("kind"), "ects", "year", "term", "p_brand", "p_type")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = lines.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(degrees(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")).join(s, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(
        "degree", "is_double", F.col("p_partkey").alias("code"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "name", "kind", "ects",
        F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.coalesce("year", F.lit(""))).alias("year"),
        F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("term")).alias("term"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("mention"),
    )


def subject_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each degree and code."""
    low = lambda c: F.min(c).alias(c)
    fill = lambda c: F.coalesce(F.min(F.nullif(F.col(c), F.lit(""))), F.lit("")).alias(c)
    return rows(spark, sf_dir).groupBy("degree", "is_double", "code").agg(low("name"), low("kind"), low("ects"), fill("year"), fill("term"), low("mention"))


def merge_subjects(spark, sf_dir):
    out = G.merge_subjects(rows(spark, sf_dir).withColumn("mentions", F.array("mention")), ["degree", "code"], "ord")
    return out.select("degree", "code", "name", "kind", "ects", "year", "term", F.array_join("mentions", "|").alias("mentions"))


def exact_dedup_units(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    out = G.dedup_units(docs, ["lang", "h"], "doc_id")
    return out.select("lang", "h", F.element_at("members", 1).alias("first_id"), F.size("members").alias("copies"), F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def text_assembly(spark, sf_dir):
    """Summary is a text's first line, contents the rest; short texts are fallback guides."""
    docs = table(spark, sf_dir, "documents")
    first = F.regexp_extract("text", "^[^\\n]*", 0)
    rest = F.substring("text", F.char_length(first) + 2, F.lit(1_000_000_000))
    return docs.select("doc_id", F.md5(G.assemble_text(F.char_length("text") < 200, F.col("text"), first, rest)).alias("text"))


def unique_name_join(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey", F.expr("case when c_custkey % 3 = 0 then concat('  NATION_', c_nationkey, ' (GIE)') when c_custkey % 3 = 1 then concat('nation_', c_nationkey) else 'region' end").alias("name"))
    right = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("unit")).union(table(spark, sf_dir, "region").select(F.lit("Region"), F.col("r_regionkey") + 1000))
    attached, ambiguous = G.attach_by_unique_name(left, right)
    return attached.select("c_custkey", "unit", F.lit("attached").alias("state")).union(ambiguous.select("c_custkey", F.lit(None).cast("int"), F.lit("ambiguous")))


def split_by_plan(spark, sf_dir):
    records = subject_table(spark, sf_dir)
    members = records.select("degree", "code").union(degrees(spark, sf_dir).where("n_nationkey < 3").select(F.lit("Grado en X").alias("degree"), F.col("n_nationkey").cast("bigint")))
    out = G.split_by_plan(members, records, ["degree", "code"], "code", "degree")
    return out.select("code", "kind", "ects", "year", "term", F.array_join("degrees", "|").alias("degrees"))


def shared_units(spark, sf_dir):
    out = G.ordered_degrees(subject_table(spark, sf_dir), "name", "degree", "code", "is_double")
    return out.select("name", F.size("degrees").alias("n"), F.md5(F.array_join("degrees", "|")).alias("degrees"), F.md5(F.array_join("codes", "|")).alias("codes"))


def no_guide_antijoin(spark, sf_dir):
    """Subjects that no order line of fifty pieces or more mentions, with the text for those that say they have a guide."""
    recent = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 49).select("l_partkey")
    s = subjects(spark, sf_dir)
    out = s.join(recent, s.p_partkey == recent.l_partkey, "left_anti")
    return out.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("La guía de «"), "name", F.lit("» no se pudo leer."))).otherwise(F.concat(F.lit("«"), "name", F.lit("» no publica guía."))).alias("text"))


def plan_listing(spark, sf_dir):
    return G.plan_listing(subject_table(spark, sf_dir)).select("degree", "grp", "year", "n", F.md5("names").alias("names"))


def year_ordered_groups(spark, sf_dir):
    s = subject_table(spark, sf_dir).groupBy("degree", "year").agg(F.count("*").alias("n")).withColumn("year_place", T.year_order(F.col("year")))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("degree").orderBy("year_place", "year")))


def catalog_rollup(spark, sf_dir):
    d = degrees(spark, sf_dir)
    return d.rollup("is_double").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("degree")), "; ").alias("names"))


def degree_record(spark, sf_dir):
    d = degrees(spark, sf_dir).select("degree").union(spark.createDataFrame([("Grado en Nada",)], "degree string"))
    return G.degree_records(d, subject_table(spark, sf_dir))


def mention_listing(spark, sf_dir):
    """Subjects by mention, without the label common to all."""
    s = subjects(spark, sf_dir).select("name", F.explode(T.split_mentions(F.concat_ws("/", "p_brand", "p_type", F.lit("Común a todas las menciones")))).alias("mention"))
    kept = s.where(T.normalize(F.col("mention")) != X.COMMON_MENTION)
    return kept.groupBy("mention").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_set("name")), "; ")).alias("names"))


def dataset_union(spark, sf_dir):
    """The seven parts of the corpus in their order, as rows with running numbers: guides, careers, plans, catalogue, records, mentions, subjects without a guide."""
    part = lambda n, origin, df, name, *text: df.select(F.lit(n).alias("ord"), F.lit(origin).alias("origin"), name.cast("string").alias("name"), F.md5(F.concat_ws("|", *text)).alias("text"))
    d = degrees(spark, sf_dir)
    parts = [
        part(1, "guia", table(spark, sf_dir, "documents"), F.col("doc_id"), "text"),
        part(2, "salidas", d.where("careers_url is not null"), F.col("degree"), F.lit("Salidas profesionales"), "degree", "careers_url"),
        part(3, "plan", plan_listing(spark, sf_dir), F.concat_ws("|", "degree", "grp", "year"), "n", "names"),
        part(4, "catalogo", catalog_rollup(spark, sf_dir), F.coalesce(F.col("is_double").cast("string"), F.lit("total")), "n", "names"),
        part(5, "ficha", degree_record(spark, sf_dir), F.col("degree"), "total", "obligatory", "elective", "duration", "mentions", "notice"),
        part(6, "mencion", mention_listing(spark, sf_dir), F.col("mention"), "n", "names"),
        part(7, "sin_guia", no_guide_antijoin(spark, sf_dir), F.col("p_partkey"), "text"),
    ]
    rows_ = numbered(reduce(DataFrame.unionByName, parts), ["ord", "name"])
    return rows_.select(F.format_string("chunk-%04d", "number").alias("id"), "origin", "name", "text")


def provenance_rollup(spark, sf_dir):
    s = subjects(spark, sf_dir)
    return s.agg(F.array_join(F.array_sort(F.collect_set("year")), "|").alias("years"), F.count_if(F.col("year").isNull() | (F.col("year") == "")).alias("without"))


def catalogue(spark, sf_dir):
    return rows(spark, sf_dir).select(F.explode(F.array("degree", "mention")).alias("name")).distinct()


def distinctive_words(spark, sf_dir):
    return G.distinctive_words(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type", F.lit("de la Universidad")).alias("name")))


def link_map(spark, sf_dir):
    """(degree, subject name) to url: pairs with several urls go; a double degree inherits from the single ones."""
    t = subject_table(spark, sf_dir).where("name <> ''")
    links = t.select("degree", "is_double", "name", F.concat(F.lit("http://u/"), F.col("code") % 50).alias("url"))
    own = G.unambiguous_links(links, ["degree", "is_double", "name"], "url")
    base = own.where(~F.col("is_double")).groupBy("name").agg(F.min_by("url", "degree").alias("base"))
    doubles = t.where("is_double").select("degree", "name").distinct().join(own.where("is_double"), ["degree", "name"], "left_anti").join(base, "name").select("degree", "name", F.col("base").alias("url"), F.lit(True).alias("inherited"))
    return own.select("degree", "name", "url", F.lit(False).alias("inherited")).union(doubles)


def page_link_map(spark, sf_dir):
    return degrees(spark, sf_dir).unpivot("degree", ["subjects_url", "careers_url"], "page", "url").where("url is not null")


def link_lookup(spark, sf_dir):
    """For each subject the url of its first degree that has one."""
    d = degrees(spark, sf_dir).select("degree", "careers_url")
    s = G.ordered_degrees(subject_table(spark, sf_dir), "code", "degree", "code", "is_double").select("code", F.posexplode("degrees").alias("pos", "degree"))
    return s.join(d, "degree").where("careers_url is not null").groupBy("code").agg(F.min_by("careers_url", "pos").alias("url"))


def source_list(spark, sf_dir):
    """First message of each text in a conversation."""
    c = table(spark, sf_dir, "conversations")
    return G.first_seen(c, "conv_id", ["role"], "turn").select("conv_id", "role", "turn")


def set_differences(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return G.difference(a, b, ["k"])


QUERIES = {f.__name__: f for f in (merge_subjects, exact_dedup_units, text_assembly, unique_name_join, split_by_plan, shared_units, no_guide_antijoin, plan_listing, year_ordered_groups, catalog_rollup, degree_record, mention_listing, dataset_union, provenance_rollup, catalogue, distinctive_words, link_map, page_link_map, link_lookup, source_list, set_differences)}
_FIRST = lambda c: f"arg_min({c}, ord)"
_PLACE = "case when trim(year) = '' then 99 " + " ".join(f"when starts_with(lower(year), '{o}') then {i}" for i, o in enumerate(X.YEAR_ORDER)) + " else 98 end"
_HIGH = "greatest(" + ", ".join(f"case when contains(lower(year), '{o}') then {i + 1} else 0 end" for i, o in enumerate(X.YEAR_ORDER)) + ")"
_LISTED = f"(select code, degree, is_double, row_number() over (partition by code order by is_double, degree) - 1 as pos from {TABLE_SQL})"
ORACLES = {
    "merge_subjects": f"with r as (select * from {ROWS_SQL}), m as (select degree, code, string_agg(mention, '|' order by f) as mentions from (select degree, code, mention, min(ord) as f from r group by degree, code, mention) group by degree, code), b as (select degree, code, {_FIRST('name')} as name, {_FIRST('kind')} as kind, {_FIRST('ects')} as ects, coalesce(arg_min(year, ord) filter (where year <> ''), '') as year, coalesce(arg_min(term, ord) filter (where term <> ''), '') as term from r group by degree, code) select * from b join m using (degree, code)",
    "exact_dedup_units": "select lang, sha256(text) as h, min(doc_id) as first_id, count(*) as copies, string_agg(doc_id, ',' order by doc_id) as members from documents group by lang, text",
    "text_assembly": "select doc_id, md5(case when length(text) < 200 then text else concat_ws(chr(10) || chr(10), nullif(regexp_extract(text, '^[^\\n]*'), ''), nullif(substr(text, length(regexp_extract(text, '^[^\\n]*')) + 2), '')) end) as text from documents",
    "unique_name_join": "select c_custkey, case when c_custkey % 3 = 2 then null else c_nationkey end as unit, case when c_custkey % 3 = 2 then 'ambiguous' else 'attached' end as state from customer",
    "split_by_plan": f"with t as (select * from {TABLE_SQL}), m as (select degree, code from t union all select 'Grado en X', n_nationkey from nation where n_nationkey < 3) select m.code, kind, ects, year, term, string_agg(m.degree, '|' order by m.degree) as degrees from (select distinct * from m) m left join t on t.degree = m.degree and t.code = m.code group by m.code, kind, ects, year, term",
    "shared_units": f"select name, count(*) as n, md5(string_agg(degree, '|' order by is_double, degree, code::varchar)) as degrees, md5(string_agg(code::varchar, '|' order by is_double, degree, code::varchar)) as codes from {TABLE_SQL} group by name",
    "no_guide_antijoin": f"select p_partkey, case when p_size % 2 = 0 then 'La guía de «' || name || '» no se pudo leer.' else '«' || name || '» no publica guía.' end as text from {SUBJECTS_SQL} s where not exists (select 1 from lineitem where l_partkey = s.p_partkey and l_quantity > 49)",
    "plan_listing": f"select degree, case when kind = 'OP' then 'optativas' else 'obligatorias' end as grp, year, count(*) as n, md5(string_agg(name, '; ' order by name)) as names from {TABLE_SQL} group by all",
    "year_ordered_groups": f"select *, row_number() over (partition by degree order by year_place, year) as place from (select degree, year, count(*) as n, {_PLACE} as year_place from {TABLE_SQL} group by degree, year)",
    "catalog_rollup": f"select is_double, count(*) as n, string_agg(degree, '; ' order by degree) as names from {DEGREES_SQL} group by rollup (is_double)",
    "degree_record": f"with d as (select degree from {DEGREES_SQL} union all select 'Grado en Nada'), s as (select degree, count(*) as total, count(*) filter (where kind <> 'OP') as obligatory, count(*) filter (where kind = 'OP') as elective, max({_HIGH}) as duration, count(distinct mention) as mentions from {TABLE_SQL} group by degree) select degree, coalesce(total, 0) as total, coalesce(obligatory, 0) as obligatory, coalesce(elective, 0) as elective, coalesce(duration, 0) as duration, coalesce(mentions, 0) as mentions, case when total is null then 'sin asignaturas publicadas' end as notice from d left join s using (degree)",
    "mention_listing": f"select mention, count(*) as n, md5(string_agg(distinct name, '; ' order by name)) as names from (select name, p_brand as mention from {SUBJECTS_SQL} union all select name, p_type from {SUBJECTS_SQL}) group by mention",
    "provenance_rollup": f"select string_agg(distinct year, '|' order by year) as years, count(*) filter (where year is null or year = '') as without from {SUBJECTS_SQL}",
    "catalogue": f"select distinct degree as name from {ROWS_SQL} union select distinct mention from {ROWS_SQL}",
    "distinctive_words": f"with c as (select p_name || ' ' || p_type || ' de la Universidad' as name from part), w as (select unnest({sql_tokens('name')}) as word from c) select word, count(*) as names from w group by word having count(*) < (select count(*) from c) / 2 and length(word) >= 4",
    "link_map": f"with l as (select degree, is_double, name, 'http://u/' || (code % 50) as url from {TABLE_SQL} where name <> ''), o as (select degree, is_double, name, min(url) as url from l group by all having count(distinct url) = 1), b as (select name, arg_min(url, degree) as url from o where not is_double group by name) select degree, name, url, false as inherited from o union all select degree, name, b.url, true from (select distinct degree, name from l where is_double and (degree, name) not in (select (degree, name) from o where is_double)) join b using (name)",
    "page_link_map": f"select degree, 'subjects_url' as page, subjects_url as url from {DEGREES_SQL} where subjects_url is not null union all select degree, 'careers_url', careers_url from {DEGREES_SQL} where careers_url is not null",
    "link_lookup": f"select code, arg_min(careers_url, pos) as url from {_LISTED} join {DEGREES_SQL} d using (degree) where careers_url is not null group by code",
    "source_list": "select conv_id, role, min(turn) as turn from conversations group by conv_id, role",
    "set_differences": "with a as (select distinct o_custkey as k from orders where o_orderstatus = 'F'), b as (select c_custkey as k from customer where c_acctbal > 0) select k, 'missing' as side from a where k not in (select k from b) union all select k, 'extra' from b where k not in (select k from a)",
}
_PARTS = " union all ".join(
    f"select {n} as ord, '{origin}' as origin, ({name})::varchar as name, md5(concat_ws('|', {text})) as text from {of}"
    for n, origin, of, name, text in (
        (1, "guia", "documents", "doc_id", "text"), (2, "salidas", f"{DEGREES_SQL} where careers_url is not null", "degree", "'Salidas profesionales', degree, careers_url"),
        (3, "plan", f"({ORACLES['plan_listing']})", "degree || '|' || grp || '|' || year", "n, names"), (4, "catalogo", f"({ORACLES['catalog_rollup']})", "coalesce(is_double::varchar, 'total')", "n, names"),
        (5, "ficha", f"({ORACLES['degree_record']})", "degree", "total, obligatory, elective, duration, mentions, notice"), (6, "mencion", f"({ORACLES['mention_listing']})", "mention", "n, names"),
        (7, "sin_guia", f"({ORACLES['no_guide_antijoin']})", "p_partkey", "text"),
    )
)
ORACLES["dataset_union"] = f"select printf('chunk-%04d', row_number() over (order by ord, name) - 1) as id, origin, name, text from ({_PARTS})"
