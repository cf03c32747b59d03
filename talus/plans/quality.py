"""Data-quality queries: how many offenders a check finds, with the first of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions import fixed as X
from talus.functions import text as T
from talus.operators import chunking as K
from talus.operators import quality as I
from talus.plans import catalog as C
from talus.plans import vectors as PV
from talus.plans.text import SUBJECTS_SQL, subjects
from talus.session import table


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def dq_totals(spark, sf_dir):
    """Table sizes against what is expected."""
    want = {"region": 5, "nation": 25, "benchmark": 40}
    return _all(*[table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"), (F.count("*") == n).alias("as_expected")) for t, n in want.items()])


def dq_degrees_without_subjects(spark, sf_dir):
    d = C.degrees(spark, sf_dir).where("subjects_url is not null")
    have = C.subject_table(spark, sf_dir).where("kind = 'OBL'").select("degree").distinct()
    return I.summary("degrees_without_subjects", d.join(have, "degree", "left_anti"), "degree")


def dq_subject_fields(spark, sf_dir):
    """Blank credits, marks left in names, slashes in mentions, subjects not offered."""
    s = subjects(spark, sf_dir)
    return _all(
        I.summary("blank_ects", s.where("ects = ''"), "p_partkey"), I.summary("footnote", s.where(F.regexp_like("name", F.lit("\\*+[ ]*$"))), "p_partkey"),
        I.summary("slash", s.where(F.contains("p_brand", F.lit("/"))), "p_partkey"), I.summary("not_offered", s.where(~T.split_offer(F.col("name"))["offered"]), "p_partkey"),
    )


def dq_only_electives_lack_year(spark, sf_dir):
    s = subjects(spark, sf_dir)
    return I.summary("obligatory_without_year", s.where(((F.col("year") == "") | F.col("year").isNull()) & (T.normalize_type(F.col("kind")) != "OP")), "p_partkey")


def dq_year_distribution(spark, sf_dir):
    return subjects(spark, sf_dir).groupBy(T.year_order(F.col("year")).alias("year_place")).agg(F.count("*").alias("n"))


def dq_binary_text(spark, sf_dir):
    return I.summary("binary", table(spark, sf_dir, "documents").where(T.looks_binary(F.col("text"))), "doc_id")


def dq_chunk_shape(spark, sf_dir):
    """Chunks over the limit or without degrees."""
    w = K.fixed_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 900, 0.0)
    c = PV.chunks(spark, sf_dir)
    return I.summary("over_limit", w.where(F.char_length("chunk") > X.CHUNK_MAX), "doc_id").union(I.summary("no_degrees", c.where(F.size("degrees") == 0), "vec_id"))


def dq_header_of_unit(spark, sf_dir):
    """Pages whose heading is not their title."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("head"))
    return I.summary("other_heading", p.where(~F.startswith("head", F.col("title"))), "page_id")


def dq_claims_by_degree(spark, sf_dir):
    """Subjects whose type differs from degree to degree."""
    t = C.rows(spark, sf_dir).select("name", "kind")
    return I.summary("several_types", I.inconsistent(t.where("name <> ''"), ["name"], "kind"), "name")


def dq_declared_counts(spark, sf_dir):
    """Listings whose declared number is not that of their lines."""
    t = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.array_join(F.collect_list("p_name"), "\n- ").alias("names"))
    text = F.concat(F.lit("Hay "), (F.col("n") + (F.substring("p_brand", -1, 1) == "3").cast("int")).cast("string"), F.lit(" asignaturas:\n- "), "names")
    d = t.select("p_brand", text.alias("t")).where(F.regexp_extract("t", "Hay ([0-9]+)", 1).cast("int") != F.size(F.filter(F.split("t", "\n"), lambda x: F.startswith(x, F.lit("- ")))))
    return I.summary("wrong_count", d, "p_brand")


def dq_totals_recomputed(spark, sf_dir):
    """Order totals against the sum of their lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    both = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return I.summary("total_below_lines", both.where("o_totalprice < s"), "o_orderkey")


def dq_contiguous_numbers(spark, sf_dir):
    c = PV.chunks(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations").withColumn("total", F.lit(None).cast("int"))
    return I.summary("units", I.not_contiguous(c, "name", "chunk_index", "total_chunks"), "name").union(I.summary("lines", table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m"), F.count_distinct("l_linenumber").alias("n")).where("m <> n"), "l_orderkey")).union(I.summary("turns", turns.groupBy("conv_id").agg(F.max("turn").alias("m"), F.count("*").alias("n")).where("m + 1 <> n"), "conv_id"))


def dq_avoidable_short(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("size", F.char_length("line"))
    return I.summary("avoidable", I.avoidable_short(lines, "doc_id", "i", "size", X.CHUNK_MIN, X.CHUNK_MAX), "doc_id")


def dq_selectors(spark, sf_dir):
    """Benchmark items that no document holds, and texts that several documents hold."""
    b = table(spark, sf_dir, "benchmark")
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    first = b.select("item_id", F.regexp_extract("text", "^[^\\n]*", 0).alias("line"))
    hit = first.join(d, "line").groupBy("item_id").agg(F.count_distinct("doc_id").alias("docs"))
    return I.summary("unresolved", first.join(hit, "item_id", "left_anti"), "item_id").union(I.summary("ambiguous", hit.where("docs > 1"), "item_id"))


def dq_file_audit(spark, sf_dir):
    """Names that several files share, labels without a document, documents without a label."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    same = d.groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n")).where("n > 1")
    return I.summary("shared_text", same, "n").union(I.summary("orphan_label", lab.join(d, "doc_id", "left_anti"), "doc_id")).union(I.summary("unlabelled", d.join(lab, "doc_id", "left_anti"), "doc_id"))


def dq_invariant(spark, sf_dir):
    """Rows that pass an invariant which would stop the query otherwise."""
    c = PV.chunks(spark, sf_dir)
    return I.require(c, F.size("embedding") == 64, F.concat(F.lit("vector of another size: "), F.col("vec_id").cast("string"))).agg(F.count("*").alias("rows"))


QUERIES = {f.__name__: f for f in (dq_totals, dq_degrees_without_subjects, dq_subject_fields, dq_only_electives_lack_year, dq_year_distribution, dq_binary_text, dq_chunk_shape, dq_header_of_unit, dq_claims_by_degree, dq_declared_counts, dq_totals_recomputed, dq_contiguous_numbers, dq_avoidable_short, dq_selectors, dq_file_audit, dq_invariant)}


def _sum(check: str, key: str, rest: str) -> str:
    return f"select '{check}' as check_, count(*) as offenders, min({key}::varchar) as first from {rest}"


def _union(*parts: str) -> str:
    return "select check_ as \"check\", offenders, first from (" + " union all ".join(parts) + ")"


_TYPE = "case lower(trim(kind)) when 'formación básica' then 'FB' when 'obligatoria' then 'OB' when 'optativa' then 'OP' when 'obl' then 'OB' else trim(kind) end"
_PLACE = "case when trim(coalesce(year, '')) = '' then 99 " + " ".join(f"when starts_with(lower(year), '{o}') then {i}" for i, o in enumerate(X.YEAR_ORDER)) + " else 98 end"
_LINES = "(select doc_id, unnest(ls) as line, unnest(range(len(ls))) as i from (select doc_id, string_split(text, chr(10)) as ls from documents))"
_FIRST = "(select item_id, regexp_extract(text, '^[^\\n]*') as line from benchmark)"
_HIT = f"(select item_id, count(distinct doc_id) as docs from {_FIRST} join {_LINES} using (line) group by item_id)"
ORACLES = {
    "dq_totals": "select 'region' as name, count(*) as n, count(*) = 5 as as_expected from region union all select 'nation', count(*), count(*) = 25 from nation union all select 'benchmark', count(*), count(*) = 40 from benchmark",
    "dq_degrees_without_subjects": _union(_sum("degrees_without_subjects", "degree", f"{C.DEGREES_SQL} where subjects_url is not null and degree not in (select degree from {C.TABLE_SQL} where kind = 'OBL')")),
    "dq_subject_fields": _union(_sum("blank_ects", "p_partkey", f"{SUBJECTS_SQL} where ects = ''"), _sum("footnote", "p_partkey", f"{SUBJECTS_SQL} where p_size % 7 = 1"), _sum("slash", "p_partkey", "part where contains(p_brand, '/')"), _sum("not_offered", "p_partkey", "part where p_size % 7 = 0")),
    "dq_only_electives_lack_year": _union(_sum("obligatory_without_year", "p_partkey", f"{SUBJECTS_SQL} where coalesce(year, '') = '' and {_TYPE} <> 'OP'")),
    "dq_year_distribution": f"select {_PLACE} as year_place, count(*) as n from {SUBJECTS_SQL} group by year_place",
    "dq_binary_text": _union(_sum("binary", "doc_id", "documents where contains(text, '%PDF') or length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0E-\\x1F]', '', 'g')) > 0.02 * length(text)")),
    "dq_chunk_shape": _union("select 'over_limit' as check_, 0 as offenders, null::varchar as first", "select 'no_degrees', 0, null::varchar"),
    "dq_header_of_unit": _union(_sum("other_heading", "page_id", "pages where not starts_with(regexp_extract(html, '<h1>([^<]*)</h1>', 1), regexp_extract(html, '<title>([^<]*)</title>', 1))")),
    "dq_claims_by_degree": _union(_sum("several_types", "name", f"(select name from {C.ROWS_SQL} where name <> '' group by name having count(distinct kind) > 1)")),
    "dq_declared_counts": _union(_sum("wrong_count", "p_brand", "(select distinct p_brand from part where ends_with(p_brand, '3'))")),
    "dq_totals_recomputed": _union(_sum("total_below_lines", "o_orderkey", "orders join (select l_orderkey, sum(l_extendedprice) as s from lineitem group by l_orderkey) on l_orderkey = o_orderkey where o_totalprice < s")),
    "dq_contiguous_numbers": _union(
        _sum("units", "name", f"(select name from {PV.CHUNKS} group by name having max(chunk_index) + 1 <> count(*) or count(distinct chunk_index) <> count(*) or min(total_chunks) <> count(*) or max(total_chunks) <> count(*))"),
        _sum("lines", "l_orderkey", "(select l_orderkey from lineitem group by l_orderkey having max(l_linenumber) <> count(distinct l_linenumber))"),
        _sum("turns", "conv_id", "(select conv_id from conversations group by conv_id having max(turn) + 1 <> count(*))"),
    ),
    "dq_avoidable_short": _union(_sum("avoidable", "doc_id", f"(select *, least(coalesce(lag(length(line)) over w, 1000000000), coalesce(lead(length(line)) over w, 1000000000)) as room from {_LINES} window w as (partition by doc_id order by i)) where length(line) < {X.CHUNK_MIN} and room + 1 + length(line) <= {X.CHUNK_MAX}")),
    "dq_selectors": _union(_sum("unresolved", "item_id", f"{_FIRST} where item_id not in (select item_id from {_HIT})"), _sum("ambiguous", "item_id", f"{_HIT} where docs > 1")),
    "dq_file_audit": _union(_sum("shared_text", "n", "(select count(*) as n from documents group by text having count(*) > 1)"), _sum("orphan_label", "doc_id", "labels where doc_id not in (select doc_id from documents)"), _sum("unlabelled", "doc_id", "documents where doc_id not in (select doc_id from labels)")),
    "dq_invariant": "select count(*) as rows from embeddings",
}
