"""Queries on the vector operators; ``embeddings`` stands for the chunk index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.functions import fixed as X
from talus.functions import text as T
from talus.operators import vectors as V
from talus.plans.text import NORMAL, SAMPLES, _ADVICE, _list
from talus.session import table

#: The driver's vectors lie far apart, so the floor is wider than the corpus' own.
FLOOR = 0.63
#: So narrow that some questions find nothing among chunks without their own.
NARROW = 0.6

_ORIGIN = "case when vec_id % 5 = 0 then 'plan' when vec_id % 5 = 1 then 'salidas' else 'guia' end"
_YEAR = "case when vec_id % 4 = 0 then 'Primer curso' when vec_id % 4 = 1 then 'Segundo curso' when vec_id % 4 = 2 then 'Tercer o cuarto curso' else '' end"
_KIND = "case when vec_id % 2 = 0 then 'OB' else 'OP' end"
CHUNKS = (
    "(select vec_id, embedding, label, case when vec_id % 3 = 0 then ['L' || label, 'L' || label || 'x'] else ['L' || label] end as degrees, "
    f"{_ORIGIN} as origin, {_YEAR} as year, {_KIND} as kind, 'U' || (vec_id // 3) as name, vec_id % 3 as chunk_index, 3 as total_chunks from embeddings)"
)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with the metadata of chunks, made by rule."""
    one = F.concat(F.lit("L"), F.col("label"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", "label",
        F.when(F.col("vec_id") % 3 == 0, F.array(one, F.concat(one, F.lit("x")))).otherwise(F.array(one)).alias("degrees"),
        F.expr(_ORIGIN).alias("origin"), F.expr(_YEAR).alias("year"), F.expr(_KIND).alias("kind"),
        F.concat(F.lit("U"), F.expr("vec_id div 3")).alias("name"), (F.col("vec_id") % 3).alias("chunk_index"), F.lit(3).alias("total_chunks"),
    )


_Q = "q as (select vec_id as query_id, embedding as qe from embeddings where vec_id % 50 = 0)"


def _dist(where: str = "true", from_: str = CHUNKS, extra: str = "") -> str:
    n = lambda e: f"(case when list_inner_product({e}::double[], {e}::double[]) = 0 then 1 else sqrt(list_inner_product({e}::double[], {e}::double[])) end)"
    return f"d as (select query_id, c.* exclude (embedding), abs(round(1 - list_inner_product(qe::double[], embedding::double[]) / ({n('qe')} * {n('embedding')}), 6)) as distance from q, {from_} c where {where})"


_R = "r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d)"
BASE = f"with {_Q}, {_dist()}, {_R}"


def vector_topk(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    return V.top_k(V.probe_set(emb), emb).join(emb.select("vec_id", "label"), "vec_id").select("query_id", "vec_id", "label", "distance", "rank")


def vector_rank(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    return V.top_k(V.probe_set(emb), emb, 100).select("query_id", "vec_id", "distance", "rank")


def vector_topk_prefilter(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return V.top_k(V.probe_set(c), V.prefilter(c, ["L1", "L2x", "L5"], "tercer", "OB"), 10).select("query_id", "vec_id", "distance", "rank")


def membership_vs_substring(spark, sf_dir):
    c = chunks(spark, sf_dir)
    exact, loose = F.array_contains("degrees", "L1"), F.exists("degrees", lambda d: F.contains(d, F.lit("1")))
    return c.groupBy("kind").agg(F.count_if(exact).alias("exact"), F.count_if(loose).alias("by_substring"), F.count_if(loose & ~exact).alias("false_positives"))


def resolve_name(spark, sf_dir):
    catalogue = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    wanted = spark.createDataFrame([("  Blue  BOLT ",), ("Ring",), ("blue w",), ("no such thing",)], "wanted string")
    return V.resolve_names(wanted, catalogue, strict=False)


_WANTED = "(select unnest(['  Blue  BOLT ', 'Ring', 'blue w', 'no such thing']) as wanted)"


def vector_band(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    return V.band(V.top_k(V.probe_set(emb), emb, 20), floor=FLOOR).select("query_id", "vec_id", "distance", "rank")


_BAND = f"b as (select *, min(distance) over (partition by {{key}}) as best, count(*) filter (where near) over (partition by {{key}}) as n_near from (select *, distance <= {X.CUT_FACTOR} * min(distance) over (partition by {{key}}) as near from r where rank <= 20))"
_KEEP = f"best <= {{floor}} and rank <= greatest({X.K_LEAST}, least(n_near, {X.K_MOST}))"


def asking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set with a text, which is one of the samples by turns."""
    text = F.element_at(F.array(*map(F.lit, SAMPLES)), (F.expr(f"query_id div {V.EVERY}") % len(SAMPLES) + 1).cast("int"))
    return V.probe_set(chunks(spark, sf_dir)).withColumn("question", text)


_ASKING = f"(select query_id, {_list(SAMPLES)}[(query_id // {V.EVERY}) % {len(SAMPLES)} + 1] as text from q)"


def retrieve_context(spark, sf_dir):
    """A question's band among optional chunks; one left empty takes the question before; advice has no band."""
    asked = asking(spark, sf_dir).withColumn("advice", T.asks_advice(F.col("question")))
    before = V.probe_set(chunks(spark, sf_dir)).withColumn("query_id", F.col("query_id") + V.EVERY)
    return V.retrieve(asked, V.prefilter(chunks(spark, sf_dir), kind="OP"), before, floor=NARROW)


def vector_interleave(spark, sf_dir):
    c = chunks(spark, sf_dir)
    probes = V.probe_set(c)
    made = None
    for i, d in enumerate(("L1", "L2", "L3")):
        one = V.band(V.top_k(probes, V.prefilter(c, [d]), 20), floor=1.0).withColumn("scope", F.lit(i))
        made = one if made is None else made.union(one)
    named = made.join(c.select("vec_id", "origin", "name", "degrees", "chunk_index"), "vec_id")
    return V.interleave(named, ["origin", "name", "degrees", "chunk_index"]).select("query_id", "position", "vec_id", "scope", "rank", "distance")


_SCOPES = " union all ".join(
    f"select *, {i} as scope from (select *, min(distance) over (partition by query_id) as best, count(*) filter (where near) over (partition by query_id) as n_near from "
    f"(select *, distance <= {X.CUT_FACTOR} * min(distance) over (partition by query_id) as near from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d where list_contains(degrees, '{d}')) where rank <= 20)) where {_KEEP.format(floor=1.0)}"
    for i, d in enumerate(("L1", "L2", "L3"))
)


def prefilter_probe(spark, sf_dir):
    """Query and label pairs with ten members of which the unfiltered top ten holds none."""
    emb = table(spark, sf_dir, "embeddings")
    probes = V.probe_set(emb)
    groups = emb.groupBy("label").agg(F.count("*").alias("members")).where("members >= 10")
    top = V.top_k(probes, emb).join(emb.select("vec_id", "label"), "vec_id").select("query_id", "label").distinct()
    return probes.select("query_id").crossJoin(groups).join(top, ["query_id", "label"], "left_anti").select("query_id", "label", "members")


def fidelity(spark, sf_dir):
    """The exact top ten against that of an index of all vectors in five bits a number."""
    emb = table(spark, sf_dir, "embeddings")
    probes = V.probe_set(emb)
    index = emb.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 15) / 15).alias("embedding"))
    return V.fidelity(V.top_k(probes, emb), V.top_k(probes, index)).select("query_id", F.round("fidelity", 6).alias("fidelity"))


def norm_check(spark, sf_dir):
    return V.norm_check(table(spark, sf_dir, "embeddings"))


def structural_scan(spark, sf_dir):
    return V.prefilter(chunks(spark, sf_dir), ["L3"], "primer").select("vec_id", "name", "year")


def existence_count(spark, sf_dir):
    c = chunks(spark, sf_dir)
    wanted = spark.createDataFrame([("L1", "OB"), ("L9x", "OP"), ("L77", "OB")], "degree string, kind string")
    have = c.select(F.explode("degrees").alias("degree"), "kind").groupBy("degree", "kind").agg(F.count("*").alias("n"))
    return wanted.join(have, ["degree", "kind"], "left").select("degree", "kind", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("present"))


def context_order(spark, sf_dir):
    """Units by their best distance; plan listings of a degree share its best one and stand by year."""
    c = chunks(spark, sf_dir)
    r = V.top_k(V.probe_set(c), c, 20).join(c.select("vec_id", "origin", "name", "degrees", "year"), "vec_id")
    unit = F.when(F.col("origin") == "plan", F.col("degrees")[0]).otherwise(F.col("name"))
    r = r.withColumn("unit", F.concat_ws(":", F.col("origin") == "plan", unit))
    r = r.withColumn("best", F.min("distance").over(Window.partitionBy("query_id", "unit")))
    order = Window.partitionBy("query_id").orderBy("best", "unit", F.when(F.col("origin") == "plan", T.year_order(F.col("year"))).otherwise(0), "rank")
    return r.withColumn("place", F.row_number().over(order)).select("query_id", "vec_id", "unit", "best", "place")


_YEAR_PLACE = "case when trim(year) = '' then 99 " + " ".join(f"when starts_with(lower(year), '{o}') then {i}" for i, o in enumerate(X.YEAR_ORDER)) + " else 98 end"


def prompt_assembly(spark, sf_dir):
    """Prompts of the query set: scopes of none to two degrees, none to four earlier questions, no context for every seventh."""
    c = chunks(spark, sf_dir)
    number = lambda x: F.concat(F.lit("pregunta "), x)
    i = F.expr(f"query_id div {V.EVERY}")
    asked = V.probe_set(c, V.EVERY, "label").select(
        "query_id", number(F.col("query_id")).alias("question"),
        F.when(i % 2 == 0, F.array(F.lit("Grado A"), F.lit("Grado B"))).alias("catalogue"),
        F.slice(F.array(F.concat(F.lit("L"), "label"), F.lit("Lx")), F.lit(1), (i % 3).cast("int")).alias("scope"),
        F.slice(F.array(*[number(F.lit(n)) for n in range(4)]), F.lit(1), (i % 5).cast("int")).alias("earlier"),
    )
    placed = context_order(spark, sf_dir).where(i % 7 != 3).join(c.select("vec_id", "name", "degrees", F.concat_ws(" ", "origin", "year").alias("text")), "vec_id")
    return V.prompts(asked, placed, INSTRUCTIONS)


INSTRUCTIONS = "Responde solo con el contexto."
_NL = "chr(10)"
_LISTED = "array_to_string(list_transform({0}, lambda x: '- ' || x), chr(10))"
_PROMPT = f"""
select query_id, '{INSTRUCTIONS}' || {_NL} || {_NL}
|| case when i % 2 = 0 then '{X.CATALOGUE_HEADING}' || {_NL} || '- Grado A' || {_NL} || '- Grado B' || {_NL} || {_NL} else '' end
|| case i % 3 when 1 then '{X.ONE_SCOPE}L' || label || '.' || {_NL} || {_NL} when 2 then '{X.SCOPES_HEADING}' || {_NL} || '- L' || label || {_NL} || '- Lx' || {_NL} || {_NL} else '' end
|| case when i % 5 > 0 then '{X.EARLIER_HEADING}' || {_NL} || {_LISTED.format("list_transform(range(greatest(i % 5 - 3, 0), i % 5), lambda n: 'pregunta ' || n)")} || {_NL} || {_NL} else '' end
|| 'CONTEXTO:' || {_NL} || coalesce(context, '{X.NO_CONTEXT}') || {_NL} || {_NL} || 'PREGUNTA: pregunta ' || query_id || {_NL} || {_NL} || 'RESPUESTA:' as prompt
from (select vec_id as query_id, vec_id // {V.EVERY} as i, label from embeddings where vec_id % {V.EVERY} = 0) a left join (
    select query_id, string_agg(name || ' — ' || array_to_string(degrees, ', ') || {_NL} || concat_ws(' ', origin, year), {_NL} || {_NL} order by place) as context
    from ({{order}}) o join {CHUNKS} c using (vec_id) where (query_id // {V.EVERY}) % 7 <> 3 group by query_id) b using (query_id)
"""


def incomplete_guides(spark, sf_dir):
    """Guides got in part that a question names, here the nearest; every third asks for credits, every third names a longer word."""
    c = chunks(spark, sf_dir)
    i = F.expr(f"query_id div {V.EVERY}") % 3
    context = V.top_k(V.probe_set(c), c, 20).join(c.select("vec_id", "origin", "name", "degrees", "chunk_index", "total_chunks"), "vec_id")
    nearest = context.where("origin = 'guia'").groupBy("query_id").agg(F.min_by("name", "rank").alias("unit"))
    question = F.concat(F.when(i == 1, "¿Cuántos créditos tiene ").otherwise("¿Qué tal es "), "unit", F.when(i == 2, "0?").otherwise("?"))
    return V.incomplete_guides(nearest.select("query_id", question.alias("question")), context)


def suggestions(spark, sf_dir):
    """Templates turned by the round, two from the scope and one for each other degree, four at most, with support only."""
    c = chunks(spark, sf_dir)
    have = c.select(F.explode("degrees").alias("degree"), "kind").distinct()
    templates = spark.createDataFrame([(i, "OB" if i % 2 else "OP", f"plantilla {i}") for i in range(10)], "t int, kind string, template string")
    turns = spark.createDataFrame([(t, f"L{t}") for t in range(6)], "turn int, scope string")
    pair = turns.join(F.broadcast(templates)).join(have, "kind")
    pair = pair.where(F.col("t") != F.col("turn") * 3 % 10)  # what was just asked
    pair = pair.withColumn("place", (F.col("t") + F.col("turn")) % 10).withColumn("own", F.col("degree") == F.col("scope"))
    w = Window.partitionBy("turn", "degree").orderBy("place")
    kept = pair.withColumn("nth", F.row_number().over(w)).where("nth <= case when own then 2 else 1 end")
    v = Window.partitionBy("turn").orderBy(F.desc("own"), "place", "degree")
    return kept.withColumn("position", F.row_number().over(v)).where("position <= 4").select("turn", "position", "degree", "template")


_TEMPL = "(select i as t, case when i % 2 = 1 then 'OB' else 'OP' end as kind, 'plantilla ' || i as template from range(10) s(i))"


def embedded_documents(spark, sf_dir):
    """The injected embedder over whole texts, in batches."""
    out = V.embed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("embedding").alias("dims"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))


_INDEXED = _dist(from_="x")[len("d as (") : -1]
QUERIES = {f.__name__: f for f in (vector_topk, vector_rank, vector_topk_prefilter, membership_vs_substring, resolve_name, vector_band, retrieve_context, vector_interleave, prefilter_probe, fidelity, norm_check, structural_scan, existence_count, context_order, prompt_assembly, incomplete_guides, suggestions, embedded_documents)}
_N = "sqrt(list_inner_product(embedding::double[], embedding::double[]))"
_FILTER = "list_has_any(degrees, ['L1', 'L2x', 'L5']) and starts_with(lower(year), 'tercer') and kind = 'OB'"
ORACLES = {
    "vector_topk": f"{BASE} select query_id, vec_id, label, distance, rank from r where rank <= 10",
    "vector_rank": f"{BASE} select query_id, vec_id, distance, rank from r where rank <= 100",
    "vector_topk_prefilter": f"with {_Q}, {_dist(_FILTER)}, {_R} select query_id, vec_id, distance, rank from r where rank <= 10",
    "membership_vs_substring": f"select kind, count(*) filter (where list_contains(degrees, 'L1')) as exact, count(*) filter (where s) as by_substring, count(*) filter (where s and not list_contains(degrees, 'L1')) as false_positives from (select *, len(list_filter(degrees, lambda d: contains(d, '1'))) > 0 as s from {CHUNKS}) group by kind",
    "resolve_name": f"with c as (select distinct p_name as name from part), w as (select wanted, {NORMAL.format('wanted')} as w from {_WANTED}), e as (select wanted, name, w from w join c on w = {NORMAL.format('name')}) select wanted, name from e union all select wanted, name from w join c on contains({NORMAL.format('name')}, w) where w not in (select w from e)",
    "vector_band": f"with {_Q}, {_dist()}, {_R}, {_BAND.format(key='query_id')} select query_id, vec_id, distance, rank from b where {_KEEP.format(floor=FLOOR)}",
    "retrieve_context": (
        f"with {_Q}, {_dist("kind = 'OP'")}, {_R}, {_BAND.format(key='query_id')}, a as (select query_id, {_ADVICE} as advice from {_ASKING}), "
        f"k as (select query_id, vec_id, distance, rank from b where {_KEEP.format(floor=NARROW)}), e as (select query_id from a where not advice and query_id not in (select query_id from k)) "
        "select k.*, 'own' as way from k join a using (query_id) where not advice "
        f"union all select query_id, vec_id, distance, rank, 'advice' from r join a using (query_id) where advice and rank <= {X.K_MOST} "
        f"union all select e.query_id, vec_id, distance, rank, 'fallback' from e join k on k.query_id = e.query_id - {V.EVERY}"
    ),
    "vector_interleave": f"with {_Q}, {_dist()}, s as ({_SCOPES}), o as (select *, row_number() over (partition by query_id, origin, name, degrees, chunk_index order by rank, scope) as seen from s), p as (select *, row_number() over (partition by query_id order by rank, scope) as position from o where seen = 1) select query_id, position, vec_id, scope, rank, distance from p where position <= {X.K_MOST}",
    "prefilter_probe": f"{BASE}, g as (select label, count(*) as members from embeddings group by label having count(*) >= 10) select query_id, g.label, members from q, g where not exists (select 1 from r where r.query_id = q.query_id and r.label = g.label and rank <= 10)",
    "fidelity": (
        f"{BASE}, x as (select vec_id, list_transform(embedding, lambda x: round(x::double * 15) / 15) as embedding from embeddings), g as ({_INDEXED}), "
        "e as (select *, row_number() over (partition by query_id order by distance, vec_id) as er from g) "
        "select r.query_id, round(count(e.vec_id) / 10, 6) as fidelity from r left join e on r.query_id = e.query_id and r.vec_id = e.vec_id and er <= 10 where r.rank <= 10 group by r.query_id"
    ),
    "norm_check": f"select round(min(n), 6) as least, round(max(n), 6) as largest, stddev_pop(n) < 1e-5 and abs(avg(n) - 1) < 1e-5 as normalised from (select {_N} as n from embeddings)",
    "structural_scan": f"select vec_id, name, year from {CHUNKS} where list_contains(degrees, 'L3') and starts_with(lower(year), 'primer')",
    "existence_count": f"with w(degree, kind) as (values ('L1', 'OB'), ('L9x', 'OP'), ('L77', 'OB')), h as (select d as degree, kind, count(*) as n from (select unnest(degrees) as d, kind from {CHUNKS}) group by all) select w.degree, w.kind, coalesce(n, 0) as n, n is not null as present from w left join h on w.degree = h.degree and w.kind = h.kind",
    "context_order": f"{BASE}, u as (select *, case when origin = 'plan' then 'true:' || degrees[1] else 'false:' || name end as unit from r where rank <= 20), m as (select *, min(distance) over (partition by query_id, unit) as best from u) select query_id, vec_id, unit, best, row_number() over (partition by query_id order by best, unit, case when origin = 'plan' then {_YEAR_PLACE} else 0 end, rank) as place from m",
    "incomplete_guides": (
        f"{BASE}, g as (select * from r where rank <= 20 and origin = 'guia'), p as (select query_id, name, degrees from g group by all having count(distinct chunk_index) < max(total_chunks)), "
        f"u as (select query_id, arg_min(name, rank) || case when (query_id // {V.EVERY}) % 3 = 2 then '0' else '' end as unit from g group by query_id) "
        f"select distinct p.query_id, name from p join u on u.query_id = p.query_id and name = unit where (p.query_id // {V.EVERY}) % 3 <> 1"
    ),
    "suggestions": f"with h as (select distinct d as degree, kind from (select unnest(degrees) as d, kind from {CHUNKS})), p as (select s.i as turn, degree, template, (t + s.i) % 10 as place, degree = 'L' || s.i as own from range(6) s(i), {_TEMPL} m join h using (kind) where t <> s.i * 3 % 10), k as (select *, row_number() over (partition by turn, degree order by place) as nth from p), v as (select *, row_number() over (partition by turn order by own desc, place, degree) as position from k where nth <= case when own then 2 else 1 end) select turn, position, degree, template from v where position <= 4",
}
ORACLES["prompt_assembly"] = _PROMPT.format(order=ORACLES["context_order"])
