"""Queries on the chunking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import fixed as X
from talus.operators import chunking as K
from talus.session import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _units(spark, sf_dir):
    header = F.concat(F.lit("«"), "lang", F.lit("» "), "source").alias("header")
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("key"), header, "text")


def structural_chunks(spark, sf_dir):
    """Whole texts to chunks under a header (language and source)."""
    return K.structural_chunks(_units(spark, sf_dir))


def split_pieces_audit(spark, sf_dir):
    """Every chunk within the limit, numbered from 0, and no character but white space lost."""
    made = structural_chunks(spark, sf_dir)
    body = F.regexp_replace(F.regexp_replace("chunk", "^[^\n]*\n", ""), "[ \\t\\n\\x0B\\f\\r]", "")
    got = made.groupBy("key").agg(F.sum(F.char_length(body)).alias("kept"), F.max(F.char_length("chunk")).alias("longest"), (F.max("chunk_index") + 1 == F.count("*")).alias("contiguous"), F.max("total_chunks").alias("total"), F.count("*").alias("n"))
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("key"), F.char_length(F.regexp_replace("text", "[ \\t\\n\\x0B\\f\\r]", "")).alias("had"))
    return docs.join(got, "key", "left").select(F.col("key").alias("doc_id"), (F.coalesce("kept", F.lit(0)) == F.col("had")).alias("whole"), (F.coalesce("longest", F.lit(0)) <= X.CHUNK_MAX).alias("bounded"), F.coalesce("contiguous", F.lit(True)).alias("contiguous"), F.coalesce(F.col("total") == F.col("n"), F.lit(True)).alias("counted"))


def greedy_pack(spark, sf_dir):
    """Lines packed to 900 characters, as a fold."""
    packed = K.greedy_pack(F.filter(F.split("text", "\n"), lambda x: x != ""), X.CHUNK_MAX)
    out = _docs(spark, sf_dir).select("doc_id", F.posexplode(packed).alias("chunk_index", "c"))
    return out.select("doc_id", "chunk_index", F.col("c.n").alias("pieces"), F.char_length("c.chunk").alias("chars"))


def fixed_window_overlap(spark, sf_dir):
    return K.fixed_windows(_docs(spark, sf_dir).select("doc_id", "text"), "text", 600, 0.2).select("doc_id", "start", F.md5("chunk").alias("chunk"))


def _pieces(spark, sf_dir):
    """Vectors as the pieces of units of ten."""
    emb = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 10").alias("unit"), F.col("vec_id").alias("pos"), "embedding")
    return K.neighbour_distances(emb, "unit", "pos")


def _thresholds(pieces):
    return pieces.agg(F.percentile("distance", F.array(*map(F.lit, (0.3, 0.5, 0.7)))).alias("p"))


def semantic_threshold(spark, sf_dir):
    p = _thresholds(_pieces(spark, sf_dir))
    return p.select(*[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p30", "p50", "p70"))])


def semantic_groups(spark, sf_dir):
    pieces = _pieces(spark, sf_dir)
    both = pieces.crossJoin(F.broadcast(_thresholds(pieces)))  # one row
    out = K.semantic_groups(both, "unit", "pos", F.col("p")[1])
    return out.groupBy("unit", "group").agg(F.count("*").alias("pieces"), F.min("pos").alias("first"))


SIZES, SHARES = (600, 900, 1200, 1500, 1800), (0.3, 0.5, 0.7)
#: Five limits, for each three settings of three strategies: share of the limit aimed at, percentile of the cut, overlap.
SETTINGS = {"structural": (0.6, 0.8, 1.0), "semantic": tuple(100 * s for s in SHARES), "fixed": (0.0, 0.1, 0.2)}
GRID = [(most, way, setting) for most in SIZES for way, settings in SETTINGS.items() for setting in settings]


def fixed_chunks(spark, sf_dir):
    """Whole texts to windows that overlap by a fifth, under their header."""
    return K.fixed_chunks(_units(spark, sf_dir), 0.2)


def semantic_chunks(spark, sf_dir):
    """Whole texts cut at distances from the median on."""
    units = _units(spark, sf_dir)
    (threshold,) = K.distance_percentiles(units, [X.CHUNK_MAX], [0.5])[X.CHUNK_MAX]
    return K.semantic_chunks(units, threshold)


def chunk_grid(spark, sf_dir):
    """All documents chunked under the 45 configurations, with the figures of each."""
    units = _units(spark, sf_dir)
    found = K.distance_percentiles(units, list(SIZES), list(SHARES))
    cuts = {(most, setting): p for most, ps in found.items() for setting, p in zip(SETTINGS["semantic"], ps, strict=True)}
    return K.run_grid(units, GRID, cuts)


def chunk_grid_audit(spark, sf_dir):
    """Of each configuration the texts it chunked, the characters in its chunks, and whether all chunks keep to the limit."""
    figures = chunk_grid(spark, sf_dir)
    return figures.select("most", "strategy", "setting", "texts", "chars", (F.col("longest") <= F.col("most")).alias("bounded"))


def truncation_audit(spark, sf_dir):
    return K.truncation_audit(_docs(spark, sf_dir), "text", 512)


def chunk_numbering(spark, sf_dir):
    """Windows numbered within their text, with the total."""
    from pyspark.sql import Window

    w = K.fixed_windows(_docs(spark, sf_dir).select("doc_id", "text"), "text", 900, 0.0)
    return w.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1).alias("chunk_index"), F.count("*").over(Window.partitionBy("doc_id")).alias("total_chunks"), F.char_length("chunk").alias("chars"))


_WINDOWS = "(select doc_id, start, trim(substr(text, start + 1, {w}), chr(32) || chr(10) || chr(9) || chr(13)) as chunk from (select doc_id, text, unnest(range(0, length(text), {s})) as start from documents where length(text) > 0))"
_PIECES = (
    "p as (select vec_id // 10 as unit, vec_id as pos, embedding::double[] as e from embeddings), "
    "n as (select unit, pos, abs(round(1 - list_inner_product(e, b) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(b, b))), 6)) as distance from (select *, lag(e) over (partition by unit order by pos) as b from p)), "
    "t as (select quantile_cont(distance, 0.3) as p30, quantile_cont(distance, 0.5) as p50, quantile_cont(distance, 0.7) as p70 from n)"
)
_BLANKS = "'[ \\t\\n\\x0B\\f\\r]'"
_SETTING_ROWS = ", ".join(f"('{w}', {s}::double)" for w, settings in SETTINGS.items() for s in settings)
# no characters are lost or doubled but by the overlap of windows, whose width the header makes
_GRID_AUDIT = f"""
with d as (select doc_id, text, 4 + length(lang) + length(source) as before from documents where regexp_replace(text, {_BLANKS}, '', 'g') <> ''),
s as (select unnest({list(SIZES)}) as most),
w as (select strategy, setting from (values {_SETTING_ROWS}) t(strategy, setting)),
f as (select most, setting, doc_id, text, most - before as width from d, s, w where strategy = 'fixed'),
p as (select most, setting, doc_id, text, width, unnest(range(0, length(text), width - floor(width * setting)::bigint)) as start from f),
x as (select most, 'fixed' as strategy, setting, count(distinct doc_id) as texts, sum(length(regexp_replace(substr(text, start + 1, width), {_BLANKS}, '', 'g')))::bigint as chars from p group by all),
o as (select count(*) as texts, sum(length(regexp_replace(text, {_BLANKS}, '', 'g')))::bigint as chars from d)
select *, true as bounded from (select * from x union all select most, strategy, setting, texts, chars from o, s, w where strategy <> 'fixed')
"""
QUERIES = {f.__name__: f for f in (structural_chunks, split_pieces_audit, greedy_pack, fixed_window_overlap, fixed_chunks, semantic_threshold, semantic_groups, semantic_chunks, chunk_grid, chunk_grid_audit, truncation_audit, chunk_numbering)}
ORACLES = {
    "split_pieces_audit": "select doc_id, true as whole, true as bounded, true as contiguous, true as counted from documents",
    "greedy_pack": (
        "with recursive l as (select doc_id, i, length(x) as n from (select doc_id, unnest(ls) as x, unnest(range(len(ls))) as i from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') as ls from documents))), "
        f"f as (select doc_id, i, n as held, 0 as c from l where i = 0 union all select l.doc_id, l.i, case when held + 1 + n <= {X.CHUNK_MAX} then held + 1 + n else n end, case when held + 1 + n <= {X.CHUNK_MAX} then c else c + 1 end from f join l on l.doc_id = f.doc_id and l.i = f.i + 1) "
        "select doc_id, c as chunk_index, count(*) as pieces, max(held) as chars from f group by doc_id, c"
    ),
    "fixed_window_overlap": f"select doc_id, start, md5(chunk) as chunk from {_WINDOWS.format(w=600, s=480)} where chunk <> ''",
    "semantic_threshold": f"with {_PIECES} select round(p30, 6) as p30, round(p50, 6) as p50, round(p70, 6) as p70 from t",
    "semantic_groups": f"with {_PIECES}, g as (select unit, pos, sum(case when distance >= p50 then 1 else 0 end) over (partition by unit order by pos) as grp from n, t) select unit, grp as \"group\", count(*) as pieces, min(pos) as first from g group by unit, grp",
    "chunk_grid_audit": _GRID_AUDIT,
    "truncation_audit": "select count(*) as texts, count(*) filter (where n > 510) as truncated, round(sum(least(n, 510)) / sum(n), 6) as share_read from (select len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) as n from documents)",
    "chunk_numbering": f"select doc_id, row_number() over (partition by doc_id order by start) - 1 as chunk_index, count(*) over (partition by doc_id) as total_chunks, length(chunk) as chars from {_WINDOWS.format(w=900, s=900)} where chunk <> ''",
}
