"""DuckDB SQL of the corpus queries that SQL can express over whole tables: quality rules, near-duplicates, substrings.

Tokenizers, rule positions, sampled seatings, packings, fingerprints and hashed permutations have none;
their tests compare with plain versions instead.
"""

from __future__ import annotations

_SPLIT = "[ \\t\\n\\x0B\\f\\r]+"
_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = f"list_filter(string_split_regex({{0}}, '{_SPLIT}'), lambda x: x <> '')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _prior(rule: str) -> str:
    """Mean and strength of a rule's beta prior over the hosts ``h``."""
    m, v = f"greatest(1e-6, least(1 - 1e-6, avg({rule} / n)))", f"var_pop({rule} / n)"
    return f"{m} as m_{rule}, case when {v} > 0 and {v} < {m} * (1 - {m}) then {m} * (1 - {m}) / {v} - 1 when {v} = 0 then 1e6 else 1e-6 end as s_{rule}"


def _rate(rule: str) -> str:
    return f"(h.{rule} + m_{rule} * s_{rule}) / (h.n + s_{rule})"


_RULES = ("short", "repeated", "symbols", "dup_lines")

QUALITY = f"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select doc_id, {_WORDS.format('t')} as ws, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_WS}) <> '') as ls from d),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as k from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
c as (select doc_id, count(distinct i + o) as n from (select doc_id, i, count(*) over (partition by doc_id, k) as m from g), (values (0), (1), (2)) v(o) where m > 1 group by doc_id),
m as (select doc_id, source, len(ws) as n_words, length(translate(t, {_WS}, '')) as word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols,
  len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words from d join w using (doc_id) left join c using (doc_id)),
f as (select *, n_words < 50 as short, 100 * n_repeat_words > 50 * n_words as repeated, 100 * n_symbols > 5 * word_chars as symbols, 100 * n_dup_lines > 30 * n_lines as dup_lines from m),
h as (select source, count(*) as n, {', '.join(f"count(*) filter (where {r}) as {r}" for r in _RULES)} from f where source <> '' group by source),
p as (select {', '.join(map(_prior, _RULES))} from h),
b as (select source as host, {_rate('short')} > 0.8 or {_rate('repeated')} > 0.8 as bad, {_rate('symbols')} > m_symbols * (1 + 1e-9) as bad_symbols, {_rate('dup_lines')} > m_dup_lines * (1 + 1e-9) as bad_lines from h, p),
r as (select f.*, short or repeated as base_failed, coalesce(bad or (symbols and bad_symbols) or (dup_lines and bad_lines), false) as host_rejected from f left join b on source = host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not host_rejected as kept, host_rejected from r
"""

NEAR_DUPLICATES = f"""
with recursive w as (select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as k from (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
e as (select x.a, x.b from (select l.doc_id as a, r.doc_id as b, count(*) as c from s l join s r on l.k = r.k and l.doc_id <> r.doc_id group by 1, 2) x
  join n na on na.doc_id = x.a join n nb on nb.doc_id = x.b where 100 * c >= 80 * (na.n + nb.n - c)),
r as (select doc_id, doc_id as root from documents union select e.b, r.root from r join e on e.a = r.doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.root as component_id, d.doc_id = m.root as kept
from documents d left join n using (doc_id) join (select doc_id, min(root) as root from r group by doc_id) m using (doc_id)
"""


def _islands(window: int) -> str:
    """Maximal removed runs from the starts ``g(doc_id, i)`` of removed windows."""
    return (
        f"o as (select doc_id, i, sum(new) over (partition by doc_id order by i) as island from (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= {window} then 0 else 1 end as new from g)), "
        f"x as (select doc_id, min(i) as a, max(i) + {window} as b from o group by doc_id, island), "
        "y as (select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans from x group by doc_id), "
        "z as (select doc_id, coalesce(lag(b) over w, 1) as a, a as b from x window w as (partition by doc_id order by a))"
    )


SUBSTRINGS = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
v as (select doc_id, i, md5(substr(h, 2 * i - 1, 200)) as k from (select doc_id, h, unnest(range(1, length(h) // 2 - 98)) as i from d where length(h) >= 200)),
g as (select doc_id, i from (select *, row_number() over (partition by k order by doc_id, i) as r from v) where r > 1),
{_islands(100)},
kept as (select doc_id, string_agg(substr(h, 2 * a - 1, 2 * (b - a)), '' order by a) as h from (select z.*, h from z join d using (doc_id) union all select doc_id, max(b), length(any_value(h)) // 2 + 1, any_value(h) from x join d using (doc_id) group by doc_id) group by doc_id)
select d.doc_id, length(d.h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join y using (doc_id) left join kept using (doc_id)
"""

WORD_WINDOWS = f"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as ws from documents),
v as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as k from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from d where len(ws) >= 50)),
g as (select doc_id, i from (select *, min(doc_id) over (partition by k) as first from v) where first < doc_id),
{_islands(50)},
kept as (select doc_id, flatten(list(ws[a:b - 1] order by a)) as ws from (select z.*, ws from z join d using (doc_id) union all select doc_id, max(b), len(any_value(ws)) + 1, any_value(ws) from x join d using (doc_id) group by doc_id) group by doc_id)
select d.doc_id, len(d.ws) as n_words, coalesce(n_removed, 0) as n_removed, sha256(array_to_string(coalesce(kept.ws, d.ws), ' ')) as kept_sha256
from d left join y using (doc_id) left join kept using (doc_id)
"""

LINES = f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from d),
k as (select *, {_LOWER.format(f"trim(line, {_WS})")} as k from l),
c as (select k, max(doc_id) as keeper from k where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
m as (select k.*, keeper is not null and keeper <> doc_id as gone from k left join c using (k))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from m group by doc_id
"""

NEGATIVES = """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select * from r where vec_id % 50 = 0),
p as (select a.vec_id as anchor_id, r.vec_id as positive_id, list_dot_product(a.v, r.v)::bigint as positive_score from a join r on a.label = r.label and a.vec_id <> r.vec_id
  qualify row_number() over (partition by a.vec_id order by positive_score desc, r.vec_id) <= 5),
n as (select a.vec_id as anchor_id, r.vec_id as negative_id, list_dot_product(a.v, r.v)::bigint as negative_score from a join r on a.label <> r.label)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id)::int as rank, negative_id, positive_score, negative_score
from p join n using (anchor_id) where 50 * positive_score <= 100 * negative_score and 100 * negative_score <= 95 * positive_score qualify rank <= 3
"""

SOURCES = f"""
with d as (select row_number() over () as r, {_LOWER.format("coalesce(text, '')")} as t, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
k as (select lang, term from w group by lang, term having count(distinct r) >= 3),
c as (select lang, source, term, count(*) as c from w join k using (lang, term) group by lang, source, term),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v from k group by lang),
x as (select g.lang, g.source, k.term, coalesce(c.c, 0) as c, sum(coalesce(c.c, 0)) over (partition by g.lang, g.source) as n from g join k using (lang) left join c using (lang, source, term)),
p as (select lang, source, term, c, (1 + 1000000000::hugeint * (c + 1) // (n + v)::hugeint)::bigint as p from x join v using (lang)),
q as (select lang, term, (1 + 1000000000::hugeint * (sum(c) + 1)::hugeint // (any_value(ln) + any_value(v))::hugeint)::bigint as q
  from x join v using (lang) join (select lang as l, sum(c) as ln from c group by lang) on l = lang group by lang, term),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
u as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all select lang, source, 'term', term, (p - q) * (p - q) // q from p join q using (lang, term) where c > 0 and p > q)
select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from u qualify part = 'pair' or rank <= 200
"""
