"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import centroids, divergence, lines
from . import quality as q

WS = r"[\x20\x09-\x0D]+"
_WORDS = "list_filter(string_split_regex({0}, '" + WS + "'), lambda x: x <> '')"

NEARDUP = f"""
with recursive w as (
  select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as sh from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as c, md5(string_agg(sh, chr(10) order by sh)) as print from s group by 1),
cls as (select *, min(doc_id) over (partition by print) as class_id from n),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.sh = y.sh and x.doc_id < y.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.c + y.c - shared)),
edges as (select a, b from links union all select b, a from links),
reach as (select a as d, b as r from edges union select reach.d, edges.b from reach join edges on edges.a = reach.r),
comp as (select d, min(r) as r from reach group by 1)
select w.doc_id, coalesce(cls.c, 0) as n_shingles, least(w.doc_id, comp.r) as component_id, least(w.doc_id, comp.r) = w.doc_id as kept, coalesce(cls.class_id, w.doc_id) as class_id
from w left join cls using (doc_id) left join comp on comp.d = w.doc_id
"""


def _distance(p: str, r: str, n: int) -> str:
    u, v = f"({p}[i] / (list_sum({p})::double))", f"({r}[i] / (list_sum({r})::double))"
    term = f"case when {p}[i] > 0 then {u} * log2(2 * {u} / ({u} + {v})) else 0 end + case when {r}[i] > 0 then {v} * log2(2 * {v} / ({u} + {v})) else 0 end"
    return f"case when list_sum({p}) > 0 and list_sum({r}) > 0 then sqrt(greatest(list_sum(list_transform(range(1, {n + 1}), lambda i: {term})) / 2, 0)) end"


def _quality() -> str:
    without = lambda p: f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))"
    count = lambda w: f"(length(s) - length(replace(s, ' {w} ', ''))) // {len(w) + 2}"
    common = " ".join(f"when lang = '{k}' then [{', '.join(map(count, ws))}]" for k, ws in q.COMMON.items())
    return f"""
with t as (select doc_id, lang, coalesce(text, '') as t, {_WORDS.format("coalesce(text, '')")} as w from documents),
tri as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from t where len(w) >= 3)),
rep as (select doc_id, count(distinct i + k) as n from (select doc_id, i, count(*) over (partition by doc_id, g) as c from tri), (select unnest([0, 1, 2]) as k) where c > 1 group by 1),
b as (select doc_id, lang, t, '  ' || lower(regexp_replace(t, '[^\\p{{L}}]+', '  ', 'g')) || '  ' as s, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
  {without('[#*$%&|<>]+')} as n_symbols, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines,
  {without('\\p{Lu}+')} as c1, {without('\\p{Ll}+')} as c2, {without('\\p{Nd}+')} as c3, {without('\\p{P}+')} as c4 from t),
m as (select *, len(lines) - len(list_distinct(lines)) as n_dup_lines, [c1, c2, c3, c4, length(t) - word_chars, greatest(length(t) - (c1 + c2 + c3 + c4 + length(t) - word_chars), 0)] as cls,
  case {common} end as com from b),
h as (select * exclude (com), case when com is not null then list_append(com, greatest(n_words - list_sum(com), 0)::bigint) end as com from m),
r as (select lang as rl, sum(n_words) as rw, [{', '.join(f'sum(cls[{i}])' for i in range(1, 7))}] as rc, [{', '.join(f'sum(com[{i}])' for i in range(1, 14))}] as rm from h group by 1),
d as (select h.*, rw, coalesce(rep.n, 0) as n_repeat_words,
  case when n_words >= {q.CLASS_WORDS} and rw >= {q.REFERENCE_WORDS} then {_distance('cls', 'rc', 6)} end as cd, case when n_words >= {q.WORD_WORDS} and rw >= {q.REFERENCE_WORDS} and com is not null then {_distance('com', 'rm', 13)} end as wd
  from h left join rep using (doc_id) left join r on h.lang is not distinct from r.rl),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from d)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(cd <= case when n_words < {q.WORD_WORDS} then {q.SHORT_LIMIT} else {q.CLASS_LIMIT} end, true) and coalesce(wd <= {q.WORD_LIMIT}, true) as kept,
  round(cd, 6) as class_distance, round(wd, 6) as word_distance, rw::bigint as reference_words from f
"""


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES = f"""
with l as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
e as (select r, doc_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from l),
k as (select *, {_LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} as key from e),
f as (select key, max(doc_id) as last from k where length(key) >= {lines.MIN_CHARS} group by key having count(distinct coalesce(doc_id, -1)) >= {lines.MIN_DOCS})
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from (select k.*, f.key is not null and doc_id is distinct from last as gone from k left join f using (key)) group by r, doc_id
"""


def _centroids() -> str:
    """Ten rounds, a step of the query each."""
    k, n = centroids.K, centroids.DIM
    steps = [f"""v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::double)::bigint) as x from embeddings
  where len(embedding) = {n} and len(list_filter(embedding, lambda x: isfinite(x))) = {n}),
c0 as materialized (select row_number() over (order by sha256('{centroids.SALT}' || vec_id), x) - 1 as c, x from v order by 1 limit {k})"""]
    for i in range(centroids.ROUNDS + 1):
        away = f"list_sum(list_transform(range(1, {n + 1}), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j])))::bigint"
        steps.append(f"a{i} as materialized (select r, any_value(vec_id) as vec_id, any_value(x) as x, min(struct_pack(d := d, c := c)) as m from (select v.r, vec_id, v.x, c.c, {away} as d from v cross join c{i} c) group by r)")
        if i < centroids.ROUNDS:
            steps.append(f"""s{i} as (select c, j, sum(x[j])::hugeint as s, count(*) as n from (select m.c as c, x, unnest(range(1, {n + 1})) as j from a{i}) group by all),
c{i + 1} as materialized (select c.c, coalesce(any_value(y.x), any_value(c.x)) as x from c{i} c left join (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as x from s{i} group by c) y on y.c = c.c group by c.c)""")
    last = centroids.ROUNDS
    return "with " + ",\n".join(steps) + f"""
select vec_id, m.c::int as cluster, m.d as distance, (sum(m.d) over (partition by m.c))::bigint as cluster_inertia, (sum(m.d) over ())::bigint as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{last} a join c{last} c on c.c = a.m.c"""


_d = divergence
_SHARE = "(1 + ({0}::hugeint * {1}) // ({2} + {3}))::bigint"
AUDIT = f"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, {_LOWER.format("coalesce(text, '')")} as t from documents),
w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
k as materialized (select lang, term from w group by all having count(distinct r) >= {_d.MIN_DOCS}),
v as (select lang, count(*) as v from k group by lang),
g as materialized (select distinct lang, source from d),
n as materialized (select w.lang, w.source, w.term, count(*) as n from w join k using (lang, term) group by all),
dense as (select g.lang, g.source, k.term, coalesce(n.n, 0) as n from g join k using (lang) left join n using (lang, source, term)),
p as materialized (select lang, source, term, n, {_SHARE.format(_d.WHOLE, f"(n + {_d.SMOOTH})", "sum(n) over (partition by lang, source)", f"{_d.SMOOTH} * v")} as p,
  {_SHARE.format(_d.WHOLE, f"(sum(n) over (partition by lang, term) + {_d.SMOOTH})", "sum(n) over (partition by lang)", f"{_d.SMOOTH} * v")} as q from dense join v using (lang)),
pairs as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
  union all select lang, source, 'term', term, p - q from p where n > 0 and p > q)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from every qualify part = 'pair' or rank <= {_d.TOP}
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_divergence_quality": _quality(), "op4_minhash_neardup": NEARDUP, "op11_mph_line_dedup": LINES, "op12_yinyang_centroids": _centroids(), "op13_source_divergence": AUDIT,
    }
