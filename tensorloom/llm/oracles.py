"""DuckDB SQL for the results of those queries that SQL can express, by plain comparison of everything with everything."""

from __future__ import annotations

import string

_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORD = r"'[^\x20\x09-\x0D]+'"
#: The least node that links lead to, by following them from every node.
_REACHED = "r as (select a, b from links union select r.a, l.b from r join links l on r.b = l.a), component as (select a, min(b) as least from r group by a)"

EMBEDDING_DEDUP = f"""with recursive u as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select x.vec_id as a, y.vec_id as b from u x join u y on x.vec_id <> y.vec_id and len(x.e) = len(y.e)
where list_inner_product(x.e, y.e) / (sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))) >= 0.95), {_REACHED},
n as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(least, vec_id)) as component_id, vec_id <= coalesce(least, vec_id) as kept
from embeddings left join n on n.a = vec_id left join component c on c.a = vec_id"""

BALL_SEARCH = """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, x.vec_id, list_inner_product(q.e, x.e)::bigint as score from v q join v x on q.vec_id <> x.vec_id and len(q.e) = len(x.e) where q.vec_id % 20 = 0),
o as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from o where rank <= 20"""

_WORDS = f"d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) as w from documents)"
#: Every window of 50 words, with the least document that has it.
_WINDOWS = f"""{_WORDS}, s as (select doc_id, unnest(range(greatest(len(w) - 49, 0))) as i, w from d),
k as materialized (select doc_id, i, sha256(array_to_string(w[i + 1 : i + 50], ' ')) as k from s), f as (select k, min(doc_id) as first from k group by k),
repeats as materialized (select doc_id, i, first from k join f using (k) where first < doc_id)"""

SUFFIX_DEDUP = f"""with {_WINDOWS}, g as (select *, i - row_number() over (partition by doc_id, first order by i) as island from repeats)
select doc_id, first as first_doc_id, min(i) as start_word, max(i) + 50 as end_word from g group by doc_id, first, island"""

SUBSTRING_DEDUP = f"""with {_WINDOWS}, p as (select doc_id, unnest(w) as word, unnest(range(len(w))) as i from d),
c as (select p.doc_id, p.i, word, max(r.i) over (partition by p.doc_id order by p.i) as last from p left join repeats r on r.doc_id = p.doc_id and r.i = p.i),
e as (select doc_id, count(*) filter (last >= i - 49) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (last is null or last < i - 49), '') as kept from c group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join e on e.doc_id = d.doc_id"""

NEAR_DUP = f"""with recursive d as (select doc_id, regexp_extract_all(coalesce({_LOWER}, ''), {_WORD}) as w from documents),
s as materialized (select distinct doc_id, sha256(case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i + 1 : i + 5], ' ') end) as k
from (select doc_id, w, unnest(range(case when len(w) = 0 then 0 else greatest(len(w) - 4, 1) end)) as i from d)),
z as materialized (select doc_id, count(*) as n from s group by doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as common from s x join s y on x.k = y.k and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id),
links as materialized (select a, b from c join z p on p.doc_id = a join z q on q.doc_id = b where 100 * common >= 75 * (p.n + q.n - common)),
{_REACHED}
select d.doc_id, coalesce(z.n, 0) as n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) as component_id, d.doc_id <= coalesce(least, d.doc_id) as kept
from d left join z on z.doc_id = d.doc_id left join component c on c.a = d.doc_id"""

#: Of op1: the base model's counts and score.
LM_BASE = f"""with recursive bits(n) as (select 0 union all select n + 1 from bits where n < 7), crc0 as (select b::ubigint as b, 0 as k, b::ubigint as c from range(256) t(b)),
crc as (select * from crc0 union all select b, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end from crc where k < 8), t as materialized (select list(c order by b) as t from crc where k = 8),
h as (select doc_id, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(split(doc_id::varchar, ''), lambda x: ascii(x)::ubigint)), lambda a, x: xor(a // 256, t[((xor(a, x) % 256) + 1)::bigint])), 4294967295::ubigint) % 5 = 1 as held_out from documents, t),
d as (select doc_id, unnest(list_append(regexp_extract_all(coalesce({_LOWER}, ''), {_WORD}), ' ')) as w from documents),
c as materialized (select w, count(*) as c from d join h using (doc_id) where not held_out group by w), m as materialized (select sum(c) as n, count(*) as v from c)
select d.doc_id, any_value(held_out) as held_out, count(*) as n_tokens, count(c.c) as n_known, any_value(m.n)::bigint as train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.5) / (m.n + 0.5 * (m.v + 1)))), 4) as base_score
from d join h using (doc_id) left join c using (w), m group by d.doc_id"""

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: str, place: int, pattern: str, keep: str) -> str:
    """Matches with their places: what stands before a match are the gaps and matches before it."""
    return f"""select doc_id, '{kind}' as kind, {place} as place, m, (list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k-1], lambda x: length(x))), 0))::bigint as start
from (select doc_id, found, gaps, unnest(found) as m, unnest(range(1, len(found) + 1)) as k from (select doc_id, regexp_extract_all(t, '{pattern}') as found, regexp_split_to_array(t, '{pattern}') as gaps from x)) where {keep}"""


#: Of op8: the fixed patterns' counts and places.
SECRET_BASE = f"""with x as (select doc_id, coalesce(text, '') as t from documents),
f as ({_matches('assign', 0, _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6")} union all {_matches('access', 1, 'AKIA[A-Z0-9]+', 'length(m) >= 20')} union all {_matches('hex', 2, '[0-9a-f]+', 'length(m) >= 24')}),
g as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex, string_agg(kind || ':' || start || ':' || (start + length(m)), ',' order by start, place) as spans from f group by doc_id)
select x.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256 from x left join g on g.doc_id = x.doc_id"""

SQL = {
    "op2_embedding_dedup": EMBEDDING_DEDUP, "op4_ball_search": BALL_SEARCH, "op5_suffix_dedup": SUFFIX_DEDUP, "op7_near_dup": NEAR_DUP, "op9_substring_dedup": SUBSTRING_DEDUP,
    "lm_base_scores": LM_BASE, "secret_base_spans": SECRET_BASE,
}
