"""Parts of the catalogue's SQL."""

from __future__ import annotations

import numpy as np

from ..functions.expressions import varint_bases


def stored(quality: float) -> str:
    """A quality as streams store it, a double literal."""
    return f"{float(np.float32(quality))!r}::double"


def quantised(value: str, quality: float) -> str:
    return f"round_even({value} / {stored(quality)}, 0)::bigint"


def varint(v: str) -> str:
    return "case " + " ".join(f"when {v} < {b} then {n}" for n, b in enumerate(varint_bases()[1:], 1)) + " else 9 end"


def width(v: str) -> str:
    return f"case when {v} = 0 then 0 else length(bin({v})) end::int"


def packed(n: str, w: str) -> str:
    """By the rule itself: of the word sizes that hold the width, the one that wastes least."""
    bits = f"(select arg_min(s, ((s % {w}) * (64 // s)) * 100 + s) from (values (8), (16), (32), (64)) v(s) where s >= {w})"
    return f"case when {w} = 0 then 0 when {w} = 1 then ({n} + 7) // 8 else (({n} + {bits} // {w} - 1) // ({bits} // {w})) * ({bits} // 8) end"


def intify(n: str, w: str) -> str:
    return f"(13 + {varint(n)} + {packed(n, w)})::bigint"


def stream(n: str, w: str, item: int) -> str:
    """Bytes with the codec byte and, for quantised payloads, their length's."""
    size = intify(n, w)
    return f"(case when {n} * {item} <= {size} then 1 + {n} * {item} else 1 + {varint(size)} + {size} end)::bigint"


#: 64 components are whole samples of four; of three, the last is in a series of its own.
EMB4 = "emb4 as (select vec_id as vertex, (i // 4)::int as sample, (i % 4)::int as coord, x::double as value from (select vec_id, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings))"
EVT = "evt as (select user_id as vertex, value, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as sample from events)"
_LI = "l_suppkey as vertex, (row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1)::int as sample"
LI = f"lr as (select {_LI}, l_quantity, l_extendedprice, l_discount from lineitem), li as (select vertex, sample, 0 as coord, l_quantity + 0.0 as value from lr union all select vertex, sample, 1, l_extendedprice + 0.0 from lr union all select vertex, sample, 2, l_discount + 0.0 from lr)"


def EVT_DELTA(quality: float) -> str:
    return f"{EVT}, q as (select *, {quantised('value', quality)} as quantised from evt), d as (select *, quantised - coalesce(lag(quantised) over (partition by vertex order by sample), 0) as delta from q)"


def LI_DELTA(quality: float) -> str:
    return f"{LI}, q as (select *, {quantised('value', quality)} as quantised from li), d as (select *, quantised - coalesce(lag(quantised) over (partition by vertex, coord order by sample), 0) as delta from q)"


HEAD = f"h as (select vertex, count(*) as n, min(delta) as base, {width('max(delta) - min(delta)')} as width from d group by vertex)"
