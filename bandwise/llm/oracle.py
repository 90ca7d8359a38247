"""DuckDB SQL of the queries that SQL can express, written from the contracts."""

from __future__ import annotations

_FOLD = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as bigint) as size,
    case when coalesce(length(text), 0) = 0 then 1.0::double else 1.0::double / (1.0::double + 20.0::double
      * (length(text) - length(translate(text, '!*$%&#|<>{{}}[]^~=\', ''))) / length(text)) end as weight,
    (('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u
  from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w, 3 * source_size as cap,
    sum(source_size) over () as total from s0),
s2 as (select *,
    total - coalesce(sum(cap) over (order by cap::double / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as room,
    sum(w) over (order by cap::double / w, source nulls last rows between current row and unbounded following) as weights from s1),
s3 as (select *, room * w >= cap * weights as is_full from s2),
s4 as (select *, max(case when not is_full then room::double / weights::double end) over () as level from s3),
s as (select source, source_size, case when is_full then cap::double else w * level end as target from s4),
e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from s),
k as (select d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest, -ln(u) / weight as key,
    coalesce(doc_id, 9223372036854775807) as place
  from d join e on d.source is not distinct from e.source),
g as (select source, key, place, size, any_value(rest) as rest, sum(size) as words from k group by source, key, place, size),
p as (select *, coalesce(sum(words) over (partition by source order by key, place, size rows between unbounded preceding and 1 preceding), 0) as ahead from g)
select k.doc_id, k.size, k.source_size, k.target,
  k.size * (k.epochs + (2 * p.ahead + p.words <= 2 * p.rest)::bigint) as taken
from k join p on k.source is not distinct from p.source and k.key = p.key and k.place = p.place and k.size = p.size
"""

OP2 = rf"""
with l as (
  select doc_id, hash(text) as th, row_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from (select *, row_number() over () as row_id from documents)),
k as (select *, {_FOLD.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key,
    coalesce(doc_id, 9223372036854775807) as d from l),
f as (select key, min(d) as first from k where length(key) >= 10 group by key having count(distinct d) >= 2),
m as (select k.*, f.first is not null and k.d <> f.first as lost from k left join f on k.key = f.key)
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count(*) filter (lost)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) as kept_sha256
from m group by row_id
"""

OP8 = rf"""
with words as (
  select kind, id, row_id, list_filter(regexp_split_to_array({_FOLD.format('text')}, '{_BLANK}+'), lambda x: x <> '') as w from (
    select 'd' as kind, doc_id as id, row_number() over () as row_id, text from documents union all
    select 'i', item_id, row_number() over (), text from benchmark)),
grams as (
  select distinct kind, id, row_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end) as g from words),
i as (select *, count(*) over (partition by row_id) as n_item from grams where kind = 'i'),
hits as (
  select d.id as doc_id, d.row_id as dr, i.id as item_id, i.row_id as ir, i.n_item, count(*) as n_shared
  from grams d join i on d.g = i.g where d.kind = 'd' group by all)
select doc_id, item_id, n_item::bigint as n_item, max(n_shared)::bigint as n_shared from hits
where 100 * n_shared >= 80 * n_item group by doc_id, item_id, n_item
"""



def _lloyd(rounds: int = 10) -> str:
    """One pair of steps (assign, mean) a round; ``c`` rows hold a centroid's number and integer components."""
    steps = ["""
kept as materialized (
  select vec_id, row_number() over () as rid, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (
  select row_number() over (order by sha256('3:' || vec_id), v) - 1 as c, v from kept
  qualify row_number() over (order by sha256('3:' || vec_id), v) <= 8)"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} as materialized (
  select rid, vec_id, kept.v, c, d from (
    select rid, vec_id, kept.v, c.c, list_sum(list_transform(range(1, 65), lambda j: (kept.v[j] - c.v[j]) * (kept.v[j] - c.v[j])))::bigint as d
    from kept, c{i} c) kept
  qualify row_number() over (partition by rid order by d, c) = 1)""")
        if i < rounds:
            steps.append(f"""
m{i} as (
  select c, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as v from (
    select c, j, sum(x) as s, count(*) as n from (select c, unnest(v) as x, generate_subscripts(v, 1) as j from a{i}) group by c, j) group by c),
c{i + 1} as materialized (select c{i}.c, coalesce(m{i}.v, c{i}.v) as v from c{i} left join m{i} using (c))""")
    return "with" + ",".join(steps) + f"""
select vec_id, a.c::int as cluster, d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia,
  (sum(d) over ())::bigint as inertia, sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256
from a{rounds} a join c{rounds} on a.c = c{rounds}.c
"""


ORACLE: dict[str, str] = {"op1_mixing": OP1, "op2_line_dedup": OP2, "op8_decontamination": OP8, "op13_centroid_clustering": _lloyd()}
