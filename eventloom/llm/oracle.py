"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op10_source_mix"] = r"""
with sized as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as k,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size,
         row_number() over (order by source asc nulls last) - 1 as place
  from sized group by source
), weighed as (
  select *, case place % 3 when 0 then 5 when 1 then 2 else 1 end as weight from sources
), filled as (
  select *, source_size * (10 // weight) as fill from weighed
), levels as (
  select *,
         sum(source_size) over () - 3 * coalesce(sum(source_size) over (order by fill, place rows between unbounded preceding and 1 preceding), 0) as left_words,
         sum(weight) over () - coalesce(sum(weight) over (order by fill, place rows between unbounded preceding and 1 preceding), 0) as left_weight
  from filled
), first_open as (
  select fill as f, place as p, left_words as w, left_weight as lw from levels
  where cast(left_words as double) * weight / left_weight <= 3 * source_size
  order by fill, place limit 1
), target as (
  select source, source_size,
         case when fill < f or (fill = f and place < p) then cast(3 * source_size as double)
              else cast(w as double) * weight / cast(lw as double) end as target
  from levels, first_open
), split as (
  select *, cast(floor(target) as bigint) // greatest(source_size, 1) as epochs,
         cast(floor(target) as bigint) % greatest(source_size, 1) as rest
  from target
), summed as (
  select s.*, coalesce(sum(size) over (partition by source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from sized s
)
select s.doc_id, s.size, t.source_size, t.target,
       cast(t.epochs * s.size + greatest(0, least(s.size, t.rest - s.before)) as bigint) as taken
from summed s join split t on s.source is not distinct from t.source
"""

ORACLE["op8_line_spread"] = r"""
with raw as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null
), trimmed as (
  select *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as bare from raw
), wide as (
  select bare, min(row(doc_id, pos)) as head from trimmed where bare <> ''
  group by bare having count(distinct coalesce(source, chr(0) || 'none')) >= 5
), marked as (
  select t.*, w.bare is not null and row(t.doc_id, t.pos) <> w.head as gone
  from trimmed t left join wide w on t.bare = w.bare
), cleaned as (
  select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text,
         count(*) filter (where bare <> '') as n_lines, count(*) filter (where gone) as n_removed
  from marked group by doc_id
)
select d.doc_id, c.text, coalesce(c.n_lines, 0) as n_lines, coalesce(c.n_removed, 0) as n_removed
from documents d left join cleaned c on d.doc_id = c.doc_id
"""

ORACLE["op4_pivot_topk"] = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""

ORACLE["op13_fill_in_middle"] = r"""
with hashed as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), numbered as (
  select *, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
         cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4,
         regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units
  from hashed
), placed as (
  select *, cast(len(units) as bigint) as n,
         least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a,
         greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b
  from numbered
), pieces as (
  select doc_id, text, n,
         case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form,
         array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle,
         array_to_string(units[b + 1:], '') as suffix
  from placed
)
select doc_id, n, form,
       case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
       sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else text end) as output_sha256,
       sha256(text) as restored_sha256
from pieces
"""
