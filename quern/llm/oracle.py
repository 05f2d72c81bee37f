"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
toks as (select doc_id, t, regexp_extract_all(t, '{WORD}') as w from d),
pos as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from toks),
win as (
  select doc_id, i, list(word) over (partition by doc_id order by i rows between current row and 7 following) as g from pos),
eight as (select doc_id, i, count(*) over (partition by doc_id, g) as n from win where len(g) = 8),
rep as (
  select doc_id, count(distinct i + k)::bigint as n_repeat_words
  from (select doc_id, i, unnest(range(8)) as k from eight where n > 1) group by doc_id),
lines as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select doc_id, unnest(string_split(t, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (
  select doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    length(regexp_replace(t, '[^\p{{L}}]', '', 'g'))::bigint as n_letters,
    length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g'))::bigint as n_capitals
  from toks left join rep using (doc_id) left join lines using (doc_id)),
b as (
  select *, (case when n_words < 20 then 1 else 0 end
    + case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end
    + case when 100 * n_symbols > 15 * n_words then 4 else 0 end
    + case when n_letters >= 20 and 100 * n_capitals > 70 * n_letters then 8 else 0 end
    + case when 10 * word_chars < 15 * n_words then 16 else 0 end
    + case when word_chars > 40 * n_words then 32 else 0 end
    + case when 100 * n_letters < 40 * word_chars then 64 else 0 end
    + case when n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines then 128 else 0 end)::bigint as fail_bits
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed,
  fail_bits = 0 as kept, fail_bits
from b
"""

OP4 = """
with v as (
  select vec_id, [floor(64 * x::double) for x in embedding] as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

OP7 = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size from documents),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as turn
  from d group by source),
w as (select *, (turn % 3 + 1)::double as weight, sum(source_size) over ()::bigint as total from s),
f as (
  select *, coalesce(sum(source_size) over (order by source_size / weight, turn rows between unbounded preceding and 1 preceding), 0)::bigint as below,
    sum(weight) over (order by source_size / weight, turn rows between current row and unbounded following) as rest
  from w),
l as (select *, (total - 3 * below) / rest as level from f),
t as (
  select source, source_size, least(coalesce((select level from l where level * weight <= 3 * source_size order by source_size / weight, turn limit 1), 'infinity'::double) * weight, (3 * source_size)::double) as target
  from l),
e as (
  select d.doc_id, size, d.source, source_size, target, case when source_size > 0 then target / source_size else 0 end as expected,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496 as u
  from d join t on d.source is not distinct from t.source),
r as (
  select *, floor(expected) as whole, expected - floor(expected) as part, u / (1 - u) / (part / (1 - part)) as q,
    case when part > 0 then q / (1 + q) else 1 end as rank
  from e),
c as (
  select *, coalesce(sum(case when part > 0 then size else 0 end) over (partition by source order by rank, doc_id, size desc rows between unbounded preceding and 1 preceding), 0) as done
  from r)
select doc_id, size, source_size, target,
  (whole + case when part > 0 and done + size / 2 <= target - whole * source_size then 1 else 0 end)::bigint as copies,
  (copies * size)::bigint as taken
from c
"""

OP8 = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
n as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as place from d where text is not null),
m as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words from n),
w as (
  select doc_id, place, line, words, lead(line) over p as line2, lead(line, 2) over p as line3, lead(place) over p as final2, lead(place, 2) over p as final3,
    lead(words) over p as words2
  from m where words > 0
  window p as (partition by doc_id order by place)),
o as (
  select doc_id, place, final3 as final, [line, line2, line3] as held from w where final3 is not null
  union all select doc_id, place, place, [line] from w where words > 50
  union all select doc_id, place, final2, [line, line2] from w where words <= 50 and words + words2 > 50),
f as (select *, row_number() over (partition by held order by doc_id, place) as turn from o),
gone as (select distinct doc_id, unnest(generate_series(place, final)) as place from f where turn > 1),
left_ as (
  select n.doc_id, string_agg(line, chr(10) order by n.place) filter (where gone.place is null) as kept,
    count(gone.place)::bigint as n_removed
  from n left join gone on n.doc_id = gone.doc_id and n.place = gone.place group by n.doc_id)
select d.doc_id, case when text is null then null else coalesce(kept, '') end as text,
  coalesce(len(lines), 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed
from d left join left_ on d.doc_id = left_.doc_id
"""

ORACLE_SQL = {"op3_quality_rules": OP3, "op4_exact_top_k": OP4, "op7_source_mixing": OP7, "op8_line_dedup": OP8}
