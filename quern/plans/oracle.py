"""DuckDB SQL for the registered queries, on the driver's tables."""

from __future__ import annotations

from quern.operators.features import ALL, SHARD_FEATURES

TOKEN = r"[^\p{L}\p{N}]+"

TEXT = rf"""
tok as (select doc_id, unnest(regexp_split_to_array(lower(text), '{TOKEN}')) as term from documents),
postings as (select term, doc_id, count(*)::bigint as freq from tok where term <> '' group by term, doc_id),
dlen as (
  select d.doc_id, coalesce(sum(p.freq), 0)::bigint as len from documents d left join postings p on d.doc_id = p.doc_id group by d.doc_id),
"""
BASKET = """
postings as (select l_partkey as term, l_orderkey as doc_id, count(*)::bigint as freq from lineitem group by all),
dlen as (select doc_id, sum(freq)::bigint as len from postings group by doc_id),
"""
COMMON = """
facts as (select count(*)::bigint as n, avg(len) as mean, min(doc_id) as least, max(doc_id) as most, (max(doc_id) - min(doc_id) + 8) // 8 as width from dlen),
weighted as (
  select term, p.doc_id, freq, least((p.doc_id - least) // width, 7)::int as shard_id,
    freq / (freq + 1.2e0 * (0.5e0 + 0.5e0 * (len / mean))) as weight
  from postings p join dlen using (doc_id), facts),
tstat as (select term, count(*)::bigint as df, sum(freq)::bigint as cf, max(weight) as max_weight from weighted group by term),
terms as (select *, greatest(1e-6, ln((n::double - df + 0.5e0) / (df + 0.5e0))) * 2.2e0 as unit from (select tstat.*, n from tstat, facts)),
kth as (select term, weight from (select term, weight, row_number() over (partition by term order by weight desc, doc_id) as r from weighted) where r = 10),
thr as (select t.term, coalesce(unit * k.weight, 0) as thresh from terms t left join kth k on t.term = k.term),
kths as (
  select term, shard_id, weight
  from (select term, shard_id, weight, row_number() over (partition by term, shard_id order by weight desc, doc_id) as r from weighted) where r = 10),
thrs as (
  select t.term, s.shard_id, coalesce(unit * k.weight, 0) as thresh
  from terms t cross join (select range::int as shard_id from range(8)) s left join kths k on t.term = k.term and s.shard_id = k.shard_id),
pos as (
  select *, row_number() over (partition by term order by doc_id) - 1 as ordinal, lag(doc_id, 1, -1) over (partition by term order by doc_id) as prev_doc
  from weighted),
posb as (select *, ordinal // 128 as block_id, doc_id - prev_doc - 1 as gap from pos),
blocks as (
  select term, block_id, count(*)::bigint as n, min(doc_id) as first_doc, max(doc_id) as last_doc, max(weight) as max_weight,
    sum(greatest(1, ceil((case when gap > 0 then len(bin(gap)) else 0 end) / 7e0)) + greatest(1, ceil((case when freq > 1 then len(bin(freq - 1)) else 0 end) / 7e0)))::bigint as bytes
  from posb group by term, block_id)
"""
QUERY_TERMS = rf"""
qw as (select item_id as qid, unnest(regexp_split_to_array(lower(text), '{TOKEN}')) as term from benchmark),
qt as (select qid, term, count(*)::bigint as qtf from qw where term <> '' group by qid, term),
qs as (select item_id as qid from benchmark)
"""
BASKET_TERMS = """
qt as (select l_orderkey as qid, l_partkey as term, count(*)::bigint as qtf from lineitem group by all),
qs as (select distinct qid from qt)
"""
MATCHED = """
met as (select qid, doc_id, count(*) as n_met, sum(freq) as freqs from (select distinct qid, term from qt) join postings using (term) group by qid, doc_id),
needed as (select qid, count(distinct term) as needed from qt group by qid)
"""
SCORED = """
scored as (
  select qid, doc_id, round(sum(unit * weight * qtf), 6) as score, count(*) as n_met
  from qt join terms using (term) join weighted using (term) group by qid, doc_id)
"""
LIMITS = """
theta as (select qid, greatest(0, max(thresh * qtf) - 1e-4) as theta from qt join thr using (term) group by qid)
"""
SIZES = """
lb as (
  select term, sum(n)::bigint as df, count(*)::bigint as n_blocks,
    (greatest(1, ceil(len(bin(sum(n)::bigint)) / 7e0)) + 8 * count(*) - 4 + sum(bytes))::bigint as list_bytes
  from blocks group by term)
"""
PROBES = "probes as (select distinct term, (qid * 7919) % n as lower from qt, facts)"


def _text(select: str, *more: str) -> str:
    return "with " + TEXT.strip() + ", ".join([COMMON, QUERY_TERMS, *more]) + select


def _basket(select: str, *more: str) -> str:
    return "with " + BASKET.strip() + ", ".join([COMMON, BASKET_TERMS, *more]) + select


def _count(kind: str, freqs: bool) -> str:
    hits = "met join needed using (qid) where n_met = needed" if kind == "and" else "met"
    more = ", coalesce(c.freqs, 0)::bigint as freqs" if freqs else ""
    return f"""
select qs.qid, coalesce(c.n, 0)::bigint as n{more}
from (select distinct qid from qs) qs left join (select qid, count(*) as n, sum(freqs) as freqs from {hits} group by qid) c on qs.qid = c.qid"""


TOP = """
select qid, rank, doc_id, score from (
  select *, row_number() over (partition by qid order by score desc, doc_id)::int as rank from scored{}) where rank <= 10"""
OR = TOP.format("")

BITS = """
z as (select term, df, cf, n as u from terms),
widths as (
  select *, case when u > df then len(bin(u // df)) - 1 else 0 end as low,
    case when u - df + 1 > df then len(bin((u - df + 1) // df)) - 1 else 0 end as slow,
    case when cf + 1 - df + 1 > df then len(bin((cf + 1 - df + 1) // df)) - 1 else 0 end as flow from z),
highs as (select *, df + (u >> low) + 2 as high, df + ((u - df + 1) >> slow) + 2 as shigh, df + ((cf + 1 - df + 1) >> flow) + 2 as fhigh from widths),
fano as (
  select *, (((high - df) >> 9) + (df >> 8)) * len(bin(high - 1)) + high + df * low as ef,
    (df >> 8) * len(bin(shigh - 1)) + shigh + df * slow as sef, (df >> 8) * len(bin(fhigh - 1)) + fhigh + df * flow as fef,
    (u >> 9) * (case when df > 0 then len(bin(df)) else 0 end) + (df >> 8) * (case when u > 1 then len(bin(u - 1)) else 0 end) + u as rb,
    (df >> 8) * (case when u > 1 then len(bin(u - 1)) else 0 end) + u as srb, (df >> 8) * len(bin(cf)) + cf + 1 as frb
  from highs)
"""

FEATURES = f"""
base as (select qid, term, qtf, df, unit, thresh, max_weight, greatest(0, max(thresh * qtf) over (partition by qid)) as topk, count(*) over (partition by qid) as term_count
  from qt join terms using (term) join thr using (term)),
fb as (
  select qid, b.term, topk, least((last_doc - least) // width, 7)::int as shard_id, qtf * (unit * b.max_weight) as score, qtf * (unit * mean_weight) as mean
  from base join blocks b using (term) join (select term, avg(max_weight) as mean_weight from blocks group by term) m using (term), facts),
own as (
  select qid, term, max(score) as max_score_term, avg(score) as avg_score_term, count(*) filter (score >= mean) as morethan_avg_score,
    count(*) filter (score >= topk) as morethan_topk_score, stddev_pop(score) as var_max_score_term from fb group by qid, term),
sb as (
  select qid, term, shard_id, avg(score) as avg_score, max(score) as max_score, count(*) filter (score >= topk) as over_topk, count(*) filter (score >= mean) as over_avg
  from fb group by qid, term, shard_id),
near as (
  select w.term, w.shard_id, count(*) filter (unit * weight >= unit * max_weight * 0.95e0) as near_max, count(*) filter (unit * weight >= thresh * 0.95e0) as near_topk
  from weighted w join (select distinct term, unit, max_weight, thresh from base) using (term) group by w.term, w.shard_id),
dense as (
  select b.qid, b.term, b.qtf, s.shard_id, coalesce(avg_score, 0) as avg_score, coalesce(max_score, 0) as max_score, coalesce(over_topk, 0) as over_topk,
    coalesce(over_avg, 0) as over_avg, coalesce(near_max, 0) as near_max, coalesce(near_topk, 0) as near_topk, coalesce(t.thresh, 0) * b.qtf as topk_score
  from base b cross join (select range::int as shard_id from range(8)) s
    left join sb on sb.qid = b.qid and sb.term = b.term and sb.shard_id = s.shard_id
    left join near on near.term = b.term and near.shard_id = s.shard_id left join thrs t on t.term = b.term and t.shard_id = s.shard_id),
sh as (
  select qid, term, {", ".join(f"stddev_pop({c}) as {f}" for c, f in zip(("topk_score", "avg_score", "over_topk", "over_avg", "max_score", "near_max", "near_topk"), SHARD_FEATURES, strict=True))},
    sum(near_max) as morethan_maxscore5_score, sum(near_topk) as morethan_topkscore5_score from dense group by qid, term),
ft as (
  select qid, term, term_count, topk as query_topk_score, df::double as no_postings, thresh * qtf as topk_score_term, 1 / df as inverse_df,
    own.* exclude (qid, term), sh.* exclude (qid, term)
  from base join own using (qid, term) join sh using (qid, term))
"""

ORACLE_SQL: dict[str, str] = {
    "postings_text": _text("select term, doc_id, freq from postings"),
    "postings_basket": _basket("select term, doc_id, freq from postings"),
    "postings_pages": rf"""
select term, page_id as doc_id, count(*)::bigint as freq
from (select page_id, unnest(regexp_split_to_array(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '{TOKEN}')) as term from pages) where term <> '' group by all""",
    "doc_lengths": _text("select doc_id, len, round(len / mean, 6) as norm_len from dlen, facts"),
    "term_stats": _text("select term, df, cf, round(max_weight, 6) as max_weight from terms"),
    "dense_term_ids": _text("select term, (row_number() over (order by term) - 1)::bigint as term_id from terms"),
    "query_terms_text": _text("select qid, term, qtf from qt"),
    "and_count": _text(_count("and", False), MATCHED),
    "and_freqs": _text(_count("and", True), MATCHED),
    "or_count": _text(_count("or", False), MATCHED),
    "or_freqs": _text(_count("or", True), MATCHED),
    "ranked_or_topk": _text(OR, SCORED),
    "wand_topk": _text(OR, SCORED),
    "maxscore_topk": _text(OR, SCORED),
    "bmw_topk": _text(OR, SCORED),
    "merged_topk": _text(OR, SCORED),
    "ranked_and_topk": _text(TOP.format(" join needed using (qid) where n_met = needed"), SCORED, MATCHED),
    "basket_and_count": _basket(_count("and", False), MATCHED),
    "basket_ranked_or": _basket(OR, SCORED),
    "dgaps": _text("select term, doc_id, ordinal::bigint as ordinal, gap::bigint as gap from posb"),
    "posting_blocks": _text("select term, block_id::bigint as block_id, n, first_doc, last_doc, round(max_weight, 6) as max_weight, bytes from blocks"),
    "next_geq_probe": _text("select p.term, p.lower, min(doc_id) as doc_id, min(ordinal)::bigint as ordinal from probes p left join pos on pos.term = p.term and doc_id >= lower group by p.term, p.lower", PROBES),
    "prev_value_probe": _text("select p.term, p.lower, min(doc_id) as doc_id, min(prev_doc) as prev_doc from probes p left join pos on pos.term = p.term and doc_id >= lower group by p.term, p.lower", PROBES),
    "block_asof_lookup": _text(
        "select p.term, p.lower, min(block_id)::bigint as block_id, min(last_doc) as last_doc, round(arg_min(max_weight, block_id), 6) as max_weight from probes p left join blocks b on b.term = p.term and last_doc >= lower group by p.term, p.lower", PROBES
    ),
    "position_probe": _text("select term, ordinal::bigint as ordinal, doc_id, freq from pos join (select distinct term, (qid * 31) % df as ordinal from qt join terms using (term)) using (term, ordinal)"),
    "shard_assignment": _text("select doc_id, least((doc_id - least) // width, 7)::int as shard_id from dlen, facts"),
    "shard_ranges": _text("select range::int as shard_id, least + range * width as lo_doc, least + (range + 1) * width as hi_doc from facts, range(8)"),
    "sharded_and_count": _text(
        "select qid, least((doc_id - least) // width, 7)::int as shard_id, count(*)::bigint as n from met join needed using (qid), facts where n_met = needed group by all", MATCHED
    ),
    "sharded_topk": _text(
        "select * from (select qid, shard_id, row_number() over (partition by qid, shard_id order by score desc, doc_id)::int as rank, doc_id, score from (select scored.qid, scored.doc_id, score, least((doc_id - least) // width, 7)::int as shard_id from scored, facts)) where rank <= 10", SCORED
    ),
    "shard_split_blocks": _text(
        "select term, range::int as shard_id, min(case when last_doc >= least + range * width then block_id end)::bigint as split_block from blocks, facts, range(8) group by all"
    ),
    "term_topk_threshold": _text("select term, round(thresh, 6) as thresh from thr"),
    "term_shard_threshold": _text("select term, shard_id, round(thresh, 6) as thresh from thrs"),
    "query_threshold": _text("select qid, round(theta, 6) as theta from theta", LIMITS),
    "essential_terms": _text(
        """select qid, term, qtf, round(bound, 6) as bound, round(running, 6) as running, running > theta as essential from (
  select *, sum(bound) over (partition by qid order by bound, term rows unbounded preceding) as running
  from (select qid, term, qtf, unit * max_weight * qtf as bound from qt join terms using (term)) join theta using (qid))""", LIMITS
    ),
    "shard_score": _text("select qid, shard_id, round(max(thresh * qtf), 6) as shard_score from qt join thrs using (term) group by qid, shard_id"),
    "shard_tasks": _text(
        """select qid, task_no, string_agg(shard_id::varchar, ' ' order by turn) as shard_ids from (
  select *, (turn % (1 + qid % 4))::int as task_no from (
    select *, row_number() over (partition by qid order by s desc, shard_id) - 1 as turn
    from (select qid, shard_id, round(max(thresh * qtf), 6) as s from qt join thrs using (term) group by qid, shard_id))) group by qid, task_no"""
    ),
    "features_term": _text(f"select qid, term, term_count, round(query_topk_score, 6) as query_topk_score, {', '.join(f'round({c}::double, 6) as {c}' for c in ALL)} from ft", FEATURES),
    "features_query": _text(
        f"""select qid, first(term_count) as term_count, round(first(query_topk_score), 6) as query_topk_score,
{", ".join(f"round(sum({c}::double), 6) as sum_{c}, round(greatest(0, max({c}::double)), 6) as max_{c}, round(stddev_pop({c}::double), 6) as var_{c}" for c in ALL)} from ft group by qid""",
        FEATURES,
    ),
    "list_bytes_vbyte": _text("select term, df, n_blocks, list_bytes from lb", SIZES),
    "list_offsets": _text("select term, list_bytes, (sum(list_bytes) over (order by term rows unbounded preceding) - list_bytes)::bigint as offset from lb", SIZES),
    "gap_code_bits": _text(
        """select term, sum(2 * (len(bin(gap + 1)) - 1) + 1)::bigint as gamma_bits,
  sum(2 * (len(bin(len(bin(gap + 1)))) - 1) + 1 + len(bin(gap + 1)) - 1)::bigint as delta_bits,
  sum(greatest(1, ceil((case when freq > 1 then len(bin(freq - 1)) else 0 end) / 7e0)))::bigint as freq_bytes from posb group by term"""
    ),
    "sequence_bitsize": _text(
        """select term, case when u = df then 0 else least(ef, rb) + 1 end::bigint as docs_bits, ef::bigint as docs_fano_bits, rb::bigint as docs_bitvector_bits,
  case when u = df then 0 else least(sef, srb) + 1 end::bigint as docs_strict_bits, case when cf + 1 = df then 0 else least(fef, frb) + 1 end::bigint as freqs_bits from fano""", BITS
    ),
    "read_alignment": _text(
        """@, ends as (select *, sum(bytes) over (partition by term order by block_id)::bigint as endpoint from blocks),
offs as (select term, (sum(list_bytes) over (order by term rows unbounded preceding) - list_bytes)::bigint as off from lb),
sp as (select term, range::int as shard_id, min(case when last_doc >= least + range * width then block_id end) as split from blocks, facts, range(8) group by all),
nx as (select *, lead(split) over (partition by term order by shard_id) as next_split from sp),
r as (
  select nx.term, shard_id, coalesce(a.endpoint, 0) as start, coalesce(b.endpoint, (select max(endpoint) from ends e where e.term = nx.term)) as stop, off
  from nx join offs on nx.term = offs.term left join ends a on a.term = nx.term and a.block_id = split - 1 left join ends b on b.term = nx.term and b.block_id = next_split
  where split is not null),
s as (
  select term, shard_id, (stop - start)::bigint as list_length, ((off + start) // 4096 * 4096)::bigint as read_offset, ((off + start) % 4096)::bigint as skip from r),
u as (select *, case when list_length <= 4096 then 4096 when list_length <= 8192 then 8192 when list_length <= 16384 then 16384 when list_length <= 32768 then 32768 else 65536 end::bigint as read_unit from s)
select *, (list_length + skip + read_unit - 1) // read_unit * read_unit as read_length from u""", SIZES
    ).replace("@, ends", ", ends"),
    "lookahead_terms": _text("select *, row_number() over (partition by qid order by n desc, term)::int as rank from (select a.qid, b.term, count(*)::bigint as n from (select distinct qid from qt) a join (select distinct qid, term from qt) b on b.qid between a.qid and a.qid + 3 group by all)"),
    "latency_quantiles": """
with v as (select value, row_number() over (order by value) - 1 as place, count(*) over () as n from events where value is not null)
select p / 10e0 as quantile, round(value, 6) as latency from v join (select unnest([250, 500, 750, 950, 990, 999]) as p) on place = p * n // 1000
union all select 0, round(avg(value), 6) from v""",
    "cache_warmup": _text(
        "select * from (select term, list_bytes, (sum(list_bytes) over (order by list_bytes desc, term rows unbounded preceding) - list_bytes)::bigint as before from lb) where before < 200000", SIZES
    ),
    "lru_first_touches": _text(
        "select (count(*) - count(distinct term))::bigint as hit_count, count(distinct term)::bigint as miss_count, (select sum(list_bytes) from lb where term in (select term from qt))::bigint as miss_size from qt where term in (select term from terms)", SIZES
    ),
    "codec_roundtrip": _basket(
        """select codec, count(*)::bigint as n_blocks, (2 * sum(n))::bigint as n_values, count(*)::bigint as n_equal
from blocks, (select unnest(['vbyte', 'interpolative', 'gamma', 'delta', 'raw', 'simple9', 'group_of_eight', 'patched']) as codec) group by codec"""
    ),
    "streamed_event_counts": "select date_trunc('hour', ts) as hour, event_type, count(*)::bigint as n from events group by all",
}
