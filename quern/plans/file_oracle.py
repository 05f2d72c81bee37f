"""DuckDB SQL for the queries over files, for simulations step by step, and for those with other scorers and costs."""

from __future__ import annotations

from quern.operators.features import ALL
from quern.plans.oracle import FEATURES, MATCHED, OR, ORACLE_SQL as PLAIN, SCORED, SIZES, _basket, _count, _text

IDS = "tid as (select term, (row_number() over (order by term) - 1)::bigint as term_id from tstat)"
DOCS = "did as (select doc_id, (row_number() over (order by doc_id) - 1)::bigint as number from dlen)"
PLACES = "places as (select qid, (row_number() over (order by qid) - 1)::bigint as place from (select distinct qid from qs))"
LISTS = "ql as (select place, term_id, row_number() over (partition by place order by term_id) - 1 as pos from qt join tid using (term) join places using (qid))"
WHOLE = ["term_count", "first(query_topk_score)", *[x for c in ALL for x in (f"sum({c}::double)", f"greatest(0, max({c}::double))", f"stddev_pop({c}::double)")]]


def _recursive(sql: str) -> str:
    return "with recursive" + sql.strip().removeprefix("with")


def cache_step(held: str, used: str, budget: str, key: str, size: str) -> str:
    """The lists held after an access; what has to go is the shortest beginning that makes room."""
    gone = f"list_min(list_filter(range(0, len({held}) + 1), lambda i: coalesce(list_sum(list_transform({held}[1:i], lambda x: x.n)), 0) >= {used} + {size} - {budget}))"
    own = f"[{{'k': {key}, 'n': {size}}}]"
    return f"""case when len(list_filter({held}, lambda x: x.k = {key})) > 0 then list_filter({held}, lambda x: x.k <> {key}) || {own}
    when {size} > {budget} then {held} when {used} + {size} <= {budget} then {held} || {own} else {held}[{gone} + 1:] || {own} end"""


SUM = "coalesce(list_sum(list_transform({0}, lambda x: x.n)), 0)"
HAS = "len(list_filter({0}, lambda x: x.k = {1})) > 0"


def _lru(accesses: str) -> str:
    """(config, seq, hit, bytes, ahead, held) after every access of accesses(config, budget, seq, key, bytes, ahead), seq from 1 on."""
    step = cache_step("s.held", "s.used", "a.budget", "a.key", "a.bytes")
    return f"""
acc as ({accesses}),
run as (
  select distinct config, 0::bigint as seq, false as hit, 0::bigint as bytes, false as ahead, []::struct(k varchar, n bigint)[] as held, 0::bigint as used, 0::bigint as gone from acc
  union all
  select config, seq, hit, bytes, ahead, held, {SUM.format("held")}::bigint as used, was + (case when hit or bytes > budget then 0 else 1 end) - len(held) as gone
  from (
    select a.config, a.seq, {HAS.format("s.held", "a.key")} as hit, a.bytes, a.ahead, {step} as held, len(s.held) as was, a.budget
    from run s join acc a on a.config = s.config and a.seq = s.seq + 1))"""


def bits(u: str, n: str) -> str:
    """Bits of the cheapest representation of n values below u, in integer arithmetic."""
    low = f"(case when {u} > {n} then len(bin({u} // {n})) - 1 else 0 end)"
    high = f"({n} + ({u} >> {low}) + 2)"
    fano = f"((({high} - {n}) >> 9) + ({n} >> 8)) * len(bin({high} - 1)) + {high} + {n} * {low}"
    ranked = f"({u} >> 9) * len(bin({n})) + ({n} >> 8) * (case when {u} > 1 then len(bin({u} - 1)) else 0 end) + {u}"
    return f"(case when {u} = {n} then 0 else least({fano}, {ranked}) + 1 end)"


def _cuts(cost) -> str:
    """The cheapest cuts of every list of baskets, end by end: best[j] is the least cost of the first j values, came[j] where the last
    part begins."""
    part = cost("(d.v[j + 1] - (case when i > 0 then d.v[i] + 1 else d.v[1] end) + 1)", "(j + 1 - i)")
    here = f"case when i = 0 and j + 1 = len(d.v) then {cost('d.u', '(j + 1)')} else {part} end"
    prices = f"list_transform(range(0, j + 1), lambda i: best[i + 1] + {here})"
    ctes = f"""
lists as (select term, list(doc_id order by doc_id) as v, max(most) + 1 as u from postings, facts group by term),
dp as (
  select term, v, u, 0::bigint as j, [0::bigint] as best, []::bigint[] as came from lists
  union all
  select term, v, u, j + 1, list_append(best, list_min(p)::bigint), list_append(came, (list_position(p, list_min(p)) - 1)::bigint)
  from (select d.*, {prices} as p from dp d where j < len(v))),
walk as (
  select term, v, u, came, len(v)::bigint as stop, came[len(v)] as start from dp where j = len(v)
  union all
  select term, v, u, came, start, came[start] from walk where start > 0)"""
    return _recursive(_basket(f"""
select term, (row_number() over (partition by term order by start) - 1)::int as part, stop - start as n, v[start + 1] as first_doc, v[stop] as last_doc,
  (case when start = 0 and stop = len(v) then {cost("u", "len(v)")} else {cost("(v[stop] - (case when start > 0 then v[start] + 1 else v[1] end) + 1)", "(stop - start)")} end)::bigint as cost
from walk""", ctes.strip()))


def _reorder(budget: int) -> str:
    """Queries one after the other by what they miss; while one is served, its lists are read one by one."""
    step = cache_step("held", "used", str(budget), "pending[1].k", "pending[1].n")
    ctes = f"""
rows as (select qid, qid // 100 as batch_id, list({{'k': term::varchar, 'n': list_bytes}} order by term) as terms, sum(list_bytes)::bigint as total from qt join lb using (term) group by qid),
ranked as (
  select *, 2 * batch_id + (case when row_number() over (partition by batch_id order by total desc, qid) <= count(*) over (partition by batch_id) * 5 // 100 then 0 else 1 end) as turn from rows),
st as (
  select 0::bigint as step, []::bigint[] as done, []::struct(k varchar, n bigint)[] as pending, []::struct(k varchar, n bigint)[] as held, 0::bigint as used, 0::bigint as missed, true as chose
  union all
  select * from (
    select step + 1, done, pending[2:], {step} as next_held, {SUM.format(step)}::bigint, missed + (case when {HAS.format("held", "pending[1].k")} then 0 else pending[1].n end), false
    from st where len(pending) > 0
    union all
    select step, done, pending, held, used, missed, true from (
      select step + 1 as step, list_append(done, qid) as done, terms as pending, held, used, 0::bigint as missed
      from st join ranked on not list_contains(done, qid) where len(pending) = 0
      qualify row_number() over (order by turn, {SUM.format("list_filter(terms, lambda t: not " + HAS.format("held", "t.k") + ")")}, total, qid) = 1)))"""
    return _recursive(_text(
        """
select 'default' as config, batch_id, (len(done) - 1)::bigint as position, done[-1] as qid, missed::bigint as miss_size
from st join ranked on qid = done[-1] where len(pending) = 0 and len(done) > 0""",
        SIZES, ctes.strip(),
    ))


def fixed(u: str, n: str) -> str:
    return f"({bits(u, n)} + 64)"


def gaps(u: str, n: str) -> str:
    """Bits of a part whose gaps all take as many as its widest could."""
    return f"({n} * len(bin({u})) + 32)"


LRU_ACCESSES = """
select config, budget, row_number() over (partition by config order by qid, term)::bigint as seq, term as key, list_bytes as bytes, false as ahead
from qt join lb using (term) cross join (select unnest(['small', 'large', 'unlimited']) as config, unnest([2000, 20000, 1152921504606846976]) as budget)"""
AHEAD = """
select 'ahead' as config, 2000::bigint as budget, row_number() over (order by moment)::bigint as seq, moment, key, bytes, ahead from (
  select 2 * s as moment, key, bytes, false as ahead from one where s < 100
  union all
  select 2 * s + 1, next, next_bytes, true from (select *, lead(key, 2) over (order by s) as next, lead(bytes, 2) over (order by s) as next_bytes from one where s < 100) where s % 3 = 0 and next is not null)"""
ONE = "one as (select row_number() over (order by qid, term_id, list_bytes) - 1 as s, term_id::varchar as key, list_bytes as bytes from qt join lb using (term) join tid using (term))"

ORACLE_SQL: dict[str, str] = {
    "collection_file": _basket("select term_id as term, number as doc_id, freq from postings join tid using (term) join did using (doc_id)", IDS, DOCS),
    "collection_sizes_file": _basket("select number as doc_id, len, round(len / mean, 6) as norm_len from dlen join did using (doc_id), facts", DOCS),
    "query_files": _text("select kind, place as qid, pos::bigint as pos, term_id as term, place // 16 as batch_id from ql, (select unnest(['tabs', 'blanks']) as kind)", IDS, PLACES, LISTS),
    "list_length_file": _text("select term_id as term, list_bytes as length, (sum(list_bytes) over (order by term rows unbounded preceding) - list_bytes)::bigint as offset from lb join tid using (term)", SIZES, IDS),
    "list_head_file": _text(
        "select term_id as term, df, block_id::bigint as block_id, last_doc, (sum(bytes) over (partition by term order by block_id rows unbounded preceding) - bytes)::bigint as start from blocks join tid using (term) join (select term, df from tstat) using (term)", IDS
    ),
    "block_max_file": _text("select term_id as term, block_id::bigint as block_id, round(max_weight::float::double, 6) as max_weight, last_doc from blocks join tid using (term)", IDS),
    "split_info_file": _text(
        "select term_id as term, range::int as shard_id, coalesce(min(case when last_doc >= least + range * width then block_id end), count(*))::bigint as split_block from blocks join tid using (term), facts, range(8) group by all", IDS
    ),
    "block_endpoint_file": _text("select term_id as term, block_id::bigint as block_id, (sum(bytes) over (partition by term order by block_id rows unbounded preceding))::bigint as endpoint from blocks join tid using (term)", IDS),
    "posting_score_file": _text("select term_id as term, ordinal::bigint as ordinal, round((unit * weight)::float::double, 6) as score from pos join tid using (term) join (select term, unit from terms) using (term)", IDS),
    "thread_file": _text("select place as qid, (1 + qid % 8)::int as threads, case 1 + qid % 8 when 1 then 0 when 2 then 1 when 4 then 2 when 8 then 3 end::int as label from places", PLACES),
    "term_info_file": _text("select term_id as term, df, round(thresh, 6) as topk_score, round(unit * max_weight, 6) as max_score from terms join thr using (term) join tid using (term)", IDS),
    "term_info_inconsistent": _text("select term from tid where term_id % 100 = 0", IDS),
    "threshold_files": _text("select term_id as term, shard_id, round(thrs.thresh, 6) as shard_thresh, round(thr.thresh, 6) as thresh from thrs join thr using (term) join tid using (term)", IDS),
    "frozen_index": _text(OR, SCORED),
    "counts_file": _text("select place, n from (" + _count("and", False) + ") join places using (qid)", MATCHED, PLACES),
    "scores_file": _text(
        "select strategy, place, coalesce(rank - 1, 0)::int as at, score from (select unnest(['exhaustive', 'bmw']) as strategy) cross join places left join (" + OR + ") using (qid)", SCORED, PLACES
    ),
    "features_file": _text(
        f"""select place, unnest(range({len(WHOLE) + 1}))::int as at, unnest(list_append(vals, qid % 7 * 0.25e0)) as value
from (select qid, list_transform([{", ".join(x.replace("term_count", "first(term_count)") + "::double" for x in WHOLE)}], lambda x: round(x, 6)) as vals from ft group by qid) join places using (qid)""",
        FEATURES, PLACES,
    ),
    "reordered_file": _text(
        "select position, pos::bigint as pos, term_id as term from ql join (select place, (row_number() over (order by n desc, place) - 1)::bigint as position from (select place, count(term_id) as n from places left join ql using (place) group by place)) using (place)", IDS, PLACES, LISTS
    ),
    "stats_lines": _text("select '{\"doc_id\":' || doc_id || ',\"len\":' || len || '}' as value from dlen"),
    "ranked_tf_idf": _text(
        OR,
        """scored as (
  select qid, doc_id, round(sum(ln(1 + n::double / df) * (1 + ln(freq::double)) / sqrt(len / mean) * qtf), 6) as score
  from qt join postings using (term) join (select term, df from tstat) using (term) join dlen using (doc_id), facts group by qid, doc_id)""",
    ),
    "lru_simulation": _recursive(_text(
        f"""
select config, count(*) filter (hit)::bigint as hit_count, count(*) filter (not hit)::bigint as miss_count, coalesce(sum(bytes) filter (not hit), 0)::bigint as miss_size,
  sum(gone)::bigint as evictions, last(used order by seq)::bigint as held_bytes from run where seq > 0 group by config""",
        SIZES, _lru(LRU_ACCESSES).strip(),
    )),
    "lru_trace": _recursive(_text("select moment as seq, hit from run join acc using (config, seq)", SIZES, IDS, ONE, _lru(AHEAD).strip())),
    "greedy_reorder": _reorder(20_000),
    "optimal_partition": _cuts(fixed),
    "gap_partition": _cuts(gaps),
    "throughput": "select event_type, count(*)::bigint as n, round(count(*) / sum(value) * 1e6, 6) as per_second from events where value is not null group by event_type",
    "balanced_shards": _text(
        """select (row_number() over (order by lo_doc) - 1)::int as shard_id, lo_doc, coalesce(lead(lo_doc) over (order by lo_doc), (select most + 1 from facts))::bigint as hi_doc from (
  select distinct lo_doc from (
    select least as lo_doc from facts
    union all
    select min(doc_id) from (select doc_id, sum(n) over (order by doc_id) - n as before, sum(n) over () as total from (select doc_id, count(*) as n from postings group by doc_id)), range(1, 8)
    where before * 8 >= range * total group by range))"""
    ),
    "read_alignment_fixed": PLAIN["read_alignment"].replace("case when list_length <= 4096 then 4096 when list_length <= 8192 then 8192 when list_length <= 16384 then 16384 when list_length <= 32768 then 32768 else 65536 end", "65536"),
    "streamed_topk": _text(OR, SCORED),
    "streamed_list_lengths": _text("select qid, term, df as n from qt join (select term, df from tstat) using (term)"),
    "streamed_cache": _recursive(_text(
        """
select 'stream' as config, count(*) filter (hit)::bigint as hits, count(*) filter (not hit)::bigint as misses, coalesce(sum(bytes) filter (not hit), 0)::bigint as miss_bytes from run where seq > 0""",
        SIZES, IDS, ONE, _lru("select 'stream' as config, 20000::bigint as budget, s + 1 as seq, key, bytes, false as ahead from one").strip(),
    )),
}
