"""DuckDB SQL for the queries of this subpackage that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
TRIM = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOW}), '[^\x20\x09-\x0D]+') ws from documents
), sh as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 4 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) s from w)
), n as (
  select w.doc_id, coalesce(c, 0) n from w left join (select doc_id, count(*) c from sh group by 1) using (doc_id)
), ids as (
  select doc_id, dense_rank() over (order by s) s from sh
), pairs as (
  select a.doc_id a, b.doc_id b, count(*) common from ids a join ids b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)
), edges as (select a, b from links union all select b, a from links),
reach(a, b) as (select doc_id, doc_id from n union select r.a, e.b from reach r join edges e on r.b = e.a)
select r.a doc_id, cast(max(n.n) as bigint) n_shingles, min(r.b) component_id from reach r join n on n.doc_id = r.a group by r.a
"""

OP3 = rf"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) pos from d),
k as (select doc_id, pos, line, translate(trim(line, {TRIM}), {LOW}) key from l),
hot as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
j as (select k.*, hot.key is not null gone from k left join hot on k.key = hot.key)
select doc_id, count(*) n_lines, cast(sum(gone::int) as bigint) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256
from j group by doc_id
"""

OP4 = rf"""
with s as (
  select doc_id, source, cast(len({WORDS}) as bigint) size from documents
), z as (select *, cast(floor(sqrt(size::double) * 1024) as bigint) root from s
), b as (
  select source, cast(sum(size) as bigint) source_size, sum(size * root) root_size, max(root) most_root,
    cast([5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) w from z group by source
), f as (
  select *, source_size * 3.0::double cap, (sum(source_size) over ())::double total,
    coalesce(sum(source_size * 3.0::double) over (order by source_size * 3.0::double / w, source nulls last rows between unbounded preceding and 1 preceding), 0) capped,
    sum(w) over (order by source_size * 3.0::double / w, source nulls last rows between current row and unbounded following) rest_w from b
), g as (
  select *, max(case when (total - capped) / rest_w * w <= cap then (total - capped) / rest_w end) over () level from f
), t as (
  select source, source_size, root_size, most_root, least(cap, coalesce(level * w, cap)) target from g
), r as (
  select *, case when source_size > 0 then target / source_size else 0.0 end rate,
    most_root * source_size / nullif(root_size::double, 0) top, source_size / nullif(root_size::double, 0) per_root from t
), q as (
  select *, case when source_size > 0 and top > 1 and rate > 0 then least(1.0, greatest(0.0, (3 / rate - 1) / (top - 1))) else 0.0 end lean from r
), e as (
  select z.doc_id, z.source, z.size, q.source_size, q.target,
    least(3.0, q.rate * (1 - q.lean + q.lean * z.root * coalesce(q.per_root, 0))) expected,
    (cast('0x' || substr(md5('mix-1|' || coalesce(z.doc_id::varchar, '') || '|' || z.size::varchar), 1, 13) as bigint) + 0.5) / 4503599627370496.0 u
  from z join q on z.source is not distinct from q.source
), v as (
  select *, floor(expected) whole, expected - floor(expected) p,
    case when expected > floor(expected) then ln(u / (1 - u)) - ln((expected - floor(expected)) / (1 - (expected - floor(expected)))) end v from e
), c as (
  select *, target - sum(whole * size) over (partition by source) left_words,
    coalesce(sum(case when p > 0 then size end) over (partition by source order by v nulls last, doc_id, size rows between unbounded preceding and 1 preceding), 0) used from v
)
select doc_id, size, source_size, target, cast((whole + case when p > 0 and used + size / 2 <= left_words then 1 else 0 end) * size as bigint) taken from c
"""



def _again(k: int) -> str:
    """DuckDB: (doc_id, n) of words in windows of k words that are found twice or more in the text, from d(doc_id, ws)."""
    return f"""select doc_id, cast(count(distinct i + k) as bigint) n from (
      select doc_id, i, count(*) over (partition by doc_id, w) times from (
        select doc_id, unnest(range(1, len(ws) - {k - 2})) i, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) w from d where len(ws) >= {k})
    ), range({k}) o(k) where times > 1 group by doc_id"""


OP7 = rf"""
with d as (select doc_id, coalesce(text, '') t, {WORDS} ws, string_split(coalesce(text, ''), chr(10)) ls from documents),
x as (select *, cast(len(ws) as bigint) n_words, list_distinct(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) kinds,
  cast(len(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) as bigint) full_lines from d),
r3 as ({_again(3)}), r5 as ({_again(5)}), r10 as ({_again(10)}),
o as (select doc_id, max(n) most from (select doc_id, w, count(*) n from (select doc_id, unnest(ws) w from d) group by all) group by 1),
m as (
  select x.doc_id, n_words, cast(length(array_to_string(ws, '')) as bigint) word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) n_symbols, full_lines - len(kinds) n_dup_lines,
    cast(coalesce(r3.n, 0) as bigint) n_repeat_words, coalesce(r5.n, 0) n5, coalesce(r10.n, 0) n10, len(ls) n_lines, coalesce(o.most, 0) most,
    length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) upper, length(t) - length(translate(t, 'abcdefghijklmnopqrstuvwxyz', '')) small,
    len(list_distinct(ws)) n_kinds, len(list_distinct(string_split(t, ''))) n_characters
  from x left join r3 on r3.doc_id = x.doc_id left join r5 on r5.doc_id = x.doc_id left join r10 on r10.doc_id = x.doc_id left join o on o.doc_id = x.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > 3 * n_words or 2 * n_dup_lines > n_lines
    or word_chars < 2 * n_words or word_chars > 15 * n_words or upper > small or n_kinds * n_kinds < n_words
    or 10 * most > 3 * n_words or n_characters < 12 or 100 * n5 > 45 * n_words or 100 * n10 > 40 * n_words) kept
from m
"""

ORACLES = {"op1_ngram_jaccard_join": OP1, "op3_line_dedup": OP3, "op4_mixing": OP4, "op7_quality_rules": OP7}
