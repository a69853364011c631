"""SQL that gives the rows of the operators' queries, for those that SQL can express."""

from __future__ import annotations

_TOKENS = "regexp_extract_all(ln, '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    # Lines as sets of words; a line that shares a rare enough word with an earlier one is compared with it (prefix filter).
    "op3_line_dedup": f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as ln, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as line from documents),
t as (select doc_id, line, list_distinct({_TOKENS}) as s from l where len({_TOKENS}) >= 1),
w as (select doc_id, line, len(s) as n, unnest(s) as word from t),
c as (select word, count(*) as c from w group by 1),
o as (select doc_id, line, n, word, row_number() over (partition by doc_id, line order by c, word) as k from w join c using (word)),
p as (select doc_id, line, n, word from o where k <= n - ceil(0.8 * n - 1e-9) + 1),
q as (select distinct b.doc_id, b.line, a.doc_id as d, a.line as l from p a join p b on a.word = b.word and (a.doc_id, a.line) < (b.doc_id, b.line) and a.n >= 0.8 * b.n - 1e-9 and b.n >= 0.8 * a.n - 1e-9),
v as (select q.doc_id, q.line, len(list_intersect(x.s, y.s)) as i, len(x.s) as a, len(y.s) as b from q join t x on x.doc_id = q.doc_id and x.line = q.line join t y on y.doc_id = q.d and y.line = q.l),
r as (select doc_id, count(*) as n, string_agg(line, ',' order by line) as removed from (select distinct doc_id, line from v where i >= 0.8 * (a + b - i) - 1e-9) group by 1)
select documents.doc_id, len(string_split(coalesce(text, ''), chr(10))) as n_lines, coalesce(n, 0) as n_removed, coalesce(removed, '') as removed_lines from documents left join r on r.doc_id = documents.doc_id""",
    "op6_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
s as (select doc_id, unnest(range(0, len(h) // 2 - 199)) as b, h from d where len(h) >= 400),
k as (select doc_id, b, md5(substring(h, 2 * b + 1, 400)) as w from s),
m as (select w from k group by w having count(*) > 1),
r as (select doc_id, b, lag(b) over (partition by doc_id order by b) as before from k where w in (select w from m)),
g as (select doc_id, b, sum(case when before is null or b > before + 200 then 1 else 0 end) over (partition by doc_id order by b) as g from r),
x as (select doc_id, g, min(b) as lo, max(b) + 200 as hi from g group by all),
y as (select doc_id, lo, hi, lag(hi, 1, 0) over (partition by doc_id order by lo) as kept from x),
z as (select y.doc_id, count(*) as n, sum(hi - lo) as gone, string_agg(substring(h, 2 * kept + 1, 2 * (lo - kept)), '' order by lo) || substring(any_value(h), 2 * max(hi) + 1) as rest from y join d on d.doc_id = y.doc_id group by 1)
select d.doc_id, len(h) // 2 as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(n, 0) as n_spans, sha256(unhex(coalesce(rest, h))) as kept_sha256 from d left join z on z.doc_id = d.doc_id""",
    "op7_chat": r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f as (select *, 4 + len(role) + case when role in ('user', 'assistant', 'system', 'tool') then 0 else 2 + len(regexp_replace(role, '[^"\\]', '', 'g')) end + 2 + 8
  + len(text) + case when strpos(text || '</turn>' || chr(10), '</turn>' || chr(10)) = len(text) + 1 then 0 else len(regexp_replace(text, '[^\\#<]', '', 'g')) end as chars from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then len(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars from f group by conv_id""",
    "op8_embeddings": """
with recursive e as (select vec_id, label, embedding::double[] as v from embeddings where label is not null),
l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.98),
r as (select vec_id, vec_id as root from embeddings union select r.vec_id, l.b from r join l on l.a = r.root),
c as (select vec_id, min(root) as component_id from r group by 1), n as (select a, count(*) as n from l group by 1)
select c.vec_id, coalesce(n, 0) as n_links, component_id, c.vec_id = component_id as kept from c left join n on n.a = c.vec_id""",
    # Counts by part and set of failing filters; each order and step reads them.
    "op12_filter_audit": r"""
with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
f as (select part, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t))::int
  + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask,
  (doc_id in (select doc_id from labels where quality = 1 and doc_id is not null))::int as good, (doc_id in (select doc_id from labels where toxic = 1 and doc_id is not null))::int as toxic from w),
g as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from f group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step, filter_order[step] as x, 1 << (ascii(filter_order[step]) - 65) as bit,
  coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))), 0)::int as before from o, (select unnest(range(1, 6))::int as step)),
r as (select part, filter_order, step, x, sum(case when mask & (before | bit) = 0 then n else 0 end) as kept, sum(case when mask & bit > 0 and mask & before = 0 then n else 0 end) as removed,
  sum(case when mask & bit > 0 and mask & before > 0 then n else 0 end) as redundant, sum(case when mask = bit then n else 0 end) as unique_fails,
  sum(case when mask & bit > 0 and mask & before = 0 then good else 0 end) as good_lost, sum(case when mask & bit > 0 and mask & before = 0 then toxic else 0 end) as toxic_lost from g, s group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, x))::bigint as shapley from r""",
    "op13_hard_negatives": """
with e as (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select *, row_number() over () as anchor from (select distinct * from e where vec_id % 100 = 0)),
s as (select anchor, a.vec_id as anchor_id, e.vec_id, a.label = e.label as same, list_sum(list_transform(list_zip(a.v, e.v), lambda z: z[1] * z[2]))::bigint as score from a join e on len(a.v) = len(e.v)),
p as (select anchor, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor order by score desc, vec_id) as k from s where same and vec_id <> anchor_id qualify k <= 5)
select anchor_id, positive_id, (row_number() over (partition by p.anchor, k order by score desc, vec_id))::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor, anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score qualify rank <= 10""",
}
