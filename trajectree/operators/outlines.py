"""SQL of trees: the nodes that programs made from the tables have, for the SQL of the tree queries. The queries themselves parse the programs."""

from trajectree.sources.order_programs import FRAGMENTS

#: Depth and label of each template's nodes in preorder, for the queries' SQL; {u} and {e} as in the templates (fixed values).
_OUTLINES = {
    "error": "0 Module,1 Assign,2 Name:x,2 Const:{u},1 Expr,2 Call,3 Name:print,3 Name:x",
    "click": "0 Module,1 For,2 Name:i,2 Call,3 Name:range,3 Const:{u},2 Expr,3 Call,4 Name:print,4 Name:i",
    "view": "0 Module,1 Assign,2 Name:n,2 Call,3 Name:int,3 Call,4 Name:input,1 If,2 Compare,3 Name:n,3 Gt,3 Const:{e},2 Expr,3 Call,4 Name:print,4 Name:n",
    "signup": "0 Module,1 Assign,2 Name:total,2 Const:0,1 AugAssign,2 Name:total,2 Add,2 Const:{u},1 Expr,2 Call,3 Name:print,3 Name:total",
    "purchase": "0 Module,1 Assign,2 Name:x,2 Const:{u},1 Assign,2 Name:y,2 Const:{e},1 Expr,2 Call,3 Name:print,3 Name:x,3 Name:y",
}
_ROWS = ", ".join(f"('{kind}', {k}, {node[0]}, '{node[2:]}')" for kind, nodes in _OUTLINES.items() for k, node in enumerate(nodes.split(",")))
#: SQL: t, the templates' nodes; b, each node with the nodes below it and itself; n, the nodes of all events.
NODES = f"""t as (select *, replace(split_part(label, ':', 1), 'Const', 'Constant') as type from (values {_ROWS}) v(kind, node, depth, label)),
b as (select a.kind, a.node as top, a.depth as top_depth, a.type as top_type, d.node, d.depth, d.label, d.type from t a join t d on a.kind = d.kind and d.node >= a.node
  and not exists (select 1 from t m where m.kind = a.kind and m.node > a.node and m.node <= d.node and m.depth <= a.depth)),
n as (select event_id as prog, user_id, ts, kind, node, depth, type, replace(replace(label, '{{u}}', user_id::varchar), '{{e}}', (event_id % 7)::varchar) as label from events join t on kind = event_type)"""
#: SQL: s, the statements of all events, each with its subtree as text.
STATEMENTS = NODES + """,
f as (select kind, top, string_agg((depth - top_depth) || label, ',' order by node) as form from b where top_type in ('Assign', 'AugAssign', 'Expr', 'For', 'If') group by all),
s as (select event_id as prog, user_id, ts, replace(replace(form, '{u}', user_id::varchar), '{e}', (event_id % 7)::varchar) as stmt from events join f on kind = event_type)"""

#: Depth, slot and label of the nodes of each statement that order programs are made of, in preorder, with the context of those that have one; {a} and {b} as there (fixed values).
_FRAGMENTS = (
    "1 - Assign,2 targets[0] Name:n Store,2 value Call,3 func Name:int Load,3 args[0] Call,4 func Name:input Load",
    "1 - For,2 target Name:i Store,2 iter Call,3 func Name:range Load,3 args[0] Const:{a},2 body[0] If,3 test Compare,4 left BinOp,5 left Name:i Load,5 op Mod,5 right Const:2,4 ops[0] Eq,"
    "4 comparators[0] Const:0,3 body[0] Expr,4 value Call,5 func Name:print Load,5 args[0] Name:i Load",
    "1 - ImportFrom:math,2 names[0] alias:gcd:g{b}",
    "1 - Assign,2 targets[0] Tuple Store,3 elts[0] Name:n Store,3 elts[1] Name:m Store,2 value Tuple Load,3 elts[0] Name:m Load,3 elts[1] Name:n Load",
    "1 - AugAssign,2 target Name:total Store,2 op Add,2 value Const:{a}",
    "1 - FunctionDef:f,2 args arguments,3 args[0] arg:x,3 args[1] arg:y,3 defaults[0] Const:{a},2 body[0] Return,3 value BinOp,4 left Name:x Load,4 op Add,4 right Name:y Load",
    "1 - With,2 items[0] withitem,3 context_expr Call,4 func Name:open Load,4 args[0] Const:\'\',3 optional_vars Name:s Store,2 body[0] Assign,3 targets[0] Name:t Store,3 value Call,"
    "4 func Attribute:read Load,5 value Name:s Load",
    "1 - Delete,2 targets[0] Subscript Del,3 value Name:x Load,3 slice Const:{b}",
    "1 - Assign,2 targets[0] Name:flag Store,2 value BoolOp,3 op Or,3 values[0] UnaryOp,4 op Not,4 operand Const:True,3 values[1] Compare,4 left Const:None,4 ops[0] Is,4 comparators[0] Name:n Load",
    "1 - Expr,2 value Call,3 func Name:print Load,3 args[0] IfExp,4 test Compare,5 left Name:n Load,5 ops[0] Gt,5 comparators[0] Const:{a},4 body Const:\'yes\',4 orelse Const:\'\',3 args[1] Const:1.5",
)


def _values() -> str:
    rows = []
    for fragment, nodes in enumerate(_FRAGMENTS):
        for k, node in enumerate(nodes.split(",")):
            depth, slot, label, ctx = (*node.split(" "), "")[:4]
            rows.append("(" + ", ".join([str(fragment), str(k), depth, *("'" + x.replace("'", "''") + "'" for x in (slot, label, ctx))]) + ")")
    return ", ".join(rows)


_TEXTS = ", ".join(f"({k}, '" + text.replace("'", "''") + "')" for k, text in enumerate(FRAGMENTS))
#: SQL: on_, the nodes of all order programs that can be parsed (prog, owner, ts, node, parent, depth, height, size, slot, label, type, ctx, walk, and form, the subtree as text).
ORDER_NODES = f"""ft as (select *, replace(split_part(label, ':', 1), 'Const', 'Constant') as type from (values {_values()}) v(fragment, k, depth, slot, label, ctx)),
fb as (select a.fragment, a.k as top, a.depth as top_depth, d.* exclude (fragment) from ft a join ft d on a.fragment = d.fragment and d.k >= a.k
  and not exists (select 1 from ft m where m.fragment = a.fragment and m.k > a.k and m.k <= d.k and m.depth <= a.depth)),
fs as (select fragment, top as k, count(*) as size, max(depth) - any_value(top_depth) as height, count(*) + count(case when ctx <> '' then 1 end) as walk,
  string_agg((depth - top_depth) || case when k = top then '' else slot end || label, ',' order by k) as form from fb group by all),
fp as (select ft.*, size, height, walk, form, coalesce((select max(p.k) from ft p where p.fragment = ft.fragment and p.k < ft.k and p.depth = ft.depth - 1), -1) as up from ft join fs using (fragment, k)),
ol as (select l_orderkey as prog, l_linenumber as b, cast(l_quantity as int) as a, fragment, replace(replace(text, '{{a}}', cast(l_quantity as int)::varchar), '{{b}}', l_linenumber::varchar) as text
  from lineitem join (values {_TEXTS}) x(fragment, text) on fragment = l_partkey % {len(_FRAGMENTS)} where l_orderkey % 16 <> 3),
os as (select ol.*, size, walk, height, count(*) over w as i, coalesce(sum(size) over w, 0) + 1 as begin_ from ol join fs on ol.fragment = fs.fragment and fs.k = 0
  window w as (partition by prog order by b, text rows between unbounded preceding and 1 preceding)),
oo as (select o_orderkey as prog, o_custkey as owner, o_orderdate as ts from orders),
fill as (select os.prog, (begin_ + k)::int as node, case when k = 0 then 0 else begin_ + up end::int as parent, depth, fp.height, fp.size::int as size, case when k = 0 then 'body[' || i || ']' else slot end as slot,
  replace(replace(label, '{{a}}', a::varchar), '{{b}}', b::varchar) as label, type, ctx, fp.walk, replace(replace(form, '{{a}}', a::varchar), '{{b}}', b::varchar) as form, os.fragment from os join fp on fp.fragment = os.fragment),
top as (select prog, 0 as node, -1 as parent, 0 as depth, max(height) + 1 as height, (sum(size) + 1)::int as size, '' as slot, 'Module' as label, 'Module' as type, '' as ctx, sum(walk) + 1 as walk, string_agg(form, ';' order by node) as form from fill where depth = 1 group by prog),
on_ as (select owner, ts, x.* from (select * exclude (fragment) from fill union all select * from top) x join oo using (prog))"""
#: SQL: matches (prog, ref, node, ref_node), by going through the steps of all four phases one node after the other, with the map so far as a list.
ORDER_MATCHES = f"""with recursive {ORDER_NODES},
nn as materialized (select x.*, coalesce(kids, []) as kids, coalesce(named, []) as named from on_ x left join
  (select prog, parent as node, list(node order by node) as kids, list(distinct label) filter (regexp_matches(slot, '^(func|target|targets.*)$')) as named from on_ group by all) y using (prog, node)),
pr as (select prog, lead(prog) over (partition by owner order by ts, prog) as ref, size from on_ where node = 0 qualify ref is not null),
st as materialized (select nn.*, phase, row_number() over (partition by prog order by phase, case phase when 1 then -height when 3 then height else 0 end, node) as step from nn, (values (1), (2), (3), (4)) p(phase)
  where phase = 4 or (phase = 2) = (height = 0)),
dp as materialized (select prog as ref, list(depth order by node) as depths from nn group by 1),
s(prog, ref, step, m) as (select prog, ref, 1::bigint, list_transform(range(size), lambda x: -1) from pr union all
  select prog, ref, step + 1, case when best is null then m else list_transform(m, lambda x, i: case when i > node and i <= node + size then best + i - 1 - node else x end) end
  from (select s.prog, s.ref, s.step, s.m, t.node, case t.phase when 1 then t.size else 1 end as size, arg_min(v.node::bigint, case t.phase when 3 then
      [(len(t.named) > 0 and not list_has_any(t.named, v.named))::bigint, -len(list_filter(t.kids, lambda c: s.m[c + 1] > v.node and s.m[c + 1] < v.node + v.size)),
       depths[s.m[list_filter(t.kids, lambda c: s.m[c + 1] > v.node and s.m[c + 1] < v.node + v.size)[1] + 1] + 1] - v.depth, list_filter(t.kids, lambda c: s.m[c + 1] > v.node and s.m[c + 1] < v.node + v.size)[1]]
      else [v.node::bigint] end) as best
    from s join st t on t.prog = s.prog and t.step = s.step join dp on dp.ref = s.ref left join nn v on v.prog = s.ref and s.m[t.node + 1] = -1 and not list_contains(s.m, v.node::bigint) and case t.phase
      when 1 then v.form = t.form and v.height = t.height when 2 then v.height = 0 and v.label = t.label
      when 3 then v.type = t.type and len(list_filter(t.kids, lambda c: s.m[c + 1] > v.node and s.m[c + 1] < v.node + v.size)) > 0 and (len(t.named) = 0 or len(v.named) = 0 or list_has_any(t.named, v.named))
      else t.parent >= 0 and s.m[t.parent + 1] >= 0 and s.m[t.parent + 1] = v.parent and v.slot = t.slot end
    group by all)),
matches as (select prog, ref, node, ref_node from (select prog, ref, unnest(range(len(m))) as node, unnest(m) as ref_node from s where step = (select count(*) + 1 from st where st.prog = s.prog)) where ref_node >= 0)
"""

#: Kinds of statements and of operators in order programs (fixed values).
STATEMENT_KINDS = "'Assign', 'For', 'If', 'Expr', 'ImportFrom', 'AugAssign', 'FunctionDef', 'Return', 'With', 'Delete'"
_OPERATORS = "'Add', 'Mod', 'Eq', 'Or', 'Not', 'Is', 'Gt'"
#: SQL: sg, the signature of each statement of the order programs that can be parsed (prog, node, sig), and fe, their features (prog, feature, n).
FEATURES = f"""with {ORDER_NODES},
cl as (select fragment, k, max(top) as stmt from fb join (select fragment, k as top, type as top_type from ft) using (fragment, top) where top_type in ({STATEMENT_KINDS}) group by all),
fo as (select fill.prog, fill.node, fill.type, fill.label, fill.slot, os.begin_ + cl.stmt as stmt from fill join os on os.prog = fill.prog and fill.node between os.begin_ and os.begin_ + os.size - 1
  join cl on cl.fragment = os.fragment and cl.k = fill.node - os.begin_),
tk as (select prog, stmt, case when type in ({_OPERATORS}) then type when type = 'Subscript' then 'sub' when label = 'Const:True' then 'kB' when label in ('Const:0', 'Const:1', 'Const:2') then 'k' || label[7:]
  when label = 'Const:1.5' then 'kF' when label[1:7] = 'Const:''' then 'kS' when label = 'Const:None' then null when type = 'Constant' then 'kI' when slot <> 'func' then null
  when label in ('Name:int', 'Name:input', 'Name:range', 'Name:print') then 'call:' || label[6:] when type = 'Attribute' then 'meth:' || label[11:] else 'call' end as tok from fo),
sg as (select fo.prog, fo.node, fo.type || coalesce('|' || toks, '') as sig from fo left join (select prog, stmt, string_agg(distinct tok, ',' order by tok) as toks from tk where tok is not null group by all) t
  on t.prog = fo.prog and t.stmt = fo.node where fo.node = fo.stmt),
sl as (select prog, sig, lead(sig, 1) over w as s1, lead(sig, 2) over w as s2 from sg window w as (partition by prog order by node)),
tl as (select prog, type || '/' || lead(type, 1) over w || '/' || lead(type, 2) over w || '/' || lead(type, 3) over w as gram from on_ window w as (partition by prog order by node)),
fe as (select prog, feature, sum(n)::bigint as n from (select prog, 'EU:' || sig as feature, 2 as n from sl union all select prog, 'E2:' || sig || '/' || s1, 1 from sl union all select prog, 'E3:' || sig || '/' || s1 || '/' || s2, 1 from sl
  union all select prog, 'Es1b:' || sig || '/' || s2, 1 from sl union all select prog, 'F4:' || gram, 1 from tl union all select prog, 'OP:' || type, 1 from on_ where type in ({_OPERATORS})
  union all select prog, 'CMP:' || type, 1 from on_ where type in ('Eq', 'Is', 'Gt') union all select prog, case when label = 'Const:True' then 'C:bool=True' when label = 'Const:None' then 'C:NoneType'
  when label = 'Const:1.5' then 'C:float' when label = 'Const:''''' then 'C:str=empty' when label[1:7] = 'Const:''' then 'C:str' when label in ('Const:0', 'Const:1', 'Const:2') then 'C:int=' || label[7:] else 'C:int=big' end, 1
  from on_ where type = 'Constant') x where feature is not null group by all)
"""
