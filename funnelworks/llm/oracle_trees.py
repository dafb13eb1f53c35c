"""DuckDB SQL for operators 11 (hash trees), 12 (prefix trie) and 13 (secrets)."""

from __future__ import annotations

from funnelworks.llm import secret_scan

WORD = r"[^\x20\x09-\x0D]+"


def crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII expression, bit by bit."""
    byte = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)"
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {byte}), lambda c, b: {bits}), 4294967295)"


def _leaf(n_chars: str) -> str:
    fields = ["doc_id::varchar", "source", "lang", n_chars, "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


MERKLE = f"""
with recursive raw as (select row_number() over () as k, doc_id, lang, {_leaf("n_chars::varchar")} as leaf,
  case when {crc32("doc_id::varchar")} % 7 = 0 then {_leaf("(n_chars::hugeint + 1)::varchar")} end as tampered from documents),
leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by lang) as n from raw),
tree as (select lang, 0 as lvl, place, n, leaf as h from leaves
  union all select lang, lvl + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' order by place)) from tree where n > 1 group by lang, lvl, n, place // 2),
sub as (select lang, h, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as n from tree where n = 1),
top as (select 0 as lvl, place, n, h from sub
  union all select lvl + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' order by place)) from top where n > 1 group by lvl, n, place // 2),
levels as (select distinct lang, lvl from tree where n > 1),
steps as (select l.k, v.lvl, 0 as part, (l.place >> v.lvl) & 1 as odd, t.h from leaves l join levels v on l.lang is not distinct from v.lang
    left join tree t on t.lang is not distinct from l.lang and t.lvl = v.lvl and t.place = xor(l.place >> v.lvl, 1)
  union all select l.k, v.lvl, 1, (s.place >> v.lvl) & 1, t.h from leaves l join sub s on l.lang is not distinct from s.lang
    cross join (select distinct lvl from top where n > 1) v left join top t on t.lvl = v.lvl and t.place = xor(s.place >> v.lvl, 1)),
numbered as (select *, row_number() over (partition by k order by part, lvl) as i from steps),
fold as (select k, 0::bigint as i, coalesce(tampered, leaf) as h from leaves
  union all select f.k, s.i, sha256(case when s.odd = 1 then coalesce(s.h, '') || f.h else f.h || coalesce(s.h, '') end)
    from fold f join numbered s on s.k = f.k and s.i = f.i + 1),
ends as (select k, arg_max(h, i) as folded_root from fold group by k),
proof as (select k, string_agg(h, '' order by i) as siblings from numbered group by k)
select l.doc_id, l.leaf, s.h as subroot, r.h as root, sha256(coalesce(p.siblings, '')) as proof_sha256, e.folded_root, e.folded_root = r.h as verified
from leaves l join sub s on l.lang is not distinct from s.lang cross join (select h from top where n = 1) r
join ends e using (k) left join proof p using (k)"""


TRIE = f"""
with t as (select conv_id as c, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as d,
  len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as words from conversations where conv_id is not null),
o as (select *, row_number() over (partition by c order by turn nulls first, d) as i from t),
size as (select c, count(*) as n, {crc32("c::varchar")} % 4 as h from t group by c),
plan as (select s.c, s.h, s.n, s.c - s.c % 20 as donor, least(s.h, coalesce(g.n, 0)) as k from size s left join size g on g.c = s.c - s.c % 20),
reb as (select p.c, o.i as pos, o.d, o.words from plan p join o on o.c = p.donor and o.i <= p.k
  union all select p.c, o.i - p.h + p.k, o.d, o.words from plan p join o on o.c = p.c and o.i > p.h),
paths as (select c, pos as depth, string_agg(d, '') over (partition by c order by pos) as key, words from reb
  union all select c, 0, '', 0 from plan),
node as (select key, depth, min(c) as conv_id, count(*) as n_convs, min(words) as words from paths group by key, depth),
kids as (select left(key, length(key) - 64) as key, count(*) as n from node where depth > 0 group by all),
full_ as (select n.*, coalesce(k.n, 0) as n_children from node n left join kids k using (key)),
sub as (select left(key, 64 * unnest(range(0, depth + 1))::bigint) as top, n_children, (n_convs - 1) * words as saved from full_),
sums as (select top as key, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved from sub group by top),
last as (select c, max(depth) as depth from paths group by c),
ended as (select p.key, string_agg(p.c::varchar, ',' order by p.c) as ids from paths p join last using (c, depth) group by p.key)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves,
  s.saved::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from full_ n left join full_ p on n.depth > 0 and p.key = left(n.key, length(n.key) - 64) join sums s on s.key = n.key left join ended e on e.key = n.key"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    words = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = rf"""(?:{words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    classes = [("[0-9A-Fa-f]+", "lower(m)", "[0-9a-f]"), ("[A-Za-z0-9+/_=-]+", "m", "[A-Za-z0-9+/_=-]")]
    patterns = [assign, "AKIA[A-Z0-9]+", "[0-9a-f]+", *[c[0] for c in classes]]
    raw = "\n  union all ".join(f"select k, {n} as kind, regexp_extract_all(t, {_quoted(p)}) as ms, string_split_regex(t, {_quoted(p)}) as gs from d"
                                for n, p in enumerate(patterns))
    harmless = [f"regexp_full_match(m, {_quoted(p.replace(']++', ']+').replace(']*+', ']*').replace(')*+', ')*'))})" for p in secret_scan.ALLOW]
    harmless += [f"contains({_quoted(t)}, m)" for t in secret_scan.KNOWN]
    best = []
    for n, (c, (_, form, _)) in enumerate(zip(secret_scan.CLASSES, classes, strict=True)):
        best.append(f"select k, kind, i, substr({form}, p::bigint, {c.window}) as w, {secret_scan.limit(c)} as most, {c.window} as size from "
                    f"(select *, unnest(range(1, length(m) - {c.window} + 2)) as p from cand where kind = {3 + n} and length(m) >= {c.window})")
    weight = "round((length(w) - length(replace(w, x, ''))) * log2(length(w) - length(replace(w, x, ''))) * 1000000)"
    return f"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
raw as ({raw}),
occ as (select k, kind, unnest(range(1, len(ms) + 1)) as i, unnest(ms) as m, unnest(list_transform(gs[:len(ms)], lambda g: length(g))) as gap from raw where len(ms) > 0),
pos as (select *, sum(gap + length(m)) over (partition by k, kind order by i) as stop from occ),
spans as (select k, kind, i, m, (stop - length(m))::bigint as start, stop::bigint as stop from pos),
base as (select k, kind, start, stop from spans where kind = 0 and length(regexp_extract(m, {_quoted(assign)}, 1)) >= {secret_scan.MIN_VALUE}
  or kind = 1 and length(m) >= 20 or kind = 2 and length(m) >= 24),
cand as (select * from spans s where kind >= 3 and regexp_matches(m, '[0-9]') and regexp_matches(m, '[^0-9]') and not ({" or ".join(harmless)})
  and not exists (select 1 from base b where b.k = s.k and b.start < s.stop and b.stop > s.start)),
win as ({" union all ".join(best)}),
found as (select distinct k, kind, i from win where length(regexp_replace(w, '[^0-9]', '', 'g')) between {secret_scan.MIN_MIX} and size - {secret_scan.MIN_MIX}
  and list_sum(list_transform(list_distinct(string_split(w, '')), lambda x: {weight})) <= most),
added as (select c.k, c.start, c.stop from cand c join found using (k, kind, i)),
marked as (select *, coalesce(max(stop) over (partition by k order by start, stop desc rows between unbounded preceding and 1 preceding) <= start, true)::int as fresh from added),
isle as (select *, sum(fresh) over (partition by k order by start, stop desc rows unbounded preceding) as g from marked),
every as (select k, kind, start, stop from base union all select k, 3, min(start), max(stop) from isle group by k, g),
named as (select *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || stop as one from every),
per as (select k, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as c, count(*) filter (kind = 2) as h, count(*) filter (kind = 3) as e,
  string_agg(one, ',' order by start, kind) as spans, string_agg(one, ',' order by start, kind) filter (kind < 3) as base from named group by k)
select doc_id, coalesce(a, 0) as n_assign, coalesce(c, 0) as n_access, coalesce(h, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(e, 0) as n_entropy from d left join per using (k)"""


SQL: dict[str, str] = {"op11_merkle_manifest": MERKLE, "op12_conversation_trie": TRIE, "op13_secret_scan": _secrets()}
