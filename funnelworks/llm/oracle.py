"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from funnelworks.llm import oracle_trees

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _level(k: int, path: list[str], weight: str, source: str, up: str | None, total: str) -> str:
    """A level of the mixing tree: budget of each node from its parent's, by its place among its siblings."""
    keys, parent, name = ", ".join(path), path[:-1], path[-1]
    budget = total if up is None else "p.given"
    join = "" if up is None else f"join {up} p using ({', '.join(parent)})"
    near = f"partition by {', '.join(parent)}" if parent else ""
    order = f"{near} order by cap::double / w, {name}"
    return f"""
n{k} as (select {keys}, sum(cap) cap, any_value({weight}) w from {source} group by {keys}),
a{k} as (select n.*, ({budget})::hugeint up from n{k} n {join}),
b{k} as (select *, cap * sum(w) over ({order} rows between current row and unbounded following)
  <= w * (up - coalesce(sum(cap) over ({order} rows between unbounded preceding and 1 preceding), 0)) filled from a{k}),
c{k} as (select *, up - coalesce(sum(cap) filter (filled) over ({near}), 0) rest_up, sum(w) filter (not filled) over ({near}) all_w,
  sum(w) filter (not filled) over ({order} rows between unbounded preceding and current row) upto from b{k}),
l{k} as (select {keys}, (case when filled then cap else (upto * rest_up) // all_w - ((upto - w) * rest_up) // all_w end)::bigint given from c{k})"""


def _mixing() -> str:
    levels = ["domain", "lang", "source"]
    weights = {"domain": "case domain when 'd0' then 2 when 'd1' then 3 when 'd2' then 4 else 1 end",
               "lang": "case lang when 'en' then 6 when 'de' then 3 when 'fr' then 2 when 'es' then 2 else 1 end",
               "source": "case source when 'src0' then 3 else 1 end"}
    parts = [_level(k + 1, levels[:k + 1], weights[x], "leaves", f"l{k}" if k else None, "(select sum(avail)::hugeint // 2 from leaves)")
             for k, x in enumerate(levels)]
    return f"""
with docs as (select doc_id, coalesce('d' || (ascii(md5(source)) % 3), '(none)') as domain, coalesce(lang, '(none)') as lang,
  coalesce(source, '(none)') as source, len({WORDS})::bigint n_tokens from documents),
leaves as (select domain, lang, source, sum(n_tokens)::hugeint avail, 4 * sum(n_tokens)::hugeint cap from docs
  group by all having sum(n_tokens) > 0),{','.join(parts)},
plans as (select domain, lang, source, given // avail as full_epochs, given % avail as rest
  from l3 join leaves using (domain, lang, source) where given > 0),
rows_ as (select d.*, full_epochs, rest, unnest(range(0, (full_epochs + (rest > 0)::int)::bigint)) as epoch
  from docs d join plans using (domain, lang, source)),
placed as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source, epoch
  order by md5('7:' || epoch || ':' || doc_id), doc_id rows between unbounded preceding and 1 preceding), 0) as begin_ from rows_)
select doc_id, domain, lang, source, epoch::bigint as epoch, n_tokens,
  (case when epoch < full_epochs then n_tokens else least(n_tokens, rest - begin_) end)::bigint as n_taken
from placed where epoch < full_epochs or begin_ < rest"""


QUALITY = f"""
with d as (select doc_id, coalesce(text, '') as t, {WORDS} as w from documents),
pos as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) as p from d),
win as (select doc_id, p, array_to_string(w[p:p + 4], chr(1)) as x from pos),
twice as (select doc_id, p from (select *, count(*) over (partition by doc_id, x) as n from win) where n > 1),
covered as (select doc_id, count(distinct q) as n from (select doc_id, unnest(range(p, p + 5)) as q from twice) group by doc_id),
line as (select doc_id, unnest(string_split(t, chr(10))) as x from d),
lines as (select doc_id, count(*) as n_lines, count(distinct x) as n_different from line
  where regexp_matches(x, '[^\\x20\\x09-\\x0D]') group by doc_id),
f as (select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_lines - n_different, 0)::bigint as n_dup_lines,
  coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(n_lines, 0) as n_lines, length(regexp_replace(t, '[^\\pL]', '', 'g')) as n_letters
  from d left join lines using (doc_id) left join covered c using (doc_id)),
g as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 5 * n_symbols <= n_words and word_chars between 2 * n_words and 15 * n_words
    and 2 * n_dup_lines <= n_lines and 2 * n_letters >= word_chars as kept
from g"""

SQL: dict[str, str] = {"op7_mixing": _mixing(), "op8_quality_rules": QUALITY, **oracle_trees.SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
