"""DuckDB SQL of the llm queries that SQL can express."""

from __future__ import annotations

_OP1 = r"""
with recursive
words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
),
sets as (
  select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
  from words
),
shingles as (select doc_id, unnest(s) as g from sets),
common as (
  select x.doc_id as a, y.doc_id as b, count(*) as n from shingles x join shingles y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2
),
links as (
  select a, b from common join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 75 * (len(x.s) + len(y.s) - n)
),
both_ways as (select a, b from links union select b, a from links),
reached as (select a, b from both_ways union select r.a, l.b from reached r join both_ways l on r.b = l.a),
least_of as (select a, min(b) as low from reached group by 1)
select doc_id, cast(len(s) as bigint) as n_shingles, least(doc_id, coalesce(low, doc_id)) as component_id,
       case when len(s) = 0 then doc_id else min(doc_id) over (partition by list_sort(s)) end as class_id
from sets left join least_of on a = doc_id
"""

_OP2 = r"""
with
pages_read as (
  select page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', '') as host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) as path,
         cast('0x' || substr(md5(coalesce(url, '')), 1, 6) as bigint) % 365 as day
  from pages
),
hosts as (select distinct host, cast('0x' || substr(md5(host), 1, 6) as bigint) as m from pages_read where host <> ''),
domains as (
  select distinct d as key, cast('0x' || substr(md5(d), 1, 6) as bigint) as m
  from (select array_to_string(list_reverse(list_reverse(string_split(host, '.'))[1:3]), '.') as d from hosts)
),
entries as (
  select 'spam' as list_name, 'block' as effect, 'domain' as kind, key, 'add' as action, m % 200 as since from domains where m % 3 = 0
  union all select 'spam', 'block', 'domain', key, 'remove', m % 200 + 40 + m % 97 from domains where m % 6 = 0
  union all select 'spam', 'block', 'domain', key, 'add', m % 200 + 160 + m % 97 from domains where m % 12 = 0
  union all select 'partners', 'allow', 'host', host, 'add', m % 300 from hosts where m % 7 = 0
  union all select 'folders', 'block', 'prefix', host || '/en', 'add', m % 365 from hosts where m % 5 = 0
),
dated as (
  select *, lead(since) over (partition by list_name, effect, kind, key order by since) as stop from entries
),
hits as (
  select p.page_id, p.url, d.effect, d.list_name from pages_read p join dated d
    on d.action = 'add' and d.since <= p.day and (d.stop is null or p.day < d.stop) and p.host <> ''
   and ((d.kind = 'domain' and (p.host = d.key or ends_with(p.host, '.' || d.key))) or (d.kind = 'host' and p.host = d.key)
        or (d.kind = 'prefix' and (p.host || p.path = d.key or starts_with(p.host || p.path, d.key || '/'))))
),
found as (
  select page_id, url, count(*) filter (effect = 'block') as n_block, count(*) filter (effect = 'allow') as n_allow, string_agg(distinct list_name, ',' order by list_name) as lists
  from hits group by 1, 2
)
select p.page_id, p.url, p.day, coalesce(n_block, 0) as n_block, coalesce(n_allow, 0) as n_allow, coalesce(lists, '') as lists,
       case when n_allow > 0 then 'allow' when n_block > 0 then 'block' else 'none' end as verdict
from pages_read p left join found f on f.page_id = p.page_id and f.url is not distinct from p.url
"""

_OP12 = r"""
with recursive
read as (
  select doc_id, lang, text,
         list_transform([cast(doc_id as varchar), source, lang, cast(n_chars as varchar)], lambda v: case when v is null then '-' else strlen(v) || ':' || v end) as head,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
         -- CRC-32 of the digits, a bit at a time
         xor(list_reduce(flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])),
             lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, 4294967295), 4294967295) as crc
  from documents
),
hashed as (
  select doc_id, lang, sha256(array_to_string(head, '') || case when text is null then '-' else strlen(text) || ':' || text end) as leaf,
         case when crc % 3 = 0 then sha256(array_to_string(head, '') || case when text is null then '-' else strlen(low) || ':' || low end) end as tampered
  from read
),
langs as (select lang, row_number() over (order by lang nulls first) - 1 as l from (select distinct lang from documents)),
leaves as (
  select doc_id, l, leaf, coalesce(tampered, leaf) as start, row_number() over (partition by l order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by l) as n
  from hashed join langs on hashed.lang is not distinct from langs.lang
),
up as (
  select 0 as lvl, l, pos, leaf as h, n from leaves
  union all
  select lvl + 1, l, pos // 8, sha256(string_agg(h, '' order by pos)), (n + 7) // 8 from up where n > 1 group by lvl, l, pos // 8, n
),
subroots as (select l, h as subroot from up where n = 1),
top as (
  select 0 as lvl, l as pos, subroot as h, (select count(*) from langs) as n from subroots
  union all
  select lvl + 1, pos // 8, sha256(string_agg(h, '' order by pos)), (n + 7) // 8 from top where n > 1 group by lvl, pos // 8, n
),
sides as (
  select lvl, l, pos, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as a,
         coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as b
  from up where n > 1 window w as (partition by lvl, l, pos // 8 order by pos)
),
top_sides as (
  select lvl, pos, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as a,
         coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as b
  from top where n > 1 window w as (partition by lvl, pos // 8 order by pos)
),
folded as (
  select l, pos as leaf_pos, 0 as lvl, pos, start as h, '' as seen from leaves
  union all
  select f.l, leaf_pos, f.lvl + 1, f.pos // 8, sha256(a || h || b), seen || a || b from folded f join sides s on s.l = f.l and s.lvl = f.lvl and s.pos = f.pos
),
in_lang as (select l, leaf_pos, arg_max(h, lvl) as h, arg_max(seen, lvl) as seen from folded group by 1, 2),
to_root as (
  select l, leaf_pos, 0 as lvl, l as pos, h, seen from in_lang
  union all
  select f.l, leaf_pos, f.lvl + 1, f.pos // 8, sha256(a || h || b), seen || a || b from to_root f join top_sides s on s.lvl = f.lvl and s.pos = f.pos
),
ended as (select l, leaf_pos, arg_max(h, lvl) as folded_root, sha256(arg_max(seen, lvl)) as proof_sha256 from to_root group by 1, 2)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified
from leaves join ended on ended.l = leaves.l and leaf_pos = leaves.pos join subroots on subroots.l = leaves.l cross join (select h as root from top where n = 1)
"""

_OP13 = r"""
with
told as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
turns as (
  select conv_id, length(text) as size, sha256(strlen(role) || ':' || role || text) as t,
         row_number() over (partition by conv_id order by turn nulls first, substr(sha256(strlen(role) || ':' || role || text), 1, 30)) as j
  from told
),
convs as (
  select conv_id, conv_id - conv_id % 100 as base,
         xor(list_reduce(flatten(list_transform(string_split(cast(conv_id as varchar), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])),
             lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, 4294967295), 4294967295) % 6 as h
  from (select distinct conv_id from told)
),
joined as (
  select c.conv_id, 0 as part, j, t, size from convs c join turns s on s.conv_id = c.base and s.j <= c.h
  union all select c.conv_id, 1, j, t, size from convs c join turns s on s.conv_id = c.conv_id and s.j > c.h
),
whole as (
  select c.conv_id, coalesce(list(t order by part, j) filter (t is not null), []) as seq, coalesce(list(size order by part, j) filter (t is not null), []) as sizes
  from convs c left join joined r on r.conv_id = c.conv_id group by 1
),
steps as (select conv_id, seq, sizes, unnest(range(0, len(seq) + 1)) as depth from whole),
nodes as (
  select seq[1:depth] as key, depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * coalesce(max(sizes[depth]), 0) as saved,
         sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (len(seq) = depth), '')) as ends_sha256
  from steps group by 1, 2
),
children as (select key[1:depth - 1] as key, count(*) as n_children from nodes where depth > 0 group by 1),
up as (select n.key[1:d] as key, d, n.saved, c.key is null as childless from (select *, unnest(range(0, depth + 1)) as d from nodes) n left join children c on c.key = n.key),
below as (select key, count(*) filter (childless) as n_leaves, sum(saved) as saved_tokens from up group by 1)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, n.ends_sha256
from nodes n join below b on b.key = n.key left join children c on c.key = n.key left join nodes p on n.depth > 0 and p.key = n.key[1:n.depth - 1]
"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": _OP1, "op2_url_filters": _OP2, "op12_merkle_manifest": _OP12,
    "op13_conversation_trie": _OP13,
}
