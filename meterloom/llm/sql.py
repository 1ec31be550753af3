"""SQL with the same results, for queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op9_exact_dedup"] = """
select doc_id,
       max(doc_id) over same as keep_id,
       count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""

#: Words are runs of anything but space and the characters from tab to carriage return.
_WORD = r"[^ \t\n\x0B\f\r]+"

ORACLE["op5_hyperminhash"] = rf"""
with recursive words as (
    select doc_id,
           regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '{_WORD}') as w
    from documents
), sets as (
    select doc_id,
           case when len(w) = 0 then []
                when len(w) < 4 then [array_to_string(w, ' ')]
                else list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)])
           end as s
    from words
), items as (
    select doc_id, len(s) as n, unnest(s) as x from sets
), links as (
    select a.doc_id as a, b.doc_id as b
    from items a join items b on a.x = b.x and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n
    having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(doc_id, other) as (
    select doc_id, doc_id from documents
    union
    select reach.doc_id, links.b from reach join links on reach.other = links.a
), least as (
    select doc_id, min(other) as component_id from reach group by doc_id
)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept
from sets join least using (doc_id)
"""

ORACLE["op6_suffix_automaton"] = rf"""
with words as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents
), windows as (
    select doc_id, s, array_to_string(w[s:s + 49], ' ') as win
    from (select doc_id, w, unnest(range(1, len(w) - 48)) as s from words)
), firsts as (
    select win, min(doc_id) as first_doc from windows group by win
), gone as (
    select distinct doc_id, unnest(range(s, s + 50)) as p
    from windows join firsts using (win) where first_doc < doc_id
), each as (
    select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from words
), marked as (
    select each.doc_id, each.p, word, gone.p is not null as removed
    from each left join gone on each.doc_id = gone.doc_id and each.p = gone.p
), runs as (
    select *, removed and not coalesce(lag(removed) over (partition by doc_id order by p), false) as opens
    from marked
), sums as (
    select doc_id, count(*) filter (removed) as n_removed, count(*) filter (opens) as n_spans,
           string_agg(word, ' ' order by p) filter (not removed) as kept
    from runs group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256, coalesce(n_spans, 0) as n_spans
from words left join sums using (doc_id)
"""

ORACLE["op7_suffix_array"] = """
with bytes as (
    select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), windows as (
    select doc_id, s, substr(h, 2 * s - 1, 100) as win
    from (select doc_id, h, unnest(range(1, len(h) // 2 - 48)) as s from bytes)
), firsts as (
    select win, min(doc_id) as first_doc from windows group by win
), gone as (
    select distinct doc_id, unnest(range(s, s + 50)) as p
    from windows join firsts using (win) where first_doc < doc_id
), ordered as (
    select doc_id, p, p - row_number() over (partition by doc_id order by p) as run from gone
), removed as (
    select doc_id, min(p) as a, max(p) + 1 as b from ordered group by doc_id, run
), edges as (
    select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 1) as since from removed
), pieces as (
    select edges.doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last,
           string_agg(substr(h, 2 * since - 1, 2 * (a - since)), '' order by a) as head
    from edges join bytes using (doc_id) group by edges.doc_id
)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 1) - 1))) as kept_sha256
from bytes left join pieces using (doc_id)
"""

ORACLE["op11_swar_infill"] = """
with units as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
           sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h
    from documents
), numbers as (
    select *, len(u) as n,
           cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
           cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
    from units
), cuts as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
           case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90
                then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
    from numbers
), parts as (
    select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m,
           array_to_string(u[b + 1:n], '') as s
    from cuts
)
select doc_id, cast(n as bigint) as n, form,
       case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from parts
"""
