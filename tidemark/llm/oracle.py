"""The registered queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: A word is covered if a window of `m` words around it occurs twice in its text; a repeat is
#: longer than `k` words if a window of k + 1 words occurs twice.
OP3 = rf"""
with w as (select doc_id, coalesce(text, '') as text, {WORDS} as ws from documents),
p as (select doc_id, ws, unnest(range(len(ws))) as i from w),
g as (select doc_id, i, array_to_string(ws[i + 1:i + 3], ' ') as g3,
             case when i + 8 <= len(ws) then array_to_string(ws[i + 1:i + 8], ' ') end as g8,
             case when i + 61 <= len(ws) then md5(array_to_string(ws[i + 1:i + 61], ' ')) end as g61,
             len(ws) as n from p),
c as (select doc_id, i,
             i + 3 <= n and count(*) over (partition by doc_id, g3, i + 3 <= n) > 1 as r3,
             g8 is not null and count(*) over (partition by doc_id, g8) > 1 as r8,
             g61 is not null and count(*) over (partition by doc_id, g61) > 1 as r61 from g),
m as (select doc_id,
             max(r3) over (partition by doc_id order by i rows between 2 preceding and current row) as in3,
             max(r8) over (partition by doc_id order by i rows between 7 preceding and current row) as in8,
             r61 from c),
s as (select doc_id, sum(in3::bigint)::bigint as n3, sum(in8::bigint)::bigint as n8, max(r61) as long
      from m group by doc_id),
l as (select doc_id, unnest(string_split(text, chr(10))) as line from w),
d as (select doc_id, (count(*) - count(distinct line))::bigint as dup from l
      where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
b as (select w.doc_id, len(ws)::bigint as n_words,
             length(array_to_string(ws, ''))::bigint as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
             coalesce(dup, 0)::bigint as n_dup_lines, coalesce(n3, 0)::bigint as n_repeat_words,
             coalesce(n8, 0)::bigint as covered_words, coalesce(long, false) as long
      from w left join s using (doc_id) left join d using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and covered_words <= 0.3::double * n_words and not long as kept, covered_words
from f
"""

OP5 = rf"""
with d as (select doc_id, source, len({WORDS})::bigint as size,
                  ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as key
           from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
t as (select *, [3, 1, 2][(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight,
             2.0::double * source_size as most, 1.5::double * sum(source_size) over () as total,
             row_number() over (order by source is null, source) - 1 as turn from s),
r as (select *, row_number() over (order by most / weight, turn) as place,
             (total - coalesce(sum(most) over (order by most / weight, turn
                  rows between unbounded preceding and 1 preceding), 0))
             / (sum(weight) over (order by most / weight, turn
                  rows between current row and unbounded following))::double as level from t),
c as (select *, min(case when level * weight <= most then place end) over () as p0 from r),
g as (select source, source_size,
             case when place >= p0 then (select min_by(level, place) from c where place = p0) * weight
                  else most end as target from c),
e as (select *, case when source_size > 0 then round(target)::bigint // source_size else 0 end as epochs from g),
b as (select *, round(target)::bigint - epochs * source_size as rest from e),
x as (select d.*, coalesce(sum(size) over (partition by source order by key, doc_id, size
             rows between unbounded preceding and 1 preceding), 0)::bigint as before from d)
select doc_id, x.source, size, source_size, target,
       (epochs * size + greatest(0, least(rest - before, size)))::bigint as taken
from x join b on x.source is not distinct from b.source
"""

OP7 = r"""
with l0 as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as line_no
            from documents),
l as (select doc_id, line_no, doc_id * 1000000 + line_no as pos,
             regexp_extract_all(line, '[^\x20\x09-\x0D]+') as ws from l0),
t as (select *, array_to_string(ws, ' ') as seq, len(ws) as n from l where len(ws) > 0),
d as (select seq, min(pos) as first, any_value(ws) as ws, any_value(n) as n from t group by seq),
v as (select seq, first, n, i, array_to_string(list_concat(ws[1:i], ws[i + 2:]), ' ') as key
      from (select *, unnest(range(n)) as i from d where n >= 8)),
s as (select seq, first, min(first) over (partition by key, i) as m from v),
x as (select v.seq, v.first, d.first as m from v join d on d.seq = v.key and d.n >= 8
      union all select d.seq, d.first, v.first as m from v join d on d.seq = v.key and d.n >= 8
      union all select * from s),
near as (select distinct seq from x where m < first),
w as (select t.doc_id, t.line_no, case when d.first < t.pos then 'exact'
                                       when near.seq is not null then 'near' end as why
      from t join d using (seq) left join near using (seq))
select a.doc_id, count(w.line_no)::bigint as n_lines, count(*) filter (why = 'exact')::bigint as n_exact,
       count(*) filter (why = 'near')::bigint as n_near,
       coalesce(string_agg(w.line_no::varchar, ',' order by w.line_no) filter (why is not null), '') as dropped
from documents a left join w using (doc_id) group by a.doc_id
"""

OP8 = r"""
with p as (select page_id, url, date '2024-01-01' + ((page_id * 7919) % 360)::int as day,
                  regexp_replace(lower(regexp_extract(url,
                      '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', '') as host,
                  regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([^/?#]*)', 1) as segment
           from pages),
n as (select distinct unnest([host, host || '/' || segment]) as pattern from p where host <> ''),
c as (select pattern, ('0x' || substr(md5(pattern), 1, 1))::int as digit,
             ('0x' || substr(md5(pattern), 2, 3))::int % 180 as d from n),
spans as (select pattern, date '2024-01-01' + d as f,
                 case when digit % 2 = 1 then date '2024-01-01' + (d + 90) end as t from c where digit < 5
          union all
          select pattern, date '2024-01-01' + (d + 180), null from c where digit = 1),
k as (select distinct host, segment from p where host <> ''),
q as (select host, segment, unnest(list_distinct(list_append(
             [array_to_string(string_split(host, '.')[i:], '.') for i in range(1, len(string_split(host, '.')) + 1)],
             host || '/' || segment))) as pattern from k),
m as (select page_id, count(*) as n,
             min(case when contains(s.pattern, '/') then '1' else '0' end || s.pattern) as first
      from p join q using (host, segment) join spans s using (pattern)
      where s.f <= p.day and (s.t is null or p.day < s.t) group by page_id)
select page_id, url, strftime(day, '%Y-%m-%d') as fetched_on, coalesce(n, 0)::bigint as n_matches,
       substr(first, 2) as first_pattern, coalesce(n, 0) > 0 as blocked
from p left join m using (page_id)
"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: kind, order, pattern, part whose length counts, least length.
_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
_SECRETS = (
    ("assign", 1, rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", 2, "AKIA[A-Z0-9]+", 0, 20),
    ("hex", 3, "[0-9a-f]+", 0, 24),
    ("github", 4, "gh[pousr]_[A-Za-z0-9]{36,}", 0, 36),
    ("slack", 5, "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 10),
    ("private_key", 6, "-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", 0, 20),
    ("jwt", 7, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 20),
    ("url_password", 8, r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~-]+:[^\s:@/]{3,}@", 0, 5),
)
_MATCHED = " union all ".join(
    f"""select r, '{kind}' as kind, {place} as place, {least} as least, unnest(range(1, len(size) + 1)) as i,
        unnest(gap[:-2]) as gap, unnest(size) as size, unnest(part) as part
        from (select r, list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) as gap,
                     list_transform(regexp_extract_all(text, '{pattern}', 0), lambda x: length(x)) as size,
                     list_transform(regexp_extract_all(text, '{pattern}', {part}), lambda x: length(x)) as part
              from d where len(list_filter(regexp_extract_all(text, '{pattern}', {part}), lambda x: length(x) >= {least})) > 0)"""
    for kind, place, pattern, part, least in _SECRETS
)
#: Matches and the gaps between them, in order: a match ends where the lengths so far end.
OP11 = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
p as (select *, sum(gap + size) over (partition by r, kind order by i) as stop from ({_MATCHED})),
f as (select r, kind, place, stop - size as start,
             kind || ':' || (stop - size)::bigint || ':' || stop::bigint as span
      from p where part >= least),
g as (select r, count(*) filter (kind = 'assign') as n_assign,
             count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
             string_agg(span, ',' order by start, place) filter (place <= 3) as base,
             string_agg(span, ',' order by start, place) as spans from f group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access,
       coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
       coalesce(spans, '') as spans
from d left join g using (r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_suffix_repeats": OP3,
        "op5_source_mix": OP5,
        "op7_deletion_neighbours": OP7,
        "op8_dated_url_lists": OP8,
        "op11_blob_ledger": OP11,
    }
