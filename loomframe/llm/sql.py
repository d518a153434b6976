"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .queries import URL_RULES
from .secretscan import RULES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"


def _fold(x: str) -> str:
    return f"translate({x}, '{_UP}', '{_LOW}')"


def _escaped(x: str) -> str:
    return rf"(2 * length({x}) - length(replace(replace(replace({x}, '<', ''), '[', ''), '\', '')))"


OP1 = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  cast(sum(23 + {_escaped("role")} + {_escaped("text")}) as bigint) as formatted_chars
from c group by conv_id"""


def _op2(rounds: int = 10, damping: float = 0.85, threshold: float = 0.1) -> str:
    ordered = sorted(URL_RULES, key=lambda r: (-len(r.name), -len(r.host)))
    fits = [f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')" for r in ordered]
    rule = "case " + " ".join(f"when {f} then '{r.name}'" for f, r in zip(fits, ordered, strict=True)) + " end"
    verdict = "case " + " ".join(f"when {f} then '{r.verdict}'" for f, r in zip(fits, ordered, strict=True)) + " end"
    steps = "".join(
        f""", m{i} as (select dst as host, sum(case when along then w * trust else 0 end) as t, sum(case when along then 0 else w * distrust end) as d from step join s{i - 1} on s{i - 1}.host = src group by dst),
s{i} as (select coalesce(a.host, m.host) as host, {1 - damping} * coalesce(t0, 0) + {damping} * coalesce(t, 0) as trust, {1 - damping} * coalesce(d0, 0) + {damping} * coalesce(d, 0) as distrust from seeds a full join m{i} m on a.host = m.host)"""
        for i in range(1, rounds + 1)
    )
    return rf"""
with u as (select page_id, html, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages),
j0 as (select page_id, html, coalesce({_fold("regexp_extract(rest, '^[^/?#]*')")}, '') as host, coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') as path from u),
j as (select page_id, html, host, path, {rule} as rule, {verdict} as v from j0),
h as (select host, case when count(*) filter (v = 'allow') > count(*) filter (v = 'block') then 1.0 else 0.0 end as t, case when count(*) filter (v = 'block') > count(*) filter (v = 'allow') then 1.0 else 0.0 end as d from j where host <> '' group by host),
seeds as (select host, cast(t / greatest(1, (select sum(t) from h)) as double) as t0, cast(d / greatest(1, (select sum(d) from h)) as double) as d0 from h),
l as (select host as src, {_fold("unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*[\"'']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"''\\s<>]+)', 1))")} as dst from j),
e as (select src, dst, count(*) as n from l where src <> '' and dst <> '' and src <> dst group by src, dst),
b as (select src, dst, n, true as along from e union all select dst, src, n, false from e),
step as (select src, dst, along, n / sum(n) over (partition by src, along) as w from b),
s0 as (select host, t0 as trust, d0 as distrust from seeds){steps}
select page_id, j.host, path, rule, coalesce(v, case when coalesce(distrust, 0) * greatest(1, (select count(*) from s{rounds})) > {threshold} and coalesce(distrust, 0) > coalesce(trust, 0) then 'block' else 'allow' end) as verdict
from j left join s{rounds} s on s.host = j.host""".replace("\\\\", "\\")


OP5 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_fold("coalesce(text, '')")}, '{_WORD}') as words from documents),
s as (select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
  else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) end as sh from w),
x as (select doc_id, len(sh) as n, unnest(sh) as t from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as i, any_value(a.n) as na, any_value(b.n) as nb from x a join x b on a.t = b.t and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from c where 100 * i >= 80 * (na + nb - i)),
r(a, b) as (select doc_id, doc_id from s union select r.a, l.b from r join l on r.b = l.a)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, m.c as component_id from s join (select a, min(b) as c from r group by a) m on m.a = s.doc_id"""

OP7 = rf"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from d),
k as (select *, {_fold("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l),
f as (select key, min(doc_id) as first from k where length(key) >= 10 group by key),
g as (select k.*, length(k.key) >= 10 and f.first <> k.doc_id as gone from k left join f on f.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not coalesce(gone, false)), '')) as kept_sha256
from g group by doc_id"""


def _op8() -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"select doc_id, {i} as o, '{r.kind}' as kind, {r.least} as least, unnest(list_zip(list_transform(string_split_regex(text, '{p}'), lambda x: length(x)), list_transform(regexp_extract_all(text, '{p}'), lambda x: length(x)), "
            f"list_transform(regexp_extract_all(text, '{p}', {r.group}), lambda x: length(x)))) as z, generate_subscripts(string_split_regex(text, '{p}'), 1) as i from t where regexp_matches(text, '{p}')"
        )
    return f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
p as ({" union all ".join(parts)}),
q as (select doc_id, o, kind, least, i, z[2] as m, z[3] as g, sum(z[1] + coalesce(z[2], 0)) over (partition by doc_id, kind order by i) as upto from p),
s as (select doc_id, o, kind, cast(upto - m as bigint) as a, cast(upto as bigint) as b from q where m is not null and g >= least)
select t.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, o) filter (o < 3), '')) as base_sha256,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, o), '') as spans
from t left join s on s.doc_id = t.doc_id group by t.doc_id"""


OP9 = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(source, chr(0)) as host, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '{_WORD}') as words from d),
v as (select r, unnest(range(1, len(words) - 3)) as i, words from w where len(words) >= 5),
k as (select r, i, count(*) over (partition by r, array_to_string(words[i:i + 4], ' ')) as c from v),
rep as (select r, count(distinct i + o) as n from k, range(5) t(o) where c >= 2 group by r),
l as (select r, host, text, unnest(string_split(text, chr(10))) as line from d),
ln as (select *, regexp_extract_all({_fold("line")}, '{_WORD}') as ws from l),
dup as (select r, count(*) - count(distinct line) as n from ln where len(ws) > 0 group by r),
sl as (select r, host, text, array_to_string(ws, ' ') as key, len(ws) as n from ln where len(ws) >= 1),
lim as (select host, greatest(20, 0.01 * count(distinct text)) as most from d group by host),
often as (select sl.host, key from sl join lim on lim.host = sl.host group by sl.host, key, most having count(distinct text) > most),
gone as (select r, sum(n) as n from sl join often using (host, key) group by r),
o as (select w.doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words, coalesce(gone.n, 0) as gone
  from w left join dup using (r) left join rep using (r) left join gone using (r)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from o)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and n_words - gone >= 0.1 * n_words as kept from f"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1, "op2_url_filters": _op2(), "op5_jaccard_join": OP5, "op7_line_dedup": OP7, "op8_secret_scans": _op8(), "op9_quality_rules": OP9}
