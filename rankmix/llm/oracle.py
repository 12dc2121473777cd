"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from rankmix.llm.pii import AGAINST, BOOST, CONTEXT, FOR, IBAN_LENGTHS, SCORES

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP3 = f"""
with t as (select doc_id, sha256(translate(coalesce(text, ''), {_AZ})) as s from documents)
select doc_id, max(doc_id) over (partition by s) as keep_id, count(*) over (partition by s) as group_size,
       doc_id = max(doc_id) over (partition by s) as kept, s as text_sha256
from t
"""


def _case(column: str, weights: dict) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in weights.items()) + " else 1 end"


def _share(frm: str, keys: str, name: str, out: str) -> str:
    """A budget shared among children: those that cannot use their share give
    all they have, the rest is split by weight (weights are positive here)."""
    part = f"partition by {keys} " if keys else ""
    return f"""
  {out}_a as (select *, coalesce(sum(cap) over ({part}order by cap / w, {name}
                 rows between unbounded preceding and 1 preceding), 0) as s,
                 sum(w) over ({part}order by cap / w, {name}
                 rows between current row and unbounded following) as wl from ({frm})),
  {out}_b as (select *, cap * wl <= w * (budget - s) as full_up from {out}_a),
  {out}_c as (select *, sum(case when full_up then cap else 0 end) over ({part.strip()}) as taken,
                 sum(case when full_up then 0 else w end) over ({part.strip()}) as open_w from {out}_b),
  {out} as (select * exclude (s, wl, full_up, taken, open_w),
              cast(case when full_up then cap else (w * (budget - taken)) // greatest(open_w, 1) end as bigint) as alloc
            from {out}_c)"""


def op6(budget_percent: int, max_epochs: int, seed: int, weights: dict) -> str:
    wd, wl, ws = (_case(c, weights[c]) for c in ("domain", "lang", "source"))
    return f"""
with d0 as (
  select doc_id, coalesce(lang, 'none') as lang, coalesce(source, 'none') as source,
         cast((strlen(coalesce(text, '')) + 3) // 4 as bigint) as tokens,
         case when doc_id is null then md5(coalesce(text, '')) end as th from documents),
  d as (select *, case when regexp_extract(source, '([0-9]{{1,9}})$', 1) = '' then 'other' else
          'domain' || cast(cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as bigint) % 4 as varchar) end as domain from d0),
  leaf as (select domain, lang, source, cast(sum(tokens) as bigint) as supply from d group by all),
  dom as (select domain, {wd} as w, cast(sum(supply) * {max_epochs} as bigint) as cap,
            (select cast(least(sum(supply) * {budget_percent} // 100, sum(supply) * {max_epochs}) as bigint) from leaf) as budget
          from leaf group by domain),
  {_share("select * from dom", "", "domain", "da")},
  lan as (select l.domain, l.lang, {wl.replace('case lang', 'case l.lang')} as w,
            cast(sum(supply) * {max_epochs} as bigint) as cap, any_value(da.alloc) as budget
          from leaf l join da on l.domain = da.domain group by l.domain, l.lang),
  {_share("select * from lan", "domain", "lang", "la")},
  src as (select l.domain, l.lang, l.source, l.supply, {ws.replace('case source', 'case l.source')} as w,
            l.supply * {max_epochs} as cap, la.alloc as budget
          from leaf l join la on l.domain = la.domain and l.lang = la.lang),
  {_share("select * from src", "domain, lang", "source", "sa")},
  k as (select d.*, sa.alloc // greatest(sa.supply, 1) as epochs, sa.alloc % greatest(sa.supply, 1) as rest,
          md5('{seed}:' || cast(sa.alloc // greatest(sa.supply, 1) + 1 as varchar) || ':' ||
              coalesce(cast(doc_id as varchar), 'null' || th)) as key
        from d join sa on d.domain = sa.domain and d.lang = sa.lang and d.source = sa.source where sa.alloc > 0),
  r as (select *, sum(tokens) over (partition by domain, lang, source order by key, doc_id, tokens
                 rows between unbounded preceding and current row) as upto from k)
select doc_id, domain, lang, source, tokens as n_tokens,
       cast(epochs + case when rest > 0 and upto <= rest then 1 else 0 end as bigint) as copies
from r where epochs + case when rest > 0 and upto <= rest then 1 else 0 end > 0
"""


OP8 = f"""
with x as (select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos,
                  unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
  k as (select doc_id, pos, line, translate(trim(line, {_WHITE}), {_AZ}) as key from x),
  hot as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select k.doc_id, count(*) as n_lines, count(hot.key) as n_dropped,
       sha256(coalesce(string_agg(case when hot.key is null then line end, chr(10) order by pos), '')) as kept_sha256
from k left join hot on k.key = hot.key group by k.doc_id
"""


# The kinds' expressions as the contract has them.
_KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
          ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
          ("card", r"[0-9](?:[\x20-]?[0-9])+"),
          ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def _iban() -> tuple[str, str]:
    """IBANs of known countries, each with its length; and, for what lies
    between those, runs of groups after any other code."""
    exact = []
    for n, names in IBAN_LENGTHS.items():
        groups, rest = divmod(n - 4, 4)
        exact.append(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]{{4}}){{{groups}}}"
                     + (f"\\x20?[A-Z0-9]{{{rest}}}" if rest else ""))
    other = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
    return rf"\b(?:{'|'.join(exact)})\b", other


def _score(no: int, kind: str) -> str:
    says = lambda words: f"regexp_matches(near, '{words}') or regexp_matches(far, '{words}')"
    out = f"{SCORES[kind]} + case when {says(FOR[kind])} then {BOOST} else 0 end"
    if kind in AGAINST:
        out += f" - case when {says(AGAINST[kind])} then {2 * BOOST} else 0 end"
    return f"when {no} then {out}"


def op10(table: str = "documents") -> str:
    exact, other = _iban()
    found = " union all ".join(
        f"select doc_id, {no} as no, 0 as part, 0 as base, regexp_extract_all(t, '{p}') as ms, "
        f"regexp_split_to_array(t, '{p}') as gs from d" for no, (_, p) in enumerate((*_KINDS, ("iban", exact))))
    counts = ", ".join(f"count(*) filter (where no = {i}) as n_{k}" for i, (k, _) in enumerate(_KINDS))
    names = [k for k, _ in _KINDS] + ["iban"]
    return f"""
with d as (select doc_id, coalesce(text, '') as t from {table}),
  f as ({found}),
  -- what lies between the IBANs of known countries
  g as (select doc_id, i as part, sum(length(g) + length(m)) over (partition by doc_id order by i) - length(g) - length(m) as base, g
        from (select doc_id, unnest(gs) as g, unnest(list_append(ms, '')) as m, generate_subscripts(gs, 1) as i from f where no = 4)),
  h as (select * from f union all
        select doc_id, 4, part, base, regexp_extract_all(g, '{other}'), regexp_split_to_array(g, '{other}') from g),
  e as (select doc_id, no, part, base, unnest(ms) as m, unnest(gs[1:len(ms)]) as g, generate_subscripts(ms, 1) as i
        from h where len(ms) > 0),
  p as (select *, regexp_replace(m, '[^0-9]', '', 'g') as digits, replace(m, ' ', '') as plain,
               base + sum(length(g) + length(m)) over (partition by doc_id, no, part order by i) as stop from e),
  q as (select doc_id, no, stop - length(m) as start, stop, case no
          when 0 then true
          when 1 then not regexp_matches(m, '(^|[.])0*([1-9][0-9]{{3}}|[3-9][0-9]{{2}}|2[6-9][0-9]|25[6-9])')
          when 2 then length(digits) between 14 and 19 and list_sum(list_transform(range(length(digits)),
            lambda k: case when (length(digits) - k) % 2 = 1 then cast(digits[k + 1] as int)
                 else cast(digits[k + 1] as int) * 2 - case when cast(digits[k + 1] as int) > 4 then 9 else 0 end end)) % 10 = 0
          when 3 then length(digits) between 10 and 15
          else length(plain) between 15 and 34 and list_reduce(list_prepend(0, list_transform(
            string_split(plain[5:] || plain[:4], ''), lambda c: case when c <= '9' then ord(c) - 48 else ord(c) - 55 end)),
            lambda a, x: (a * case when x > 9 then 100 else 10 end + x) % 97) = 1 end as ok from p),
  c as (select q.doc_id, no, start, stop, substr(t, cast(greatest(start - {CONTEXT}, 0) + 1 as bigint), cast(least(start, {CONTEXT}) as bigint)) as near,
               substr(t, cast(stop + 1 as bigint), {CONTEXT}) as far
        from q join d on q.doc_id = d.doc_id where ok),
  z as (select doc_id, no, ['{"', '".join(names)}'][no + 1] || ':' || start || ':' || stop as span, start,
               cast(round(100 * (case no {" ".join(_score(i, k) for i, k in enumerate(names))} end)) as int) as score from c),
  s as (select doc_id, {counts},
               string_agg(span, ',' order by start, no) filter (where no < 4) as base,
               string_agg(span, ',' order by start, no) as spans,
               string_agg(cast(score as varchar), ',' order by start, no) as scores
        from z group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k, _ in _KINDS)},
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(scores, '') as scores
from d left join s on d.doc_id = s.doc_id
"""
