"""The quality rules as one DuckDB statement (the oracle of op2)."""

from __future__ import annotations

import math

from docsift.llm import quality_rules as Q

WS, NOT_WS = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def _fences() -> str:
    out = []
    for r, (least, count, once, below) in Q.RATIOS.items():
        out.append(f"({r} <= {r}_high + greatest({Q.FENCE} * ({r}_high - {r}_mid + {Q.BLUR} * {r}_high), {least})" + (f" or {count} <= {once})" if count else ")"))
        if below:
            out.append(f"{r} >= {r}_low - greatest({Q.FENCE} * ({r}_mid - {r}_low + {Q.BLUR} * {r}_low), {least})")
    return " and ".join(out)


def _tails(name: str, by: list[str]) -> str:
    """CTE ``name``: n and the quantiles of each ratio for the groups ``by``."""
    ends = ("low", "mid", "high")
    wide = ", ".join(f"max(case when ratio = '{r}' then {e} end) as {r}_{e}" for r in Q.RATIOS for e in ends)
    keys, group = "".join(f"{k}, " for k in by), ", ".join([*by, "ratio"])
    at = ", ".join(f"min(case when upto >= {q} * total then v end) as {e}" for q, e in zip(Q.TAILS, ends))
    return f"""{name} as (
  select {keys}max(n) as n, {wide} from (
    select {keys}ratio, max(total) as n, {at} from (
      select {keys}ratio, coalesce(2 * pow({Q.GAMMA!r}, bucket) / {Q.GAMMA + 1!r}, 0.0) as v,
             sum(n) over (partition by {group} order by bucket nulls first) as upto, sum(n) over (partition by {group}) as total
      from (select {group}, bucket, sum(n) as n from sketch group by all))
    group by {group}){" group by " + ", ".join(by) if by else ""})"""


def statement() -> str:
    names = ", ".join(Q.RATIOS)
    pick = ", ".join(f"case when own.n >= {Q.MIN_GROUP} then own.{r}_{e} when by_lang.n >= {Q.MIN_GROUP} then by_lang.{r}_{e} else whole.{r}_{e} end as {r}_{e}"
                     for r in Q.RATIOS for e in ("low", "mid", "high"))
    return f"""
with d as (
  select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{NOT_WS}+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{NOT_WS}')) as l from documents),
grams as (
  select r, i, count(*) over (partition by r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as c
  from (select r, w, unnest(range(1, len(w) - 1)) as i from d)),
repeated as (select r, count(distinct pos) as n from (select r, unnest([i, i + 1, i + 2]) as pos from grams where c > 1) group by r),
s as (
  select d.r, doc_id, lang, source, len(w) as n_words, length(t) - len(regexp_extract_all(t, '{WS}')) as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(repeated.n, 0) as n_repeat_words
  from d left join repeated on repeated.r = d.r),
b as (
  select *, n_words < {Q.MIN_WORDS} or 100 * n_repeat_words > {Q.MAX_REPEAT_PCT} * n_words as base_failed,
         n_symbols / nullif(n_words, 0) as symbol_ratio, n_dup_lines / nullif(n_lines, 0) as dup_line_ratio,
         n_repeat_words / nullif(n_words, 0) as repeat_ratio, word_chars / nullif(n_words, 0) as word_length from s),
sketch as (
  select lang, source, ratio, case when v >= {Q.SMALLEST} then cast(ceil(ln(v) / {math.log(Q.GAMMA)!r}) as integer) end as bucket, count(*) as n
  from (unpivot (select lang, source, {names} from b where not base_failed) on {names} into name ratio value v) group by all),
{_tails("own", ["lang", "source"])},
{_tails("by_lang", ["lang"])},
{_tails("whole", [])},
f as (select own.lang, own.source, {pick} from own join by_lang on by_lang.lang is not distinct from own.lang cross join whole)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and coalesce({_fences()}, false) as kept
from b left join f on f.lang is not distinct from b.lang and f.source is not distinct from b.source"""
