"""SQL snippets for the DuckDB oracle (JSON text kept as VARCHAR)."""

from __future__ import annotations


def valid_obj(text: str) -> str:
    """The text is one JSON object (DuckDB only evaluates json_type on valid text)."""
    return f"coalesce(case when json_valid({text}) then json_type({text}) = 'OBJECT' end, false)"


def parsed(src: str) -> str:
    """``line_no, line, rec, status`` over a log CTE named ``src``. A bare NaN
    (only ever a value of a whole field here) is read as a string."""
    return f"""select line_no, line, case when {valid_obj('text')} then text end as rec,
  case when {valid_obj('text')} then case when json_exists(text, '$.error') then 'failed' else 'ok' end
       when regexp_matches(coalesce(text, ''), '^\\s*$') then 'blank'
       when not json_valid(text) then 'invalid_json' else 'not_object' end as status
 from (select *, replace(line, ':NaN', ':"NaN"') as text from {src})"""


def has(rec: str, key: str) -> str:
    return f"json_exists({rec}, '$.{key}')"


def nonnull(rec: str, key: str) -> str:
    return f"coalesce(json_exists({rec}, '$.{key}') and json_type({rec}, '$.{key}') <> 'NULL', false)"


def get_str(rec: str, key: str) -> str:
    return f"({rec} ->> '$.{key}')"


def bucket(rec: str, key: str) -> str:
    return (f"case when not {has(rec, key)} then 'Unknown' when json_type({rec}, '$.{key}') = 'NULL' then 'None' "
            f"else {get_str(rec, key)} end")


def pct(part: str, whole: str) -> str:
    return f"case when {whole} > 0 then cast({part} as double) / cast({whole} as double) * 100.0 end"


def str_list(rec: str, key: str) -> str:
    """JSON list of strings as a DuckDB VARCHAR[] (NULL when missing or null)."""
    return f"case when json_type({rec}, '$.{key}') = 'ARRAY' then cast(json_extract({rec}, '$.{key}') as varchar[]) end"
