"""Column expressions over JSON text and VARIANT values.

All helpers return ``Column`` objects built from Spark built-ins, so they stay
inside whole-stage codegen. The text is parsed once per row into a VARIANT;
every field access afterwards is a ``variant_get`` on the binary value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second element behind a text that is parsed: the first that the text doesn't
#: hold, as a text that brings it along (``1,<mark>]``) would pass.
MARKS = (7046029254386353131, 2862933555777941757)

_JSON_WS = "[ \\t\\r\\n]*"


def strict_parse(text: Column) -> Column:
    """Parse ``text`` as exactly one JSON value, or NULL; the text is parsed once.

    ``try_parse_json`` alone accepts trailing text (``{..} junk``) and two
    concatenated objects. So the text is parsed as the first element of an array
    whose second is a mark, an integer: a text that closes the bracket itself
    (``{..}] junk``) never reaches the mark, and one with several values has it
    later. Nothing but the mark itself can stand there, for what would make the
    second element of its own is followed by the mark as a third. Blank text is a
    syntax error, and so NULL as well. The array is held in a lambda variable, so
    that the optimizer can't copy the parse into every use.
    """
    mark = F.when(text.contains(str(MARKS[0])), F.lit(MARKS[1])).otherwise(F.lit(MARKS[0]))
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))

    def single(x: Column) -> Column:
        marked = (F.try_variant_get(x["v"], "$[1]", "bigint") == x["mark"]) & F.variant_get(x["v"], "$[2]", "variant").isNull()
        return F.when(marked, F.variant_get(x["v"], "$[0]", "variant"))

    return F.get(F.transform(F.array(F.struct(whole.alias("v"), mark.alias("mark"))), single), F.lit(0))


def quote_constants(text: Column) -> Column:
    """``NaN``, ``Infinity`` and ``-Infinity`` outside strings as strings: common
    JSON readers accept them as numbers, Spark's does not."""
    mark = "\u0001"  # can't stand in valid JSON text
    marked = F.regexp_replace(text, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|(NaN|-?Infinity)', f"$1{mark}$2")
    quoted = F.regexp_replace(marked, f"{mark}(NaN|-?Infinity)", '"$1"')
    return F.regexp_replace(quoted, mark, "")


def is_object_text(text: Column) -> Column:
    """Text whose first non-blank character opens an object."""
    return text.rlike("^" + _JSON_WS + "\\{")


def parse_object(text: Column) -> Column:
    """Strictly parsed JSON object as VARIANT; NULL for anything else.

    Repeated keys keep the last value where the session allows them (see
    :func:`allow_repeated_keys`)."""
    plain = strict_parse(text)
    odd = F.when(text.rlike("NaN|Infinity"), strict_parse(quote_constants(text)))
    return F.when(is_object_text(text), F.coalesce(plain, odd))


def allow_repeated_keys(spark) -> None:
    """Let objects repeat a key, the last value winning, as common readers do."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _path(key: str) -> str:
    return "$." + key


def has_key(v: Column, key: str) -> Column:
    """Key present at the top level, even with a JSON null value."""
    return F.variant_get(v, _path(key), "variant").isNotNull()


def is_json_null(v: Column, key: str) -> Column:
    return F.coalesce(F.is_variant_null(F.variant_get(v, _path(key), "variant")), F.lit(False))


def non_null(v: Column, key: str) -> Column:
    """Present and not JSON null (empty strings and lists count)."""
    return has_key(v, key) & ~is_json_null(v, key)


def get_str(v: Column, key: str) -> Column:
    return F.try_variant_get(v, _path(key), "string")


def get_double(v: Column, key: str) -> Column:
    """Number or numeric text as DOUBLE (confidence comes in both forms)."""
    return F.try_variant_get(v, _path(key), "double")


def get_str_array(v: Column, key: str) -> Column:
    return F.try_variant_get(v, _path(key), "array<string>")


def bucket_value(v: Column, key: str, missing: str = "Unknown", null: str = "None") -> Column:
    """Histogram value: a missing key and an explicit null are separate buckets."""
    return (F.when(~has_key(v, key), F.lit(missing))
            .when(is_json_null(v, key), F.lit(null))
            .otherwise(get_str(v, key)))


def display_value(v: Column, key: str, default: str = "N/A") -> Column:
    """Value shown for a record field; ``default`` only when the key is missing."""
    return F.when(has_key(v, key), get_str(v, key)).otherwise(F.lit(default))


def is_number(v: Column, key: str) -> Column:
    """The field holds a JSON number (not numeric text)."""
    t = F.schema_of_variant(F.variant_get(v, _path(key), "variant"))
    return F.coalesce(t.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def scalar_text(v: Column, key: str) -> Column:
    """Field as text the way a JSON reader shows it: fractional numbers are
    floats (``462645.00`` -> ``462645.0``), integers and strings as they are."""
    t = F.schema_of_variant(F.variant_get(v, _path(key), "variant"))
    return (F.when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"),
                   F.try_variant_get(v, _path(key), "double").cast("string"))
            .otherwise(get_str(v, key)))


def strip_ws(text: Column) -> Column:
    """Remove leading and trailing whitespace (not only spaces)."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def reply_json_text(content: Column) -> Column:
    """JSON text inside a model reply.

    A reply containing the json fence yields the text after it up to the next
    fence, stripped; without a closing fence the last character is dropped,
    because the not-found position counts as one before the end. Otherwise,
    if there is a ``{``, the text from the first ``{`` to the last ``}``
    (empty when there is no ``}`` after it). Otherwise the reply itself.
    Positions are 1-based as in SQL.
    """
    fence = "```json"
    n = F.length(content)
    fence_pos = F.locate(fence, content)
    body_start = fence_pos + F.lit(len(fence))
    close_pos = F.position(F.lit("```"), content, body_start)
    body_end = F.when(close_pos > 0, close_pos).otherwise(n)  # exclusive
    fenced = strip_ws(F.substring(content, body_start, body_end - body_start))
    first = F.locate("{", content)
    last = F.when(F.locate("}", content) > 0, n - F.locate("}", F.reverse(content)) + 1).otherwise(F.lit(0))
    braced = F.when(last >= first, F.substring(content, first, last - first + 1)).otherwise(F.lit(""))
    return (F.when(fence_pos > 0, fenced)
            .when(first > 0, braced)
            .otherwise(content))
