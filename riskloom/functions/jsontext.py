"""Canonical JSON text: sorted keys, ``", "`` and ``": "`` separators, ASCII only.

``to_json`` writes compact text and drops nulls, so the text that checksums are taken from is
composed here from Columns.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.numbers import double_text

_PLAIN = r"\A[ !#-\[\]-~]*\z"  # $ would also match before a last line end


def _unicode_escape(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def _escape_char(char: Column) -> Column:
    code = F.ascii(char)
    beyond = code - 0x10000
    pair = F.concat(
        _unicode_escape(F.lit(0xD800) + F.shiftright(beyond, 10)),
        _unicode_escape(F.lit(0xDC00) + beyond.bitwiseAND(F.lit(0x3FF))),
    )
    return (
        F.when(char == '"', '\\"')
        .when(char == "\\", "\\\\")
        .when(char == "\n", "\\n")
        .when(char == "\r", "\\r")
        .when(char == "\t", "\\t")
        .when(char == "\b", "\\b")
        .when(char == "\f", "\\f")
        .when(code > 0xFFFF, pair)
        .when((code < 0x20) | (code > 0x7E), _unicode_escape(code))
        .otherwise(char)
    )


def json_string(text: Column) -> Column:
    """Quoted and escaped; NULL becomes ``null``."""
    escaped = F.array_join(F.transform(F.split(text, ""), _escape_char), "")
    body = F.when(text.rlike(_PLAIN), text).otherwise(escaped)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def json_double(number: Column) -> Column:
    return F.coalesce(double_text(number), F.lit("null"))


def json_int(number: Column) -> Column:
    return F.coalesce(number.cast("string"), F.lit("null"))


def json_string_list(items: Column) -> Column:
    inner = F.array_join(F.transform(items, json_string), ", ")
    return F.coalesce(F.concat(F.lit("["), inner, F.lit("]")), F.lit("null"))


def json_object(members: Mapping[str, Column], drop_null: bool = False) -> Column:
    """An object of already serialised members in key order.

    With ``drop_null`` a member whose Column is NULL is left out; else it must not be NULL.
    """
    parts = [F.concat(F.lit(f'"{key}": '), members[key]) for key in sorted(members)]
    if drop_null:
        body = F.concat_ws(", ", *parts)
    else:
        spaced = [parts[0]]
        for part in parts[1:]:
            spaced += [F.lit(", "), part]
        body = F.concat(*spaced)
    return F.concat(F.lit("{"), body, F.lit("}"))
