"""Canonical JSON: keys ascending by bytes, numbers as doubles, fixed escapes; and equality of payloads on replay.

Numbers are printed as the shortest digits that give the same double, with an
exponent below 1e-6 and from 1e21 on. `<`, `>`, `&`, U+2028 and U+2029 are
escaped. Of repeated keys the last counts. These rules need a parser of their
own, so they run as Arrow UDFs on batches.
"""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_ESCAPES = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029", '"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_ESCAPED = re.compile(r'[<>&\u2028\u2029"\\\x00-\x1f]')


def _string(text: str) -> str:
    return '"' + _ESCAPED.sub(lambda m: _ESCAPES.get(m[0]) or f"\\u{ord(m[0]):04x}", text) + '"'


quoted = _string


def quoted_column(text: Column) -> Column:
    """The text as a canonical JSON string, in JVM code; few texts need any escape."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    signs = [c for c in _ESCAPES if c != "\\"] + [chr(k) for k in range(32) if chr(k) not in _ESCAPES]
    for sign in signs:
        escaped = F.replace(escaped, F.lit(sign), F.lit(_string(sign)[1:-1]))
    plain = ~text.rlike("[<>&\"\\\\\\u0000-\\u001f\\u2028\\u2029]")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(escaped), F.lit('"'))


def number(value: float) -> str:
    if value != value or value in (float("inf"), float("-inf")):
        raise ValueError("not a finite number")
    if value == 0:
        return "-0" if str(value)[0] == "-" else "0"
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    text = "".join(map(str, digits))
    point = len(text) + exponent  # place of the decimal point, from the first digit
    minus = "-" if sign else ""
    if 1e-6 <= abs(value) < 1e21:
        if point <= 0:
            return f"{minus}0.{'0' * -point}{text}"
        return minus + (text + "0" * (point - len(text)) if point >= len(text) else f"{text[:point]}.{text[point:]}")
    power = point - 1
    mantissa = text[0] + (f".{text[1:]}" if len(text) > 1 else "")
    return f"{minus}{mantissa}e{'-' if power < 0 else '+'}{abs(power)}"


def render(value) -> str:
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, float):
        return number(value)
    if isinstance(value, list):
        return "[" + ",".join(map(render, value)) + "]"
    return "{" + ",".join(f"{_string(k)}:{render(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-8", "surrogatepass"))) + "}"


def canonical_text(text: str | None) -> str | None:
    """The canonical form; null for what is no JSON."""
    if text is None:
        return None
    try:
        return render(json.loads(text, parse_int=float, parse_constant=lambda c: float("nan")))
    except (ValueError, RecursionError):
        return None


_INSTANT = re.compile(r"^(\d{4}-\d\d-\d\d)T(\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)$")


def instant(text: str) -> tuple[datetime, str] | None:
    """Seconds in UTC and the fraction's digits of an RFC 3339 time with a zone."""
    if not (m := _INSTANT.match(text)):
        return None
    try:
        at = datetime.fromisoformat(f"{m[1]}T{m[2]}")
        if m[4] != "Z":
            hours, minutes = int(m[4][1:3]), int(m[4][4:])
            if hours > 23 or minutes > 59:
                return None
            shift = timedelta(hours=hours, minutes=minutes)
            at += -shift if m[4][0] == "+" else shift
    except (ValueError, OverflowError):
        return None
    return at.replace(tzinfo=timezone.utc), (m[3] or "").rstrip("0")


def equivalent_values(a, b) -> bool:
    """Equal JSON values; strings that are instants are equal if the instants are."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equivalent_values(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equivalent_values, a, b))
    if isinstance(a, str) and isinstance(b, str):
        return a == b or (x := instant(a)) is not None and x == instant(b)
    return type(a) is type(b) and a == b


def equivalent_texts(a: str | None, b: str | None) -> bool:
    if a is None or b is None:
        return a is None and b is None
    try:
        return equivalent_values(json.loads(a, parse_int=float), json.loads(b, parse_int=float))
    except (ValueError, RecursionError):
        return a == b


@F.pandas_udf(T.StringType())
def canonical(payload: pd.Series) -> pd.Series:
    return payload.map(canonical_text, na_action=None).astype(object).where(payload.notna(), None)


def with_null(payload: Column, name: str) -> Column:
    """An object with one of its own fields set to null, canonical; nested fields of that name are left alone."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if not isinstance(t, str) else _with_null(t, name)).astype(object).where(texts.notna(), None)

    return run(payload)


def _with_null(text: str, name: str) -> str:
    value = json.loads(text, parse_int=float)
    return render(value | {name: None} if isinstance(value, dict) and name in value else value)


@F.pandas_udf(T.BooleanType())
def replay_equivalent(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([equivalent_texts(None if x is pd.NA or x != x else x, None if y is pd.NA or y != y else y) for x, y in zip(a, b)])


def canonical_equal(a: Column, b: Column) -> Column:
    return canonical(a).eqNullSafe(canonical(b))
