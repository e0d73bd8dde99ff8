"""Typed reading of JSON payloads. A field that is missing, null or of another type gives null.

Payloads are parsed once to VARIANT; an expression of these functions stays in
generated JVM code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _kind(payload: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "variant"))


def _text(payload: Column, name: str) -> Column:
    """The field as text: strings without quotes."""
    return F.get_json_object(payload, f"$.{name}")


def _is_number(payload: Column, name: str) -> Column:
    return _kind(payload, name).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$")


def has_field(payload: Column, name: str) -> Column:
    """Whether the key is there, even with null."""
    return F.coalesce(F.array_contains(F.json_object_keys(payload), name), F.lit(False))


def str_field(payload: Column, name: str) -> Column:
    return F.when(_kind(payload, name) == "STRING", _text(payload, name))


def int64_field(payload: Column, name: str) -> Column:
    """Numbers are cut towards zero; of strings the number they begin with counts: decimal, 0x hexadecimal or 0 octal."""
    text = F.ltrim(_text(payload, name))
    sign = F.when(F.regexp_extract(text, r"^([+-]?)", 1) == "-", -1).otherwise(1)
    hexadecimal, octal, decimal = (F.regexp_extract(text, p, 1) for p in (r"^[+-]?0[xX]([0-9A-Fa-f]+)", r"^[+-]?0([0-7]+)", r"^[+-]?(0|[1-9][0-9]*)"))
    prefix = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).when(octal != "", F.conv(octal, 8, 10)).when(decimal != "", decimal)
    number = F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "double").cast("decimal(38,10)").cast("bigint")
    return F.when(_kind(payload, name) == "STRING", prefix.try_cast("bigint") * sign).when(_is_number(payload, name), number)


def float64_field(payload: Column, name: str) -> Column:
    """Numbers, and the number a string begins with."""
    prefix = F.regexp_extract(F.ltrim(_text(payload, name)), r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    number = F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "double")
    return F.when(_kind(payload, name) == "STRING", F.nullif(prefix, F.lit("")).try_cast("double")).when(_is_number(payload, name), number)


def bool_field(payload: Column, name: str) -> Column:
    """Booleans, numbers (not zero), and the strings 1, true, TRUE, 0, false, FALSE."""
    text = _text(payload, name)
    return (
        F.when(_kind(payload, name) == "BOOLEAN", text == "true")
        .when(_is_number(payload, name), F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "double") != 0)
        .when((_kind(payload, name) == "STRING") & text.isin("1", "true", "TRUE"), True)
        .when((_kind(payload, name) == "STRING") & text.isin("0", "false", "FALSE"), False)
    )


def as_uuid(text: Column) -> Column:
    """The canonical form of a UUID in any of its spellings: dashed, with urn:uuid:, in braces, or 32 digits."""
    digits = F.lower(F.regexp_replace(F.regexp_replace(text, r"^(?i:urn:uuid:)", ""), r"[{}-]", ""))
    dashed = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    known = text.rlike(rf"^(?:(?i:urn:uuid:))?{dashed}$") | text.rlike(rf"^\{{{dashed}\}}$") | text.rlike("^[0-9a-fA-F]{32}$")
    return F.when(known, dashes(digits))


def dashes(digits: Column) -> Column:
    return F.concat_ws("-", F.substring(digits, 1, 8), F.substring(digits, 9, 4), F.substring(digits, 13, 4), F.substring(digits, 17, 4), F.substring(digits, 21, 12))


def uuid_field(payload: Column, name: str) -> Column:
    return as_uuid(str_field(payload, name))


def base64_field(payload: Column, name: str) -> Column:
    """The bytes of a string in standard base64."""
    return strict_base64(str_field(payload, name))


def strict_base64(text: Column) -> Column:
    ok = text.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return F.when(ok, F.unbase64(text))


def uuid_from_base64(text: Column) -> Column:
    """The UUID whose 16 bytes the text encodes; null for other texts."""
    data = strict_base64(text)
    return F.when(F.octet_length(data) == 16, dashes(F.lower(F.hex(data))))


def uuid_or_same(text: Column) -> Column:
    """As uuid_from_base64, with other texts given back."""
    return F.coalesce(uuid_from_base64(text), text)


def required(value: Column, name: str) -> Column:
    """The value; a null one fails the query."""
    return F.when(value.isNull(), F.raise_error(F.lit(f"required field {name} is missing or of the wrong type"))).otherwise(value)


def normalize_optional(payload: Column) -> Column:
    """An empty text, or the text null, is null."""
    return F.nullif(F.nullif(F.trim(payload), F.lit("null")), F.lit(""))
