"""Keys, binary values and rows in their local and wire forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerflow.functions.payload import dashes, strict_base64
from ledgerflow.operators.conflicts import CANONICAL_UUID


def key_bytes(key: Column, kind: str) -> Column:
    """16 bytes of a canonical UUID (null for another text), or the UTF-8 bytes of a text key."""
    if kind == "uuid":
        return F.when(key.rlike(CANONICAL_UUID), F.unhex(F.regexp_replace(key, "-", "")))
    return F.encode(key, "UTF-8")


def key_text(data: Column, kind: str) -> Column:
    if kind == "uuid":
        return F.when(F.octet_length(data) == 16, dashes(F.lower(F.hex(data))))
    return F.decode(data, "UTF-8")


def hash_key(table_id: Column, data: Column) -> Column:
    """Key bytes and the table's number in four bytes, the higher first."""
    return F.concat(data, F.unhex(F.lpad(F.hex(table_id), 8, "0")))


def key_map(column: str, key: Column) -> Column:
    return F.create_map(F.lit(column), key)


def local_key(column: str, key: Column) -> Column:
    """A key as the JSON object that a follower stores."""
    return F.to_json(F.struct(key.alias(column)))


def wire_key(local: Column, column: str) -> Column:
    return F.get_json_object(local, f"$.{column}")


def wire_from_hex(text: Column) -> Column:
    """Binary values go out as base64; a \\x prefix is dropped. Null if they are not hexadecimal."""
    digits = F.regexp_replace(text, r"^\\x", "")
    return F.when(digits.rlike("^(?:[0-9a-fA-F]{2})*$"), F.base64(F.unhex(digits)))


def database_from_wire(text: Column) -> Column:
    """Base64 comes in as \\x and hexadecimal digits; null if it is no standard base64."""
    return F.concat(F.lit(r"\x"), F.lower(F.hex(strict_base64(text))))


def strict_wire(text: Column) -> Column:
    """Whether base64 is spelled as an encoder would."""
    return F.coalesce(F.base64(strict_base64(text)) == text, F.lit(False))


def lenient_local(text: Column) -> Column:
    """The bytes of a locally stored value: hexadecimal or base64."""
    return F.coalesce(F.when(text.rlike("^(?:[0-9a-fA-F]{2})+$"), F.unhex(text)), strict_base64(text))


def inject(payload: Column, name: str, value: Column) -> Column:
    """A flat payload with one string field set, the others as they are."""
    rest = F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, _: k != name)
    return F.to_json(F.map_concat(rest, F.create_map(F.lit(name), value)))


def without(payload: Column, name: str) -> Column:
    """A flat payload of strings without a field, whatever its case."""
    return F.to_json(F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, _: F.lower(k) != name.lower()))


def column_list(payload: Column) -> Column:
    """The payload's column names, lower-cased and sorted."""
    return F.array_sort(F.transform(F.json_object_keys(payload), F.lower))


def request_hash(lines: Column) -> Column:
    """SHA-256 of canonical JSON lines (an array) as one JSON array."""
    return F.sha2(F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")), 256)
