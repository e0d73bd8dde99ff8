"""Scalar functions on payloads, keys and binary values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.functions import canonical, codecs, payload as P
from ledgerflow.queries import base as B, query

_DOC = """CASE event_id % 12 WHEN 0 THEN '{"v":"12"}' WHEN 1 THEN '{"v":12.9}' WHEN 2 THEN '{"v":true}' WHEN 3 THEN '{"v":null}' WHEN 4 THEN '{}' WHEN 5 THEN '{"v":"12abc"}' WHEN 6 THEN '{"v":"TRUE"}'
 WHEN 7 THEN '{"v":"aGVsbG8="}' WHEN 8 THEN '{"v":"6BA7B810-9DAD-11D1-80B4-00C04FD430C8"}' WHEN 9 THEN '{"v":-3.5}' WHEN 10 THEN '{"v":"  -7"}' ELSE '{"v":"0"}' END"""


def docs(spark, d):
    return B.table(spark, d, "events").selectExpr("event_id", f"{_DOC} AS p")


def _fn(name, spark_value, sql_value):
    @query(name, f"WITH t AS (SELECT event_id, {_DOC} AS p FROM events) SELECT event_id, {sql_value} AS v FROM t")
    def run(spark, d):
        return docs(spark, d).select("event_id", spark_value(F.col("p")).alias("v"))


_T, _S, _K = "json_type(p, '$.v')", "json_extract_string(p, '$.v')", "event_id % 12"
_fn("fn_01_str_field", lambda p: P.str_field(p, "v"), f"CASE WHEN {_T} = 'VARCHAR' THEN {_S} END")
_fn("fn_02_int64_field", lambda p: P.int64_field(p, "v").cast("string"), f"CAST(CASE {_K} WHEN 0 THEN 12 WHEN 1 THEN 12 WHEN 5 THEN 12 WHEN 8 THEN 6 WHEN 9 THEN -3 WHEN 10 THEN -7 WHEN 11 THEN 0 END AS VARCHAR)")
_fn("fn_03_float64_field", lambda p: P.float64_field(p, "v"), f"CAST(CASE {_K} WHEN 0 THEN 12 WHEN 1 THEN 12.9 WHEN 5 THEN 12 WHEN 8 THEN 6 WHEN 9 THEN -3.5 WHEN 10 THEN -7 WHEN 11 THEN 0 END AS DOUBLE)")
_fn("fn_04_bool_field", lambda p: P.bool_field(p, "v"), f"CASE {_K} WHEN 1 THEN true WHEN 2 THEN true WHEN 6 THEN true WHEN 9 THEN true WHEN 11 THEN false END")
_fn("fn_05_uuid_field", lambda p: P.uuid_field(p, "v"), f"CASE WHEN {_T} = 'VARCHAR' AND regexp_full_match({_S}, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') THEN lower({_S}) END")
_fn("fn_06_has_field", lambda p: P.has_field(p, "v"), f"list_contains(json_keys(p), 'v')")
_fn("fn_07_base64_field", lambda p: F.hex(P.base64_field(p, "v")), f"CASE {_K} WHEN 7 THEN '68656C6C6F' WHEN 6 THEN '4D1504' END")
_fn("fn_12_optional_json", lambda p: P.normalize_optional(F.when(p == "{}", " null ").otherwise(p)), "CASE WHEN p = '{}' THEN NULL ELSE p END")


@query("prj_16_typed_extraction", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def typed_extraction(spark, d):
    return B.table(spark, d, "events").select("event_id", P.int64_field(F.col("props"), "k").alias("k"))


_UUID = "printf('%08x-0000-4000-8000-%012x', CAST(event_id AS INTEGER), event_id)"


def uuids(spark, d):
    return B.table(spark, d, "events").selectExpr("event_id", "printf('%08x-0000-4000-8000-%012x', event_id, event_id) AS u")


@query("fn_08_uuid_from_base64", "SELECT event_id, lower(hex(event_id)) AS tail, 'same' AS other FROM events".replace("lower(hex(event_id))", "format('{:08x}-0000-4000-8000-{:012x}', event_id, event_id)"))
def uuid_from_base64(spark, d):
    encoded = F.base64(codecs.key_bytes(F.col("u"), "uuid"))
    return uuids(spark, d).select("event_id", P.uuid_from_base64(encoded).alias("tail"), P.uuid_or_same(F.lit("same")).alias("other"))


@query("prj_04_key_codec", "SELECT event_id, format('{:08x}00004000800{:1x}{:012x}', event_id, 0, event_id) AS bytes_hex, format('{:08x}-0000-4000-8000-{:012x}', event_id, event_id) AS again, format('{:08x}00004000800{:1x}{:012x}{:08x}', event_id, 0, event_id, event_id % 3) AS hash_hex FROM events")
def key_codec(spark, d):
    data = codecs.key_bytes(F.col("u"), "uuid")
    return uuids(spark, d).select("event_id", F.lower(F.hex(data)).alias("bytes_hex"), codecs.key_text(data, "uuid").alias("again"), F.lower(F.hex(codecs.hash_key(F.col("event_id") % 3, data))).alias("hash_hex"))


@query("prj_05_wire_key", "SELECT c_custkey, '{\"id\":\"' || c_name || '\"}' AS key_json FROM customer")
def wire_key(spark, d):
    return B.table(spark, d, "customer").select("c_custkey", F.to_json(codecs.key_map("id", F.col("c_name"))).alias("key_json"))


@query("prj_12_local_and_wire_key", "SELECT c_custkey, '{\"id\":\"' || c_name || '\"}' AS local_key, c_name AS wire FROM customer")
def local_and_wire_key(spark, d):
    local = codecs.local_key("id", F.col("c_name"))
    return B.table(spark, d, "customer").select("c_custkey", local.alias("local_key"), codecs.wire_key(local, "id").alias("wire"))


@query("fn_11_sync_keys_equal", "SELECT c_custkey, true AS same, false AS other FROM customer")
def sync_keys_equal(spark, d):
    a, b = F.col("c_custkey").cast("string"), F.col("c_name")
    one = F.concat(F.lit('{"a":"'), a, F.lit('","b":"'), b, F.lit('"}'))
    two = F.concat(F.lit('{ "b" : "'), b, F.lit('", "a" : "'), a, F.lit('"}'))
    return B.table(spark, d, "customer").select("c_custkey", canonical.canonical_equal(one, two).alias("same"), canonical.canonical_equal(one, F.lit("{}")).alias("other"))


@query("prj_01_without_scope", "SELECT c_custkey, CAST(json_object('id', CAST(c_custkey AS VARCHAR), 'name', c_name) AS VARCHAR) AS payload FROM customer")
def without_scope(spark, d):
    rows = B.table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.lit("s1").alias("_Sync_Scope_Id"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))).alias("full"))
    return rows.select("c_custkey", codecs.without(F.col("full"), "_sync_scope_id").alias("payload"))


for _name in ("prj_02_with_scope", "prj_08_key_in_payload"):

    @query(_name, "SELECT c_custkey, CAST(json_object('name', c_name, 'id', CAST(c_custkey AS VARCHAR)) AS VARCHAR) AS payload FROM customer")
    def with_scope(spark, d):
        return B.table(spark, d, "customer").select("c_custkey", codecs.inject(F.to_json(F.struct(F.col("c_name").alias("name"))), "id", F.col("c_custkey").cast("string")).alias("payload"))


@query("prj_07_column_list", "SELECT event_id, 'a,b,k' AS columns FROM events")
def column_list(spark, d):
    wide = F.concat(F.lit('{"K":1,"b":2,"A":'), F.col("event_id").cast("string"), F.lit("}"))
    return B.table(spark, d, "events").select("event_id", F.array_join(codecs.column_list(wide), ",").alias("columns"))


for _name in ("prj_09_binary_wire", "prj_10_blob_codec"):

    @query(_name, "SELECT c_custkey, to_base64(encode(c_name)) AS wire, '\\x' || lower(hex(c_name)) AS stored, true AS strict, NULL::VARCHAR AS bad FROM customer")
    def binary_wire(spark, d):
        wire = codecs.wire_from_hex(F.concat(F.lit("\\x"), F.hex(F.encode("c_name", "UTF-8"))))
        return B.table(spark, d, "customer").select("c_custkey", wire.alias("wire"), codecs.database_from_wire(wire).alias("stored"), codecs.strict_wire(wire).alias("strict"), codecs.wire_from_hex(F.lit("zz")).alias("bad"))


@query("prj_11_local_payload_to_wire", "SELECT c_custkey, CAST(json_object('id', CAST(c_custkey AS VARCHAR), 'data', to_base64(encode(c_name))) AS VARCHAR) AS payload FROM customer")
def local_to_wire(spark, d):
    data = codecs.wire_from_hex(F.lower(F.hex(F.encode("c_name", "UTF-8"))))
    return B.table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), data.alias("data"))).alias("payload"))


@query("prj_13_canonical_json", "SELECT event_id, '{\"a\":' || CAST(event_id AS VARCHAR) || ',\"k\":' || json_extract_string(props, '$.k') || ',\"z\":\"\\u003cb\\u003e\"}' AS canonical FROM events")
def canonical_json(spark, d):
    text = F.concat(F.lit('{"z":"<b>", "k":'), F.get_json_object("props", "$.k"), F.lit(', "a": '), F.col("event_id").cast("string"), F.lit("}"))
    return B.table(spark, d, "events").select("event_id", canonical.canonical(text).alias("canonical"))


@query("prj_15_request_hash", "SELECT user_id, sha256('[' || string_agg('{\"id\":' || CAST(event_id AS VARCHAR) || '}', ',' ORDER BY event_id) || ']') AS request_hash FROM events GROUP BY user_id")
def request_hash(spark, d):
    lines = F.transform(F.array_sort(F.collect_list("event_id")), lambda e: F.concat(F.lit('{"id":'), e.cast("string"), F.lit("}")))
    return B.table(spark, d, "events").groupBy("user_id").agg(codecs.request_hash(lines).alias("request_hash"))


@query("fn_09_replay_equivalence", "SELECT event_id, event_id % 3 <> 2 AS same FROM events")
def replay_equivalence(spark, d):
    a = F.lit('{"at":"2026-03-24T18:42:11Z","n":[1,2.0]}')
    b = F.when(F.col("event_id") % 3 == 0, '{"n":[1.0,2],"at":"2026-03-24T10:42:11-08:00"}').when(F.col("event_id") % 3 == 1, '{"at":"2026-03-24T18:42:11.000Z","n":[1,2]}').otherwise('{"at":"2026-03-24T18:42:11","n":[1,2]}')
    return B.table(spark, d, "events").select("event_id", canonical.replay_equivalent(a, b).alias("same"))


@query("fn_10_canonical_equal", "SELECT event_id, event_id % 2 = 0 AS same FROM events")
def canonical_equal(spark, d):
    other = F.when(F.col("event_id") % 2 == 0, F.regexp_replace("props", ":", " : ")).otherwise(F.lit(None))
    return B.table(spark, d, "events").select("event_id", canonical.canonical_equal(F.col("props"), other).alias("same"))


@query("src_06_prepared_rows", "SELECT event_id, 'k' AS columns, lower(hex(CAST(user_id AS VARCHAR))) AS key_hex FROM events")
def prepared_rows(spark, d):
    return B.table(spark, d, "events").select("event_id", F.array_join(codecs.column_list(F.col("props")), ",").alias("columns"), F.lower(F.hex(codecs.key_bytes(F.col("user_id").cast("string"), "text"))).alias("key_hex"))


@query("set_03_column_mismatch", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'extra' END AS mismatch FROM events")
def column_mismatch(spark, d):
    from ledgerflow.operators.tables import column_mismatch as mismatch

    payload = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise('{"k":1,"extra":2}')
    return B.table(spark, d, "events").select("event_id", F.array_join(mismatch(payload, ["k"]), ",").alias("mismatch"))
