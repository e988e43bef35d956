"""Live event intake: validation, sanitising, keys, and the flow from raw requests to two sinks.

Every function works on batch and streaming DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, once
from ..functions.dates import parse_date

# Fixed values.
KEY_PATTERN = r"^sk_[a-zA-Z0-9]{32}$"
MAX_SOURCE, MAX_PAYLOAD = 100, 100_000
MAX_TIME_MS = 8_640_000_000_000_000
ERRORS = {
    "timestamp": "timestamp is required",
    "source": "source is required",
    "metrics": "metrics is required",
    "time": "Invalid timestamp format. Use ISO 8601 format.",
    "text": "source must be a string with maximum 100 characters",
    "object": "metrics must be an object",
    "size": "Payload too large. Maximum size is 100KB",
}
NOT_JSON = "body is not a JSON object"


def _kind(t: Column) -> Column:
    """text, number, boolean, nested or none, by the name of a variant's type."""
    return (F.when(t == "VOID", "none").when(t == "STRING", "text").when(t == "BOOLEAN", "boolean")
            .when(t.startswith("OBJECT") | t.startswith("ARRAY"), "nested").otherwise("number"))


def _parts(df: DataFrame, name: str, v: Column, fields: list[str], *more: Column) -> DataFrame:
    """Add struct `name` of the payload fields as (text, kind, given), and of `more`; kind is as in `_kind`.

    A field is given when it is not null, false, 0 or ''. Every step reads columns of the one before, since an
    expression inside `once` that occurs twice is computed twice, and a nested field may be long.
    """
    get = lambda n, kind: F.try_variant_get(v, f"$.{n}", kind)
    d = once(df, "_t", F.struct(*[F.coalesce(F.schema_of_variant(get(n, "variant")), F.lit("VOID")).alias(n) for n in fields]))
    d = once(d, "_k", F.struct(*[_kind(F.col("_t")[n]).alias(n) for n in fields])).drop("_t")
    d = once(d, "_x", F.struct(*[F.when(F.col("_k")[n] != "nested", get(n, "string")).alias(n) for n in fields]))

    def field(n: str) -> Column:
        text, kind = F.col("_x")[n], F.col("_k")[n]
        given = (F.when(kind == "none", False).when(kind == "nested", True).when(kind == "text", text != "")
                 .when(kind == "boolean", text == "true").otherwise(text.try_cast("double") != 0))
        return F.struct(text.alias("text"), kind.alias("kind"), F.coalesce(given, F.lit(False)).alias("given")).alias(n)

    return once(d, name, F.struct(*map(field, fields), *more)).drop("_k", "_x")


def event_time(field: Column) -> Column:
    """A time text, or a JSON number of milliseconds, as timestamp; `field` comes from `_parts`."""
    text, ms = field["text"], field["text"].try_cast("double")
    at = F.when(F.abs(ms) <= MAX_TIME_MS, F.timestamp_millis(ms.cast("long")))
    return F.when(field["kind"] == "number", at).otherwise(F.coalesce(F.try_to_timestamp(text), parse_date(text)))


def validate(df: DataFrame, body: str = "body") -> DataFrame:
    """SS-1: add errors (empty when the JSON payload is valid) and valid. The payload is parsed once."""
    d = once(df, "_v", F.try_parse_json(col(body)))
    v = F.col("_v")
    # Compact JSON is never longer than the body, so only long bodies are written out again.
    size = F.when(F.octet_length(col(body)) <= MAX_PAYLOAD, 0).when(
        F.char_length(col(body)) > MAX_PAYLOAD, F.char_length(F.to_json(v))).otherwise(F.lit(0))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    d = _parts(d, "_f", v, ["timestamp", "source", "metrics"], size.alias("size"), is_object.alias("is_object"))
    time, source, metrics = F.col("_f.timestamp"), F.col("_f.source"), F.col("_f.metrics")
    checks = [
        (~time["given"], "timestamp"), (~source["given"], "source"), (~metrics["given"], "metrics"),
        (time["given"] & event_time(time).isNull(), "time"),
        (source["given"] & ((source["kind"] != "text") | (F.char_length(source["text"]) > MAX_SOURCE)), "text"),
        (metrics["given"] & (metrics["kind"] != "nested"), "object"),
        (F.col("_f.size") > MAX_PAYLOAD, "size"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(ERRORS[k])) for c, k in checks]))
    errors = F.when(F.col("_f.is_object"), found).otherwise(F.array(F.lit(NOT_JSON)))
    return d.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0).drop("_v", "_f")


def sanitize_source(source: Column) -> Column:
    """SS-2: trim, then drop angle brackets."""
    return F.translate(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""), "<>", "")


def valid_key(key: Column) -> Column:
    """SS-3: format test."""
    return F.coalesce(key.rlike(KEY_PATTERN), F.lit(False))


def key_hash(key: Column) -> Column:
    """SS-3: SHA-256 in hex."""
    return F.sha2(key.cast("binary"), 256)


def attach_user(df: DataFrame, keys: DataFrame, hash_column: str = "key_hash") -> DataFrame:
    """SS-5: inner join with the active keys (key_hash, user_id, is_active); unknown keys drop out."""
    active = keys.filter("is_active").select(F.col("key_hash").alias(hash_column), "user_id")
    return df.join(active, hash_column)


def last_used(df: DataFrame, key: str = "key_hash", time: str = "ts") -> DataFrame:
    """SS-6: newest use per key; streams emit it in update mode."""
    return df.groupBy(col(key)).agg(F.max(col(time)).alias("last_used_at"))


def event_rows(df: DataFrame, body: str = "body") -> DataFrame:
    """SS-7: rows of the live table from validated requests that carry a user_id."""
    v = F.col("_v")
    return _parts(once(df, "_v", F.try_parse_json(col(body))), "_f", v, ["timestamp"]).select(
        event_time(F.col("_f.timestamp")).alias("timestamp"),
        sanitize_source(F.try_variant_get(v, "$.source", "string")).alias("source"),
        F.to_json(F.try_variant_get(v, "$.metrics", "variant")).alias("metrics"),
        col(body).alias("raw_data"), "user_id", F.current_timestamp().alias("created_at"))


def first_entries(payload: Column, k: int = 3) -> Column:
    """SS-10: the first k (key, value) entries of a JSON object, null when it is not one."""
    m = F.from_json(payload, "map<string,string>")
    return F.slice(F.map_entries(m), 1, k)


def by_format(df: DataFrame, key: str = "api_key") -> tuple[DataFrame, DataFrame]:
    """Requests with a well-formed key, which becomes its hash, and the others with a reason."""
    rest = [col(c) for c in df.columns if c != key]
    ok = valid_key(col(key))
    return (df.filter(ok).select(*rest, key_hash(col(key)).alias("key_hash")),
            df.filter(~ok).select(*rest, F.lit("invalid key format").alias("reason")))


def by_user(df: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests of an active key with their user, and the others with a reason."""
    active = keys.filter("is_active").select(F.col("key_hash").alias("_kh"), "user_id")
    d = df.join(active, F.col("key_hash") == F.col("_kh"), "left").drop("_kh")
    known = F.col("user_id").isNotNull()
    return d.filter(known), d.filter(~known).drop("user_id").withColumn("reason", F.lit("unknown or inactive key"))
