"""Pushed JSON documents -> accepted events and a quarantine.

A document is `{"events": [...]}`. All checks are expressions over the variant
value of one row, so a request is judged where it was read, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.functions.timestamps import parse_iso
from tickloom.model import EVENT_COLUMNS, EVENT_SCHEMA, Instant, instant


FIELDS = ("name", "value", "tag", "additional_info", "timestamp")

# The messages of the request checks.
NOT_AN_OBJECT = "Request body must be a JSON object"
NO_EVENTS = "Missing 'events' field in request body"
NOT_AN_ARRAY = "'events' field must be an array"
ITEM_ERRORS = {
    "object": "must be an object",
    "name": "missing required 'name' field (string)",
    "value": "'value' field must be a number",
    "tag": "'tag' field must be a string if provided",
    "additional_info": "'additional_info' field must be a string if provided",
    "timestamp": "invalid timestamp format. Use ISO format (e.g., '2025-01-01T12:00:00Z')",
}


def _json_type(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL")


def _blank(v: Column, kind: Column) -> Column:
    """Whether a JSON value counts as not given: null, "", 0, false, [] or {}."""
    return (
        F.when(kind.isin("", "VOID", "ARRAY<VOID>", "OBJECT<>"), F.lit(True))
        .when(kind == "STRING", v.try_cast("string") == "")
        .when(kind == "BOOLEAN", ~v.try_cast("boolean"))
        .when(_is_number(kind), F.coalesce(v.try_cast("double") == 0, F.lit(False)))
        .otherwise(F.lit(False))
    )


def _fields(event: Column) -> Column:
    """The fields of one event, each taken out of its JSON once."""
    return F.struct(
        event.try_cast("map<string,variant>").isNotNull().alias("object"),
        *[_get(event, key).alias(key) for key in FIELDS],
    )


def _typed(event: Column) -> Column:
    kinds = [_json_type(event[key]).alias(f"{key}_type") for key in FIELDS]
    stamp = F.when(_json_type(event["timestamp"]) == "STRING", parse_iso(event["timestamp"].try_cast("string")))
    return F.struct(event.alias("field"), *kinds, stamp.alias("time"))


def _checked(event: Column) -> Column:
    """Key of the first failed check of one event (NULL if it is fine) and its values."""
    field = event["field"]

    def kind(key: str) -> Column:
        return event[f"{key}_type"]

    name = F.when(kind("name") == "STRING", field["name"].try_cast("string"))
    # A JSON number as a whole number, cut toward zero; true counts 1.
    value = F.when(kind("value") == "", F.lit(0).cast("bigint")).when(
        _is_number(kind("value")), field["value"].try_cast("bigint")
    )
    error = (
        F.when(~field["object"], "object")
        .when(F.coalesce(F.length(name), F.lit(0)) == 0, "name")
        .when(value.isNull(), "value")
        .when(~kind("tag").isin("", "VOID", "STRING"), "tag")
        .when(~kind("additional_info").isin("", "VOID", "STRING"), "additional_info")
        .when(event["time"].isNull() & ~_blank(field["timestamp"], kind("timestamp")), "timestamp")
    )
    return F.struct(
        error.alias("error"),
        name.alias("name"),
        value.cast("double").alias("value"),
        field["tag"].try_cast("string").alias("tag"),
        field["additional_info"].try_cast("string").alias("additional_info"),
        event["time"].alias("timestamp"),
    )


def _message(key: Column, pos: Column) -> Column:
    text = F.lit(None).cast("string")
    for name, message in ITEM_ERRORS.items():
        text = F.when(key == name, F.lit(message)).otherwise(text)
    return F.concat(F.lit("Event at index "), pos.cast("string"), F.lit(" "), text)


def judge_requests(requests: DataFrame) -> DataFrame:
    """Add to (request_id, body): `request_error` and the `checked` event array.

    Each step is a projection of its own, so that no part is computed twice.
    """
    doc = F.col("_doc")
    # Valid JSON that begins with a brace is an object.
    is_object = doc.isNotNull() & F.col("body").rlike(r"^\s*\{")
    listed = _get(doc, "events")
    error = (
        F.when(~is_object, NOT_AN_OBJECT)
        .when(F.size("_items") > 0, F.lit(None).cast("string"))
        .when(_blank(listed, _json_type(listed)), NO_EVENTS)
        .otherwise(NOT_AN_ARRAY)
    )
    return (
        requests.withColumn("_doc", F.try_parse_json("body"))
        .withColumn("_items", F.try_variant_get("_doc", "$.events", "array<variant>"))
        .withColumn("request_error", error)
        .withColumn("_fields", F.transform("_items", _fields))
        .withColumn("_typed", F.transform("_fields", _typed))
        .withColumn("checked", F.transform("_typed", _checked))
        .drop("_doc", "_fields", "_typed")
    )


def outcomes(requests: DataFrame, as_of: Instant, mode: str = "atomic") -> DataFrame:
    """One row per accepted event (`error` is NULL) and per fault, of (request_id,
    body) documents; every document is judged once.

    "atomic": one bad event rejects its whole request, reported once at its
    first bad index. "row": bad events are reported one by one and the rest of
    their request is accepted. A fault of a request as a whole has no `pos`.

    What is kept is chosen inside the array before it is exploded: a filter on
    the request would be pushed below the checks and run them a second time. A
    document is judged as one row, so its size is bounded by that of a row.
    """
    if mode not in ("atomic", "row"):
        raise ValueError(f"unknown mode {mode!r}")
    judged = judge_requests(requests)
    nothing = F.lit(None).cast("string")

    def accepted(e: Column, pos: Column) -> Column:
        stamp = F.coalesce(e["timestamp"], instant(as_of)).alias("timestamp")
        values = [e[c].alias(c) for c in ("name", "value", "tag", "additional_info")]
        return F.struct(pos.alias("pos"), nothing.alias("error"), nothing.alias("raw"), *values, stamp)

    def fault(pos: Column, error: Column, raw: Column) -> Column:
        types = (("name", "string"), ("value", "double"), ("tag", "string"), ("additional_info", "string"), ("timestamp", "timestamp"))
        empty = [F.lit(None).cast(kind).alias(name) for name, kind in types]
        return F.struct(pos.alias("pos"), error.alias("error"), raw.alias("raw"), *empty)

    rows = F.transform("checked", accepted)
    if mode == "atomic":
        kept = F.when(F.exists("checked", lambda e: e["error"].isNotNull()), F.slice(rows, 1, 0)).otherwise(rows)
    else:
        fine = F.filter(
            F.transform("checked", lambda e, i: F.when(e["error"].isNull(), accepted(e, i))), lambda r: r.isNotNull()
        )
        kept = fine
    faults = F.filter(
        F.transform("checked", lambda e, i: F.when(e["error"].isNotNull(), F.struct(i.alias("pos"), e["error"].alias("key")))),
        lambda f: f.isNotNull(),
    )
    if mode == "atomic":
        faults = F.slice(faults, 1, 1)

    def report(f: Column) -> Column:
        raw = F.col("body") if mode == "atomic" else F.to_json(F.element_at("_items", f["pos"] + 1))
        return fault(f["pos"], _message(f["key"], f["pos"]), raw)

    whole = F.array(fault(F.lit(None).cast("int"), F.col("request_error"), F.col("body")))
    found = F.when(F.col("request_error").isNotNull(), whole).otherwise(F.concat(kept, F.transform(faults, report)))
    return judged.select("request_id", F.inline(found))


def split_requests(
    requests: DataFrame, as_of: Instant, mode: str = "atomic"
) -> tuple[DataFrame, DataFrame]:
    """Accepted events and quarantined rows, see `outcomes`."""
    rows = outcomes(requests, as_of, mode)
    accepted = rows.where(F.col("error").isNull()).drop("error", "raw")
    return accepted, rows.where(F.col("error").isNotNull()).select("request_id", "pos", "error", "raw")


def accepted_events(accepted: DataFrame) -> DataFrame:
    """Accepted rows as an event frame, ids following the reading order.

    Events pushed without a time all get the ingest time, so the id keeps them
    in the order they were sent. Appended with `new_ids`, they get ids of the
    event table's own in the same order.
    """
    with_id = accepted.withColumn("event_id", F.monotonically_increasing_id())
    return with_id.select(*[F.col(c).cast(EVENT_SCHEMA[c].dataType).alias(c) for c in EVENT_COLUMNS])


def read_requests(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Requests from text: one JSON document per line, or one per file."""
    lines = spark.read.text(path, wholetext=one_per_file)
    return lines.select(F.monotonically_increasing_id().alias("request_id"), F.col("value").alias("body"))
