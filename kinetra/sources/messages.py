"""Messages: JSON on the wire, columns inside. Records that don't parse go to quarantine, not away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetra import schemas as S


def parse(messages: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Every message with its parsed record, or with the text in _corrupt where it is no such record."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return messages.withColumn("record", F.from_json(F.col(column).cast("string"), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))


def _flat(messages: DataFrame, schema: T.StructType, key: str, columns: list[Column]) -> tuple[DataFrame, DataFrame]:
    parsed = parse(messages, schema)
    good = F.col("record._corrupt").isNull() & F.col(f"record.{key}").isNotNull()
    return parsed.where(good).select(*columns), parsed.where(~good).select(F.col("value").cast("string").alias("value"))


def _vector(name: str, prefix: str) -> list[Column]:
    return [F.coalesce(F.col(f"record.{name}.{c}"), F.lit(0.0)).alias(f"{prefix}{c}") for c in "xyz"]


def vehicles(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vehicle rows, quarantined texts) of position reports in `value`; works on batches and streams."""
    r = lambda n: F.col(f"record.{n}").alias(n)
    return _flat(messages, S.VEHICLE_MESSAGE, "id", [r("id"), *_vector("position", ""), *_vector("velocity", "v"), *_vector("acceleration", "a"), r("heading"), r("size"), r("type"), F.col("record.timestamp").alias("ts")])


def locations(messages: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(location rows, quarantined texts); a report without a time is of as_of."""
    return _flat(messages, S.LOCATION_MESSAGE, "vehicle_id", [F.col("record.vehicle_id").alias("vehicle_id"), F.coalesce("record.timestamp", as_of).alias("ts"), *_vector("position", ""), *_vector("velocity", "v"), F.col("record.heading").alias("heading"), F.col("record.vehicle_type").alias("vehicle_type")])


def vehicle_json(fleet: DataFrame) -> Column:
    """A vehicle as a nested report."""
    vector = lambda p: F.struct(*(F.col(f"{p}{c}").alias(c) for c in "xyz"))
    return F.to_json(F.struct(F.col("id").cast("string").alias("id"), vector("").alias("position"), vector("v").alias("velocity"), vector("a").alias("acceleration"), "heading", "size", "type", F.col("ts").alias("timestamp")))


def of_events(events: DataFrame) -> DataFrame:
    """Events as messages (id, topic, key, value, headers, ts)."""
    return events.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("topic"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), F.create_map(F.lit("source"), F.lit("events")).alias("headers"), "ts")


def round_trip(messages: DataFrame) -> DataFrame:
    """Messages written as JSON and read back, with the number k of their value."""
    wire = messages.select(F.to_json(F.struct(*messages.columns)).alias("value"))
    back = parse(wire, S.MESSAGE).select("record.*")
    return back.select("id", "topic", "key", F.get_json_object("value", "$.k").cast("long").alias("k"), "ts")
