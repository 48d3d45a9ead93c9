"""Driver tables as fleets, tracks, nodes, tasks and logs, by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, k: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), k.cast("int"))


def _motion(k: Column) -> dict[str, Column]:
    number = lambda c: c.cast("double")
    return {
        "x": number(k * 7919 % 2000), "y": number(k * 104729 % 2003), "z": F.lit(0.0),
        "vx": number(k * 31 % 41 - 20), "vy": number(k * 17 % 37 - 18), "vz": F.lit(0.0),
        "ax": (k * 13 % 5 - 2) * 0.5, "ay": (k * 29 % 5 - 2) * 0.5, "az": F.lit(0.0),
        "heading": k * 11 % 628 / 100,
    }


def fleet(spark: SparkSession, sf_dir: str, source: str = "customer", key: str = "c_custkey") -> DataFrame:
    """Vehicles by the rows of a table; one with fewer splits than there are cores is dealt out before any join, larger ones are not moved."""
    k, keys = F.col(key), table(spark, sf_dir, source).select(key)
    cores = spark.sparkContext.defaultParallelism
    if keys.rdd.getNumPartitions() < cores:
        keys = keys.repartition(cores)
    return keys.select(
        k.alias("id"), *(v.cast("double").alias(n) for n, v in _motion(k).items()),
        _pick([2.0, 4.0, 5.0, 1.0], k % 4).alias("size"), _pick(["car", "truck", "bus", "motorcycle"], k % 4).alias("type"), F.lit(0.0).alias("ts"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ts as epoch seconds and event_id as the arrival order seq."""
    return table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("ts").cast("timestamp").alias("time"), "user_id", "event_type", "value", "props")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k, u = events(spark, sf_dir), F.col("event_id"), F.col("user_id")
    m = _motion(k)
    return e.select(u.alias("id"), "seq", "ts", m["x"].alias("x"), m["y"].alias("y"), m["z"].alias("z"), m["vx"].alias("vx"), m["vy"].alias("vy"), m["vz"].alias("vz"), m["heading"].cast("double").alias("heading"), _pick(["car", "truck", "bus", "motorcycle"], u % 4).alias("type"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("node_id"), (k * 37 % 100 / 100).alias("cpu_usage"), (k * 53 % 100 / 100).alias("memory_usage"), F.when(k % 5 == 0, "inactive").otherwise("active").alias("status"), (k % 4).alias("grid"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node count is that of the supplier table."""
    k = F.col("n_nationkey").cast("long")
    count = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "nation").join(F.broadcast(count)).select(k.alias("shard_id"), (k % F.col("n")).alias("node_id"), (k * 97 % 50).alias("vehicle_count"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86400
    return table(spark, sf_dir, "orders").select(
        k.alias("task_id"), (100 - 20 * F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), (day + k % 86400).alias("created_at"), (60 + k % 600).alias("timeout"),
        (F.col("o_custkey") % 4).alias("grid"), F.when(F.col("o_orderstatus") == "F", "collision_detection").otherwise("vehicle_count").alias("task_type"), F.col("o_orderstatus").alias("status"),
    )


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").alias("key"), "value", "ts", "seq", F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), (F.col("event_id") % 3).alias("source_node"), F.lit(3600.0).alias("ttl"))


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run"), (F.col("l_extendedprice") / 100).alias("latency_ms"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("line"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select((F.col("event_id") % 50).alias("term"), (F.col("user_id") % 7).alias("voter"), (F.col("event_id") * 31 % 3).alias("candidate"), (F.col("event_type") != "error").alias("granted"))
