"""The read and write routes as query functions, and the queries behind tasks, shards, recovery and state transfer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.functions import grid as G
from kinetra.operators import grid_stats, kv, lifecycle, trajectory
from kinetra.sources.store import KeyedStore


def vehicle_location(locations: DataFrame, vehicle_id, as_of: Column, ttl: float = 60.0) -> DataFrame:
    """The latest location of a vehicle, unless it has expired."""
    return kv.latest(locations.where(F.col("id") == vehicle_id), "id", "ts", "seq").where(as_of <= F.col("ts") + ttl)


def vehicle_history(locations: DataFrame, vehicle_id, n: int = 10) -> DataFrame:
    """The last n locations of a vehicle, oldest first, as API responses."""
    rows = kv.history(locations.where(F.col("id") == vehicle_id), "id", "seq", n)
    return rows.orderBy("seq").select(F.col("id").alias("vehicle_id"), "ts", F.struct("x", "y", "z").alias("position"), F.struct("vx", "vy", "vz").alias("velocity"), "heading")


def vehicle_risks(risks: DataFrame, vehicle_id, n: int = 20) -> DataFrame:
    """The last n risks in which a vehicle is on either side."""
    return kv.risks_of_vehicles(risks.where((F.col("vehicle_id") == vehicle_id) | (F.col("other_vehicle_id") == vehicle_id)), n).where(F.col("vehicle") == vehicle_id)


def risk_by_id(risks: DataFrame, risk_id: str) -> DataFrame:
    return risks.where(F.col("risk_id") == risk_id)


def vehicles_in_cell(fleet: DataFrame, level: int, cx: int, cy: int, cz: int = 0) -> DataFrame:
    return grid_stats.placed(fleet, level).where((F.col("cx") == cx) & (F.col("cy") == cy) & (F.col("cz") == cz)).select("id")


LOCATION = "id long, ts double, seq long, x double, y double, z double, vx double, vy double, vz double, heading double, type string"
RISK = "risk_id string, vehicle_id long, other_vehicle_id long, risk_level double, time_to_collision double, distance double, ts double"


def location_stores(spark: SparkSession, folder: str, ttl: float = 60.0, history_ttl: float = 3600.0, cap: int = 10) -> tuple[KeyedStore, KeyedStore]:
    """The latest location of each vehicle, and its last `cap` ones in order of arrival."""
    return KeyedStore(spark, f"{folder}/latest", LOCATION, ["id"], ["ts", "seq"], ttl=ttl), KeyedStore(spark, f"{folder}/history", LOCATION, ["id"], ["seq"], keep=cap, ttl=history_ttl)


def store_locations(reports: DataFrame, batch: int, stores: tuple[KeyedStore, KeyedStore]) -> None:
    """A batch of reports into both stores; a batch that runs twice changes nothing."""
    for store in stores:
        store.append(reports, batch)


def risk_stores(spark: SparkSession, folder: str, ttl: float = 3600.0, cap: int = 20) -> tuple[KeyedStore, KeyedStore]:
    """Risks by id, and the last `cap` risks of each vehicle, whichever side it is on."""
    return KeyedStore(spark, f"{folder}/risks", RISK, ["risk_id"], ["ts"], ttl=ttl), KeyedStore(spark, f"{folder}/by_vehicle", f"vehicle long, {RISK}", ["vehicle"], ["ts", "risk_level", "risk_id"], keep=cap, ttl=ttl)


def store_risks(risks: DataFrame, batch: int, stores: tuple[KeyedStore, KeyedStore]) -> None:
    stores[0].append(risks, batch)
    stores[1].append(risks.select(F.explode(F.array("vehicle_id", "other_vehicle_id")).alias("vehicle"), *risks.columns), batch)


def detection_task(fleet: DataFrame, vehicle_id, **options) -> DataFrame:
    """Look-ahead risks of one vehicle: the pair join sees that vehicle and its others alone."""
    from kinetra.operators.detect import lookahead

    return lookahead(fleet, **options).where(F.col("vehicle_id1") == vehicle_id)


def shard_vehicles(fleet: DataFrame, shards: DataFrame, level: int, n_shards: int) -> DataFrame:
    """Each vehicle's shard by its cell, and the shard's node."""
    cells = grid_stats.placed(fleet, level).select("id", G.mixed(F.col("cx"), F.col("cy"), F.col("cz"), n_shards).cast("long").alias("shard_id"))
    return cells.join(shards.select("shard_id", "node_id"), "shard_id").select("id", "shard_id", "node_id")


def process_shard(fleet: DataFrame, shard: int, level: int, n_shards: int) -> DataFrame:
    """Alerts of the vehicles of one shard, against the whole fleet."""
    own = grid_stats.placed(fleet, level).where(G.mixed(F.col("cx"), F.col("cy"), F.col("cz"), n_shards) == shard).select("id")
    return lifecycle.raise_alerts(trajectory.predict_fleet(fleet, subjects=fleet.join(own, "id", "left_semi")))


def transfers(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """State requests with their responses; state is null while none came."""
    return requests.join(responses.select("request_id", "state"), "request_id", "left")


def recoveries(log: DataFrame) -> DataFrame:
    """Latest status of each recovery (recovery_id, status, ts, seq)."""
    return kv.latest(log, "recovery_id", "ts", "seq")


def system_stats(**parts: DataFrame) -> DataFrame:
    """One JSON document of one-row statistics by name."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.to_json(F.first(F.struct(*df.columns))).alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out.select(F.to_json(F.struct(*out.columns)).alias("stats"))
