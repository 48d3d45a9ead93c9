"""Latest state, history, expiry and replication as queries over append logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra.operators.control import fold
from kinetra.operators.ranking import foremost


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key. An aggregate of structs, so that rows combine before the shuffle."""
    rest = [c for c in log.columns if c != key and c not in order]
    return log.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("row")).select(key, "row.*").select(*log.columns)


def history(log: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key in arrival order, numbered from the newest."""
    return log.withColumn("back", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("back") <= n)


def unexpired(kv: DataFrame, as_of: Column) -> DataFrame:
    """Rows that live at as_of: expired strictly after ts + ttl; no ttl, or 0, never expires."""
    ttl = F.nullif(F.col("ttl"), F.lit(0))
    return kv.where(ttl.isNull() | (as_of <= F.col("ts") + ttl))


def merge_latest(log: DataFrame) -> DataFrame:
    """Last writer wins with tombstones: the newest operation of each key, if it is a put."""
    return latest(log, "key", "ts", "seq").where("op = 'put'")


def merge_arrival(log: DataFrame, own: int | None = None) -> DataFrame:
    """Last writer wins without tombstones, in arrival order: an operation applies if the key is absent or it is strictly newer, so that a delete lets an older put in again. With own, a node's number, its own messages (source_node) are ignored, as it has applied them itself."""

    def step(state, _, seq, ts, value, op):
        if state is None or (ts is not None and ts > state[0]):
            state = {"put": (ts, value), "delete": None}.get(op, state)
        return state, (seq, *(state or (None, None)), state is not None)

    rows = (log if own is None else log.where(F.col("source_node") != own)).withColumns({"at": F.col("ts"), "ts": F.lit(0.0)})
    return latest(fold(rows, ["key"], ["at", "value", "op"], lambda: None, step, "seq long, ts double, value double, held boolean"), "key", "seq").where("held").select("key", "ts", "value")


def registry(log: DataFrame) -> DataFrame:
    """Nodes by a log of operations (node_id, ts, seq, op, load): put registers a node with a load, load changes that of a registered one, delete removes it."""

    def step(load, _, seq, op, told):
        load = told if op == "put" or (op == "load" and load is not None) else None if op == "delete" else load
        return load, (seq, load)

    return latest(fold(log, ["node_id"], ["op", "load"], lambda: None, step, "seq long, load double"), "node_id", "seq").where("load is not null").select("node_id", "load")


def risks_of_vehicles(risks: DataFrame, n: int = 20) -> DataFrame:
    """The last n risks of each vehicle, whichever side it is on."""
    both = risks.select(F.explode(F.array("vehicle_id", "other_vehicle_id")).alias("vehicle"), *risks.columns)
    both = foremost(both, ["vehicle"], [("ts", "descending"), ("risk_level", "descending"), ("vehicle_id", "ascending"), ("other_vehicle_id", "ascending")], n)
    order = W.partitionBy("vehicle").orderBy(F.desc("ts"), F.desc("risk_level"), "vehicle_id", "other_vehicle_id")
    return both.withColumn("back", F.row_number().over(order)).where(F.col("back") <= n)


def members(log: DataFrame, group: str, member: str) -> DataFrame:
    """Current members of each group from a log of joins and leaves (op put/delete, ts, seq)."""
    pair = log.groupBy(group, member).agg(F.max_by("op", F.struct("ts", "seq")).alias("op")).where("op = 'put'")
    return pair.groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("members"), F.count("*").alias("n"))
