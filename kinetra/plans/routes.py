"""Queries of the API routes and of shards, transfers and recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetra import fixtures as X
from kinetra.operators import api as Q
from kinetra.operators import control as C
from kinetra.operators import metrics as M
from kinetra.plans import base as B
from kinetra.plans import detection as P
from kinetra.plans.grid import cell_sql
from kinetra.sources import files
from kinetra.sources import generators as G
from kinetra.sources.scratch import scratch

EVENTS, TRACKS = f"with {B.EVENTS_SQL}", f"with {B.TRACKS_SQL}"
SHARD = "cast((((cx::bigint*73856093 + cy::bigint*19349663 + cz::bigint*83492791) % 10) + 10) % 10 as bigint)"


def api_location(spark, sf):
    return Q.vehicle_location(X.tracks(spark, sf), 42, F.lit(1706572800.0), 86400.0).select("id", "ts", "x", "y")


def api_history(spark, sf):
    return Q.vehicle_history(X.tracks(spark, sf), 42).select("vehicle_id", "ts", F.col("position.x").alias("x"), F.col("velocity.vx").alias("vx"), "heading")


def api_cell_vehicles(spark, sf):
    return Q.vehicles_in_cell(X.fleet(spark, sf), 1, 1, 2)


def shard_vehicles(spark, sf):
    return Q.shard_vehicles(X.fleet(spark, sf), X.shards(spark, sf), 2, 10)


def process_shard(spark, sf):
    return Q.process_shard(P.patterned_fleet(spark, sf), 3, 2, 10).groupBy("priority").agg(F.count("*").alias("alerts"))


def detection_task(spark, sf):
    return B.rounded(Q.detection_task(X.fleet(spark, sf).withColumn("history", F.lit(2)), 7, threshold=0.05).select("vehicle_id2", "risk_level"), "risk_level")


def transfers(spark, sf):
    e = X.events(spark, sf)
    return Q.transfers(e.select(F.col("seq").alias("request_id"), "user_id"), e.where("value >= 50").select(F.col("seq").alias("request_id"), F.col("props").alias("state")))


def all_transfers(spark, sf):
    """A request of every event, answered unless it is an error."""
    e = X.events(spark, sf).withColumn("request_id", F.col("seq"))
    return Q.transfers(e.select("request_id", "user_id"), e.where("event_type <> 'error'").select("request_id", F.col("props").alias("state")))


def recoveries(spark, sf):
    return Q.recoveries(X.events(spark, sf).select((F.col("user_id") % 30).alias("recovery_id"), F.col("event_type").alias("status"), "ts", "seq"))


def recovery_conformance(spark, sf):
    """Each status of a recovery against the steps that are allowed."""
    status = F.get(F.array(*map(F.lit, ["initiated", "starting", "completed", "failed"])), (F.col("event_id") * 7 % 4).cast("int"))
    log = X.events(spark, sf).select((F.col("user_id") % 30).alias("recovery_id"), "ts", "seq", status.alias("status"))
    return C.conformance(log)


def snapshots(spark, sf):
    """Seven backups of the events by day of the week, of which the newest five are kept, a half-written one is not seen and the one before the last is restored."""
    folder, e = scratch(spark), X.events(spark, sf).withColumn("day", F.col("event_id") % 7)
    for day in range(7):
        files.backup({"events": e.where(F.col("day") == day).select("event_id", "event_type", "value"), "counts": e.where(F.col("day") == day).groupBy("event_type").count()}, folder, f"day{day}", float(day))
    e.limit(1).select("event_id").write.parquet(f"{folder}/backup_half/events")
    files.retain(spark, folder, 5)
    kept = files.backups(spark, folder)
    back = files.restore(spark, folder, kept.offset(1).first()["backup_id"])
    left = kept.agg(F.count("*").alias("kept"), F.min("created_at").alias("oldest"))
    rows = back["events"].groupBy("event_type").agg(F.count("*").alias("events"), F.max("event_id").alias("last")).join(back["counts"], "event_type")
    return rows.select("event_type", "events", "last", F.col("count").alias("counted"), left.select("kept").scalar().alias("kept"), left.select("oldest").scalar().alias("oldest"))


def road_hops(spark, sf):
    roads, edges, _ = G.grid_roads(spark, 6, 4, 100.0)
    at = X.fleet(spark, sf).select("id", F.concat(F.lit("h"), F.col("id") % 5).alias("road"))
    return G.next_roads(at, edges)


def fleet_stats(spark, sf):
    return X.fleet(spark, sf).groupBy("type").agg(F.count("*").alias("vehicles"), F.count_if((F.col("x") < 1000) & (F.col("y") < 1000)).alias("in_city"))


def system_stats(spark, sf):
    nodes = X.nodes(spark, sf)
    return Q.system_stats(nodes=nodes.agg(F.count("*").alias("n")), active=nodes.agg(F.count_if(F.col("status") == "active").alias("n")))


def tumbling_counters(spark, sf):
    return M.throughput(X.events(spark, sf), "time", 86400).select("start", "events")


PROCESS_SHARD = f"""{P.PREDICTED.rsplit(chr(10) + "select", 1)[0]}, own as (select id from (select id, {cell_sql("2")} from fleet) where {SHARD} = 3
), best as (select * from risks semi join own on id = vehicle_id qualify row_number() over (partition by vehicle_id, other_vehicle_id order by risk_level desc, time_to_collision) = 1
), p as (select case when risk_level >= 0.8e0 and time_to_collision < 3 then 3 when risk_level >= 0.8e0 or time_to_collision < 5 then 2 when risk_level >= 0.6e0 then 1 else 0 end as priority from best where risk_level >= 0.3e0)
select priority, count(*) as alerts from p group by priority"""

QUERIES = {
    "api_location": (api_location, f"{TRACKS}, t as (select * from tracks where id = 42 qualify row_number() over (order by ts desc, seq desc) = 1) select id, ts, x, y from t where 1706572800 <= ts + 86400"),
    "api_history": (api_history, f"{TRACKS}, t as (select *, row_number() over (order by seq desc) as back from tracks where id = 42) select id as vehicle_id, ts, x, vx, heading from t where back <= 10"),
    "api_cell_vehicles": (api_cell_vehicles, f"with {B.fleet_sql()}, c as (select id, {cell_sql('1')} from fleet) select id from c where cx = 1 and cy = 2 and cz = 0"),
    "shard_vehicles": (shard_vehicles, f"with {B.fleet_sql()}, {B.SHARDS_SQL}, c as (select id, {cell_sql('2')} from fleet), h as (select id, {SHARD} as shard_id from c) select id, shard_id, node_id from h join shards using (shard_id)"),
    "process_shard": (process_shard, PROCESS_SHARD),
    "detection_task": (detection_task, P.LOOKAHEAD.replace("0.1e0)\n", "0.05e0)\n").rsplit("\nselect", 1)[0] + "\nselect vehicle_id2, round(risk_level, 6) + 0e0 as risk_level from h where vehicle_id1 = 7"),
    "transfers": (transfers, f"{EVENTS} select a.seq as request_id, a.user_id, b.props as state from ev a left join (select * from ev where value >= 50) b on a.seq = b.seq"),
    "all_transfers": (all_transfers, f"{EVENTS} select seq as request_id, user_id, case when event_type <> 'error' then props end as state from ev"),
    "recoveries": (recoveries, f"{EVENTS} select user_id % 30 as recovery_id, event_type as status, ts, seq from ev qualify row_number() over (partition by user_id % 30 order by ts desc, seq desc) = 1"),
    "recovery_conformance": (recovery_conformance, f"""with recursive {B.EVENTS_SQL}, o as (select user_id % 30 as recovery_id, seq, ['initiated', 'starting', 'completed', 'failed'][event_id*7 % 4 + 1] as status, row_number() over (partition by user_id % 30 order by ts, seq) as n from ev),
f as (select recovery_id, n, seq, status, status = 'initiated' as valid, case when status = 'initiated' then status end as state from o where n = 1
  union all select recovery_id, n, seq, status, ok, case when ok then status else state end from (
    select o.recovery_id, o.n, o.seq, o.status, f.state, case o.status when 'initiated' then f.state is null or f.state in ('completed', 'failed') when 'starting' then coalesce(f.state = 'initiated', false) else coalesce(f.state = 'starting', false) end as ok
    from f join o on o.recovery_id = f.recovery_id and o.n = f.n + 1))
select recovery_id, seq, status, valid, state from f"""),
    "snapshots": (snapshots, f"{EVENTS} select event_type, count(*) as events, max(event_id) as last, count(*) as counted, 5::bigint as kept, 2e0 as oldest from ev where event_id % 7 = 5 group by event_type"),
    "road_hops": (road_hops, "select c_custkey as id, 'h' || (c_custkey % 5) as road, 'v' || k as next from customer, range(0, 7) as g(k)"),
    "fleet_stats": (fleet_stats, f"with {B.fleet_sql()} select type, count(*) as vehicles, count(*) filter (x < 1000 and y < 1000) as in_city from fleet group by type"),
    "system_stats": (system_stats, f"""with {B.NODES_SQL}, s as (select to_json({{'n': count(*)}}) as nodes, to_json({{'n': count(*) filter (status = 'active')}}) as active from nodes)
select cast(to_json({{'nodes': cast(nodes as varchar), 'active': cast(active as varchar)}}) as varchar) as stats from s"""),
    "tumbling_counters": (tumbling_counters, f"{EVENTS} select cast(us // 86400000000 * 86400 as bigint) as start, count(*) as events from ev group by 1"),
}
