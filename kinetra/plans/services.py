"""Queries of services around detection: topics, ingested locations, replication, elections, registries, comparisons and statistics of all parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetra import fixtures as X
from kinetra.functions import alerts as A
from kinetra.operators import api as Q
from kinetra.operators import control as C
from kinetra.operators import kv
from kinetra.operators import metrics as M
from kinetra.operators import placement as P
from kinetra.plans import base as B
from kinetra.plans import platform, state
from kinetra.plans.base import r6, rounded
from kinetra.sources.scratch import scratch
from kinetra.sources.store import KeyedStore
from kinetra.streaming import ingest

EVENTS = f"with {B.EVENTS_SQL}"
RECURSIVE = EVENTS.replace("with ", "with recursive ", 1)


def alert_topic(spark, sf):
    """Alerts as messages keyed by their vehicle."""
    return ingest.keyed_json(state.alerts(spark, sf).select("vehicle_id", "other_vehicle_id", "priority"), "vehicle_id")


def alert_labels(spark, sf):
    """Alerts by the name of their priority."""
    return state.alerts(spark, sf).groupBy(A.priority_label(F.col("priority")).alias("label")).agg(F.count("*").alias("alerts"))


def ingested_locations(spark, sf):
    """Location messages, some without a time, through a store in three batches; the latest of each vehicle."""
    store = KeyedStore(spark, scratch(spark), "vehicle_id string, ts double, x double, y double, vehicle_type string", ["vehicle_id"], ["ts", "x", "y"])
    messages = platform.location_messages(spark, sf).withColumn("n", F.pmod(F.xxhash64("vehicle_id", "ts", "x"), F.lit(3)))
    for n in range(3):
        store.append(messages.where(F.col("n") == n), n)
    return store.read()


def lww_remote(spark, sf):
    """What node 1 takes over from the others' messages, in order of arrival."""
    log = X.kv_log(spark, sf).withColumn("seq", state.arrival(F.col("seq")))
    return kv.merge_arrival(log, own=1).select("key", "value", "ts")


def leader_terms(spark, sf):
    """Term and leader of five clusters after each vote; some votes are of the term before."""
    e = X.events(spark, sf)
    term = F.floor(F.col("event_id") / 100) - F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    votes = e.select((F.col("event_id") % 5).alias("cluster"), "seq", F.col("seq").cast("double").alias("ts"), term.alias("term"), (F.col("user_id") % 7).alias("voter"), (F.col("event_id") * 31 % 3 % 2).alias("candidate"), (F.col("event_type") != "error").alias("granted"))
    return C.elections(votes, 7)


def task_assignment_grids(spark, sf):
    """Tasks over nodes that serve two grids each."""
    nodes = X.nodes(spark, sf).withColumn("grid_ids", F.array("grid", (F.col("grid") + F.col("node_id") % 3) % 4)).drop("grid")
    return P.assign_tasks(X.tasks(spark, sf), nodes)


def registry_loads(spark, sf):
    """Nodes that are registered, and their loads, after puts, updates and deletions."""
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "put").otherwise("load")
    return kv.registry(X.events(spark, sf).select(F.col("user_id").alias("node_id"), "ts", "seq", op.alias("op"), F.col("value").alias("load")))


def run_compare(spark, sf):
    """Four runs by what they measured: requests a second, their values as latencies, and the share of errors."""
    samples = X.events(spark, sf).select((F.col("user_id") % 4).cast("string").alias("run"), "ts", F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("error"))
    sums = samples.groupBy("run").agg(F.round(F.count("*") / (F.max("ts") - F.min("ts")), 9).alias("throughput"), F.round(F.count_if("error") / F.count("*"), 9).alias("error_rate"))
    stats = M.latency_stats(samples).select("run", F.round("mean", 6).alias("mean"), "p99")
    return M.compare(sums.join(stats, "run"))


def platform_stats(spark, sf):
    """One document of the statistics of all parts."""
    count = F.count("*").alias("n")
    tasks = X.tasks(spark, sf).agg(count, F.count_if(F.col("status") == "O").alias("pending"))
    alerts = state.alerts(spark, sf).agg(count, F.count_if(F.col("priority") >= 2).alias("urgent"))
    nodes = X.nodes(spark, sf).agg(count, F.count_if(F.col("status") == "active").alias("active"))
    shards = X.shards(spark, sf).agg(count, F.sum("vehicle_count").alias("vehicles"))
    reports = X.events(spark, sf).agg(count, F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("vehicles"))
    return Q.system_stats(vehicles=X.fleet(spark, sf).agg(count), alerts=alerts, nodes=nodes, shards=shards, tasks=tasks, reports=reports)


_PARTS = {
    "vehicles": "{'n': count(*)} from fleet",
    "alerts": "{'n': count(*), 'urgent': count(*) filter (priority >= 2)} from alerts",
    "nodes": "{'n': count(*), 'active': count(*) filter (status = 'active')} from nodes",
    "shards": "{'n': count(*), 'vehicles': sum(vehicle_count)::bigint} from shards",
    "tasks": "{'n': count(*), 'pending': count(*) filter (status = 'O')} from tasks",
    "reports": "{'n': count(*), 'errors': count(*) filter (event_type = 'error'), 'vehicles': count(distinct user_id)} from ev",
}

QUERIES = {
    "alert_topic": (alert_topic, f"{state.ALERTS} select cast(vehicle_id as varchar) as key, cast(to_json({{'vehicle_id': vehicle_id, 'other_vehicle_id': other_vehicle_id, 'priority': priority}}) as varchar) as value from alerts"),
    "alert_labels": (alert_labels, f"{state.ALERTS} select ['low', 'medium', 'high', 'emergency'][priority + 1] as label, count(*) as alerts from alerts group by 1"),
    "ingested_locations": (ingested_locations, f"""with {B.TRACKS_SQL}, m as (select cast(id as varchar) as vehicle_id, case when seq % 10 > 0 then ts else 1e9 end as ts, x, y, type as vehicle_type from tracks)
select * from m qualify row_number() over (partition by vehicle_id order by ts desc, x desc, y desc) = 1"""),
    "lww_remote": (lww_remote, state.QUERIES["lww_arrival"][1].replace("from kv),", "from kv where source_node <> 1),", 1)),
    "leader_terms": (leader_terms, f"""{RECURSIVE}, o as (select event_id % 5 as cluster, seq, event_id // 100 - case when event_id % 7 = 0 then 1 else 0 end as term, user_id % 7 as voter, event_id*31 % 3 % 2 as candidate, event_type <> 'error' as granted,
  row_number() over (partition by event_id % 5 order by seq) as n from ev),
f as (select cluster, 0::bigint as n, 0::bigint as seq, -1::bigint as term, []::bigint[] as voted, 0 as c0, 0 as c1, null::bigint as leader from o where n = 1
  union all select cluster, n, seq, term, voted, c0, c1, coalesce(leader, case when c0*2 > 7 then 0 when c1*2 > 7 then 1 end) from (
    select cluster, n, seq, term, case when counts then list_append(voted, voter) else voted end as voted, c0 + (counts and candidate = 0)::int as c0, c1 + (counts and candidate = 1)::int as c1, leader from (
    select *, t = term and granted and not list_contains(voted, voter) as counts from (
    select o.cluster, o.n, o.seq, o.voter, o.candidate, o.granted, o.term as t, greatest(o.term, f.term) as term, case when o.term > f.term then [] else f.voted end as voted,
      case when o.term > f.term then 0 else f.c0 end as c0, case when o.term > f.term then 0 else f.c1 end as c1, case when o.term > f.term then null else f.leader end as leader
    from f join o on o.cluster = f.cluster and o.n = f.n + 1))))
select cluster, seq, term as current_term, leader from f where n > 0"""),
    "task_assignment_grids": (task_assignment_grids, f"""with {B.NODES_SQL.replace("s_suppkey % 4 as grid", "unnest([s_suppkey % 4, (s_suppkey % 4 + s_suppkey % 3) % 4]) as grid")}, {B.TASKS_SQL},
best as (select grid, arg_min(node_id, (cpu_usage, node_id)) as of_grid from nodes where status = 'active' group by grid), anyone as (select arg_min(node_id, (cpu_usage, node_id)) as anywhere from nodes where status = 'active')
select task_id, case when task_type = 'collision_detection' and of_grid is not null then of_grid else (select anywhere from anyone) end as node_id from tasks left join best using (grid)"""),
    "registry_loads": (registry_loads, f"""{EVENTS}, p as (select user_id, seq, row_number() over (partition by user_id order by ts, seq) as n, event_type, value from ev),
l as (select user_id, max(n) filter (event_type = 'signup') as put, coalesce(max(n) filter (event_type = 'error'), 0) as gone from p group by user_id),
k as (select p.user_id, p.n, p.value from p join l using (user_id) where p.event_type = 'signup' and p.n > l.gone),
f as (select user_id, min(n) as first from k group by user_id)
select p.user_id as node_id, p.value as load from p join f using (user_id) where p.n >= f.first and p.event_type <> 'error' qualify row_number() over (partition by p.user_id order by p.n desc) = 1"""),
    "run_compare": (run_compare, f"""{EVENTS}, q as (select cast(user_id % 4 as varchar) as run, ts, value, event_type from ev), s as (
  select run, round(count(*)/(max(ts) - min(ts)), 9) as throughput, round(count(*) filter (event_type = 'error')/count(*), 9) as error_rate, round(avg(value), 6) as mean, count(*) as n, list_sort(list(value)) as v from q group by run),
u as (select *, v[cast(floor(n*0.99e0) as bigint) + 1] as p99 from s)
select arg_max(run, (throughput, run)) as best_throughput, arg_min(run, (mean, run)) as best_mean, arg_min(run, (p99, run)) as best_p99, arg_min(run, (error_rate, run)) as best_error_rate from u"""),
    "platform_stats": (platform_stats, f"""{state.ALERTS}, {B.NODES_SQL}, {B.SHARDS_SQL}, {B.TASKS_SQL}, {B.EVENTS_SQL}
select cast(to_json({{{", ".join(f"'{k}': (select cast(to_json({v.split(' from ')[0]}) as varchar) from {v.split(' from ')[1]})" for k, v in _PARTS.items())}}}) as varchar) as stats"""),
}
