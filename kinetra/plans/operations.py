"""Queries of placement, scheduling, control folds, metrics and messages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra import fixtures as X
from kinetra.operators import control as C
from kinetra.operators import metrics as M
from kinetra.operators import placement as P
from kinetra.operators.ranking import placed
from kinetra.plans import base as B
from kinetra.plans.base import r6, rounded
from kinetra.sources import messages as S

TASK_TIME = 900_000_000  # epoch seconds within the orders' dates
NODES, TASKS = f"with {B.NODES_SQL}", f"with {B.NODES_SQL}, {B.TASKS_SQL}"
EVENTS = f"with {B.EVENTS_SQL}"


def task_order(spark, sf):
    return P.task_order(X.tasks(spark, sf)).select("task_id", "priority", "created_at")


def pending_task_order(spark, sf):
    """All tasks without a result, in the order in which they are to be assigned."""
    return placed(P.task_order(X.tasks(spark, sf).where("status = 'O'")).select("task_id", "priority", "created_at"))


def task_timeouts(spark, sf):
    return P.timed_out(X.tasks(spark, sf), F.lit(TASK_TIME)).select("task_id", "created_at", "timeout")


def task_assignment(spark, sf):
    return P.assign_tasks(X.tasks(spark, sf), X.nodes(spark, sf))


ASSIGN = """best as (select grid, arg_min(node_id, (cpu_usage, node_id)) as of_grid from nodes where status = 'active' group by grid),
anyone as (select arg_min(node_id, (cpu_usage, node_id)) as anywhere from nodes where status = 'active'),
assigned as (select task_id, case when task_type = 'collision_detection' and of_grid is not null then of_grid else (select anywhere from anyone) end as node_id from tasks left join best using (grid))"""


def task_lifecycle(spark, sf):
    tasks = X.tasks(spark, sf)
    results = tasks.where("status <> 'O'").select("task_id", (F.col("status") == "F").alias("success"))
    assigned = P.assign_tasks(tasks.where("task_id % 3 = 0"), X.nodes(spark, sf))
    return P.lifecycle(tasks, results, assigned, F.lit(TASK_TIME))


def node_least_loaded(spark, sf):
    return P.least_loaded(P.active(X.nodes(spark, sf)), "cpu_usage", ["grid"])


def active_nodes(spark, sf):
    return P.active(X.nodes(spark, sf)).groupBy("grid").agg(F.count("*").alias("nodes"))


def node_load_stats(spark, sf):
    return rounded(P.load_stats(X.nodes(spark, sf)), "cpu_mean", "cpu_std", "memory_mean", "memory_std")


def node_imbalance(spark, sf):
    return P.imbalance(X.nodes(spark, sf))


def shard_load(spark, sf):
    return rounded(P.shard_load(X.shards(spark, sf), X.nodes(spark, sf)), "load")


def node_shards(spark, sf):
    return P.node_stats(X.shards(spark, sf))


def shard_reassign(spark, sf):
    return P.reassign(X.shards(spark, sf), X.nodes(spark, sf), F.col("node_id") % 3 == 0)


def node_registry(spark, sf):
    return P.current(X.kv_log(spark, sf).withColumnRenamed("key", "node_id"), "node_id", "ts", "seq").select("node_id", "value", "ts")


def leader_votes(spark, sf):
    e = X.events(spark, sf)
    votes = e.select((F.col("event_id") % 50).alias("term"), (F.col("user_id") % 7).alias("voter"), (F.col("event_id") * 31 % 3).alias("candidate"), (F.col("event_type") != "error").alias("granted"), "seq")
    return P.elected(votes, 7)


def _cells(spark, sf):
    return X.shards(spark, sf).select(F.col("shard_id").alias("cell"), F.col("vehicle_count").alias("load"), (F.col("shard_id") % 4).cast("int").alias("shard_id"))


def greedy_shards(spark, sf):
    return P.greedy_shards(_cells(spark, sf).select("cell", "load"), 4)


def cell_rebalance(spark, sf):
    skewed = _cells(spark, sf).withColumn("shard_id", F.when(F.col("cell") < 16, 0).otherwise(F.col("shard_id")))
    return P.rebalance_cells(skewed, 4)


def node_rebalance(spark, sf):
    nodes = X.nodes(spark, sf)
    loaded = P.shard_load(X.shards(spark, sf), nodes).join(nodes.select("node_id", F.col("cpu_usage").alias("node_load")), "node_id")
    return P.rebalance_nodes(loaded)


CELLS = f"""with recursive {B.SHARDS_SQL}, cells as (select shard_id as cell, vehicle_count as load, cast(shard_id % 4 as int) as shard_id from shards)"""
GREEDY = f"""{CELLS}, q as (select cell, load, row_number() over (order by cell) as n from cells),
f as (select 0::bigint as n, 0::bigint as cell, 0::bigint as load, 0 as shard_id, [{{'h': 0::bigint, 'k': k::int}} for k in range(4)] as t
  union all select q.n, q.cell, q.load, t[1].k, list_sort(list_append(t[2:], {{'h': t[1].h + q.load, 'k': t[1].k}})) from f join q on q.n = f.n + 1)
select cell, load, shard_id from f where n > 0"""
REBALANCED = f"""{CELLS}, c as (select cell, load, case when cell < 16 then 0 else shard_id end as shard_id from cells),
l as (select *, avg(held) over () as mean from (select cast(k as int) as shard_id, cast(coalesce(sum(load), 0) as bigint) as held from range(4) g(k) left join c on c.shard_id = k group by k)),
w as (select c.*, held, mean, held - sum(load) over (partition by c.shard_id order by load desc, cell rows unbounded preceding) as rest from c join l using (shard_id) where held > 1.2e0*mean),
q as (select *, row_number() over (order by held desc, shard_id, load desc, cell) as n from w where rest > mean),
f as (select 0::bigint as n, 0::bigint as cell, 0 as target, list_sort(list({{'h': held, 'k': shard_id}})) as t from l where held < 0.8e0*mean
  union all select n, cell, target, case when u[1].h > 0.9e0*mean then u[2:] else u end from (
    select q.n, q.cell, q.mean, t[1].k as target, list_sort(list_append(t[2:], {{'h': t[1].h + q.load, 'k': t[1].k}})) as u from f join q on q.n = f.n + 1 where len(t) > 0))
select c.cell, c.load, c.shard_id as was, coalesce(target, c.shard_id) as shard_id from c left join (select * from f where n > 0) f using (cell)"""
NODE_REBALANCED = f"""with recursive {B.NODES_SQL}, {B.SHARDS_SQL}, s as (select shard_id, node_id, vehicle_count, cpu_usage / count(*) over (partition by node_id) as load, cpu_usage from shards join nodes using (node_id)),
l as (select *, avg(node_load) over () as mean from (select node_id, max(cpu_usage) as node_load from s group by node_id)),
q as (select s.*, 0.8e0*mean as goal, row_number() over (order by node_id, vehicle_count desc, shard_id) as n from s join l using (node_id) where node_load > 1.2e0*mean),
t as (select node_id, node_load, row_number() over (order by node_id) as k from l where node_load < 0.8e0*mean),
f as (select 0::bigint as n, 0::bigint as shard_id, 0::bigint as target, 1::bigint as k, 0e0 as got
  union all select n, shard_id, target, case when total >= goal then k + 1 else k end, case when total >= goal then 0 else got end from (
    select q.n, q.shard_id, q.goal, t.node_id as target, f.k, f.got + q.load as got, t.node_load + f.got + q.load as total from f join q on q.n = f.n + 1 join t on t.k = f.k))
select s.shard_id, s.node_id as was, coalesce(target, s.node_id) as node_id from s left join (select * from f where n > 0) f using (shard_id)"""


def region_plan(spark, sf):
    """The cells lie in rows of five."""
    placed = {"level": F.lit(2), "cx": F.col("cell") % 5, "cy": F.floor(F.col("cell") / 5), "cz": F.lit(0).cast("long")}
    return P.region_plan(_cells(spark, sf).withColumnRenamed("load", "vehicle_count").withColumns(placed), 4)


#: splits fill the idle shards in order, then new ones; the idle ones left are paired until a pair has no cells that touch
PLAN = f"""{CELLS}, r as (select cell, cell % 5 as cx, cell // 5 as cy, shard_id, load as n from cells),
l as (select shard_id, coalesce(sum(n), 0) as held from (select cast(k as int) as shard_id from range(4) g(k)) left join r using (shard_id) group by shard_id), m as (select max(held) as most from l),
s as (select r.*, row_number() over (order by r.shard_id) as turn from (select * from r qualify row_number() over (partition by shard_id order by n desc, cell) = 1) r join l using (shard_id), m where held > 0.7e0*most),
idle as (select shard_id, row_number() over (order by shard_id) as place from l, m where held < 0.3e0*most),
parts as (select s.*, i, case when i > 0 then (turn - 1)*7 + i end as place from s, range(8) g(i)),
rest as (select shard_id, row_number() over (order by place) - 1 as k from idle where place > (select coalesce(max(place), 0) from parts)),
two as (select a.k // 2 as k, a.shard_id as one, b.shard_id as other from rest a join rest b on a.k % 2 = 0 and b.k = a.k + 1),
pick as (select two.k, one, a.cell as a, b.cell as b from two join r a on a.shard_id = one join r b on b.shard_id = other and abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1 qualify row_number() over (partition by two.k order by a.cell, b.cell) = 1),
merged as (select unnest([a, b]) as cell, a || '+' || b as region, one from pick where k < (select coalesce(min(k), 1000000) from two where k not in (select k from pick)))
select 'split' as action, cell, cell || '/' || i as region, 3 as level, cast(2*cx + i // 4 as bigint) as cx, cast(2*cy + i // 2 % 2 as bigint) as cy, cast(i % 2 as bigint) as cz, parts.shard_id as was,
  cast(case when i = 0 then parts.shard_id else coalesce(idle.shard_id, 4 + parts.place - (select count(*) from idle) - 1) end as int) as shard_id from parts left join idle using (place)
union all select 'merge', r.cell, region, 2, r.cx, r.cy, 0, r.shard_id, one from merged join r using (cell)"""


def _resources(spark, sf):
    """A resource of each task, spread over all nodes."""
    nodes = X.nodes(spark, sf)
    ranked = nodes.select("node_id", (F.row_number().over(W.orderBy("node_id")) - 1).cast("long").alias("turn"))
    held = X.tasks(spark, sf).join(F.broadcast(nodes.agg(F.count("*").alias("n")))).withColumn("turn", F.col("task_id") % F.col("n"))
    return held.join(F.broadcast(ranked), "turn").select(F.concat_ws("-", "task_type", F.col("task_id").cast("string")).alias("resource_id"), "node_id")


def resource_failover(spark, sf):
    return P.failover(_resources(spark, sf), X.nodes(spark, sf), F.col("node_id") % 4 == 1)


def _requests(spark, sf):
    return X.events(spark, sf).select("ts", "seq", F.col("user_id").alias("client"), F.col("event_type").alias("endpoint"), (F.col("event_type") != "error").alias("success"), (F.col("seq") % 10).alias("current_priority"), (F.col("seq") * 37 % 100 / 100).alias("cpu"))


RATE, CAPACITY = 1 / 40000, 2.0


def token_bucket(spark, sf):
    return C.token_bucket(_requests(spark, sf), RATE, CAPACITY).select("client", "seq", "allowed")


ORDERED = f"{EVENTS}, o as (select user_id as client, ts, seq, event_type <> 'error' as success, (seq*37 % 100)/100e0 as cpu, row_number() over (partition by user_id order by ts, seq) as n from ev)"
RECURSIVE = ORDERED.replace("with ", "with recursive ", 1)
BUCKET = f"""{RECURSIVE}, f as (select client, n, seq, ts, {CAPACITY - 1}::double as tokens, true as allowed from o where n = 1
  union all select client, n, seq, ts, case when r >= 1 then r - 1 else r end, r >= 1 from (
    select o.client, o.n, o.seq, o.ts, least({CAPACITY}::double, f.tokens + (o.ts - f.ts)*{RATE!r}::double) as r from f join o on o.client = f.client and o.n = f.n + 1))
select client, seq, allowed from f"""


def circuit_breaker(spark, sf):
    return C.circuit_breaker(_requests(spark, sf), failures=2, recovery=60000.0, key="client").select("client", "seq", "allowed", "state")


BREAKER = f"""{RECURSIVE}, f as (select client, 0::bigint as n, 0::bigint as seq, 'closed' as state, 0 as failed, 0e0 as since, 0 as trials, true as allowed from o where n = 1
  union all select client, n, seq, case when won and st = 'half-open' then 'closed' when opens then 'open' else st end, cnt, case when lost then ts else since end,
    case when won and st = 'half-open' then 0 else tr end, ok from (
    select *, lost and (st = 'half-open' or (st = 'closed' and cnt >= 2)) as opens from (
    select *, case when won then 0 when lost and st = 'closed' then failed + 1 else failed end as cnt from (
    select *, ok and success as won, ok and not success as lost from (
    select o.client, o.n, o.seq, o.ts, o.success, f.failed, f.since, case when f.state = 'open' and o.ts - f.since > 60000 then 'half-open' else f.state end as st,
      case when f.state = 'open' and o.ts - f.since > 60000 then 0 when f.state = 'half-open' and f.trials < 3 then f.trials + 1 else f.trials end as tr,
      f.state = 'closed' or (f.state = 'open' and o.ts - f.since > 60000) or (f.state = 'half-open' and f.trials < 3) as ok
    from f join o on o.client = f.client and o.n = f.n + 1)))))
select client, seq, allowed, state from f where n > 0"""


def adaptive_throttle(spark, sf):
    return rounded(C.adaptive_rate(_requests(spark, sf), 100.0, "client"), "rate").select("client", "seq", "rate")


ADAPT = f"""{RECURSIVE}, f as (select client, 0::bigint as n, 0::bigint as seq, 100e0 as rate from o where n = 1
  union all select o.client, o.n, o.seq, case when cpu > 0.8e0 then greatest(10e0, rate*0.8e0) when cpu < 0.5e0 then least(10000e0, rate*1.1e0) else rate end from f join o on o.client = f.client and o.n = f.n + 1)
select client, seq, {r6("rate")} from f where n > 0"""


def admission_chain(spark, sf):
    return C.admission(_requests(spark, sf), *ADMITTED, {"failures": 3, "recovery": 3600.0})


ADMITTED = ((1 / 300, 50.0), (1 / 1500, 20.0), (1 / 40000, 3.0))


def _limiter_sql(source: str, name: str, key: str, rate: float, capacity: float, where: str = "true") -> str:
    """CTEs {name}o and {name}: which of the rows of a source that meet a condition find a token, in order, by key."""
    return f"""{name}o as (select seq, ts, {key} as key, row_number() over (partition by {key} order by ts, seq) as n from {source} where {where}),
{name}f as (select key, 1::bigint as n, seq, ts, {capacity - 1}::double as tokens, true as allowed from {name}o where n = 1
  union all select key, n, seq, ts, case when r >= 1 then r - 1 else r end, r >= 1 from (
    select o.key, o.n, o.seq, o.ts, least({capacity}::double, f.tokens + (o.ts - f.ts)*{rate!r}::double) as r from {name}f f join {name}o o on o.key = f.key and o.n = f.n + 1))"""


def _admission_sql() -> str:
    chain, source = [], "o"
    for name, key, limit in zip(("g", "e", "c"), ("0", "endpoint", "client"), ADMITTED):
        chain.append(_limiter_sql(source, name, key, *limit))
        chain.append(f"{name}r as (select * from {source} semi join (select seq from {name}f where allowed) using (seq))")
        source = f"{name}r"
    calls = RECURSIVE.split(", o as", 1)[0] + ", o as (select user_id as client, event_type as endpoint, ts, seq, event_type <> 'error' as success from ev), " + ", ".join(chain)
    breaker = BREAKER.split("f as (", 1)[1].rsplit("\nselect", 1)[0].replace("client", "endpoint").replace(" o on", " q on").replace("o.", "q.").replace("from o ", "from q ").replace("60000", "3600").replace("cnt >= 2", "cnt >= 3")
    return f"""{calls}, q as (select endpoint, ts, seq, success, row_number() over (partition by endpoint order by ts, seq) as n from cr), f as ({breaker}
select seq, endpoint, client, case when seq not in (select seq from gr) then 'global' when seq not in (select seq from er) then 'endpoint' when seq not in (select seq from cr) then 'client'
  when seq in (select seq from f where not allowed) then 'breaker' end as refused from o"""


def _rules(spark, sf):
    """A rule of each region, with its conditions as rows."""
    k = F.col("r_regionkey").cast("int")
    of = lambda values: F.get(F.array(*(F.lit(v) for v in values)), k)
    rules = X.table(spark, sf, "region").select(k.alias("place"), *(of(v).cast("double").alias(n) for n, v in RULES.items()))
    wanted = X.table(spark, sf, "region").select(k.alias("place"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), of(v).alias("value")) for f, v in CONDITIONS.items()))).alias("x"))
    return rules, wanted.select("place", "x.*").where("value is not null")


#: Of the rule of each region: its limiter, least priority, and what it asks of a request.
RULES = {"rate": [1 / 2000, None, None, 1 / 500, 1 / 9000], "capacity": [5.0, None, None, 10.0, 2.0], "priority": [None, 9.0, 2.0, None, None]}
CONDITIONS = {"endpoint": ["click", "view", None, "click", None], "client": [None, "7", None, None, "35"]}


def policy_rules(spark, sf):
    return C.policy(_requests(spark, sf), *_rules(spark, sf), ["endpoint", "client"])


def _policy_sql() -> str:
    """One rule after the other over what the ones before let through."""
    ctes, source, refused = [], "o", []
    for k in range(5):
        wanted = " and ".join(f"{f} = '{v[k]}'" if f == "endpoint" else f"{f} = {v[k]}" for f, v in CONDITIONS.items() if v[k]) or "true"
        gone = []
        if RULES["rate"][k] is not None:
            ctes.append(_limiter_sql(source, f"l{k}", "0", RULES["rate"][k], RULES["capacity"][k], wanted))
            gone.append(f"seq in (select seq from l{k}f where not allowed)")
        if RULES["priority"][k] is not None:
            gone.append(f"({wanted} and current_priority < {RULES['priority'][k]})")
        ctes.append(f"r{k} as (select * from {source} where not ({' or '.join(gone)}))")
        source = f"r{k}"
        refused.append(f"when seq not in (select seq from r{k}) then {k}")
    calls = RECURSIVE.split(", o as", 1)[0] + ", o as (select user_id as client, event_type as endpoint, ts, seq, seq % 10 as current_priority from ev), " + ", ".join(ctes)
    return f"{calls} select seq, cast(case {' '.join(refused)} end as int) as refused from o"


def queue_capacity(spark, sf):
    ticks = X.events(spark, sf).select(F.col("event_type").alias("topic"), "ts", "seq", F.floor(F.col("ts") / 3600).alias("tick"))
    return C.queue_verdicts(ticks, 5, 2)


QUEUED = f"""{RECURSIVE.split(", o as", 1)[0]}, o as (select event_type as topic, seq, cast(floor(ts/3600) as bigint) as tick, row_number() over (partition by event_type order by ts, seq) as n from ev),
f as (select topic, n, seq, tick, 1::bigint as held, true as accepted from o where n = 1
  union all select topic, n, seq, tick, case when l < 5 then l + 1 else l end, l < 5 from (
    select o.topic, o.n, o.seq, o.tick, greatest(0, f.held - 2*(o.tick - f.tick)) as l from f join o on o.topic = f.topic and o.n = f.n + 1))
select topic, seq, accepted from f"""


def heartbeat_failures(spark, sf):
    beats = X.events(spark, sf).select((F.col("user_id") % 10).alias("node_id"), "ts", "seq")
    return C.heartbeat_failures(beats, 3600.0, 3)


def latency_stats(spark, sf):
    return rounded(M.latency_stats(X.latencies(spark, sf)), "mean", places=4)


def metric_compare(spark, sf):
    stats = M.latency_stats(X.latencies(spark, sf))
    runs = stats.select("run", F.round(F.col("n") / F.col("mean"), 6).alias("throughput"), F.round("mean", 6).alias("mean"), F.round("p99", 6).alias("p99"), (F.col("n") % 7).alias("error_rate"))
    return M.compare(runs)


STATS = """q as (select l_returnflag as run, l_extendedprice/100 as latency_ms from lineitem), s as (
  select run, count(*) as n, avg(latency_ms) as mean, max(latency_ms) as largest, list_sort(list(latency_ms)) as v from q group by run), t as (
  select run, n, mean, largest, v[cast(floor(n*0.95e0) as bigint) + 1] as p95, v[cast(floor(n*0.99e0) as bigint) + 1] as p99 from s)"""


def metric_running_mean(spark, sf):
    return rounded(M.running_mean(X.events(spark, sf), "user_id", "value", "ts", "seq").select("user_id", "seq", "n", "running_mean"), "running_mean", places=9)


def metric_sample_10(spark, sf):
    return rounded(M.every_nth(X.events(spark, sf), "user_id", "value", 10, "ts", "seq").select("user_id", "seq", "n", "running_mean"), "running_mean", places=9)


def throughput_window(spark, sf):
    return rounded(M.throughput(X.events(spark, sf), "time", 3600, "event_type"), "per_second")


def io_rates(spark, sf):
    counters = X.events(spark, sf).withColumn("bytes", F.sum(F.col("event_id") * 1000).over(W.partitionBy("user_id").orderBy("ts", "seq")))
    return rounded(M.io_rates(counters, "user_id", "bytes"), "rate", places=9)


def session_activity(spark, sf):
    return M.sessions(X.events(spark, sf), "user_id", 36000.0)


def staleness_filter(spark, sf):
    newest = X.events(spark, sf).groupBy("user_id").agg(F.max("ts").alias("last_update"))
    return newest.where(F.lit(1706572800.0) - F.col("last_update") <= 36000)


def message_json(spark, sf):
    return S.round_trip(S.of_events(X.events(spark, sf)))


_sum = "sum(value) over (partition by user_id order by ts, seq)"
QUERIES = {
    "task_order": (task_order, f"{TASKS} select task_id, priority, created_at from tasks order by priority desc, created_at, task_id"),
    "pending_task_order": (pending_task_order, f"{TASKS} select task_id, priority, created_at, row_number() over (order by priority desc, created_at, task_id) as place from tasks where status = 'O'"),
    "task_timeouts": (task_timeouts, f"{TASKS} select task_id, created_at, timeout from tasks where {TASK_TIME} - created_at > timeout"),
    "task_assignment": (task_assignment, f"{TASKS}, {ASSIGN} select * from assigned"),
    "task_lifecycle": (task_lifecycle, f"""{TASKS}, {ASSIGN} select task_id, case when status = 'F' then 'completed' when status <> 'O' then 'failed' when {TASK_TIME} - created_at > timeout then 'timed_out' when task_id % 3 = 0 then 'assigned' else 'pending' end as state from tasks"""),
    "node_least_loaded": (node_least_loaded, f"{NODES} select grid, node_id, cpu_usage from nodes where status = 'active' qualify row_number() over (partition by grid order by cpu_usage, node_id) = 1"),
    "active_nodes": (active_nodes, f"{NODES} select grid, count(*) as nodes from nodes where status = 'active' group by grid"),
    "node_load_stats": (node_load_stats, f"{NODES}, s as (select count(*) as nodes, avg(cpu_usage) as cpu_mean, stddev_pop(cpu_usage) as cpu_std, avg(memory_usage) as memory_mean, stddev_pop(memory_usage) as memory_std from nodes) select nodes, {r6('cpu_mean', 'cpu_std', 'memory_mean', 'memory_std')} from s"),
    "node_imbalance": (node_imbalance, f"""{NODES}, m as (select avg(cpu_usage) as c, avg(memory_usage) as m from nodes)
select node_id, case when cpu_usage > 1.2e0*c or memory_usage > 1.2e0*m then 'over' when cpu_usage < 0.8e0*c and memory_usage < 0.8e0*m then 'under' else 'normal' end as class from nodes, m"""),
    "shard_load": (shard_load, f"{NODES}, {B.SHARDS_SQL} select shard_id, node_id, vehicle_count, round(cpu_usage / count(*) over (partition by node_id), 6) + 0e0 as load from shards join nodes using (node_id)"),
    "node_shards": (node_shards, f"with {B.SHARDS_SQL} select node_id, count(*) as shards, cast(sum(vehicle_count) as bigint) as vehicles from shards group by node_id"),
    "shard_reassign": (shard_reassign, f"""{NODES}, {B.SHARDS_SQL}, t as (select node_id as target from nodes where status = 'active' and node_id % 3 <> 0 order by cpu_usage, node_id limit 1)
select shard_id, s.node_id as was, case when n.node_id % 3 = 0 then target else s.node_id end as node_id from shards s left join nodes n using (node_id), t"""),
    "node_registry": (node_registry, f"with {B.KV_SQL}, t as (select * from kv qualify row_number() over (partition by key order by ts desc, seq desc) = 1) select key as node_id, value, ts from t where op = 'put'"),
    "leader_votes": (leader_votes, f"""{EVENTS}, v as (select event_id % 50 as term, user_id % 7 as voter, event_id*31 % 3 as candidate, seq from ev where event_type <> 'error'),
f as (select * from v qualify row_number() over (partition by term, voter order by seq) = 1) select term, candidate, count(*) as votes, count(*)*2 > 7 as leader from f group by term, candidate"""),
    "heartbeat_failures": (heartbeat_failures, f"""{EVENTS}, g as (select user_id % 10 as node_id, seq, ts, lead(ts) over (partition by user_id % 10 order by ts, seq) as recovered_at from ev)
select *, cast(floor((recovered_at - ts)/3600) as bigint) as missed from g where floor((recovered_at - ts)/3600) >= 3"""),
    "token_bucket": (token_bucket, BUCKET),
    "circuit_breaker": (circuit_breaker, BREAKER),
    "adaptive_throttle": (adaptive_throttle, ADAPT),
    "admission_chain": (admission_chain, _admission_sql()),
    "policy_rules": (policy_rules, _policy_sql()),
    "queue_capacity": (queue_capacity, QUEUED),
    "greedy_shards": (greedy_shards, GREEDY),
    "cell_rebalance": (cell_rebalance, REBALANCED),
    "node_rebalance": (node_rebalance, NODE_REBALANCED),
    "region_plan": (region_plan, PLAN),
    "resource_failover": (resource_failover, None),
    "latency_stats": (latency_stats, f"with {STATS} select run, n, round(mean, 4) + 0e0 as mean, largest, p95, p99 from t"),
    "metric_compare": (metric_compare, f"""with {STATS}, u as (select run, round(n/mean, 6) as throughput, round(mean, 6) as mean, round(p99, 6) as p99, n % 7 as error_rate from t)
select arg_max(run, (throughput, run)) as best_throughput, arg_min(run, (mean, run)) as best_mean, arg_min(run, (p99, run)) as best_p99, arg_min(run, (error_rate, run)) as best_error_rate from u"""),
    "metric_running_mean": (metric_running_mean, f"{EVENTS} select user_id, seq, n, round(s/n, 9) + 0e0 as running_mean from (select user_id, seq, count(*) over (partition by user_id order by ts, seq) as n, {_sum} as s from ev)"),
    "metric_sample_10": (metric_sample_10, f"{EVENTS} select user_id, seq, n, round(s/n, 9) + 0e0 as running_mean from (select user_id, seq, count(*) over (partition by user_id order by ts, seq) as n, {_sum} as s from ev) where n % 10 = 0"),
    "throughput_window": (throughput_window, f"{EVENTS} select cast(us // 3600000000 * 3600 as bigint) as start, event_type, count(*) as events, round(count(*)/3600e0, 6) + 0e0 as per_second from ev group by 1, 2"),
    "io_rates": (io_rates, f"""{EVENTS}, c as (select user_id, seq, ts, sum(event_id*1000) over (partition by user_id order by ts, seq) as b from ev), r as (
  select user_id, seq, (b - lag(b) over w)/(nullif(ts - lag(ts) over w, 0)*1048576e0) as rate from c window w as (partition by user_id order by ts, seq)) select user_id, seq, round(rate, 9) + 0e0 as rate from r where rate is not null"""),
    "session_activity": (session_activity, f"""{EVENTS}, s as (select *, case when ts - lag(ts) over w <= 36000 then 0 else 1 end as fresh from ev window w as (partition by user_id order by ts, seq)),
n as (select *, cast(sum(fresh) over (partition by user_id order by ts, seq) as bigint) as session from s) select user_id, session, min(ts) as first, max(ts) as last, count(*) as events from n group by user_id, session"""),
    "staleness_filter": (staleness_filter, f"{EVENTS} select user_id, max(ts) as last_update from ev group by user_id having 1706572800 - max(ts) <= 36000"),
    "message_json": (message_json, f"{EVENTS} select cast(event_id as varchar) as id, event_type as topic, cast(user_id as varchar) as key, cast(json_extract_string(props, '$.k') as bigint) as k, ts from ev"),
}
