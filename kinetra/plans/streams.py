"""Queries that run a stream over the events to its end and return what it wrote."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetra import fixtures as X
from kinetra.operators import kv
from kinetra.plans import base as B
from kinetra.plans import operations
from kinetra.sources import generators as G
from kinetra.sources.scratch import scratch
from kinetra.streaming import requests as RQ
from kinetra.streaming import state as S

EVENTS = f"with {B.EVENTS_SQL}"


@contextlib.contextmanager
def rocksdb(spark):
    """Streams that start inside keep their state in RocksDB, in a part for each core, or 8, at most, as each part costs a Python process and a commit a batch, however few its rows. A stream takes the settings when it starts, so the session has them back at once."""
    parts = "spark.sql.shuffle.partitions"
    settings = {"spark.sql.streaming.stateStore.providerClass": S.ROCKSDB, parts: str(min(int(spark.conf.get(parts)), max(8, spark.sparkContext.defaultParallelism)))}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def drain(stream, mode: str, spark):
    """Run a stream over what is there and return its rows with the number of their batch."""
    folder = scratch(spark)
    with rocksdb(spark):
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .foreachBatch(lambda df, n: df.withColumn("batch_no", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/n={n}"))
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_no", T.IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/out")


def _events(spark, sf):
    raw = spark.readStream.schema(X.table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    ts = F.col("ts").cast("timestamp")
    return raw.select("event_id", F.col("event_id").alias("seq"), (F.unix_micros(ts) / 1e6).alias("ts"), ts.alias("time"), "user_id", "event_type", "value")


def streaming_latest(spark, sf):
    e = _events(spark, sf)
    reports = e.select(F.col("user_id").alias("id"), "ts", "seq", (F.col("event_id") * 7919 % 2000).cast("double").alias("x"), (F.col("event_id") * 104729 % 2003).cast("double").alias("y"))
    return kv.latest(drain(S.latest(reports), "update", spark), "id", "batch_no").drop("batch_no")


def streaming_trajectories(spark, sf):
    e = _events(spark, sf)
    reports = e.select(F.col("user_id").alias("id"), "seq", (F.col("event_id") * 7919 % 2000).cast("double").alias("x"), F.lit(0.0).alias("y"))
    return kv.latest(drain(S.trajectories(reports, 20), "update", spark), "id", "batch_no").drop("batch_no")


def streaming_windows(spark, sf):
    """Windows that the watermark has closed by the end of the stream."""
    return drain(S.windowed_counts(_events(spark, sf), 3600), "append", spark).drop("batch_no")


def streaming_sessions(spark, sf):
    return drain(S.session_counts(_events(spark, sf), "10 hours"), "append", spark).drop("batch_no")


def streaming_token_bucket(spark, sf):
    requests = _events(spark, sf).select(F.col("user_id").alias("client"), "ts", "seq")
    return drain(S.token_bucket(requests, 1 / 40000, 2.0), "append", spark).drop("batch_no")


def streaming_alerts(spark, sf):
    risks = _events(spark, sf).where("event_type <> 'error'").select((F.col("user_id") % 20).alias("vehicle_id"), (F.col("user_id") % 7 + 100).alias("other_vehicle_id"), (F.col("event_id") % 4).cast("int").alias("priority"), "ts")
    acks = _events(spark, sf).where("event_type = 'error'").select((F.col("user_id") % 20).alias("vehicle_id"), (F.col("user_id") % 7 + 100).alias("other_vehicle_id"), "ts")
    return drain(S.alert_updates(risks, acks), "append", spark).drop("batch_no")


def streaming_heartbeats(spark, sf):
    """Nodes rarely miss beats by event time, so intervals are of an hour."""
    beats = _events(spark, sf).select((F.col("user_id") % 10).alias("node_id"), "time")
    return drain(S.node_failures(beats, 3600.0, 3), "append", spark).drop("batch_no")


#: Seconds after which no task or transfer is waited for any longer.
LONGEST = 700


def streaming_tasks(spark, sf):
    """A task of each event, and a result of each that is no error, some of them after the task's timeout."""
    e = _events(spark, sf)
    tasks = e.select(F.col("event_id").alias("task_id"), "time", (60 + F.col("event_id") % 600).alias("timeout"))
    results = _events(spark, sf).where("event_type <> 'error'").select(F.col("event_id").alias("task_id"), F.expr("time + make_dt_interval(0, 0, 0, event_id * 7 % 700)").alias("time"), (F.col("event_type") != "signup").alias("success"))
    return drain(RQ.task_states(tasks, results, LONGEST), "append", spark).drop("batch_no")


def streaming_transfers(spark, sf):
    """A state request of each event; errors are not answered, and some answers come too late."""
    e = _events(spark, sf)
    requests = e.select(F.col("event_id").alias("request_id"), "time", "user_id")
    responses = _events(spark, sf).where("event_type <> 'error'").select(F.col("event_id").alias("request_id"), F.expr("time + make_dt_interval(0, 0, 0, event_id * 11 % 1000)").alias("time"), F.col("event_type").alias("state"))
    return drain(RQ.transfer_states(requests, responses, LONGEST), "append", spark).drop("batch_no")


def sim_step(spark, sf):
    moved = G.move(X.fleet(spark, sf), 1.0, 2003.0, steps=3)
    return B.rounded(moved, *"x y vx vy heading".split()).select("id", "x", "y", "vx", "vy", "ts", "heading")


#: of each row of a pair: the last risk before it, and whether it was acknowledged since
STREAMED_ALERTS = f"""{EVENTS}, r as (select user_id % 20 as vehicle_id, user_id % 7 + 100 as other_vehicle_id, case when event_type = 'error' then 'ack' else 'risk' end as kind, cast(event_id % 4 as int) as priority, ts from ev),
n as (select *, row_number() over (partition by vehicle_id, other_vehicle_id order by ts, kind) as n from r),
p as (select *, max(case when kind = 'risk' then n end) over b as risk_n, max(case when kind = 'ack' then n end) over b as ack_n from n window b as (partition by vehicle_id, other_vehicle_id order by n rows between unbounded preceding and 1 preceding)),
q as (select p.*, l.ts as risk_ts, l.priority as risk_priority from p left join n l on l.vehicle_id = p.vehicle_id and l.other_vehicle_id = p.other_vehicle_id and l.n = p.risk_n),
k as (select *, risk_ts is not null and ts - risk_ts <= 30 as held from q),
x as (select a.vehicle_id, a.other_vehicle_id, a.priority, a.ts from n a where kind = 'risk' and not exists (
  select 1 from n c where c.vehicle_id = a.vehicle_id and c.other_vehicle_id = a.other_vehicle_id and c.n > a.n and c.ts - a.ts <= 30) and (
  exists (select 1 from n c where c.vehicle_id = a.vehicle_id and c.other_vehicle_id = a.other_vehicle_id and c.n > a.n) or a.ts + 30 <= (select max(ts) - 30 from n)))
select vehicle_id, other_vehicle_id, case when kind = 'ack' then 'acknowledged' when not held or ack_n > risk_n then 'raised' else 'updated' end as event, case when kind = 'ack' then risk_priority else priority end as priority, ts
from k where kind = 'risk' or held union all select vehicle_id, other_vehicle_id, 'expired', priority, ts + 30 from x"""

QUERIES = {
    "streaming_tasks": (streaming_tasks, f"""{EVENTS}, a as (select event_id as task_id, us, 60 + event_id % 600 as timeout, event_type, case when event_type <> 'error' then event_id * 7 % 700 end as after from ev),
w as (select least(max(us), max(us + after * 1000000)) - 30000000 as mark from a)
select task_id, case when after is null or after > timeout then 'timed_out' when event_type <> 'signup' then 'completed' else 'failed' end as state from a, w where after is not null or us + {LONGEST}000000 < mark"""),
    "streaming_transfers": (streaming_transfers, f"""{EVENTS}, a as (select event_id as request_id, us, user_id, event_type, case when event_type <> 'error' then event_id * 11 % 1000 end as after from ev),
w as (select least(max(us), max(us + after * 1000000)) - 30000000 as mark from a)
select request_id, user_id, case when after <= {LONGEST} then event_type end as state, coalesce(after <= {LONGEST}, false) as answered from a, w where after <= {LONGEST} or us + {LONGEST}000000 < mark"""),
    "streaming_latest": (streaming_latest, f"{EVENTS} select user_id as id, ts, seq, cast(event_id*7919 % 2000 as double) as x, cast(event_id*104729 % 2003 as double) as y from ev qualify row_number() over (partition by user_id order by ts desc, seq desc) = 1"),
    "streaming_trajectories": (streaming_trajectories, f"{EVENTS}, t as (select user_id, seq, row_number() over (partition by user_id order by seq desc) as back from ev) select user_id as id, cast(count(*) as int) as points, min(seq) as oldest from t where back <= 20 group by user_id"),
    "streaming_windows": (streaming_windows, f"""{EVENTS}, w as (select cast(us // 3600000000 * 3600 as bigint) as start, event_type, count(*) as events, round(sum(value), 6) + 0e0 as total from ev group by 1, 2)
select * from w where start + 3600 <= (select max(ts) - 30 from ev)"""),
    "streaming_sessions": (streaming_sessions, f"""{EVENTS}, s as (select *, case when ts - lag(ts) over w < 36000 then 0 else 1 end as fresh from ev window w as (partition by user_id order by ts, seq)),
n as (select *, sum(fresh) over (partition by user_id order by ts, seq) as session from s), g as (select user_id, session, min(ts) as a, max(ts) as b, count(*) as events from n group by all)
select user_id, cast(floor(a) as bigint) as start, events from g where b + 36000 <= (select max(ts) - 30 from ev)"""),
    "streaming_token_bucket": (streaming_token_bucket, operations.BUCKET),
    "streaming_alerts": (streaming_alerts, STREAMED_ALERTS),
    "streaming_heartbeats": (streaming_heartbeats, f"""{EVENTS}, b as (select user_id % 10 as node_id, us // 1000 as ms, lag(us // 1000) over (partition by user_id % 10 order by us) as was from ev),
late as (select * from b where ms - was >= 10800000), ends as (select node_id, max(ms) as ms from b group by node_id having max(ms) + 10800000 <= (select max(ms) - 30000 from b))
select node_id, 'failed' as event, was + 10800000 as ms from late union all select node_id, 'recovered', ms from late union all select node_id, 'failed', ms + 10800000 from ends"""),
    "sim_step": (sim_step, None),
}
