"""Helpers of the query registry: rounding, and SQL text shared by the DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = "x y z vx vy vz ax ay az heading size type ts".split()


def _round(name: str, places: int) -> Column:
    """A double to so many decimals, half away from zero: as arithmetic, as the SQL has it; F.round() makes a decimal number of each value by way of its text."""
    shifted = F.abs(name) * 10.0**places
    # beyond 2^52 there are no fractions, and what is not a number stays as it is
    near = F.signum(name) * F.floor(shifted + 0.5) / 10.0**places
    return F.when(shifted < 2.0**52, near).otherwise(F.col(name))


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    # adding zero turns -0.0 into 0.0
    types = dict(df.dtypes)
    return df.withColumns({n: (_round(n, places) if types[n] == "double" else F.round(n, places)) + F.lit(0.0) for n in names})


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0e0 as {n}" for n in names)


def fleet_sql(source: str = "customer", key: str = "c_custkey", name: str = "fleet") -> str:
    return f"""{name} as (
  select k as id, cast(k * 7919 % 2000 as double) as x, cast(k * 104729 % 2003 as double) as y, 0e0 as z,
    cast(k * 31 % 41 - 20 as double) as vx, cast(k * 17 % 37 - 18 as double) as vy, 0e0 as vz,
    (k * 13 % 5 - 2) * 0.5e0 as ax, (k * 29 % 5 - 2) * 0.5e0 as ay, 0e0 as az, cast(k * 11 % 628 as double) / 100 as heading,
    [2e0, 4e0, 5e0, 1e0][k % 4 + 1] as size, ['car', 'truck', 'bus', 'motorcycle'][k % 4 + 1] as type, 0e0 as ts
  from (select {key} as k from {source}))"""


EVENTS_SQL = """ev as (
  select event_id, event_id as seq, epoch_us(ts) as us, epoch_us(ts) / 1e6 as ts, ts as time, user_id, event_type, value, props from events)"""

TRACKS_SQL = (
    EVENTS_SQL
    + """, tracks as (
  select user_id as id, seq, ts, cast(event_id * 7919 % 2000 as double) as x, cast(event_id * 104729 % 2003 as double) as y, 0e0 as z,
    cast(event_id * 31 % 41 - 20 as double) as vx, cast(event_id * 17 % 37 - 18 as double) as vy, 0e0 as vz,
    cast(event_id * 11 % 628 as double) / 100 as heading, ['car', 'truck', 'bus', 'motorcycle'][user_id % 4 + 1] as type
  from ev)"""
)

NODES_SQL = """nodes as (
  select s_suppkey as node_id, (s_suppkey * 37 % 100) / 100e0 as cpu_usage, (s_suppkey * 53 % 100) / 100e0 as memory_usage,
    case when s_suppkey % 5 = 0 then 'inactive' else 'active' end as status, s_suppkey % 4 as grid from supplier)"""

SHARDS_SQL = """shards as (
  select cast(n_nationkey as bigint) as shard_id, n_nationkey % (select count(*) from supplier) as node_id, cast(n_nationkey * 97 % 50 as bigint) as vehicle_count from nation)"""

TASKS_SQL = """tasks as (
  select o_orderkey as task_id, 100 - 20 * cast(substr(o_orderpriority, 1, 1) as int) as priority,
    cast(epoch(cast(o_orderdate as date)) as bigint) + o_orderkey % 86400 as created_at, 60 + o_orderkey % 600 as timeout,
    o_custkey % 4 as grid, case when o_orderstatus = 'F' then 'collision_detection' else 'vehicle_count' end as task_type, o_orderstatus as status
  from orders)"""

KV_SQL = (
    EVENTS_SQL
    + """, kv as (
  select user_id as key, value, ts, seq, case when event_type = 'error' then 'delete' else 'put' end as op, event_id % 3 as source_node, 3600e0 as ttl from ev)"""
)


def norm_sql(x: str, y: str, z: str) -> str:
    return f"sqrt(({x})*({x}) + ({y})*({y}) + ({z})*({z}))"


def at_sql(side: str, c: str, t: str) -> str:
    return f"({side}_{c} + {side}_v{c}*({t}) + 0.5e0*{side}_a{c}*({t})*({t}))"


def dist_at_sql(t: str) -> str:
    return norm_sql(*(f"{at_sql('s', c, t)} - {at_sql('o', c, t)}" for c in "xyz"))


SAFE_SQL = "((s_size + o_size) / 2 + 5)"


def pairs_sql(where: str, left: str = "fleet", right: str = "fleet", extra_left: tuple[str, ...] = ()) -> str:
    cols = ", ".join(f"{a}.{c} as {a}_{c}" for a in "so" for c in ["id", *COLUMNS])
    cols += "".join(f", s.{c} as s_{c}" for c in extra_left)
    d = norm_sql("s.x - o.x", "s.y - o.y", "s.z - o.z")
    return f"""pairs as (
  select * from (select {cols}, {d} as dist from {left} s join {right} o on s.id <> o.id and abs(s.x - o.x) <= 200 and abs(s.y - o.y) <= 200) where {where})"""


def closing_sql() -> str:
    return """closing as (
  select *, sqrt(wx*wx + wy*wy + wz*wz) as speed, rx*wx + ry*wy + rz*wz as approach from (
    select *, s_vx - o_vx as wx, s_vy - o_vy as wy, s_vz - o_vz as wz, o_x - s_x as rx, o_y - s_y as ry, o_z - s_z as rz from pairs))"""


def temporal_sql(approach: str = "corrected") -> str:
    sign, extra = ("", "") if approach == "corrected" else ("-", " and not (approach > 0 and dist > 5)")
    return f"""{closing_sql()}, timed as (
  select *, {sign}approach / nullif(speed*speed, 0) as t_closest from closing where speed >= 0.1e0{extra}
), close as (
  select * from (select *, {dist_at_sql("t_closest")} as d_closest from timed where t_closest >= 0 and t_closest <= 10) where d_closest <= {SAFE_SQL})"""


def probe_sql(source: str, steps: int, key: str = "s_id, o_id") -> str:
    d = dist_at_sql("k*0.1e0")
    return f"""probed as (
  select * from (
    select *, k as hit_k, k*0.1e0 as ttc, row_number() over (partition by {key} order by k) as rn from (
      select p.*, g.k, {d} as hit_distance from {source} p, range(0, {steps}) as g(k)) where hit_distance <= {SAFE_SQL}) where rn = 1)"""


RISK_SQL = f"""greatest(0e0, least(1e0, 0.3e0*(1 - hit_distance/{SAFE_SQL}) + 0.3e0*(1 - least(1e0, ttc/10)) + 0.2e0*least(1e0, speed/50)
    + 0.1e0*sin(abs(s_heading - o_heading)) + 0.1e0*case when s_type = o_type then 0.5e0 else 0.8e0 end))"""


def risks_sql(source: str = "probed", offset: str = "") -> str:
    mid = ", ".join(f"({at_sql('s', c, 'ttc')} + {at_sql('o', c, 'ttc')})/2 as c{c}" for c in "xyz")
    return f"""risks as (
  select s_id as vehicle_id, o_id as other_vehicle_id, ttc{offset} as time_to_collision, hit_distance as distance, speed as relative_speed, {RISK_SQL} as risk_level, {mid} from {source})"""
