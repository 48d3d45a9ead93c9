"""Queries of joins, detection, kinematics and trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetra import fixtures as X
from kinetra.functions import alerts as A
from kinetra.functions import kinematics as KN
from kinetra.operators import detect as D
from kinetra.operators import trajectory as T
from kinetra.operators.spatial import prefixed
from kinetra.plans import base as B
from kinetra.plans.base import r6, rounded

RISK = ["time_to_collision", "distance", "relative_speed", "risk_level", "cx", "cy", "cz"]
PAIRS = f"with {B.fleet_sql()}, {B.pairs_sql('dist <= 100')}"


def radius_join(spark, sf):
    return rounded(D.nearby(X.fleet(spark, sf)).select(F.col("s_id").alias("vehicle_id"), F.col("o_id").alias("other_id"), "dist"), "dist")


def radius_join_sized(spark, sf):
    return rounded(D.nearby_sized(X.fleet(spark, sf), 50.0).select(F.col("s_id").alias("vehicle_id"), F.col("o_id").alias("other_id"), "dist"), "dist")


def contact_pairs(spark, sf):
    return rounded(D.contacts(X.fleet(spark, sf)), "distance")


def contact_prediction(spark, sf):
    return rounded(D.time_to_contact(X.fleet(spark, sf)), "time_to_contact")


def _temporal(approach):
    def run(spark, sf):
        found = D.temporal_filter(D.nearby(X.fleet(spark, sf)), approach=approach)
        return rounded(found.select(F.col("s_id").alias("vehicle_id"), F.col("o_id").alias("other_id"), "speed", "t_closest", "d_closest"), "speed", "t_closest", "d_closest")

    return run


def precise_probe(spark, sf):
    found = D.probe(D.temporal_filter(D.nearby(X.fleet(spark, sf))))
    return rounded(found.select(F.col("s_id").alias("vehicle_id"), F.col("o_id").alias("other_id"), "hit_k", "ttc", "hit_distance"), "ttc", "hit_distance")


def _risks(approach):
    def run(spark, sf):
        return rounded(D.detect(X.fleet(spark, sf), approach=approach).select("vehicle_id", "other_vehicle_id", *RISK), *RISK)

    return run


def _risks_sql(approach):
    return f"{PAIRS}, {B.temporal_sql(approach)}, {B.probe_sql('close', 100)}, {B.risks_sql()} select vehicle_id, other_vehicle_id, {r6(*RISK)} from risks"


def lookahead_risks(spark, sf):
    found = D.lookahead(X.fleet(spark, sf).withColumn("history", F.lit(2)), threshold=0.1)
    return rounded(found.select("vehicle_id1", "vehicle_id2", "risk_level", "time_to_collision", "relative_velocity", "px", "py"), "risk_level", "time_to_collision", "relative_velocity", "px", "py")


_F = {c: [f"(s_{c} + s_v{c}*5e0)", f"(o_{c} + o_v{c}*5e0)"] for c in "xyz"}
LOOKAHEAD = f"""{PAIRS}, f as (
  select *, {B.norm_sql(*(f"{a} - {b}" for a, b in _F.values()))} as future, {B.norm_sql("s_vx - o_vx", "s_vy - o_vy", "s_vz - o_vz")} as speed from pairs where dist <= 50
), g as (select *, least(1e0, 4e0 / greatest(0.1e0, future) * speed / 10) as risk_level from f where not (future > dist and dist > 4)
), h as (select s_id as vehicle_id1, o_id as vehicle_id2, risk_level, case when future < 4 and dist > future then greatest(0.1e0, 5e0*(dist - 4)/(dist - future)) else 5e0 end as time_to_collision,
  speed as relative_velocity, ({_F["x"][0]} + {_F["x"][1]})/2 as px, ({_F["y"][0]} + {_F["y"][1]})/2 as py from g where risk_level >= 0.1e0)
select vehicle_id1, vehicle_id2, {r6("risk_level", "time_to_collision", "relative_velocity", "px", "py")} from h"""


def merge_risks(spark, sf):
    fleet = X.fleet(spark, sf)
    risks = rounded(D.detect(fleet), "risk_level", "time_to_collision")
    # a pair's two rows are the same but for their sides: where ids are distinct, nothing has to be sorted to tell the first
    found = risks.where("vehicle_id < other_vehicle_id") if D.distinct_ids(fleet) else D.merge(risks, "global")
    return found.select("vehicle_id", "other_vehicle_id", "risk_level", "time_to_collision")


MERGE = f"""{PAIRS}, {B.temporal_sql()}, {B.probe_sql("close", 100)}, {B.risks_sql()}, m as (select vehicle_id, other_vehicle_id, {r6("risk_level", "time_to_collision")} from risks)
select * from m qualify row_number() over (partition by least(vehicle_id, other_vehicle_id), greatest(vehicle_id, other_vehicle_id) order by risk_level desc, time_to_collision, vehicle_id) = 1"""


def patterned_fleet(spark, sf):
    """The fleet with a motion pattern by id."""
    return X.fleet(spark, sf).withColumn("pattern", F.get(F.array(*map(F.lit, ["stationary", "constant_velocity", "accelerating"])), (F.col("id") % 3).cast("int")))


PATTERNED = "pfleet as (select *, ['stationary', 'constant_velocity', 'accelerating'][id % 3 + 1] as pattern from fleet)"
POINTS = (
    PATTERNED
    + """, points as (
  select * replace (case pattern when 'stationary' then x when 'constant_velocity' then x + vx*off else x + vx*off + 0.5e0*ax*off*off end as x,
    case pattern when 'stationary' then y when 'constant_velocity' then y + vy*off else y + vy*off + 0.5e0*ay*off*off end as y, ts + off as ts)
  from (select *, k as step, k*0.5e0 as off from pfleet, range(0, 20) as g(k)))"""
)


def predicted_collisions(spark, sf):
    found = T.predict_fleet(patterned_fleet(spark, sf))
    return rounded(found.select("vehicle_id", "other_vehicle_id", "risk_level", F.lit(True).alias("is_predicted")), "risk_level")


_MOVED = "* replace (" + ", ".join(f"o_{c} + o_v{c}*s_off + 0.5e0*o_a{c}*s_off*s_off as o_{c}" for c in "xyz") + ")"
PREDICTED = f"""with {B.fleet_sql()}, {POINTS}, {B.pairs_sql("dist <= 100", "points", "fleet", ("off", "step"))}, moved as (
  select *, {B.norm_sql("s_vx - o_vx", "s_vy - o_vy", "s_vz - o_vz")} as speed from (select {_MOVED} from pairs)
), {B.probe_sql("moved", 10, "s_id, o_id, s_step")}, {B.risks_sql("probed", " + s_off")}
select vehicle_id, other_vehicle_id, round(max(risk_level), 6) + 0e0 as risk_level, true as is_predicted from risks group by all"""


def future_trajectory(spark, sf):
    points = T.future_points(patterned_fleet(spark, sf))
    return rounded(points.select("id", "step", "offset", "pattern", "x", "y"), "x", "y")


def _paced(spark, sf):
    """Tracks with one report a second, so that speeds differ."""
    from pyspark.sql import Window as W

    return X.tracks(spark, sf).withColumn("t", F.row_number().over(W.partitionBy("id").orderBy("seq")).cast("double")).withColumn("x", F.col("id") % 3 * F.col("t") * (1 + F.col("t") * (F.col("id") % 2) / 10)).withColumn("y", F.lit(0.0))


PACED = f"""with {B.TRACKS_SQL}, paced as (
  select id, seq, t, (id % 3)*t*(1 + t*(id % 2)/10) as x, 0e0 as y, 0e0 as z from (select *, cast(row_number() over (partition by id order by seq) as double) as t from tracks)
), steps as (
  select id, t, seq, (x - lag(x) over w)/nullif(t - lag(t) over w, 0) as vx, (y - lag(y) over w)/nullif(t - lag(t) over w, 0) as vy, t - lag(t) over w as dt from paced window w as (partition by id order by t, seq)
), vel as (select id, t, seq, vx, vy from steps where dt > 0
), acc as (select *, (vx - lag(vx) over w)/nullif(t - lag(t) over w, 0) as ax, (vy - lag(vy) over w)/nullif(t - lag(t) over w, 0) as ay from vel window w as (partition by id order by t, seq))"""


def trajectory_velocity(spark, sf):
    return rounded(T.accelerations(_paced(spark, sf)).select("id", "seq", "vx", "vy", "ax", "ay"), "vx", "vy", "ax", "ay")


def trajectory_pattern(spark, sf):
    return rounded(T.patterns(_paced(spark, sf)), "avg_speed", "avg_acceleration")


PATTERN = f"""{PACED}, a as (select id, avg(vx) as vx, avg(vy) as vy, avg(ax) as ax, avg(ay) as ay from acc group by id), n as (select id, count(*) as points from paced group by id),
m as (select id, points, sqrt(coalesce(vx,0)*coalesce(vx,0) + coalesce(vy,0)*coalesce(vy,0)) as avg_speed, sqrt(coalesce(ax,0)*coalesce(ax,0) + coalesce(ay,0)*coalesce(ay,0)) as avg_acceleration from n left join a using (id))
select id, points, {r6("avg_speed", "avg_acceleration")}, case when points < 2 then 'unknown' when avg_speed < 0.1e0 then 'stationary' when avg_acceleration < 0.1e0 then 'constant_velocity' else 'accelerating' end as pattern from m"""


def kinematics(spark, sf):
    u = KN.normalized("v")
    p = KN.position_at(F.lit(2.5))
    out = X.fleet(spark, sf).select("id", KN.magnitude("v").alias("speed"), u[0].alias("ux"), u[1].alias("uy"), p[0].alias("px"), p[1].alias("py"), KN.position_at(F.lit(5.0), accelerate=False)[0].alias("lx"))
    return rounded(out, "speed", "ux", "uy", "px", "py", "lx")


KINEMATICS = f"""with {B.fleet_sql()}, m as (select id, sqrt(vx*vx + vy*vy) as speed, coalesce(vx/nullif(sqrt(vx*vx + vy*vy), 0), 0) as ux, coalesce(vy/nullif(sqrt(vx*vx + vy*vy), 0), 0) as uy,
  x + vx*2.5e0 + 0.5e0*ax*2.5e0*2.5e0 as px, y + vy*2.5e0 + 0.5e0*ay*2.5e0*2.5e0 as py, x + vx*5e0 as lx from fleet)
select id, {r6("speed", "ux", "uy", "px", "py", "lx")} from m"""


def pair_kinematics(spark, sf):
    pairs = D.closing(D.nearby(X.fleet(spark, sf), 50.0))
    m = D.midpoint(F.lit(1.0))
    out = pairs.select(F.col("s_id").alias("vehicle_id"), F.col("o_id").alias("other_id"), "speed", "approach", KN.distance_at(F.lit(1.0)).alias("d1"), KN.safe_distance().alias("safe"), KN.type_factor().alias("factor"), m[0].alias("mx"), m[1].alias("my"))
    return rounded(out, "speed", "approach", "d1", "mx", "my")


PAIR_KINEMATICS = f"""with {B.fleet_sql()}, {B.pairs_sql("dist <= 50")}, {B.closing_sql()}, m as (select s_id as vehicle_id, o_id as other_id, speed, approach, {B.dist_at_sql("1e0")} as d1, {B.SAFE_SQL} as safe,
  case when s_type = o_type then 0.5e0 else 0.8e0 end as factor, ({B.at_sql("s", "x", "1e0")} + {B.at_sql("o", "x", "1e0")})/2 as mx, ({B.at_sql("s", "y", "1e0")} + {B.at_sql("o", "y", "1e0")})/2 as my from closing)
select vehicle_id, other_id, {r6("speed", "approach", "d1", "mx", "my")}, safe, factor from m"""


def flagship(spark, sf, source="orders", key="o_orderkey"):
    """Who is about to collide, and how urgent is it: alerts in order of urgency."""
    risks = D.merge(D.detect(X.fleet(spark, sf, source, key))).where(F.col("risk_level") >= 0.3)
    p = A.priority(F.col("risk_level"), F.col("time_to_collision"))
    out = risks.withColumn("priority", p).withColumn("message", A.message(F.col("risk_level"), F.col("other_vehicle_id"), F.col("time_to_collision"), F.col("distance")))
    return out.select("vehicle_id", "other_vehicle_id", "priority", "risk_level", "time_to_collision", "message").orderBy(F.desc("priority"), "time_to_collision", "vehicle_id", "other_vehicle_id")


_two = "s_id as vehicle_id, o_id as other_id"
QUERIES = {
    "radius_join": (radius_join, f"{PAIRS} select {_two}, {r6('dist')} from pairs"),
    "radius_join_sized": (radius_join_sized, f"with {B.fleet_sql()}, {B.pairs_sql('dist <= 50 + o_size')} select {_two}, {r6('dist')} from pairs"),
    "contact_pairs": (contact_pairs, f"with {B.fleet_sql()}, {B.pairs_sql('dist < s_size + o_size')} select s_id as vehicle_id, o_id as other_vehicle_id, round(dist, 6) + 0e0 as distance from pairs"),
    "contact_prediction": (contact_prediction, f"with {B.fleet_sql()}, {B.pairs_sql('dist <= 10*s_size + o_size and dist - s_size - o_size >= 0 and (dist - s_size - o_size)/12.5e0 <= 5')} select s_id as vehicle_id, o_id as other_vehicle_id, round((dist - s_size - o_size)/12.5e0, 6) + 0e0 as time_to_contact from pairs"),
    "temporal_filter": (_temporal("corrected"), f"{PAIRS}, {B.temporal_sql()} select {_two}, {r6('speed', 't_closest', 'd_closest')} from close"),
    "temporal_filter_literal": (_temporal("literal"), f"{PAIRS}, {B.temporal_sql('literal')} select {_two}, {r6('speed', 't_closest', 'd_closest')} from close"),
    "precise_probe": (precise_probe, f"{PAIRS}, {B.temporal_sql()}, {B.probe_sql('close', 100)} select {_two}, cast(hit_k as int) as hit_k, {r6('ttc', 'hit_distance')} from probed"),
    "collision_risks": (_risks("corrected"), _risks_sql("corrected")),
    "collision_risks_literal": (_risks("literal"), _risks_sql("literal")),
    "lookahead_risks": (lookahead_risks, LOOKAHEAD),
    "merge_risks": (merge_risks, MERGE),
    "predicted_collisions": (predicted_collisions, PREDICTED),
    "future_trajectory": (future_trajectory, f"with {B.fleet_sql()}, {POINTS} select id, cast(step as int) as step, off as offset, pattern, {r6('x', 'y')} from points"),
    "trajectory_velocity": (trajectory_velocity, f"{PACED} select id, seq, {r6('vx', 'vy', 'ax', 'ay')} from acc"),
    "trajectory_pattern": (trajectory_pattern, PATTERN),
    "kinematics": (kinematics, KINEMATICS),
    "pair_kinematics": (pair_kinematics, PAIR_KINEMATICS),
}
