"""Trajectories: successive differences, motion patterns, future points and predicted collisions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra import constants as K
from kinetra.functions import kinematics as KN
from kinetra.operators import detect as D
from kinetra.operators.blocks import reach_pairs
from kinetra.operators.spatial import box_pairs, prefixed


def last_n(history: DataFrame, n: int, key: str = "id", order: str = "seq") -> DataFrame:
    """The last n rows of each key in arrival order."""
    return history.withColumn("_back", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_back") <= n).drop("_back")


def velocities(history: DataFrame) -> DataFrame:
    """Velocity between neighbouring reports of one vehicle (id, t, seq, x, y, z), where time passed."""
    w = W.partitionBy("id").orderBy("t", "seq")
    dt = F.col("t") - F.lag("t").over(w)
    steps = history.select("id", "t", "seq", dt.alias("dt"), *((F.col(c) - F.lag(c).over(w)).alias(f"d{c}") for c in "xyz"))
    return steps.where("dt > 0").select("id", "t", "seq", *(F.try_divide(F.col(f"d{c}"), F.col("dt")).alias(f"v{c}") for c in "xyz"))


def accelerations(history: DataFrame) -> DataFrame:
    """Velocity and, from the second velocity on, the change against the velocity before it."""
    w = W.partitionBy("id").orderBy("t", "seq")
    v = velocities(history)
    dt = F.col("t") - F.lag("t").over(w)
    return v.select("*", *(F.try_divide(F.col(f"v{c}") - F.lag(f"v{c}").over(w), F.when(dt > 0, dt)).alias(f"a{c}") for c in "xyz"))


def patterns(history: DataFrame) -> DataFrame:
    """stationary, constant_velocity or accelerating for each vehicle with two reports or more; no step in time is stationary."""
    a = accelerations(history).groupBy("id").agg(*(F.avg(f"v{c}").alias(f"v{c}") for c in "xyz"), *(F.avg(f"a{c}").alias(f"a{c}") for c in "xyz"))
    counts = history.groupBy("id").agg(F.count("*").alias("points"))
    out = counts.join(a, "id", "left").na.fill(0.0)
    speed, change = KN.magnitude("v"), KN.magnitude("a")
    kind = F.when(speed < K.STATIONARY_SPEED, "stationary").when(change < K.CONSTANT_ACCELERATION, "constant_velocity").otherwise("accelerating")
    return out.select("id", "points", speed.alias("avg_speed"), change.alias("avg_acceleration"), F.when(F.col("points") >= 2, kind).otherwise("unknown").alias("pattern"))


def _moved(c: str, t: Column, prefix: str = "") -> Column:
    """A coordinate at a time by the vehicle's pattern; velocity is not advanced."""
    i, kind = "xyz".index(c), F.col(f"{prefix}pattern")
    linear, full = KN.position_at(t, prefix, accelerate=False)[i], KN.position_at(t, prefix)[i]
    return F.when(kind == "stationary", F.col(f"{prefix}{c}")).when(kind == "constant_velocity", linear).otherwise(full)


def future_points(fleet: DataFrame, horizon: float = K.PREDICTION_HORIZON, step: float = K.PREDICTION_STEP) -> DataFrame:
    """Positions at 0, step, … below the horizon, by the vehicle's pattern; velocity is not advanced."""
    rows = fleet.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(int(horizon / step) - 1)))).withColumn("offset", F.col("step") * F.lit(step))
    return rows.withColumns({f"n{c}": _moved(c, F.col("offset")) for c in "xyz"}).drop(*"xyz").withColumnsRenamed({f"n{c}": c for c in "xyz"}).withColumn("ts", F.col("ts") + F.col("offset"))


def predict(fleet: DataFrame, radius: float = K.SEARCH_RADIUS, window: float = K.PREDICTION_WINDOW, scope: str = "subject", subjects: DataFrame | None = None, horizon: float = K.PREDICTION_HORIZON, step: float = K.PREDICTION_STEP) -> DataFrame:
    """Risks along predicted trajectories, the highest of each pair.

    Others are sought around each predicted point by their current position
    and moved to the point's time before the probe. The join meets a pair
    once, on the box that a vehicle's points can cover; the steps of a pair
    are unfolded after it. subjects: the part of the fleet to predict.
    """
    subjects = (fleet if subjects is None else subjects).where("pattern <> 'unknown'")
    motion = ["id", *"xyz", *(f"{k}{c}" for k in "va" for c in "xyz"), "heading", "size", "type", "ts"]
    # the motion that a pattern takes part in: none, by velocity, or by velocity and acceleration
    part = {f"mv{c}": F.when(F.col("pattern") == "stationary", 0.0).otherwise(F.col(f"v{c}")) for c in "xyz"} | {f"ma{c}": F.when(F.col("pattern") == "accelerating", F.col(f"a{c}")).otherwise(0.0) for c in "xyz"}
    s, o = prefixed(subjects.select(*motion, *(v.alias(k) for k, v in part.items())), "s_"), prefixed(fleet.select(*motion), "o_")
    last, box = horizon - step, {}
    for c in "xy":
        low, high = (f"s_{c} + {f}(s_mv{c} * {last!r}D, 0D) + {f}(s_ma{c} * {0.5 * last * last!r}D, 0D)" for f in ("least", "greatest"))
        box[c] = f"{low} - {float(radius)!r}D", f"{high} + {float(radius)!r}D"
    keep = "s_id <> o_id and " + " and ".join(f"o_{c} between {low} and {high}" for c, (low, high) in box.items())
    pairs = box_pairs(s, o, box, {c: (f"o_{c}", f"o_{c}") for c in "xy"}, radius, keep)
    # what all steps of a pair share is computed before they are unfolded
    pairs = pairs.withColumns({"speed": KN.norm(*KN.relative_velocity()), "change": KN.norm(*(F.col(f"s_a{c}") - F.col(f"o_a{c}") for c in "xyz"))})
    pairs = pairs.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(int(horizon / step) - 1)))).withColumn("s_offset", F.col("step") * F.lit(step))
    t = F.col("s_offset")
    there = [F.col(f"s_{c}") + F.col(f"s_mv{c}") * t + F.lit(0.5) * F.col(f"s_ma{c}") * t * t for c in "xyz"]
    near = KN.norm(*(F.col(f"o_{c}") - p for c, p in zip("xyz", there))) <= radius
    pairs = D.staged(pairs, "moved", F.struct(*(p.alias(f"s_{c}") for c, p in zip("xyz", there)), *(p.alias(f"o_{c}") for c, p in zip("xyz", KN.position_at(t, "o_")))), near)
    pairs = pairs.drop(*(f"{p}_{c}" for p in "so" for c in "xyz"), *(f"s_{k}" for k in part)).select("*", "moved.*").drop("moved").withColumn("s_ts", F.col("s_ts") + t)
    # the cheap bound of a whole window, from its middle, comes before the probe of its steps
    reachable = KN.distance_at(F.lit(window / 2)) - (F.col("speed") + F.col("change") * window) * (window / 2) <= KN.safe_distance() + 1e-6
    return D.merge(D.score(D.probe(pairs.where(reachable), window), t), scope)


#: Steps of a path that a tile is tested by together.
TOGETHER = 4


def predict_fleet(fleet: DataFrame, radius: float = K.SEARCH_RADIUS, window: float = K.PREDICTION_WINDOW, subjects: DataFrame | None = None, horizon: float = K.PREDICTION_HORIZON, step: float = K.PREDICTION_STEP) -> DataFrame:
    """The risks of predict(), term for term, for many subjects: rows meet in blocks, and a pair's steps are judged where its rows meet, so that only its highest risk is handed on."""
    subjects = (fleet if subjects is None else subjects).where("pattern <> 'unknown'")
    last, axes = horizon - step, KN.AXES
    steps = [k * step for k in range(int(horizon / step))]
    spans = [steps[i : i + TOGETHER] for i in range(0, len(steps), TOGETHER)]
    # the motion that a pattern takes part in, as in predict()
    part = {f"mv{c}": F.when(F.col("pattern") == "stationary", 0.0).otherwise(F.col(f"v{c}")) for c in axes} | {f"ma{c}": F.when(F.col("pattern") == "accelerating", F.col(f"a{c}")).otherwise(0.0) for c in axes}
    # both halves of a hash of the type, as numbers
    kind = {"t1": F.when(F.col("type").isNotNull(), F.shiftright(F.xxhash64("type"), 32).cast("double")), "t2": F.xxhash64("type").bitwiseAND(0xFFFFFFFF).cast("double")}
    own = [*(f"{k}{c}" for k in "va" for c in axes), "size", "heading", "ts"]
    s = subjects.select("id", *own, *(F.col(c).alias(f"p{c}") for c in axes), *(v.alias(k) for k, v in (part | kind).items()))
    # a path lies around the middle of its chord, no further off than half of it and what it sags
    way = {c: f"(mv{c} * {last!r}D + ma{c} * {0.5 * last * last!r}D)" for c in axes}
    s = s.selectExpr("*", *(f"p{c} + {way[c]} / 2 as {c}" for c in axes))
    norm = lambda names: "sqrt(" + " + ".join(f"{n} * {n}" for n in names) + ")"
    reach = f"{float(radius)!r}D + {norm(way.values())} / 2 + {norm([f'ma{c}' for c in axes])} * {last * last / 8!r}D + 1e-6D"
    o = fleet.select("id", *axes, *own, *(v.alias(k) for k, v in kind.items()))

    def derived(p: str, v: str, a: str, base: float):
        """Of each span of steps the place in its middle, half a window on, and how far from there a row may be within it, with its share of the safe distance."""

        def run(m):
            out, half = {}, window / 2
            fast, pull, there, change = (np.sqrt(sum(m[f"{k}{c}"] ** 2 for c in axes)) for k in ("v", "a", v, a))
            for j, span in enumerate(spans):
                middle, off = (span[0] + span[-1]) / 2, (span[-1] - span[0]) / 2
                for c in axes:
                    out[f"{c}{j}"] = m[f"{p}{c}"] + m[f"{v}{c}"] * middle + 0.5 * m[f"{a}{c}"] * middle * middle + m[f"v{c}"] * half + 0.5 * m[f"a{c}"] * half * half
                out[f"r{j}"] = off * (there + change * span[-1]) + half * (fast + pull * window) + m["size"] / 2 + base
            return out

        return run

    def rough(s, o, tile):
        way, far, square = tile
        flat = not s["z"].any() and not s["pz"].any() and not s["vz"].any() and not s["az"].any() and not any(o[c].any() for c in ("z", "vz", "az"))
        keep = None
        for j in range(len(spans)):
            np.add(s[f"r{j}"], o[f"r{j}"], out=far)
            np.multiply(far, far, out=far)
            for i, c in enumerate("xy" if flat else "xyz"):
                np.subtract(s[f"{c}{j}"], o[f"{c}{j}"], out=way)
                np.multiply(way, way, out=way if i else square)
                if i:
                    square += way
            close = square <= far
            keep = close if keep is None else keep | close
        return keep

    def judge(s, o, dist):
        used = axes if any(m[c].any() for m, names in ((s, "pz vz az"), (o, "z vz az")) for c in names.split()) else "xy"
        half, some, met = window / 2, [], []
        for j, span in enumerate(spans):
            at = np.flatnonzero(sum(np.square(s[f"{c}{j}"] - o[f"{c}{j}"]) for c in used) <= np.square(s[f"r{j}"] + o[f"r{j}"]))
            a = {c: s[c].take(at) for c in [*(f"{k}{x}" for k in ("p", "mv", "ma", "v", "a") for x in used), "size"]}
            b = {c: o[c].take(at) for c in [*(f"{k}{x}" for k in ("", "v", "a") for x in used), "size"]}
            v, h = {c: a[f"v{c}"] - b[f"v{c}"] for c in used}, {c: 0.5 * (a[f"a{c}"] - b[f"a{c}"]) for c in used}
            speed, change = (np.sqrt(sum(np.square(w) for w in ways.values())) for ways in (v, h))
            # the bound of a whole window from its middle, as in predict(), h being half the change
            reach = (a["size"] + b["size"]) / 2 + K.SAFE_DISTANCE_BASE + (speed + 2 * change * window) * half + 1e-6
            for t in span:
                there = {c: a[f"p{c}"] + a[f"mv{c}"] * t + 0.5 * a[f"ma{c}"] * t * t for c in used}
                moved = {c: b[c] + b[f"v{c}"] * t + 0.5 * b[f"a{c}"] * t * t for c in used}
                near = sum(np.square(there[c] - moved[c] + v[c] * half + h[c] * (half * half)) for c in used) <= reach * reach
                near &= np.sqrt(sum(np.square(b[c] - there[c]) for c in used)) <= radius
                left = np.flatnonzero(near)
                some.append(at[left])
                met.append([np.full(len(left), t), *(m[c][left] for c in used for m in (there, moved))])
        at, (t, *places) = np.concatenate(some), map(np.concatenate, zip(*met))
        a, b = ({c: m[c].take(at) for c in [*(f"{k}{x}" for k in "va" for x in axes), "size", "heading", "t1", "t2"]} for m in (s, o))
        speed = np.sqrt(sum(np.square(a[f"v{c}"] - b[f"v{c}"]) for c in axes))
        safe = (a["size"] + b["size"]) / 2 + K.SAFE_DISTANCE_BASE
        sides = [tuple((place, m[f"v{c}"], 0.5 * m[f"a{c}"]) for place, m in zip(places[2 * i : 2 * i + 2], (a, b))) for i, c in enumerate(used)]
        k, d = D.first_hits(sides, safe, speed, K.PROBE_STEP, int(window / K.PROBE_STEP))
        hit = np.flatnonzero(k >= 0)
        at, t, k, d = at[hit], t[hit], k[hit], d[hit]
        a, b = ({c: m[c].take(hit) for c in ("heading", "t1", "t2")} for m in (a, b))
        ttc = k * K.PROBE_STEP
        risk = D.risk_of(d, ttc, speed[hit], safe[hit], np.abs(a["heading"] - b["heading"]), (a["t1"] == b["t1"]) & (a["t2"] == b["t2"]))
        # of a pair's steps the highest risk, the earliest among equals
        order = np.lexsort((ttc + t, -risk, at))
        order = order[np.diff(at[order], prepend=-1) != 0]
        found = np.zeros(len(dist), bool)
        found[at[order]] = True
        out = []
        for value in (risk, ttc + t, d, s["ts"][at] + t):
            out.append(np.zeros(len(dist)))
            out[-1][at[order]] = value[order]
        return found, *out

    numbers = [*own, *(f"p{c}" for c in axes), *part, *kind]
    values = ("risk_level", "time_to_collision", "distance", "ts")
    found = reach_pairs(s, reach, "0D", radius, judge, numbers, o, rough, (derived("p", "mv", "ma", K.SAFE_DISTANCE_BASE), derived("", "v", "a", 1e-6)), values)
    found = found.withColumnsRenamed({"s_id": "vehicle_id", "o_id": "other_vehicle_id"})
    return found if D.distinct_ids(fleet) else D.merge(found)
