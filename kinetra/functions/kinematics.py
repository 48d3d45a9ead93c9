"""Scalar kinematics as Column functions: they stay in generated code and never divide by zero under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetra import constants as K

AXES = ("x", "y", "z")


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def distance(a: str, b: str) -> Column:
    """Distance of two prefixed positions, as in distance('s_', 'o_')."""
    return norm(*(F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in AXES))


def magnitude(prefix: str = "v") -> Column:
    return norm(*(F.col(f"{prefix}{c}") for c in AXES))


def normalized(prefix: str = "v") -> list[Column]:
    """Unit vector; the zero vector stays zero."""
    m = magnitude(prefix)
    return [F.when(m == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(f"{prefix}{c}"), m)) for c in AXES]


def dot(a: list[Column], b: list[Column]) -> Column:
    x, y, z = (p * q for p, q in zip(a, b))
    return x + y + z


def relative_velocity(s: str = "s_", o: str = "o_") -> list[Column]:
    """Own velocity minus the other's."""
    return [F.col(f"{s}v{c}") - F.col(f"{o}v{c}") for c in AXES]


def relative_position(s: str = "s_", o: str = "o_") -> list[Column]:
    """The other's position minus the own one."""
    return [F.col(f"{o}{c}") - F.col(f"{s}{c}") for c in AXES]


def position_at(t: Column, prefix: str = "", accelerate: bool = True) -> list[Column]:
    out = []
    for c in AXES:
        p = F.col(f"{prefix}{c}") + F.col(f"{prefix}v{c}") * t
        out.append(p + F.lit(0.5) * F.col(f"{prefix}a{c}") * t * t if accelerate else p)
    return out


def distance_at(t: Column, s: str = "s_", o: str = "o_") -> Column:
    return norm(*(p - q for p, q in zip(position_at(t, s), position_at(t, o))))


def safe_distance(s: str = "s_", o: str = "o_") -> Column:
    return (F.col(f"{s}size") + F.col(f"{o}size")) / 2 + K.SAFE_DISTANCE_BASE


def type_factor(s: str = "s_", o: str = "o_") -> Column:
    return F.when(F.col(f"{s}type") == F.col(f"{o}type"), K.SAME_TYPE).otherwise(K.OTHER_TYPE)


def risk_level(dist: Column, ttc: Column, speed: Column, s: str = "s_", o: str = "o_") -> Column:
    """Weighted risk, clamped to [0, 1]."""
    w = K.RISK_WEIGHTS
    score = (
        w["distance"] * (1 - F.try_divide(dist, safe_distance(s, o)))
        + w["time"] * (1 - F.least(F.lit(1.0), ttc / K.MAX_WARNING_TIME))
        + w["speed"] * F.least(F.lit(1.0), speed / K.MAX_RELATIVE_SPEED)
        + w["angle"] * F.sin(F.abs(F.col(f"{s}heading") - F.col(f"{o}heading")))
        + w["type"] * type_factor(s, o)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def lookahead_risk(future: Column, speed: Column) -> Column:
    return F.least(F.lit(1.0), F.try_divide(F.lit(2 * K.CONTACT_RADIUS), F.greatest(F.lit(0.1), future)) * speed / 10)


def lookahead_time(now: Column, future: Column) -> Column:
    reach = 2 * K.CONTACT_RADIUS
    meets = (future < reach) & (now > future)
    return F.when(meets, F.greatest(F.lit(0.1), F.try_divide(K.LOOKAHEAD * (now - reach), now - future))).otherwise(K.LOOKAHEAD)
