"""Requests and their answers as two streams: an outer join that gives up on an answer when its time has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answered(requests: DataFrame, answers: DataFrame, key: str, longest: float, watermark: str = "30 seconds") -> DataFrame:
    """Each request (key, time, …) with its answers (key, time, …) of up to `longest` seconds later, or with nulls once none can come.

    The answer's time comes out as answered_at. State is bounded: a request
    waits until the watermark of both streams has passed its longest time, an
    answer for one that may still arrive.
    """
    asked = requests.withWatermark("time", watermark)
    rest = [c for c in answers.columns if c not in (key, "time")]
    told = answers.select(F.col(key).alias("_key"), F.col("time").alias("answered_at"), *rest).withWatermark("answered_at", watermark)
    span = F.expr(f"time + interval '{longest}' second")
    return asked.join(told, (F.col(key) == F.col("_key")) & (F.col("answered_at") >= F.col("time")) & (F.col("answered_at") <= span), "leftOuter").drop("_key")


def task_states(tasks: DataFrame, results: DataFrame, longest: float, watermark: str = "30 seconds") -> DataFrame:
    """What became of each task (task_id, time, timeout seconds) by its result (task_id, time, success): completed, failed, or timed_out, which later results don't change. No task's timeout exceeds `longest`."""
    joined = answered(tasks, results, "task_id", longest, watermark)
    late = F.col("answered_at").isNull() | (F.unix_micros("answered_at") - F.unix_micros("time") > F.col("timeout") * 1_000_000)
    return joined.select("task_id", F.when(late, "timed_out").when(F.col("success"), "completed").otherwise("failed").alias("state"))


def transfer_states(requests: DataFrame, responses: DataFrame, longest: float, watermark: str = "30 seconds") -> DataFrame:
    """State requests (request_id, time, user_id) with the state of their response (request_id, time, state), null and answered false where none came in time."""
    joined = answered(requests, responses, "request_id", longest, watermark)
    return joined.select("request_id", "user_id", "state", F.col("answered_at").isNotNull().alias("answered"))
