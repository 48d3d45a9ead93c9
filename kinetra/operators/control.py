"""Ordered folds per key: rate limits, circuit breakers, admission, adaptive rates, failure detection.

A fold reads a key's requests in order and keeps the state alone. The requests of
one key are one sequence, so they pass through one task, which holds a batch of
them at a time; the sort before it spills.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinetra import constants as K
from kinetra.sources.scratch import written


def fold(log: DataFrame, key: list[str], row: list[str], start, step, out: str, carry: Sequence[str] = ()) -> DataFrame:
    """Fold each key's rows, in order of (ts, seq): rows of the key, the columns `carry` and `out`.

    step(state, ts, seq, *row) returns the next state and the tuple of the
    row's results, of the columns `out`; start makes a key's first state.
    Columns that are carried spare the join that would bring them back.
    """
    schema = StructType([log.schema[k] for k in [*key, *carry]] + StructType.fromDDL(out).fields)
    arrow, n, m = to_arrow_schema(schema), len(key), len(key) + 2 + len(row)

    def run(batches):
        last, state = None, None
        for batch in batches:
            rows = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                if values[:n] != last:
                    last, state = values[:n], start()
                state, result = step(state, *values[n:m])
                rows.append(last + values[m:] + result)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(arrow), arrow)], schema=arrow)

    names = [F.col(c).alias(f"_{i}") for i, c in enumerate([*key, "ts", "seq", *row, *carry])]
    sort = [f"_{i}" for i in range(m)]
    return log.select(*names).repartition(*sort[:n]).sortWithinPartitions(*sort).mapInArrow(run, schema)


def fold_all(log: DataFrame, row: list[str], start, step, out: str, carry: Sequence[str]) -> DataFrame:
    """fold() of all rows as one sequence: rows of `carry` (ts and seq among them) and `out`.

    Ranges are sorted side by side and packed, so that the one task which folds
    them sorts a row for each batch and not for each of its rows.
    """
    rows = log.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(["ts", "seq", *row, *carry])))
    schema, n = StructType([log.schema[c] for c in carry] + StructType.fromDDL(out).fields), 2 + len(row)
    packed, arrow = to_arrow_schema(rows.schema), to_arrow_schema(schema)

    def pack(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, packed)], schema=packed)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, packed, options=pa.ipc.IpcWriteOptions(compression="zstd")) as told:
                told.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([k]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "k", "rows"])
            k += 1

    def run(batches):
        state = start()
        for batch in batches:
            for raw in batch.column(2):
                for rows in pa.ipc.open_stream(raw.as_buffer()):
                    results = []
                    for values in zip(*(c.to_pylist() for c in rows.columns[:n])):
                        state, result = step(state, *values)
                        results.append(result)
                    yield pa.RecordBatch.from_arrays([*rows.columns[n:], *(pa.array(c, f.type) for c, f in zip(zip(*results), list(arrow)[len(carry):]))], schema=arrow)

    order = [f"_{i}" for i in range(n)]
    runs = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(pack, "part long, k long, rows binary")
    return runs.repartition(1).sortWithinPartitions("part", "k").mapInArrow(run, schema)


def _since(now, then):
    return 0 if now is None or then is None else now - then


def token_bucket(requests: DataFrame, rate: float, capacity: float, key: str = "client", cost: float = 1.0) -> DataFrame:
    """Whether each request (ts, seq) finds cost tokens; the bucket begins full."""

    def step(bucket, ts, seq):
        bucket, ok = take(bucket, ts, rate, capacity, cost)
        return bucket, (seq, ok)

    return fold(requests, [key], [], lambda: None, step, "seq long, allowed boolean")


#: State, failures, time of the last failure and trial calls of a breaker at its start.
CLOSED = ("closed", 0, 0.0, 0)


def breaker_step(failures: int, recovery: float, trial_calls: int):
    """A breaker's step over calls (ts, seq, success): the result is (seq, let through, state after)."""

    def step(s, ts, seq, success):
        state, failed, since, trials = s
        wakes = state == "open" and None not in (ts, since) and ts - since > recovery
        probing = state == "half-open" and trials < trial_calls
        ok = state == "closed" or wakes or probing
        if wakes:
            state, trials = "half-open", 0
        elif probing:
            trials += 1
        if ok and success:
            failed = 0
            if state == "half-open":
                state, trials = "closed", 0
        elif ok and success is False:
            failed += state == "closed"
            if state == "half-open" or failed >= failures:
                state = "open"
            since = ts
        return (state, failed, since, trials), (seq, ok, state)

    return step


def circuit_breaker(calls: DataFrame, failures: int = K.BREAKER["failures"], recovery: float = K.BREAKER["recovery"], trial_calls: int = K.BREAKER["trial_calls"], key: str = "endpoint") -> DataFrame:
    """Whether each call (ts, seq, success) is let through, and the state after it. Rejected calls have no outcome."""
    return fold(calls, [key], ["success"], lambda: CLOSED, breaker_step(failures, recovery, trial_calls), "seq long, allowed boolean, state string")


def take(bucket, ts, rate: float, capacity: float, cost: float = 1.0):
    """A token bucket (tokens, time) after a request at ts, and whether it found its tokens; None is a bucket as it begins, full."""
    tokens, at = bucket or (float(capacity), None)
    refilled = min(float(capacity), tokens + _since(ts, at) * rate)
    ok = refilled >= cost
    return (refilled - (cost if ok else 0.0), ts), ok


def _limited(requests: DataFrame, key: str | None, name: str, rate: float, capacity: float, carry: Sequence[str]) -> DataFrame:
    """Requests with the verdict of one more limiter, which sees only those let through so far; without a key, one limiter for all."""

    def step(bucket, ts, seq, refused):
        if refused is None:
            bucket, ok = take(bucket, ts, rate, capacity)
            refused = None if ok else name
        return bucket, (refused,)

    if key is None:
        return fold_all(requests, ["refused"], lambda: None, step, "refused string", carry)
    return fold(requests, [key], ["refused"], lambda: None, step, "refused string", [c for c in carry if c != key])


def admission(requests: DataFrame, overall: tuple[float, float], endpoint: tuple[float, float], client: tuple[float, float], breaker: dict | None = None) -> DataFrame:
    """Global, endpoint and client limits and the endpoint's breaker, in that order; tokens taken before a refusal stay taken.

    The requests are read once and pass through four folds, each by its own
    key, that hand them on with what has refused them. The global limit is one
    shared bucket and so one sequence, which reaches its task in packed batches.
    """
    carry = ["ts", "seq", "endpoint", "client", "success"]
    rows = requests.select(*carry, F.lit(None).cast("string").alias("refused"))
    rows = _limited(rows, None, "global", *overall, carry)
    rows = _limited(rows, "endpoint", "endpoint", *endpoint, carry)
    rows = _limited(rows, "client", "client", *client, carry)
    call = breaker_step(*(({} | K.BREAKER | (breaker or {}))[k] for k in ("failures", "recovery", "trial_calls")))

    def step(state, ts, seq, success, refused):
        if refused is None:
            state, (_, ok, _) = call(state, ts, seq, success)
            refused = None if ok else "breaker"
        return state, (refused,)

    return fold(rows, ["endpoint"], ["success", "refused"], lambda: CLOSED, step, "refused string", ["seq", "client"]).select("seq", "endpoint", "client", "refused")


RULE = "struct<place:int,rate:double,capacity:double,priority:double>"


def rules_of_requests(requests: DataFrame, rules: DataFrame, conditions: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Each request's column `rules`: in order of place, the rules whose conditions hold.

    rules (place, rate, capacity, priority: null where a rule has no limiter or
    no least priority) and conditions (place, field, value as text) are tables;
    a rule holds if all its conditions do, and always if it has none. A field
    that is null or absent meets no condition. Matches are counted by request
    and rule (relational division): a request meets only the conditions on its
    own values.
    """
    told = F.struct(F.col("place").cast("int").alias("place"), *(F.col(c).cast("double").alias(c) for c in ("rate", "capacity", "priority"))).cast(RULE)
    asked = conditions.groupBy("place").agg(F.count("*").alias("n"))
    sized = rules.join(asked, "place", "left").select("place", told.alias("rule"), F.coalesce("n", F.lit(0)).alias("n"))
    always = F.coalesce(sized.where("n = 0").agg(F.collect_list("rule")).scalar(), F.array().cast(f"array<{RULE}>"))
    values = requests.select("seq", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields))).alias("x")).select("seq", "x.*").where("value is not null")
    met = values.join(conditions, ["field", "value"]).groupBy("seq", "place").agg(F.count("*").alias("n"))
    own = met.join(sized, ["place", "n"]).groupBy("seq").agg(F.collect_list("rule").alias("own"))
    return requests.join(own, "seq", "left").withColumn("rules", F.sort_array(F.concat(F.coalesce("own", F.array().cast(f"array<{RULE}>")), always))).drop("own")


def _families(rows: DataFrame) -> DataFrame:
    """(place, family): limiters that stand on one request, directly or through others, are of one family, named by its smallest place."""
    limiters = F.transform(F.filter("rules", lambda r: r["rate"].isNotNull()), lambda r: r["place"])
    links = written(rows.select(F.explode(F.arrays_zip(limiters.alias("b"), F.transform(limiters, lambda _: F.get(limiters, F.lit(0))).alias("a"))).alias("x")).select("x.a", "x.b").distinct())
    both = links.union(links.select("b", "a"))
    labels = written(links.select(F.col("b").alias("place")).distinct().withColumn("family", F.col("place")))
    while True:
        near = both.join(labels.withColumnRenamed("place", "b"), "b").groupBy(F.col("a").alias("place")).agg(F.min("family").alias("near"))
        step = written(labels.join(near, "place").select("place", F.least("family", "near").alias("family"), F.col("family").alias("was")))
        labels = step.select("place", "family")
        if step.where("family <> was").isEmpty():
            return labels


def policy(requests: DataFrame, rules: DataFrame, conditions: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rules in order of place: of those that hold for a request, its limiter, then its least priority, may refuse. refused is the place of the refusing rule.

    Limiters that share no request are folded apart; requests that meet no
    limiter need no order and are spread. A request without a priority passes
    every least priority.
    """
    rows = written(rules_of_requests(requests.select("ts", "seq", "current_priority", *fields), rules, conditions, fields).select("ts", "seq", "current_priority", "rules"))
    first = F.get(F.transform(F.filter("rules", lambda r: r["rate"].isNotNull()), lambda r: r["place"]), 0)
    keyed = rows.withColumn("place", first).join(_families(rows), "place", "left").withColumn("family", F.coalesce(F.col("family").cast("long"), -1 - F.abs("seq")))

    def step(buckets, ts, seq, priority, met):
        for rule in met:
            place = rule["place"]
            if rule["rate"] is not None:
                buckets[place], ok = take(buckets.get(place), ts, rule["rate"], rule["capacity"])
                if not ok:
                    return buckets, (seq, place)
            if None not in (rule["priority"], priority) and priority < rule["priority"]:
                return buckets, (seq, place)
        return buckets, (seq, None)

    return fold(keyed, ["family"], ["current_priority", "rules"], dict, step, "seq long, refused int").select("seq", "refused")


#: Rates above and below these uses of the processor are scaled, down to a least and up to a greatest rate.
BUSY, IDLE, DOWN, UP, LEAST_RATE, GREATEST_RATE = 0.8, 0.5, 0.8, 1.1, 10.0, 10000.0
CHUNKS = "chunk long, n long, seq long, scale double, low double, high double"


def _scalings(key_field):
    """Rows (key, ts, seq, cpu) of a sorted range with what the samples of the key since the range began do to a rate r: min(high, max(low, scale * r))."""
    arrow = to_arrow_schema(StructType([key_field, *StructType.fromDDL(CHUNKS).fields]))

    def run(batches):
        chunk, last, n, f = TaskContext.get().partitionId(), None, 0, None
        for batch in batches:
            rows = []
            for k, _, seq, cpu in zip(*(c.to_pylist() for c in batch.columns)):
                if n == 0 or k != last:
                    last, n, f = k, 0, (1.0, 0.0, float("inf"))
                if cpu is not None and cpu > BUSY:
                    f = f[0] * DOWN, max(LEAST_RATE, f[1] * DOWN), max(LEAST_RATE, f[2] * DOWN)
                elif cpu is not None and cpu < IDLE:
                    f = f[0] * UP, min(GREATEST_RATE, f[1] * UP), min(GREATEST_RATE, f[2] * UP)
                n += 1
                rows.append((k, chunk, n, seq, *f))
            yield pa.RecordBatch.from_arrays([pa.array(c, f_.type) for c, f_ in zip(zip(*rows) if rows else [[]] * len(arrow), arrow)], schema=arrow)

    return run


def adaptive_rate(samples: DataFrame, start_rate: float, key: str = "endpoint") -> DataFrame:
    """Rate after each sample (ts, seq, cpu): times 0.8 above 0.8 (10 at least), times 1.1 below 0.5 (10000 at most).

    Any run of samples scales a rate and clamps it, and so do two runs after
    each other. So the samples are cut into sorted ranges, of one key or many;
    a range knows what its samples do to any rate, and the rates with which
    keys enter a range follow from one row for each key and range. A key
    that has all rows uses all cores. Rounding differs from a loop's in the
    last digits.
    """
    rows = samples.select(F.col(key).alias("_k"), "ts", "seq", "cpu")
    order = ["_k", "ts", "seq"]
    cut = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scalings(rows.schema["_k"]), StructType([rows.schema["_k"], *StructType.fromDDL(CHUNKS).fields])))
    runs = cut.groupBy("_k", "chunk").agg(F.max_by(F.struct("scale", "low", "high"), "n").alias("f")).select("_k", F.col("chunk").alias("ts"), F.col("chunk").alias("seq"), "f.*")

    def step(rate, _, chunk, scale, low, high):
        return min(high, max(low, scale * rate)), (chunk, rate)

    starts = fold(runs, ["_k"], ["scale", "low", "high"], lambda: float(start_rate), step, "chunk long, start double").withColumnRenamed("_k", "_key")
    joined = cut.join(starts.withColumnRenamed("chunk", "_chunk"), F.col("_k").eqNullSafe(F.col("_key")) & (F.col("chunk") == F.col("_chunk")))
    return joined.select(F.col("_k").alias(key), "seq", F.least("high", F.greatest("low", F.col("scale") * F.col("start"))).alias("rate"))


def heartbeat_failures(beats: DataFrame, interval: float = K.HEARTBEAT_INTERVAL, misses: int = K.HEARTBEAT_MISSES) -> DataFrame:
    """Gaps of each node (node_id, ts, seq) that miss so many intervals, with the time of recovery."""
    after = F.lead("ts").over(W.partitionBy("node_id").orderBy("ts", "seq"))
    gaps = beats.select("node_id", "seq", "ts", after.alias("recovered_at")).withColumn("missed", F.floor((F.col("recovered_at") - F.col("ts")) / interval).cast("long"))
    return gaps.where(F.col("missed") >= misses)


def queue_verdicts(messages: DataFrame, capacity: int, drained: int) -> DataFrame:
    """Whether each message (topic, ts, seq, tick) finds room in its topic's bounded queue, of which `drained` messages leave at each tick."""

    def step(s, ts, seq, tick):
        held, before = s
        left = max(0, held - drained * _since(tick, before))
        ok = left < capacity
        return (left + ok, tick), (seq, ok)

    return fold(messages, ["topic"], ["tick"], lambda: (0, None), step, "seq long, accepted boolean")


#: Statuses of a recovery in the order in which they may follow each other; an ended one may be initiated again.
RECOVERY_STEPS = {(None, "initiated"), ("initiated", "starting"), ("starting", "completed"), ("starting", "failed"), ("completed", "initiated"), ("failed", "initiated")}


def conformance(log: DataFrame, steps: set[tuple[str | None, str]] = RECOVERY_STEPS, key: str = "recovery_id") -> DataFrame:
    """Whether each status of a workflow (key, ts, seq, status) may follow the state before it, and the state after: a status that may not changes nothing."""

    def step(state, ts, seq, status):
        ok = (state, status) in steps
        state = status if ok else state
        return state, (seq, status, ok, state)

    return fold(log, [key], ["status"], lambda: None, step, "seq long, status string, valid boolean, state string")


def elections(votes: DataFrame, known: int, key: str = "cluster") -> DataFrame:
    """Term and leader of a cluster after each vote (ts, seq, term, voter, candidate, granted).

    A vote of a higher term ends the leadership of the term before; votes of a
    lower one and further votes of a voter in a term don't count; a candidate
    with more than half of the known nodes leads its term.
    """

    def step(state, ts, seq, term, voter, candidate, granted):
        now, voted, leader = state
        if term > now:
            now, voted, leader = term, {}, None
        if term == now and granted and voter not in voted:
            voted = voted | {voter: candidate}
            if leader is None and 2 * sum(c == candidate for c in voted.values()) > known:
                leader = candidate
        return (now, voted, leader), (seq, now, leader)

    return fold(votes, [key], ["term", "voter", "candidate", "granted"], lambda: (-1, {}, None), step, "seq long, current_term long, leader long")
