"""Latency, throughput and resource metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra.sources.scratch import written


#: Cells in which a round of a selection counts.
CELLS = 4096


def percentile_at(samples: DataFrame, run: str, value: str, shares: dict[str, float]) -> DataFrame:
    """sorted[int(n * share)] of each run, exactly, by selection: nothing is sorted and no run is gathered in one place.

    The range in which a percentile lies is cut into CELLS of equal width, of
    which the values are counted, with the least and greatest of each; the cell
    that holds the index is cut again between these, until it holds one value.
    Each round reads the samples once and leaves a row for each run and share.
    Nulls are no samples; infinities and NaN, the largest, have cells of their own.
    """
    rows = samples.select(F.col(run).alias("run"), F.col(value).cast("double").alias("v")).where("v is not null")
    finite = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    all_of = rows.groupBy("run").agg(F.count("*").alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(share)).alias("share")) for name, share in shares.items()))).alias("ask")
    aims = all_of.select("run", asked, "n", "lo", "hi").select("run", "ask.name", F.least(F.floor(F.col("n") * F.col("ask.share")), F.col("n") - 1).alias("index"), "lo", "hi", F.lit(True).alias("open"))
    aims, first, done = written(aims), True, None
    while True:
        inside = F.lit(True) if first else F.col("v").between(F.col("lo"), F.col("hi"))
        # monotone in v whatever is rounded, and the greatest value never shares the least one's cell
        width = F.expr(f"cast(floor(try_divide(v / 2 - lo / 2, hi / 2 - lo / 2) * {CELLS}) as int)")
        cell = F.when(F.isnan("v"), CELLS + 1).when(F.col("v") == float("inf"), CELLS).when(F.col("v") == float("-inf"), -1).when(F.col("v") >= F.col("hi"), CELLS - 1).otherwise(F.coalesce(F.least(width, F.lit(CELLS - 2)), F.lit(0)))
        counted = rows.join(aims.where("open"), "run").where(inside).groupBy("run", "name", "index", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(W.partitionBy("run", "name").orderBy("cell"))
        found = counted.withColumn("upto", upto).where((F.col("upto") > F.col("index")) & (F.col("upto") - F.col("n") <= F.col("index")))
        aims = written(found.select("run", "name", (F.col("index") - (F.col("upto") - F.col("n"))).alias("index"), "lo", "hi", (F.col("lo") < F.col("hi")).alias("open")))
        closed = aims.where("not open").select("run", "name", "lo")
        done = closed if done is None else done.unionByName(closed)
        first = False
        if aims.where("open").isEmpty():
            break
    return done.groupBy(F.col("run").alias(run)).agg(*(F.max(F.when(F.col("name") == name, F.col("lo"))).alias(name) for name in shares))


def latency_stats(samples: DataFrame, run: str = "run", value: str = "latency_ms") -> DataFrame:
    """Count, mean, index percentiles and largest latency of each run."""
    base = samples.groupBy(run).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("largest"))
    return base.join(percentile_at(samples, run, value, {"p95": 0.95, "p99": 0.99}), run)


def compare(runs: DataFrame) -> DataFrame:
    """Best run by throughput (highest) and by mean, p99 and error rate (lowest)."""
    return runs.agg(F.max_by("run", F.struct("throughput", "run")).alias("best_throughput"), *(F.min_by("run", F.struct(c, "run")).alias(f"best_{c}") for c in ("mean", "p99", "error_rate")))


def running_mean(samples: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return samples.withColumns({"n": F.count("*").over(w), "running_mean": F.avg(value).over(w)})


def every_nth(samples: DataFrame, key: str, value: str, n: int, *order: str) -> DataFrame:
    """Cumulative snapshot at each n-th sample."""
    return running_mean(samples, key, value, *order).where(F.col("n") % n == 0)


def throughput(events: DataFrame, time: str, seconds: int, *by: str) -> DataFrame:
    return events.groupBy(F.window(time, f"{seconds} seconds").alias("w"), *by).agg(F.count("*").alias("events")).select(F.unix_seconds("w.start").alias("start"), *by, "events", (F.col("events") / seconds).alias("per_second"))


def io_rates(counters: DataFrame, key: str, counter: str, scale: float = 1024.0 * 1024.0) -> DataFrame:
    """Change of a counter over time (ts, seq), in units of scale a second; a first sample, or no time, has no rate."""
    w = W.partitionBy(key).orderBy("ts", "seq")
    change, time = F.col(counter) - F.lag(counter).over(w), F.col("ts") - F.lag("ts").over(w)
    return counters.select(key, "seq", F.try_divide(change, F.when(time > 0, time) * scale).alias("rate")).where("rate is not null")


def sessions(events: DataFrame, key: str, gap: float) -> DataFrame:
    """Runs of a key's events (ts, seq) with gaps of at most `gap` seconds."""
    w = W.partitionBy(key).orderBy("ts", "seq")
    fresh = F.coalesce(F.col("ts") - F.lag("ts").over(w) > gap, F.lit(True)).cast("int")
    numbered = events.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w))
    return numbered.groupBy(key, "session").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events"))


def series_stats(series: DataFrame) -> DataFrame:
    """Summary of each run's samples (as read by sources.files.read_metrics): how many, mean and highest throughput, mean and highest latencies, mean error rate and use of the host."""
    return series.groupBy("run").agg(
        F.count("*").alias("samples"), F.avg("throughput").alias("throughput"), F.max("throughput").alias("best_throughput"), F.avg("avg_latency").alias("avg_latency"),
        F.max("p99_latency").alias("p99_latency"), F.max("max_latency").alias("max_latency"), F.avg("error_rate").alias("error_rate"), F.avg("cpu_usage").alias("cpu_usage"), F.max("memory_usage").alias("memory_usage"),
    )


def node_counters(reports: DataFrame, seconds: int) -> DataFrame:
    """Of each node (node_id, id, time, collided) and tumbling window: reports, distinct vehicles, collisions, and reports a second."""
    w = F.window("time", f"{seconds} seconds").alias("w")
    counts = reports.groupBy("node_id", w).agg(F.count("*").alias("reports"), F.countDistinct("id").alias("vehicles"), F.count_if("collided").alias("collisions"))
    return counts.select("node_id", F.unix_seconds("w.start").alias("start"), "reports", "vehicles", "collisions", (F.col("reports") / seconds).alias("per_second"))
