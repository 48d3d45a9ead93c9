"""Files in and out: reports, metrics, results, backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra import schemas as S
from kinetra.sources import messages as M


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vehicles, quarantined texts) of line-delimited JSON."""
    return M.vehicles(spark.read.text(path))


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All *_metrics.csv of a folder, files or folders of files, as numbers, with the name before _metrics as run."""
    rows = spark.read.csv(f"{folder}/*_metrics.csv", header=True, schema=S.PERFORMANCE)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), "([^/=]+)_metrics[.]csv", 1).alias("run"))


def write_results(latencies: DataFrame, metrics: DataFrame, summary: DataFrame, folder: str) -> None:
    latencies.write.mode("overwrite").csv(f"{folder}/latencies", header=True)
    metrics.write.mode("overwrite").csv(f"{folder}/metrics", header=True)
    summary.select(F.to_json(F.struct(*summary.columns)).alias("value")).write.mode("overwrite").text(f"{folder}/summary")


def write_metric_family(rows: DataFrame, folder: str, by: str = "node_id") -> None:
    rows.write.mode("overwrite").partitionBy(by).csv(folder, header=True)


def backup(sources: dict[str, DataFrame], folder: str, backup_id: str, as_of: float) -> None:
    """One Parquet table a source, and metadata written last: a backup without it is incomplete."""
    for name, df in sources.items():
        df.write.mode("overwrite").parquet(f"{folder}/backup_{backup_id}/{name}")
    spark = next(iter(sources.values())).sparkSession
    meta = spark.createDataFrame([(backup_id, as_of, sorted(sources))], "backup_id string, created_at double, sources array<string>")
    meta.coalesce(1).write.mode("overwrite").json(f"{folder}/backup_{backup_id}/metadata")


def backups(spark: SparkSession, folder: str) -> DataFrame:
    """Complete backups, newest first."""
    return spark.read.json(f"{folder}/backup_*/metadata", schema="backup_id string, created_at double, sources array<string>").orderBy(F.desc("created_at"))


def restore(spark: SparkSession, folder: str, backup_id: str) -> dict[str, DataFrame]:
    names = spark.read.json(f"{folder}/backup_{backup_id}/metadata", schema="sources array<string>").first()["sources"]
    return {n: spark.read.parquet(f"{folder}/backup_{backup_id}/{n}") for n in names}


def superseded(found: DataFrame, keep: int = 5) -> DataFrame:
    """Backups beyond the newest `keep`."""
    return found.orderBy(F.desc("created_at")).offset(keep)


def retain(spark: SparkSession, folder: str, keep: int = 5) -> None:
    """Delete the backups beyond the newest `keep`. Their metadata goes first, so that none is seen in part."""
    for row in superseded(backups(spark, folder), keep).toLocalIterator():
        for part in ("/metadata", ""):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/backup_{row['backup_id']}{part}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
