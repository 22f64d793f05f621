"""Status roll-ups over the records of workpackages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The statuses.
STATUSES = ("NOTSTARTED", "RUNNING", "FINISHED", "ERROR", "BLOCKED", "INTERRUPTED")
RECORD = "schema int, status string, step string, row bigint, started_at timestamp, finished_at timestamp, duration double, exit_code int, error string"

MANIFEST = "run_id string, work array<struct<step: string, `row`: bigint, `values`: map<string, string>>>"


def read_status(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=RECORD, multiLine=True, recursiveFileLookup=True)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """As `read_status`, from files that hold one record a line, which many tasks can share."""
    return spark.read.json(path, schema=RECORD, recursiveFileLookup=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, step, row, values) of every workpackage of the runs whose manifests lie at `path`; values are texts."""
    runs = spark.read.json(path, schema=MANIFEST, multiLine=True, recursiveFileLookup=True)
    return runs.select("run_id", F.explode("work").alias("w")).select("run_id", "w.step", "w.row", "w.values")


def pivot(records: DataFrame) -> DataFrame:
    """Per step and in all (step null): counts by status, their total and the summed duration; one pass."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES]
    return records.rollup("step").agg(*counts, F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("duration"))


def final_status(records: DataFrame, *by: str) -> DataFrame:
    """INTERRUPTED before ERROR (or BLOCKED) before FINISHED, of all records or per value of the columns `by`."""
    return records.groupBy(*by).agg(
        F.when(F.bool_or(F.col("status") == "INTERRUPTED"), "INTERRUPTED").when(F.bool_or(F.col("status").isin("ERROR", "BLOCKED")), "ERROR").otherwise("FINISHED").alias("status")
    )
