"""Job tables: states from events, recent jobs, summaries, storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ["QUEUED", "PROCESSING", "COMPLETED", "FAILED"]


def latest_state(events: DataFrame, job: str = "job_id", at: str = "at") -> DataFrame:
    """Each job's last status, error and time; of events at one time the later state counts."""
    order = F.struct(F.col(at), F.array_position(F.array(*map(F.lit, STATES)), F.col("status")))
    return events.groupBy(job).agg(F.max_by("status", order).alias("status"), F.max_by("error", order).alias("error"), F.max(at).alias("updated_at"))


def last_jobs(jobs: DataFrame, limit: int = 50, order: str = "created_at", job: str = "job_id") -> DataFrame:
    """The last ``limit`` jobs (1 to 200) in order of creation. A top-k: each task sends its own last ones."""
    return jobs.orderBy(F.desc(order), F.desc(job)).limit(max(1, min(200, limit))).orderBy(order, job)


def summary(jobs: DataFrame, *keys: str) -> DataFrame:
    """Counts by status, how many are active, and elapsed seconds."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in STATES]
    active = F.count_if(F.col("status").isin("QUEUED", "PROCESSING")).alias("active")
    return jobs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_jobs"), *counts, active, F.avg("elapsed").alias("mean_elapsed"), F.max("elapsed").alias("max_elapsed"))


def scaled_progress(percent: Column, start: float = 15.0, span: float = 70.0) -> Column:
    return start + percent / 100.0 * span


def storage_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Total length of all files under a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files"))


def create_jobs(requests: DataFrame, root: str, seed: str = "request_id", name: str = "job_name") -> DataFrame:
    """``requests`` as queued jobs: job_id (eight hexadecimal digits of a hash of the request's id, so that a
    retried task makes the same job), job_name (by default after the id), status, progress, message, output_dir."""
    job = F.substring(F.sha2(F.col(seed).cast("string"), 256), 1, 8)
    rows = requests.withColumn("job_id", job)
    return rows.select(
        *(c for c in requests.columns if c != name),
        "job_id",
        F.coalesce(F.when(F.trim(name) != "", F.col(name)), F.concat(F.lit("job_"), "job_id")).alias("job_name"),
        F.lit("QUEUED").alias("status"),
        F.lit(0.0).alias("progress_percent"),
        F.lit("Job queued for processing").alias("message"),
        F.concat(F.lit(root.rstrip("/") + "/"), "job_id").alias("output_dir"),
    )


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, to hundredths."""
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6, 2)


def iso_utc(at: Column) -> Column:
    """A timestamp as ISO text in UTC, with microseconds."""
    return F.date_format(F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def mosaic_message(engine: Column, width: Column, height: Column, seconds: Column) -> Column:
    return F.concat(F.lit("Successfully generated "), engine, F.lit(" orthomosaic ("), width.cast("string"), F.lit("x"), height.cast("string"), F.lit("px) in "), seconds.cast("string"), F.lit("s"))


def model_message(points: Column, triangles: Column, seconds: Column) -> Column:
    return F.concat(F.lit("Reconstructed "), points.cast("string"), F.lit(" 3D points ("), F.coalesce(triangles, F.lit(0)).cast("string"), F.lit(" triangles) in "), seconds.cast("string"), F.lit("s"))
