"""The status of a running batch of jobs as a streaming aggregation over its job log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_status(log: DataFrame, job: str, at: str, status: str) -> DataFrame:
    """Each job's last status."""
    return log.groupBy(job).agg(F.max_by(status, at).alias(status), F.max(at).alias(at))


def status_by_window(log: DataFrame, at: str, status: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each status in windows of event time; rows later than `late` are left out of windows that closed."""
    return log.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), status).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), status, "n")


def watch(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, job: str = "job", at: str = "ts", status: str = "status") -> StreamingQuery:
    """Follow a folder of job logs; after each micro-batch the jobs it touched replace their old status in `out`."""
    log = spark.readStream.schema(schema).json(path)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").json(f"{out}/batch={batch}")

    return latest_status(log, job, at, status).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()
