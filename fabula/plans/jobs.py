"""Batches of model runs: plan the matrix, skip what is finished, run with retries, keep a status table."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.operators import matching, summaries


def plan(roles: DataFrame, samples: DataFrame, finished: DataFrame, sample: str, modes: list[str], keys: list[str]) -> DataFrame:
    """Jobs still to run: each sample of a role in each mode, without finished ones; roles without samples say so."""
    jobs = matching.episode_jobs(roles, samples, keys, sample, modes)
    done = finished.select(*keys, sample, "mode")
    return matching.skip_finished(jobs.where("status = 'planned'"), done, [*keys, sample, "mode"]).unionByName(jobs.where("status <> 'planned'"))


def run(jobs: DataFrame, payload: str, work: Callable[[str], str], tries: int = 3) -> DataFrame:
    """jobs with status (finished or failed), attempt_count, elapsed_sec, result and error. work runs on executors; Spark retries lost tasks besides."""
    schema = jobs.drop("status").withColumns({"status": F.lit(""), "attempt_count": F.lit(0), "elapsed_sec": F.lit(0.0), "result": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).schema
    rows = jobs.drop("status")
    at = rows.columns.index(payload)

    def each(batches):
        for batch in batches:
            out: list[tuple] = []
            for value in batch.column(at).to_pylist():
                began, error = time.monotonic(), None
                for attempt in range(1, tries + 1):
                    try:
                        out.append(("finished", attempt, time.monotonic() - began, work(value), None))
                        break
                    except Exception as e:  # noqa: BLE001  a failed job is a row, not a failed batch
                        error = f"{type(e).__name__}: {e}"
                else:
                    out.append(("failed", tries, time.monotonic() - began, None, error))
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], schema.names)

    return rows.mapInArrow(each, schema)


def summary(rows: DataFrame, score: str) -> DataFrame:
    """Counts and mean scores by status, mode, role and role and mode."""
    return summaries.run_summary(rows, "status", "mode", "character", score, ["finished", "skipped_finished"])
