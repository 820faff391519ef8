"""Run ledger: an append-only table of job runs and steps, and the reports over it."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "run_id string, kind string, step string, status string, read_rows long, written_rows long, error string,"
    " started timestamp, ended timestamp"
)


def observe_counts(df: DataFrame, name: str | None = None, kept: Column | None = None) -> tuple[DataFrame, Observation]:
    """`df` with row counters that fill in when the next action runs; no extra pass over the data."""
    observation = Observation(name or f"counts-{uuid.uuid4().hex}")
    metrics = [F.count(F.lit(1)).alias("read_rows")]
    metrics.append((F.count_if(kept) if kept is not None else F.count(F.lit(1))).alias("written_rows"))
    return df.observe(observation, *metrics), observation


@dataclass
class Ledger:
    """Appends entries below `path`, each in a folder of its own, so that jobs may append at the same time."""

    spark: SparkSession
    path: str
    kind: str
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def append(self, step: str, status: str, started: dt.datetime, read=None, written=None, error: str | None = None):
        ended = dt.datetime.now(dt.timezone.utc) if status != "RUNNING" else None
        row = (self.run_id, self.kind, step, status, read, written, error, started, ended)
        entry = f"{self.path}/entry-{uuid.uuid4().hex}"
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.parquet(entry)

    def run(self, step: str, action, observation: Observation | None = None) -> bool:
        """Run one step and record how it went; an error is recorded, not raised, so other steps go on."""
        started = dt.datetime.now(dt.timezone.utc)
        self.append(step, "RUNNING", started)
        try:
            action()
        except Exception as e:  # noqa: BLE001 - the ledger is where job errors go
            self.append(step, "FAILED", started, error=str(e))
            return False
        counts = observation.get if observation else {}
        self.append(step, "COMPLETED", started, counts.get("read_rows"), counts.get("written_rows"))
        return True

    def entries(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)


def history(*runs: DataFrame) -> DataFrame:
    """All kinds of runs in one list, newest first, numeric ids first by number."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.orderBy(F.desc_nulls_last("started"), F.desc_nulls_last(F.col("run_id").try_cast("long")), F.desc("run_id"))


def latest_state(entries: DataFrame) -> DataFrame:
    """The last entry of each step of each run: a combinable maximum, no window."""
    order = F.struct(F.coalesce("ended", "started"), F.col("status") != "RUNNING")
    last = F.max_by(F.struct("status", "read_rows", "written_rows", "error", "started", "ended"), order)
    return entries.groupBy("run_id", "kind", "step").agg(last.alias("s")).select("run_id", "kind", "step", "s.*")


def status(entries: DataFrame, run_id: str | None = None) -> DataFrame:
    """Per run: steps, finished steps, percent (99 at most while unfinished), rows, first error."""
    rows = latest_state(entries if run_id is None else entries.filter(F.col("run_id") == run_id))
    done, steps = F.count_if(F.col("status") == "COMPLETED"), F.count(F.lit(1))
    failed = F.count_if(F.col("status") == "FAILED")
    percent = F.floor(done * 100 / steps).cast("int")
    return rows.groupBy("run_id", "kind").agg(
        steps.alias("steps"), done.alias("completed"), failed.alias("failed"),
        F.when(done == steps, 100).otherwise(F.least(percent, F.lit(99))).alias("percent"),
        F.coalesce(F.sum("written_rows"), F.lit(0).cast("long")).alias("written_rows"),
        F.when(failed > 0, "FAILED").when(done == steps, "COMPLETED").otherwise("RUNNING").alias("status"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.struct("started", "step"))).alias("first_error"),
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each kind."""
    return runs.groupBy("kind").agg(F.max_by("run_id", F.struct("started", "run_id")).alias("run_id"), F.max("started").alias("started"))


def summary_by_key(df: DataFrame, key: str) -> DataFrame:
    """Row counts per value with a total row (NULL key)."""
    return df.rollup(key).agg(F.count(F.lit(1)).alias("n_rows"))
