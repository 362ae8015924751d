"""States of the jobs of a workspace whose files may be loaded anew while older ones are still worked on.

Each load and each reset gives a workspace its next revision; what is told about an
older revision, however late it comes, is stale and has no effect. This is the batch
form, over events in any order; ``streaming.jobs`` keeps the same states up to date.

An event is (workspace, revision, job_id, seq, kind, detail):

| kind | a job becomes |
|---|---|
| load | ready; only jobs that were loaded have a state |
| start | working |
| analyzed | analyzed |
| verified | verified |
| unverified | error, ``verification-failed`` |
| failed | error, with the event's detail |
| reset | (no job) the workspace has no jobs at this revision |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states that events lead to.
STATUSES = {"load": "ready", "start": "working", "analyzed": "analyzed", "verified": "verified", "unverified": "error", "failed": "error"}
UNVERIFIED = "verification-failed"


def status_of(kind: Column) -> Column:
    """The state after an event of this kind; null for kinds that are not known."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair]), kind)


def error_of(kind: Column, detail: Column) -> Column:
    """Why a job failed; null while it has not."""
    return F.when(kind == "unverified", UNVERIFIED).when(kind == "failed", F.coalesce(detail, F.lit("failed")))


def latest(events: DataFrame) -> DataFrame:
    """(workspace, revision, job_id, events, loaded, kind, detail): what the events of one job at one revision come to.

    The last by ``seq`` counts; of equal ones that of greatest kind, then detail. Partial
    results are made where the events are, so a workspace or job with most of all
    events is no single task's work. Events without a workspace, revision or known kind are left out.
    """
    known = events.where(F.col("workspace").isNotNull() & F.col("revision").isNotNull() & F.col("kind").isin(*STATUSES, "reset"))
    order = F.struct("seq", "kind", "detail")
    told = known.groupBy("workspace", "revision", "job_id").agg(F.count("*").alias("events"), F.bool_or(F.col("kind") == "load").alias("loaded"), F.max(F.when(F.col("kind") != "reset", order)).alias("last"))
    return told.select("workspace", "revision", "job_id", "events", "loaded", F.col("last.kind").alias("kind"), F.col("last.detail").alias("detail"))


def revisions(told: DataFrame) -> DataFrame:
    """(workspace, revision, jobs, stale_events): the revision of each workspace that counts, its jobs, and how many events are of older ones."""
    each = told.groupBy("workspace", "revision").agg(F.sum("events").alias("events"), F.count_if(F.col("loaded") & F.col("job_id").isNotNull()).alias("jobs"))
    return each.groupBy("workspace").agg(F.max("revision").alias("revision"), F.max_by("jobs", "revision").alias("jobs"), (F.sum("events") - F.max_by("events", "revision")).alias("stale_events"))


def states(events: DataFrame) -> DataFrame:
    """(workspace, revision, job_id, status, error) of every job that was loaded at its workspace's last revision."""
    told = latest(events)
    current = told.groupBy("workspace").agg(F.max("revision").alias("revision"))
    live = told.where(F.col("loaded") & F.col("job_id").isNotNull()).join(current, ["workspace", "revision"])
    return live.select("workspace", "revision", "job_id", status_of(F.col("kind")).alias("status"), error_of(F.col("kind"), F.col("detail")).alias("error"))
