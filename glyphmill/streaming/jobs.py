"""States of jobs over a stream of events that may come late, repeated or out of order (see ``operators.jobs``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glyphmill.operators.jobs import STATUSES, UNVERIFIED

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "workspace string, revision long, job_id string, status string, error string, stale_events long"


class JobStates(StatefulProcessor):
    """Keeps a workspace's revision and, for each job of it, the last event.

    A workspace holds one batch of files at a time, so its state is bounded; jobs of an
    older revision go when a newer one is told. Events come in frames of bounded size.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revision = handle.getValueState("revision", "revision long")
        self.jobs = handle.getMapState("jobs", "job_id string", "seq long, kind string, detail string, loaded boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known = self.revision.get()[0] if self.revision.exists() else None
        changed: dict[str, None] = {}
        stale = 0
        for frame in rows:
            frame = frame[frame["kind"].isin([*STATUSES, "reset"]) & frame["revision"].notna()]
            for e in frame.itertuples():
                revision = int(e.revision)
                if known is not None and revision < known:
                    stale += 1
                    continue
                if known is None or revision > known:
                    self.jobs.clear()
                    changed.clear()
                    known = revision
                    self.revision.update((revision,))
                if e.kind == "reset" or e.job_id is None:
                    continue
                job = (str(e.job_id),)
                seq, kind, detail, loaded = self.jobs.getValue(job) if self.jobs.containsKey(job) else (None, "", None, False)
                newer = seq is None or (int(e.seq), e.kind, e.detail or "") > (seq, kind, detail or "")
                last = (int(e.seq), e.kind, e.detail) if newer else (seq, kind, detail)
                loaded = bool(loaded) or e.kind == "load"
                self.jobs.updateValue(job, (*last, loaded))
                if loaded:
                    changed[job[0]] = None
        out = []
        for job in changed:
            _, kind, detail, _ = self.jobs.getValue((job,))
            error = UNVERIFIED if kind == "unverified" else (detail or "failed") if kind == "failed" else None
            out.append((key[0], known, job, STATUSES[kind], error, None))
        if stale:
            out.append((key[0], known, None, None, None, stale))
        yield pd.DataFrame(out, columns=["workspace", "revision", "job_id", "status", "error", "stale_events"]).astype({"revision": "Int64", "stale_events": "Int64"})

    def close(self) -> None:
        pass


def job_states(events: DataFrame) -> DataFrame:
    """(workspace, revision, job_id, status, error, stale_events) for each job that a micro-batch changed.

    Events are those of ``operators.jobs``. A job counts once it is loaded, however late that is told.
    A row without a job says how many events of the micro-batch were of older
    revisions. A reader keeps the rows of each workspace's greatest revision, and of each job the
    last; a newer revision without jobs (a reset) tells nothing until it has some.
    The session must use a RocksDB state store (``STATE_STORE``).
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    told = events.selectExpr("cast(workspace as string) workspace", "cast(revision as long) revision", "cast(job_id as string) job_id", "cast(seq as long) seq", "kind", "detail")
    told = told.where("workspace is not null and seq is not null")
    return told.groupBy("workspace").transformWithStateInPandas(statefulProcessor=JobStates(), outputStructType=OUTPUT, outputMode="Update", timeMode="None")
