"""Job states: events of older revisions have no effect, in a batch and over a stream, in whatever order they come."""

import random

import pytest

from glyphmill.operators import jobs
from glyphmill.streaming import jobs as streamed

SCHEMA = "workspace string, revision long, job_id string, seq long, kind string, detail string, note string"


def brute(events):
    """One event after another by revision, as a workspace would see them come."""
    out, stale = {}, {}
    last = {}
    for w, r, *_ in events:
        last[w] = max(r, last.get(w, r))
    loaded = {(w, j) for w, r, j, _, k, _, _ in events if k == "load" and r == last[w]}
    for w, r, j, seq, kind, detail, _ in sorted(events, key=lambda e: (e[0], e[3], e[4], e[5] or "")):
        if r < last[w]:
            stale[w] = stale.get(w, 0) + 1
        elif kind != "reset" and (w, j) in loaded:
            status = {"load": "ready", "start": "working", "analyzed": "analyzed", "verified": "verified"}.get(kind, "error")
            error = {"unverified": "verification-failed", "failed": detail or "failed"}.get(kind)
            out[w, j] = (w, r, j, status, error)
    return set(out.values()), {w: (last[w], sum(k[0] == w for k in out), stale.get(w, 0)) for w in last}


def some_events(seed, workspaces=12, hot=0):
    rng = random.Random(seed)
    events = []
    for w in range(workspaces):
        for r in range(1, rng.randrange(2, 5)):
            for j in range(rng.randrange(1, 6) + (hot if not w else 0)):
                kinds = ["load", "start", rng.choice(["analyzed", "verified", "unverified", "failed"])]
                kinds = kinds[: rng.randrange(1, 4)] if rng.random() < 0.8 else kinds[1:]
                events += [(f"w{w}", r, f"{r}-{j}", ["load", "start"].index(k) if k in ("load", "start") else 2, k, rng.choice([None, "why"]) if k == "failed" else None, "x") for k in kinds]
        if rng.random() < 0.3:
            events.append((f"w{w}", 9, None, 0, "reset", None, None))
    events += rng.sample(events, len(events) // 5)  # told twice
    rng.shuffle(events)
    return events


@pytest.mark.parametrize("seed", [1, 2])
def test_batch(spark, seed):
    events = some_events(seed, hot=200)
    df = spark.createDataFrame(events, SCHEMA).repartition(5)
    wanted, per_workspace = brute(events)
    assert {tuple(r) for r in jobs.states(df).collect()} == wanted
    assert {r.workspace: (r.revision, r.jobs, r.stale_events) for r in jobs.revisions(jobs.latest(df)).collect()} == per_workspace


def test_odd_events(spark):
    rows = [(None, 1, "a", 0, "load", None, None), ("w", None, "a", 0, "load", None, None), ("w", 1, "a", 0, "load", None, None), ("w", 1, "a", 5, "no such kind", None, None), ("w", 1, "b", 1, "start", None, None), ("w", 1, None, 0, "load", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in jobs.states(df).collect()] == [("w", 1, "a", "ready", None)]
    assert jobs.states(df.limit(0)).count() == 0 and jobs.revisions(jobs.latest(df.limit(0))).count() == 0


def test_stream_comes_to_the_same(spark, tmp_path):
    """Micro-batches in an order of their own; of what they tell, the last row of a job at the greatest revision is its state."""
    events = some_events(3)
    folder = tmp_path / "in"
    for n, at in enumerate(range(0, len(events), len(events) // 3 + 1)):
        spark.createDataFrame(events[at : at + len(events) // 3 + 1], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    told = []

    def keep(batch, n):
        told.extend((n, *r) for r in batch.collect())

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = streamed.job_states(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(180) and query.exception() is None
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert len({n for n, *_ in told}) >= 2
    wanted, per_workspace = brute(events)
    last = {}
    for n, w, r, j, status, error, stale in sorted(told, key=lambda t: (t[0], t[2])):
        if j is not None:
            last[w, j] = (w, r, j, status, error)
    top = {w: r for w, (r, _, _) in per_workspace.items()}
    assert {x for x in last.values() if x[1] == top[x[0]]} == wanted
    assert sum(t[6] or 0 for t in told) > 0
