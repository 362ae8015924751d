"""Queries of the job states: documents as jobs of workspaces that are loaded anew while results still come in.

Forty documents are a workspace, loaded one to three times; every fifth workspace is
reset at last. Odd revisions analyze, even ones sanitize in safe mode and look again;
texts of more than 6,000 characters fail there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import rules
from glyphmill.functions import text as tx
from glyphmill.operators import jobs
from glyphmill.plans.text import DOCS, Query, docs, sql_has, sql_sanitize

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FILES, LONGEST = 40, 6_000

EVENTS = f"""
{DOCS},
judged as (select doc_id, doc_id // {FILES} as workspace, length(mt) as n, {sql_has(sql_sanitize('mt', 'safe'), rules.ALL)} as marked from docs),
loads as (select *, unnest(range(1, workspace % 3 + 2)) as revision from judged),
told as (select *, unnest(range(0, 3)) as seq from loads),
events as (
  select workspace, revision, cast(doc_id as varchar) as job_id, seq,
         case when seq = 0 then 'load' when seq = 1 then 'start' when n > {LONGEST} then 'failed' when revision % 2 = 1 then 'analyzed' when marked then 'unverified' else 'verified' end as kind
  from told
  union all select distinct workspace, workspace % 3 + 2, null, 0, 'reset' from judged where workspace % 5 = 4
)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of all loads, in no order."""
    text = F.col("text")
    clean = F.coalesce(tx.finding_count(tx.sanitize(text, "safe")) == 0, F.lit(True))
    judged = docs(spark, sf_dir).select("doc_id", F.expr(f"doc_id div {FILES}").alias("workspace"), F.length("text").alias("n"), clean.alias("clean"))
    loads = judged.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("workspace") % 3 + 1)).alias("revision"))
    told = loads.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("seq"))
    result = F.when(F.col("n") > LONGEST, "failed").when(F.col("revision") % 2 == 1, "analyzed").when(F.col("clean"), "verified").otherwise("unverified")
    kind = F.when(F.col("seq") == 0, "load").when(F.col("seq") == 1, "start").otherwise(result)
    own = told.select("workspace", "revision", F.col("doc_id").cast("string").alias("job_id"), "seq", kind.alias("kind"), F.when(kind == "failed", "too long").alias("detail"))
    none = F.lit(None).cast("string")
    resets = judged.where("workspace % 5 = 4").select("workspace").distinct().select("workspace", (F.col("workspace") % 3 + 2).alias("revision"), none.alias("job_id"), F.lit(0).alias("seq"), F.lit("reset").alias("kind"), none.alias("detail"))
    return own.unionAll(resets)


def q_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job of each workspace's last revision, with its state; results of older revisions have no effect."""
    return jobs.states(events(spark, sf_dir))


SQL["q_job_states"] = f"""
with {EVENTS},
live as (select *, row_number() over (partition by workspace, revision, job_id order by seq desc) as last from events where revision = (select max(revision) from events e where e.workspace = events.workspace))
select workspace, revision, job_id, case kind when 'analyzed' then 'analyzed' when 'verified' then 'verified' when 'start' then 'working' when 'load' then 'ready' else 'error' end as status,
       case kind when 'unverified' then 'verification-failed' when 'failed' then 'too long' end as error
from live where last = 1 and kind <> 'reset'
"""


def q_stale_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each workspace's last revision, its jobs, and the events that came from older revisions."""
    return jobs.revisions(jobs.latest(events(spark, sf_dir)))


SQL["q_stale_results"] = f"""
with {EVENTS}, top as (select workspace, max(revision) as revision from events group by workspace)
select top.workspace, top.revision, count(distinct case when events.revision = top.revision and kind = 'load' then job_id end) as jobs, count(*) filter (events.revision < top.revision) as stale_events
from events join top using (workspace) group by 1, 2
"""
QUERIES |= {f.__name__: f for f in (q_job_states, q_stale_results)}
