"""Lease queue: jobs are enqueued, claimed, kept alive, completed, failed and reaped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "status string, attempts int, lease_until long"
OUTPUT = "job_id long, status string, attempts int"
LEASE_S = 600
MAX_ATTEMPTS = 3
#: What each event does to a job.
ACTIONS = {"signup": "enqueue", "view": "claim", "click": "heartbeat", "purchase": "complete", "error": "fail"}


def step(state: tuple[str, int, int], action: str, at: int) -> tuple[str, int, int]:
    """The state (status, attempts, lease_until) of a job after one action at a second."""
    status, attempts, until = state
    if status == "running" and at > until:  # the lease ran out before this action
        status = "failed" if attempts >= MAX_ATTEMPTS else "pending"
    if action == "enqueue" and status in ("none", "succeeded", "failed"):
        return "pending", 0, 0
    if action == "claim" and status == "pending":
        return "running", attempts + 1, at + LEASE_S
    if action == "heartbeat" and status == "running":
        return "running", attempts, at + LEASE_S
    if action == "complete" and status == "running":
        return "succeeded", attempts, 0
    if action == "fail" and status == "running":
        return ("failed" if attempts >= MAX_ATTEMPTS else "pending"), attempts, 0
    return status, attempts, until


def replay(events: DataFrame) -> DataFrame:
    """T01-T05 in batch: events (job_id, event_id, at, action) folded per job in order.

    The fold is an array aggregate, so it stays in the JVM; a job's events are the unit of work.
    """
    s = lambda st, at, un: F.struct(st.cast("string").alias("status"), at.cast("int").alias("attempts"), un.cast("long").alias("until"))

    def fold(acc, e):
        spent = (acc.status == "running") & (e.at > acc.until)
        again = F.when(acc.attempts >= MAX_ATTEMPTS, "failed").otherwise("pending")
        status = F.when(spent, again).otherwise(acc.status)
        running = status == "running"
        lease = e.at + LEASE_S
        return (
            F.when((e.action == "enqueue") & status.isin("none", "succeeded", "failed"), s(F.lit("pending"), F.lit(0), F.lit(0)))
            .when((e.action == "claim") & (status == "pending"), s(F.lit("running"), acc.attempts + 1, lease))
            .when((e.action == "heartbeat") & running, s(F.lit("running"), acc.attempts, lease))
            .when((e.action == "complete") & running, s(F.lit("succeeded"), acc.attempts, F.lit(0)))
            .when((e.action == "fail") & running, s(again, acc.attempts, F.lit(0)))
            .otherwise(s(status, acc.attempts, acc.until))
        )

    start = s(F.lit("none"), F.lit(0), F.lit(0))
    jobs = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "action"))).alias("log"))
    return jobs.select("job_id", F.aggregate("log", start, fold).alias("state")).select("job_id", "state.status", "state.attempts")


def stream(events: DataFrame) -> DataFrame:
    """T01-T05 as a stream: the state of each job after every batch of its events."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = tuple(state.get) if state.exists else ("none", 0, 0)
        for e in pd.concat(list(batches)).sort_values(["at", "event_id"]).itertuples():
            own = step(own, e.action, int(e.at))
        state.update(own)
        yield pd.DataFrame({"job_id": [key[0]], "status": [own[0]], "attempts": [own[1]]})

    return events.groupBy("job_id").applyInPandasWithState(run, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def claimable(jobs: DataFrame, now: int) -> DataFrame:
    """The oldest runnable job of each snapshot: pending, or running with a spent lease."""
    ready = jobs.where((F.col("status") == "pending") | ((F.col("status") == "running") & (F.col("lease_until") < now)))
    w = Window.partitionBy("snapshot_id").orderBy("created_at", "job_id")
    return ready.where(F.col("attempts") < MAX_ATTEMPTS).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def snapshot_states(jobs: DataFrame) -> DataFrame:
    """A snapshot is failed if a job is, done if all are, else running."""
    bad, good = F.bool_or(F.col("status") == "failed"), F.bool_and(F.col("status") == "succeeded")
    return jobs.groupBy("snapshot_id").agg(F.when(bad, "failed").when(good, "done").otherwise("running").alias("state"), F.count("*").alias("n_jobs"))
