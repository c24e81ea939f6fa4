"""A ledger of jobs told by what happened to them: queued, claimed, completed, failed with a cooldown, handed back, interrupted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.streaming import folds
from tidemark.streaming.folds import NEVER

COLUMNS = ["at", "id", "what", "error"]
SCHEMA = "status string, attempts bigint, enqueued_ms bigint, started_ms bigint, completed_ms bigint, next_ms bigint, last_error string"


class JobMachine:
    """Records (at, id, what, error). What a job's status doesn't allow changes nothing: a claim needs a pending job whose cooldown is over, an end or a release a running one."""

    def __init__(self, most: int, cooldown_ms: int) -> None:
        self.most, self.cooldown_ms = most, cooldown_ms
        self.status, self.attempts, self.queued, self.started, self.completed, self.next, self.error = None, 0, None, None, None, None, None

    def due(self) -> int:
        return NEVER

    def advance(self, now: int) -> list[tuple]:
        return []

    def _again(self, at: int | None) -> None:
        """Back to the queue while attempts are left."""
        left = self.attempts < self.most
        self.status, self.next = ("pending" if left else "failed"), (at if left else None)

    def take(self, record: tuple) -> list[tuple]:
        at, _, what, error = record
        running = self.status == "running"
        if what == "enqueue" and self.status is None:
            self.status, self.queued = "pending", at
        elif what == "claim" and self.status == "pending" and (self.next is None or self.next <= at):
            self.status, self.attempts, self.started = "running", self.attempts + 1, at
        elif what == "complete" and running:
            self.status, self.completed, self.next, self.error = "completed", at, None, None
        elif what == "fail" and running:
            self._again(at + self.cooldown_ms)
            self.error = error
        elif what == "release" and running:
            self.status, self.attempts, self.started, self.next, self.error = "pending", max(self.attempts - 1, 0), None, None, error
        elif what == "restart" and running:
            self._again(None)
            self.error = self.error if self.error is not None else "interrupted"
        return []

    def end(self) -> list[tuple]:
        return [(self.status, self.attempts, self.queued, self.started, self.completed, self.next, self.error)] if self.status else []


def job_states(events: DataFrame, keys: list[str], most: int = 3, cooldown_ms: int = 3_600_000) -> DataFrame:
    """keys and SCHEMA: where each job stands after its events (keys and COLUMNS), in order of time and id. what: enqueue, claim, complete, fail, release, restart; others are ignored.

    A failed attempt goes back to the queue after the cooldown until `most` attempts are spent; a release gives its attempt back; a restart ends
    what was running as interrupted. Jobs never queued have no row.
    """
    rows = events.where(F.col("at").isNotNull() & F.col("what").isin("enqueue", "claim", "complete", "fail", "release", "restart"))
    return folds.batch(rows.select(*keys, *COLUMNS), keys, COLUMNS, lambda k: JobMachine(most, cooldown_ms), SCHEMA)


def status_totals(states: DataFrame) -> DataFrame:
    """One row: jobs by status, 0 where there is none, and when the first of the pending ones can be claimed (0: at once, null: none is pending)."""
    count = lambda s: F.sum((F.col("status") == s).cast("bigint"))
    names = ("pending", "running", "completed", "failed")
    return states.agg(*(F.coalesce(count(s), F.lit(0)).alias(s) for s in names), F.min(F.when(F.col("status") == "pending", F.coalesce("next_ms", F.lit(0)))).alias("claimable_ms"))
