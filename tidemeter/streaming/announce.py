"""What is said or done once, however often a batch is tried: announcements and hooks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policy
from ..sources import claims


def once(root: str, say: Callable[[DataFrame], None], now_ms: int, top: int = policy.BROAD) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: ``say`` gets what is worth saying of a batch, at most once.

    The batch's number is claimed before anything is said. A run that dies
    between the two loses that batch: a warning that nobody hears costs less than one that is heard twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        if claims.claim(batch.sparkSession, root, f"batch-{number}"):
            say(policy.capped(batch.where(policy.worth_saying("kind", "state", "eta_ms", F.lit(now_ms))), top))

    return write


def hook_outcomes(hooks: list[dict], events: DataFrame, now_ms: int) -> DataFrame:
    """(hook_id, status, event_id) of hooks (configuration, as policy.hook_matches() takes them) by ``now_ms``.

    A pending hook fires at the first event that it is about behind its cursor that came by its expiry, even if
    that has passed meanwhile; without one it is expired once that has passed. Settled hooks stay as they are.
    """
    own = events.sparkSession.createDataFrame([(h["hook_id"], h["status"], h["expires_ms"]) for h in hooks], "hook_id long, status string, expires_ms long")
    got = own.join(policy.hook_matches(hooks, events), "hook_id", "left")
    status = F.when(F.col("status") != "pending", F.col("status")).when(F.col("event_id").isNotNull(), "fired").when(F.col("expires_ms") <= now_ms, "expired").otherwise("pending")
    return got.select("hook_id", status.alias("status"), "event_id")


def fire(spark: SparkSession, root: str, outcomes: DataFrame, run: Callable[[int, int], None]) -> list[int]:
    """Run each hook that outcomes say fires, unless somebody has claimed it; returns those that ran here. The claim comes first, so a hook never runs twice."""
    done = []
    for r in outcomes.where("status = 'fired' and event_id is not null").toLocalIterator():
        if claims.claim(spark, root, f"hook-{r.hook_id}"):
            run(r.hook_id, r.event_id)
            done.append(r.hook_id)
    return done
