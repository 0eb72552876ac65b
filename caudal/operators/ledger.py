"""Operational ledger as pure transitions over small frames: queue, retries, windows, runs."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal.scale import materialize


def rolling_days(until: date, days: int = 4) -> list[date]:
    """The last ``days`` days up to ``until``, newest first."""
    return [until - timedelta(days=i) for i in range(days)]


def weekday_anchor(day: date) -> date:
    """Saturday and Sunday count as the Friday before."""
    return day - timedelta(days=max(0, day.weekday() - 4))


def promote_retries(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs waiting for a retry whose time has come are available again."""
    due = (F.col("status") == "retry") & (F.col("available_at") <= now)
    return jobs.withColumn("status", F.when(due, "available").otherwise(F.col("status")))


def claim_next(jobs: DataFrame, now: Column, worker: str) -> DataFrame:
    """The table with its next job claimed: least priority number, then time, then id; one attempt more."""
    ready = jobs.where((F.col("status") == "available") & (F.col("available_at") <= now))
    first = ready.orderBy("priority", "available_at", "created_at", "id").limit(1).select(F.col("id").alias("claimed"))
    joined = jobs.join(F.broadcast(first), F.col("id") == F.col("claimed"), "left")
    taken = F.col("claimed").isNotNull()
    changed = {
        "status": F.when(taken, "running").otherwise(F.col("status")),
        "attempts": F.col("attempts") + taken.cast("int"),
        "worker": F.when(taken, worker).otherwise(F.col("worker")),
    }
    return joined.withColumns(changed).select(*jobs.columns)


def fail_job(jobs: DataFrame, job: int, retryable: bool, delay_seconds: int, now: Column) -> DataFrame:
    """A failed job waits ``delay_seconds`` times its attempts, or is dead when attempts are used up or pointless."""
    mine = F.col("id") == job
    again = F.lit(retryable) & (F.col("attempts") < F.col("max_attempts"))
    later = F.timestamp_seconds(F.unix_seconds(now.cast("timestamp")) + F.lit(delay_seconds) * F.col("attempts"))
    kind = dict(jobs.dtypes)["available_at"]
    return jobs.withColumns({"status": F.when(mine & again, "retry").when(mine, "dead").otherwise(F.col("status")), "available_at": F.when(mine & again, later.cast(kind)).otherwise(F.col("available_at"))})


def within_budget(requests: DataFrame, used: int, budget: int) -> DataFrame:
    """Requests in order of ``seq`` until their cost exceeds what the day's budget leaves.

    Running sums within ranges of ``seq``, each a task, from the sums of the ranges before: no task holds all rows.
    """
    # Written, as the ranges must stay the same for both uses.
    ranged = materialize(requests.repartitionByRange("seq").withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = ranged.groupBy("__range").agg(F.sum("cost_units").alias("s")).select("__range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("__range").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.col("start") + F.sum("cost_units").over(within)
    return ranged.join(F.broadcast(ranges), "__range").withColumn("spent", spent).where(F.col("spent") <= budget - used).select(*requests.columns)


def close_stale(runs: DataFrame, now: Column, hours: int) -> DataFrame:
    """Runs said to be running for longer than ``hours`` become failed."""
    stale = (F.col("status") == "running") & (F.unix_seconds(F.col("started_at").cast("timestamp")) < F.unix_seconds(now.cast("timestamp")) - hours * 3600)
    return runs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def detail_candidates(notices: DataFrame, target: Column, open_days: int = 7, stale_days: int = 7, most: int = 50) -> DataFrame:
    """Notices to fetch in detail: those closing soon first, then by close date, then the longest unseen.

    A notice without close date comes last, one never seen in detail first; the limit is the request budget.
    """
    closing = (F.col("close_date") > target) & (F.col("close_date") <= F.date_add(target, open_days))
    stale = F.col("detail_date").isNull() | (F.datediff(target, F.col("detail_date")) >= stale_days)
    ranked = notices.where(stale).withColumn("rank_open", F.when(closing, 0).otherwise(1))
    return ranked.orderBy("rank_open", F.col("close_date").asc_nulls_last(), F.col("detail_date").asc_nulls_first(), "code").limit(most)


def newest(runs: DataFrame, by: str, tie: str, most: int = 200, **equal: object) -> DataFrame:
    """The newest runs or files, filtered by the values given; the limit is the size of the listing."""
    for column, value in equal.items():
        runs = runs if value is None else runs.where(F.col(column) == F.lit(value))
    return runs.orderBy(F.col(by).desc_nulls_last(), F.col(tie).desc_nulls_last()).limit(most)


def summary_of_day(snapshots: DataFrame, day: Column) -> DataFrame:
    """The stored summary to serve on ``day``: the latest generated that day, else none (a fresh one is due)."""
    today = snapshots.where(F.to_date("generated_at") == day)
    return today.orderBy(F.col("generated_at").desc(), F.col("id").desc()).limit(1)
