"""Rows for callers: names and values as they are served, first of each key, next page by key, worker steps, stored summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.operators.ledger import claim_next, fail_job, promote_retries, summary_of_day


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(p.capitalize() for p in rest)


def served(df: DataFrame) -> DataFrame:
    """Columns in camel case, decimals as doubles, dates and times as ISO text; fractions of a second only where there are any."""

    def value(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double")
        if isinstance(f.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_trunc("second", c.cast("timestamp")) == c.cast("timestamp")
            return F.when(whole, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        return c

    return df.select(*[value(f).alias(camel(f.name)) for f in df.schema.fields])


def first_of_each(df: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of each key by ``position``; rows without a key are left out."""
    rest = [c for c in df.columns if c not in (key, position)]
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(position, *rest)).alias("r"))
    return out.select(*[F.col(c) if c == key else F.col(f"r.{c}").alias(c) for c in df.columns])


def next_by_key(df: DataFrame, key: str, last: object, size: int, equal: dict[str, object] | None = None) -> DataFrame:
    """The next ``size`` rows by ``key`` after ``last``; the filters reach the scan. The size is that of a page."""
    for column, value in (equal or {}).items():
        df = df if value is None else df.where(F.col(column) == F.lit(value))
    return df.where(F.col(key) > F.lit(last)).orderBy(key).limit(size)


def work(jobs: DataFrame, now: Column, worker: str, handlers: dict[str, Callable[[dict], None]], kind: str = "kind", delay_seconds: int = 60) -> DataFrame:
    """One step of a worker: claim the next job, hand it to its handler, and note how it ended.

    A handler that raises ``ValueError``, or is missing, fails the job for good; any other error has it tried
    again while attempts are left. Without a job the table comes back as it was.
    """
    claimed = claim_next(promote_retries(jobs, now), now, worker)
    job = claimed.where((F.col("status") == "running") & (F.col("worker") == worker)).orderBy(F.col("attempts").desc(), "id").first()
    if job is None:
        return claimed
    try:
        handler = handlers.get(job[kind])
        if handler is None:
            raise ValueError(f"no handler for {job[kind]}")
        handler(job.asDict())
    except Exception as e:  # noqa: BLE001
        return fail_job(claimed, job["id"], not isinstance(e, ValueError), delay_seconds, now)
    mine = F.col("id") == job["id"]
    return claimed.withColumn("status", F.when(mine, "done").otherwise(F.col("status")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row a table: its number of rows."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("table_name"), "n") for k, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(stored: DataFrame, day: Column, fresh: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The summary stored for ``day`` and False, or, where there is none, a fresh one and True: it is to be stored."""
    kept = summary_of_day(stored, day)
    return (fresh(), True) if kept.isEmpty() else (kept, False)
