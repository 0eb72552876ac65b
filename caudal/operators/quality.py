"""Load metrics with conservation checks, quality issues and the gate decision."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Part of rejected rows above which a load fails.
MOST_REJECTED = 0.005


@dataclass(frozen=True)
class LoadMetrics:
    entity: str
    processed: int
    accepted: int
    deduplicated: int
    inserted: int
    existing: int

    @property
    def rejected(self) -> int:
        return self.processed - self.accepted

    def check(self) -> None:
        """Raise where the counts do not add up."""
        if min(asdict(self)[k] for k in ("processed", "accepted", "deduplicated", "inserted", "existing")) < 0:
            raise ValueError(f"{self.entity}: a count is negative")
        if self.accepted > self.processed or self.deduplicated > self.accepted or self.inserted + self.existing != self.deduplicated:
            raise ValueError(f"{self.entity}: counts do not add up")


def load_metrics(entity: str, raw: DataFrame, accepted: DataFrame, target_before: DataFrame, keys: list[str]) -> LoadMetrics:
    """Counts of one load: rows read, accepted, distinct by key, new and already there."""
    known = target_before.select(*keys).distinct().withColumn("__known", F.lit(1))
    groups = accepted.groupBy(*keys).agg(F.count("*").alias("__n")).join(known, keys, "left")
    taken = groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("accepted"), F.count("*").alias("distinct"), F.count_if(F.col("__known").isNull()).alias("new")).first()
    out = LoadMetrics(entity, raw.count(), taken["accepted"], taken["distinct"], taken["new"], taken["distinct"] - taken["new"])
    out.check()
    return out


def gate(metrics: list[LoadMetrics], issues: int = 0, most: float = MOST_REJECTED) -> str:
    """``failed`` if any entity rejects over ``most`` of its rows, ``warning`` with issues or rejects, else ``passed``."""
    if any(m.processed and m.rejected / m.processed > most for m in metrics):
        return "failed"
    return "warning" if issues or any(m.rejected for m in metrics) else "passed"


def audit(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: the number of rows, and of rows that fail each check (a check is true of a failing row)."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(name) for name, c in checks.items()])
