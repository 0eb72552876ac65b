"""Changes between consecutive full snapshots of one table (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_changes(
    df: DataFrame, snapshot: Column, key: Column, recency: list[Column], compared: dict[str, Column]
) -> DataFrame:
    """Label what was added, removed or changed between each snapshot and the one before it.

    ``snapshot``/``key`` identify a record, ``recency`` orders superseded rows of one record within a
    snapshot (greatest wins, ties fall to the greater compared values) and ``compared`` names the
    values whose change counts. Result: snapshot, key, change_kind and old_/new_ of each value.

    The identical rows of two snapshots are removed by EXCEPT ALL in both directions; both are had from
    one aggregate: a row counts +1 for its own snapshot's comparison and -1 for the next one's, so what
    is left over is the positive and the negative residue. The residues are full-joined by key, again
    as one aggregate, since either side has at most one row a key.

    Nulls: a null key is a key of its own, a null compared value is a value, a null recency is the
    oldest, rows without a snapshot belong to none and are left out. A single snapshot gives no rows.
    Hot keys are combined before each shuffle; after the first aggregate a key has one row a snapshot.
    """
    names = list(compared)
    state = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(recency)], *[c.alias(n) for n, c in compared.items()])
    latest = (
        df.select(snapshot.alias("snapshot"), key.alias("key"), state.alias("state"))
        .where(F.col("snapshot").isNotNull())
        .groupBy("snapshot", "key")
        .agg(F.max("state").alias("state"))
        .select("snapshot", "key", *[F.col(f"state.{n}").alias(n) for n in names])
    )
    # The dates are as many as snapshots were taken, never as many as rows.
    order = Window.orderBy("snapshot")
    dates = (
        df.select(snapshot.alias("snapshot"))
        .where(F.col("snapshot").isNotNull())
        .distinct()
        .select("snapshot", F.lag("snapshot").over(order).alias("before"), F.lead("snapshot").over(order).alias("after"))
    )
    sides = F.array(
        F.when(F.col("before").isNotNull(), F.struct(F.col("snapshot").alias("at"), F.lit(1).alias("side"))),
        F.when(F.col("after").isNotNull(), F.struct(F.col("after").alias("at"), F.lit(-1).alias("side"))),
    )
    residue = (
        latest.join(F.broadcast(dates), "snapshot")
        .select("key", *names, F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("s"))
        .groupBy("s.at", "key", *names)
        .agg(F.sum("s.side").alias("left_over"))
        .where("left_over <> 0")
    )
    row = F.struct(*names)
    joined = residue.groupBy("at", "key").agg(
        F.max(F.when(F.col("left_over") > 0, row)).alias("new"), F.max(F.when(F.col("left_over") < 0, row)).alias("old")
    )
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return joined.select(
        F.col("at").alias("snapshot"),
        "key",
        kind.alias("change_kind"),
        *[F.col(f"old.{n}").alias(f"old_{n}") for n in names],
        *[F.col(f"new.{n}").alias(f"new_{n}") for n in names],
    )
