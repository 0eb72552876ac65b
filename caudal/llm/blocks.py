"""Blocks of records for pairwise comparison, split where they are hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.scale import broadcast_if_small, materialize


def split_hot(keyed: DataFrame, values: list[Column], most: int, side: str | None = None) -> DataFrame:
    """``keyed`` (block and other columns) with blocks of which none gives more than ``most`` pairs, as far as values tell apart.

    ``values`` are array columns: what is known of a record in some respect, empty where it is unknown; records
    without a common value contradict. A hot block is split by the first of them, what is still hot by the next,
    and so on. Records of one value meet in the block of that value. Records of unknown value meet each other and
    all records of known value in one more block, where bit ``level`` of ``known_at`` marks the latter: two records
    of a block meet if no bit is set in both (``may_meet``). So a split parts no two records that don't contradict.
    ``side`` names a column of 0 and 1 if only records of different sides meet.

    Result: the columns of ``keyed`` and ``known_at``.
    """
    live = keyed.withColumn("known_at", F.lit(0))
    names, done = live.columns, None
    for level in range(len(values) + 1):
        live = materialize(live)
        if level == len(values):
            return done.unionByName(live)
        masks = range(1 << level)
        if side:
            n = [[F.count_if((F.col("known_at") == m) & (F.col(side) == s)) for m in masks] for s in (0, 1)]
            pairs = sum((n[0][i] * n[1][k] for i in masks for k in masks if not i & k), F.lit(0))
        else:
            n = [F.count_if(F.col("known_at") == m) for m in masks]
            pairs = sum((n[i] * n[k] for i in masks for k in masks if i < k and not i & k), n[0] * (n[0] - 1) / 2)
        hot = materialize(live.groupBy("block").agg(pairs.alias("pairs")).where(F.col("pairs") > most).select("block"))
        if hot.isEmpty():
            return live if done is None else done.unionByName(live)
        hot = broadcast_if_small(hot)
        cool = live.join(hot, "block", "left_anti").select(*names)
        done = cool if done is None else done.unionByName(cool)
        own, known = values[level], F.size(values[level]) > 0
        bit = F.col("known_at").bitwiseOR(F.when(known, 1 << level).otherwise(0))

        def part(v: Column) -> Column:
            return F.xxhash64("block", F.lit(level), v)

        parts = F.transform(own, lambda v: F.struct(part(v).alias("block"), F.col("known_at").alias("known_at")))
        rest = F.array(F.struct(F.xxhash64("block", F.lit(-1 - level)).alias("block"), bit.alias("known_at")))
        split = live.join(hot, "block", "left_semi").withColumn("e", F.explode(F.concat(parts, rest)))
        live = split.withColumn("block", F.col("e.block")).withColumn("known_at", F.col("e.known_at")).select(*names)
    raise AssertionError


def may_meet(left: str, right: str) -> Column:
    """Whether records ``left`` and ``right`` are of one block and may meet there."""
    return (F.col(f"{left}.block") == F.col(f"{right}.block")) & (F.col(f"{left}.known_at").bitwiseAND(F.col(f"{right}.known_at")) == 0)
