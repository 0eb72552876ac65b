"""Choosing one row per key, ranking, paging."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """The row of each key that is greatest by ``order`` (nulls last), as one aggregate: no window over a hot key.

    Only ``columns`` (all where None) are read, combined and shuffled: name the ones used, since the optimizer can't
    prune a packed row. Give a unique last order column for a defined choice among ties.
    """
    packed = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*(columns or df.columns)).alias("row"))
    return df.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.max(packed).alias("m")).select("m.row.*")


def mode_rank(mode: Column, ranks: dict[str, int], other: int) -> Column:
    """Rank of a source mode; the lower the more it is trusted."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[mode], F.lit(other))


# Trust in the modes of snapshots.
MODES = {"detail-by-codigo": 0, "rolling-window": 1}


def latest_snapshots(df: DataFrame, key: str, mode: str | None, synced: str, unique: str, columns: list[str] | None = None) -> DataFrame:
    """Latest snapshot of each notice: by trusted mode first where ``mode`` is given, then time, then id."""
    order = ([-mode_rank(F.col(mode), MODES, 2)] if mode else []) + [F.col(synced), F.col(unique)]
    return latest(df, [key], order, columns)


def contains_any(columns: list[str], text: str) -> Column:
    """Case-insensitive containment of ``text`` in any column; its wildcards count as such."""
    return F.coalesce(reduce(or_, [F.col(c).ilike(f"%{text}%") for c in columns]), F.lit(False))


def search(df: DataFrame, contains: dict[str, tuple[list[str], str | None]] | None = None, equal: dict[str, object] | None = None, ranges: dict[str, tuple[object, object]] | None = None, days: dict[str, tuple[str | None, str | None]] | None = None) -> DataFrame:
    """Rows that meet every filter given; filters that are None are not in the plan at all.

    ``contains`` name -> (columns, text), ``equal`` column -> value, ``ranges`` column -> (least, greatest)
    inclusive, ``days`` column -> (first, last day), the last day whole.
    """
    tests = [contains_any(cols, t) for cols, t in (contains or {}).values() if t]
    tests += [F.col(c) == F.lit(v) for c, v in (equal or {}).items() if v is not None]
    for c, (lo, hi) in (ranges or {}).items():
        tests += [F.col(c) >= lo] if lo is not None else []
        tests += [F.col(c) <= hi] if hi is not None else []
    for c, (first, last) in (days or {}).items():
        tests += [F.col(c) >= F.lit(first).cast("timestamp_ntz")] if first else []
        tests += [F.col(c) < F.lit(last).cast("timestamp_ntz") + F.expr("interval 1 day")] if last else []
    return df.where(reduce(and_, tests)) if tests else df


def page(df: DataFrame, by: str, descending: bool, tie: list[str], number: int, size: int) -> DataFrame:
    """One page of the rows ordered by ``by`` (nulls last either way) and ``tie``; pages count from 1."""
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return df.orderBy(first, *[F.col(t).asc_nulls_last() for t in tie]).offset((number - 1) * size).limit(size)
