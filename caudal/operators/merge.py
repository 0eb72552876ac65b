"""Keyed merging: last wins, never overwrite with nothing, prune orphans, guard schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def last_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, whole, nulls included; ties fall to the greatest other values.

    One aggregate with map-side combining, so a hot key costs one row a map task. A null key part is a
    key value. An empty table gives an empty one.
    """
    rest = [c for c in df.columns if c not in keys and c not in order and not isinstance(df.schema[c].dataType, T.MapType)]
    maps = [c for c in df.columns if isinstance(df.schema[c].dataType, T.MapType)]
    packed = F.struct(*order, *rest, *[F.array_sort(F.map_entries(c)).alias(c) for c in maps])
    out = df.groupBy(*keys).agg(F.max(packed).alias("r"))
    return out.select(*[F.col(c) if c in keys else F.map_from_entries(f"r.{c}").alias(c) if c in maps else F.col(f"r.{c}").alias(c) for c in df.columns])


def filled(c: str, kind: T.DataType) -> Column:
    return _filled(F.col(f"`{c}`"), kind)


def _filled(col: Column, kind: T.DataType) -> Column:
    """The value, or null where it is a blank text, an empty array or map, or an empty JSON text."""
    if isinstance(kind, T.StringType):
        return F.when(~F.trim(col).isin("", "{}", "[]"), col)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.when(F.size(col) > 0, col)
    return col


def last_filled(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each key and column the last value by ``order`` that is filled: later nulls never overwrite.

    The result does not depend on how arrivals were batched. Ties in ``order`` fall to the greater value.
    """
    aggs = []
    for f in df.schema.fields:
        if f.name in keys:
            continue
        if f.name == order:
            aggs.append(F.max(order).alias(order))
        elif isinstance(f.dataType, T.MapType):
            v = filled(f.name, f.dataType)
            aggs.append(F.map_from_entries(F.max(F.when(v.isNotNull(), F.struct(F.col(order).alias("o"), F.array_sort(F.map_entries(v)).alias("v"))))["v"]).alias(f.name))
        else:
            v = filled(f.name, f.dataType)
            aggs.append(F.max(F.when(v.isNotNull(), F.struct(F.col(order).alias("o"), v.alias("v"))))["v"].alias(f.name))
    return df.groupBy(*keys).agg(*aggs).select(*df.columns)


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], only_fill: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``target`` with the rows of ``incoming`` inserted or merged; both must have unique keys.

    With ``only_fill`` an incoming value counts only if it is filled, else it replaces what was there.
    Columns named in ``keep`` stay as in the target. Null key parts match each other.
    """
    keep = keep or []
    a, b = target.alias("t"), incoming.alias("i")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"t.{k}").eqNullSafe(F.col(f"i.{k}"))
    joined = a.withColumn("in_t", F.lit(True)).alias("t").join(b.withColumn("in_i", F.lit(True)).alias("i"), on, "full")
    out = []
    for f in target.schema.fields:
        t, i = F.col(f"t.{f.name}"), F.col(f"i.{f.name}") if f.name in incoming.columns else F.lit(None)
        if f.name in keys:
            out.append(F.when(F.col("in_i"), i).otherwise(t).alias(f.name))
        elif f.name in keep:
            out.append(F.when(F.col("in_t"), t).otherwise(i).alias(f.name))
        elif only_fill:
            if f.name not in incoming.columns:
                out.append(t.alias(f.name))
            else:
                out.append(F.coalesce(_filled(i, f.dataType), t).alias(f.name))
        else:
            out.append(F.when(F.col("in_i"), i).otherwise(t).alias(f.name))
    return joined.select(*out)


def insert_new(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key ``target`` lacks, each key once: insert, or do nothing on conflict."""
    return last_rows(incoming, keys, []).join(target.select(*keys), keys, "left_anti")


def prune_orphans(links: DataFrame, parents: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Links whose every parent exists; ``parents`` lists (table, its key, the link's column)."""
    for table, key, column in parents:
        links = links.join(table.select(F.col(key).alias(column)).where(F.col(column).isNotNull()).distinct(), column, "left_semi")
    return links


def fill_from(rows: DataFrame, source: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Blank values of ``rows`` filled from ``source`` (unique keys): row column -> source column."""
    side = source.select(*keys, *[F.col(s).alias(f"__{r}") for r, s in columns.items()])
    joined = rows.join(side, keys, "left")
    return joined.select(*[F.coalesce(filled(c, rows.schema[c].dataType), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns])


# Names of columns that must not enter curated tables, of judgements, term weights and embeddings.
FORBIDDEN_JUDGEMENTS = [
    "opportunity_rank", "opportunity_score", "winnability_score", "convenience_score", "win_probability", "award_probability", "forecast_value", "forecast_label", "anomaly_verdict", "recommendation_score",
]
FORBIDDEN_WEIGHTS = ["tfidf_vector", "tfidf_values", "tfidf_matrix"]
FORBIDDEN_EMBEDDINGS = ["embedding", "embeddings", "embedding_vector", "dense_vector", "sentence_embedding"]
FORBIDDEN_NAMES = [*FORBIDDEN_JUDGEMENTS, *FORBIDDEN_WEIGHTS, *FORBIDDEN_EMBEDDINGS]
FORBIDDEN_SUFFIXES = ["_score", "_probability", "_forecast", "_prediction", "_rank"]
FORBIDDEN_PREFIXES = ["future_"]


def guard_features(df: DataFrame, reference_column: str | None = None) -> list[str]:
    """What breaks the rules for curated tables: forbidden column names, and references that are no ``tfidf://``."""
    bad = [c for c in df.columns if c in FORBIDDEN_NAMES or c.endswith(tuple(FORBIDDEN_SUFFIXES)) or c.startswith(tuple(FORBIDDEN_PREFIXES))]
    found = [f"forbidden column {c}" for c in bad]
    if reference_column and reference_column in df.columns:
        n = df.select(F.count_if(F.col(reference_column).isNotNull() & ~F.col(reference_column).startswith("tfidf://")).alias("n")).first()["n"]
        if n:
            found.append(f"{n} values of {reference_column} are no reference")
    return found


def key_problems(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows with a null key part, keys held by more than one row, and the rows of those."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).cast("long").alias("null_keys"),
        F.count_if(~null & (F.col("n") > 1)).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(~null & (F.col("n") > 1), F.col("n"))), F.lit(0)).cast("long").alias("repeated_rows"),
    )


def required_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that are missing, sorted; the comparison is case-sensitive."""
    return sorted(set(required) - set(df.columns))


def canonical_headers(names: list[str], aliases: dict[str, str]) -> list[str]:
    """Headers trimmed, freed of a byte-order mark, aliases replaced."""
    return [aliases.get(n, n) for n in (re.sub(r"^﻿", "", n).strip() for n in names)]
