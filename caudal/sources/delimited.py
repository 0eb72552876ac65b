"""Delimited records held as text: parse, check and split into loaded and rejected rows (problem 2)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.functions.text import utrim
from caudal.scale import broadcast_if_small, materialize

# Spellings of null.
NULLS = ["", "NA", "N/A", "NULL", "1900-01-01"]
# Date patterns and the shape each demands.
DATES = [
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("ddMMyyyy", r"^\d{8}$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"),
]
NUMBER_LIMIT = "100000000000000"
_SIGN = r"^(?:[+-]?\$?|\$[+-])"
_EXPONENT = r"(?:[eE][+-]?\d+)?$"
_PLAIN = _SIGN + r"\d+(?:[.,]\d+)?" + _EXPONENT
_DOTTED = _SIGN + r"\d{1,3}(?:\.\d{3})+(?:,\d+)?" + _EXPONENT
_COMMAED = _SIGN + r"\d{1,3}(?:,\d{3})+(?:\.\d+)?" + _EXPONENT

PARSED = T.StructType([T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("problem", T.StringType())])


@dataclass(frozen=True)
class Feed:
    """What is checked in a feed: columns that must not be null, hold a date, or hold a number."""

    keys: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    numbers: list[str] = field(default_factory=list)


def split_record(text: str | None, sep: str = ";", quote: str = '"') -> tuple[list[str], str | None]:
    """Fields of one record and what is wrong with its quoting.

    A quote opens a quoted field only where the field begins; doubled quotes inside stand for one; a
    quote elsewhere is plain text. Null text gives no fields and ``no_text``.
    """
    if text is None:
        return [], "no_text"
    text = text[:-2] if text.endswith("\r\n") else text[:-1] if text[-1:] in ("\n", "\r") else text
    if quote not in text:
        return text.split(sep), None
    fields: list[str] = []
    problem, at, n = None, 0, len(text)
    while True:
        if text.startswith(quote, at):
            close = text.find(quote, at + 1)
            while close >= 0 and text.startswith(quote, close + 1):
                close = text.find(quote, close + 2)
            if close < 0:
                fields.append(text[at + 1 :].replace(quote * 2, quote))
                return fields, "quote_not_closed"
            value, at = text[at + 1 : close].replace(quote * 2, quote), close + 1
            if at < n and text[at] != sep:
                problem = problem or "text_after_quote"
                end = text.find(sep, at)
                end = n if end < 0 else end
                value, at = value + text[at:end], end
            fields.append(value)
        else:
            end = text.find(sep, at)
            end = n if end < 0 else end
            fields.append(text[at:end])
            at = end
        if at >= n:
            return fields, problem
        at += 1


@F.pandas_udf(PARSED)
def _parse(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_record(t) for t in texts], columns=["fields", "problem"])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_null_word(c: Column) -> Column:
    """Null, or one of the null spellings after trimming, in any case."""
    return F.coalesce(F.upper(utrim(c)), F.lit("")).isin(NULLS)


def date_problem(value: Column) -> Column:
    """Reason why trimmed ``value`` is no date; null if it is one or stands for null."""
    real = F.lit(False)
    for pattern, shape in DATES:
        real = real | (value.rlike(shape) & F.try_to_timestamp(F.when(value.rlike(shape), value), F.lit(pattern)).isNotNull())
    shaped = F.lit(False)
    for _, shape in DATES:
        shaped = shaped | value.rlike(shape)
    return F.when(is_null_word(value) | F.coalesce(real, F.lit(False)), None).when(shaped, "no_such_date").otherwise("not_a_date")


def number_value(value: Column) -> Column:
    """Decimal(38,18) of a tolerant number text, null where it is none or beyond 20 integer digits."""
    return _let(F.regexp_replace(value, r"(?U)\s+", ""), _number_of)


def _number_of(tight: Column) -> Column:
    bare = F.when(
        tight.rlike(_DOTTED) & ~tight.rlike(r"^[^.]*\.\d{3}(?:[eE]|$)"),
        F.translate(F.regexp_replace(tight, r"\.", ""), ",", "."),
    ).when(tight.rlike(_COMMAED) & ~tight.rlike(r"^[^,]*,\d{3}(?:[eE]|$)"), F.regexp_replace(tight, ",", ""))
    # One group mark alone (1.234 or 1,234) is a thousand, like more of them.
    bare = F.coalesce(
        bare,
        F.when(tight.rlike(_DOTTED), F.regexp_replace(tight, r"\.", "")),
        F.when(tight.rlike(_COMMAED), F.regexp_replace(tight, ",", "")),
        F.when(tight.rlike(_PLAIN), F.translate(tight, ",", ".")),
    )

    def cast(b: Column) -> Column:
        # Exponents of four digits and more leave nothing or everything of the value.
        kept = F.when(b.rlike(r"[eE]-\d{4,}$") | b.rlike(r"^-?[0.]+[eE]"), F.lit("0")).when(b.rlike(r"[eE]0*[1-9]\d{3,}$"), None).otherwise(b)
        return kept.try_cast("decimal(38,18)")

    return _let(F.regexp_replace(bare, r"[$+]", ""), cast)


def number_problem(value: Column) -> Column:
    """Reason why trimmed ``value`` is no number below the limit; null if it is one or stands for null."""

    def problem(tight: Column) -> Column:
        shaped = tight.rlike(_PLAIN) | tight.rlike(_DOTTED) | tight.rlike(_COMMAED)
        within = F.coalesce(F.abs(_number_of(tight)) < F.lit(NUMBER_LIMIT).cast("decimal(38,18)"), F.lit(False))
        return F.when(shaped, F.when(~within, "number_too_large")).otherwise("not_a_number")

    return F.when(~is_null_word(value), _let(F.regexp_replace(value, r"(?U)\s+", ""), problem))


def parse_feed(df: DataFrame, feed: Feed, file: str = "source_file_id", row: str = "raw_row_num", text: str = "raw_text", keep_values: bool = True) -> DataFrame:
    """Each non-header record of ``df`` with its named fields and the reasons why it fails.

    Result: file, row, values (map of header name to text, only where the field count is right, and only
    with ``keep_values``), reasons (array, empty for a valid record). Record 0 of a file is its header; its names are trimmed
    and freed of a byte-order mark. Records of a file without header fail with ``no_header``; of
    several headers of a file the least text counts. A checked column that the header lacks fails a
    key column (``missing_key:``) and is null otherwise. Repeated records are kept, each by itself.

    Distinct values of the date and number columns are cast once; the invalid ones form a dictionary
    that is joined back (broadcast when measured small). Key columns need no dictionary beyond the
    fixed null spellings: their values are as many as the rows.
    """
    # Only the contract's columns: extra columns of df may bear the names used below.
    base = df.select(F.col(file).alias("file"), F.col(row).cast("long").alias("row"), F.col(text).alias("text"))
    checked = [("key", c) for c in feed.keys] + [("date", c) for c in feed.dates] + [("number", c) for c in feed.numbers]
    header = (
        base.where("row = 0")
        .groupBy("file")
        .agg(F.min("text").alias("text"))
        .select("file", F.transform(_parse(F.regexp_replace("text", "^﻿", "")).fields, lambda x: utrim(x)).alias("header"))
    )
    records = base.where("row <> 0 OR row IS NULL").select("file", "row", _parse("text").alias("p")).select("file", "row", "p.*")
    rows = records.join(broadcast_if_small(materialize(header)), "file", "left")
    fits = F.size("header") == F.size("fields")

    def cell(name: str) -> Column:
        return F.when(fits, F.get(F.col("fields"), F.array_position("header", name).cast("int") - 1))

    # Each cell is looked up, trimmed and tested for null once.
    cells = {c: f"c{i}" for i, (_, c) in enumerate(checked)}
    rows = rows.withColumn("fits", fits).withColumns({v: utrim(cell(c)) for c, v in cells.items()})
    rows = rows.withColumns({v: F.when(~is_null_word(F.col(v)), F.col(v)) for v in cells.values()})
    structure = F.array(
        F.col("problem"),
        F.when(F.col("header").isNull(), "no_header").when(~F.col("fits") & F.col("problem").isNull(), "field_count"),
        *[F.when(F.col("fits") & F.col(cells[c]).isNull(), F.concat(F.lit("missing_key:"), F.lit(c))) for c in feed.keys],
    )
    named = F.map_from_arrays(F.transform("header", lambda x, i: F.when(F.array_position("header", x) == i + 1, x).otherwise(F.concat(x, F.lit("#"), i))), "fields")
    values = [F.when(F.col("fits"), named).alias("values")] if keep_values else []
    valued = [(kind, c) for kind, c in checked if kind != "key"]
    rows = materialize(rows.select("file", "row", F.filter(structure, lambda x: x.isNotNull()).alias("structure"), *values, *[F.col(cells[c]).alias(f"v{i}") for i, (_, c) in enumerate(valued)]))
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"v{i}").alias("value")) for i, (kind, _) in enumerate(valued)])
    distinct = rows.select(F.explode(kinds).alias("k")).select("k.*").where("value IS NOT NULL").distinct()
    problem = F.when(F.col("kind") == "date", date_problem(F.col("value"))).otherwise(number_problem(F.col("value")))
    # Exploded rather than filtered: a filter would be pushed below and judge each value twice.
    judged = F.explode(F.filter(F.array(problem), lambda x: x.isNotNull())).alias("problem")
    bad = broadcast_if_small(materialize(distinct.select("kind", "value", judged)))
    for i, (kind, _) in enumerate(valued):
        one = bad.where(F.col("kind") == kind).select(F.col("value").alias(f"v{i}"), F.col("problem").alias(f"p{i}"))
        rows = rows.join(one, f"v{i}", "left")
    invalid = F.array(*[F.when(F.col(f"p{i}").isNotNull(), F.concat(F.col(f"p{i}"), F.lit(f":{c}"))) for i, (_, c) in enumerate(valued)])
    return rows.select("file", "row", *(["values"] if keep_values else []), F.concat("structure", F.filter(invalid, lambda x: x.isNotNull())).alias("reasons"))


def rejected(parsed: DataFrame) -> DataFrame:
    """Records that failed, with their reasons joined by a comma."""
    return parsed.where(F.size("reasons") > 0).select("file", "row", F.concat_ws(",", "reasons").alias("reasons"))


def loaded(parsed: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Valid records as columns: text (nulls recognised), ``timestamp_ntz`` dates and decimal(38,6) numbers.

    ``columns`` maps each output column to ``text``, ``date`` or ``number``; a column that a file lacks is null.
    """
    out = []
    for name, kind in columns.items():
        raw = utrim(F.element_at("values", F.lit(name)))
        raw = F.when(~is_null_word(raw), raw)
        if kind == "date":
            raw = F.coalesce(*[F.try_to_timestamp(F.when(raw.rlike(s), raw), F.lit(p)) for p, s in DATES]).cast("timestamp_ntz")
        elif kind == "number":
            raw = number_value(raw).cast("decimal(38,6)")
        out.append(raw.alias(name))
    return parsed.where(F.size("reasons") == 0).select("file", "row", *out)
