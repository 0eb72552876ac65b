"""Tolerant parsing of source text into typed columns. Nothing here raises on bad input: it gives null."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.functions.text import normalise, utrim

# Spellings of null in raw rows, and in values to be parsed.
RAW_NULLS = ["", "NA", "1900-01-01"]
VALUE_NULLS = ["", "NA", "N/A", "NULL"]
NULL_DATES = ["1900-01-01", "0001-01-01", "01-01-1900", "01/01/1900"]
# Date patterns in the order they are tried, with the shape each demands.
TIMESTAMPS = [
    ("yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("d-M-yyyy H:m:s", r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d/M/yyyy H:m:s", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
]
# Words of truth.
TRUE_WORDS = ["1", "true", "si", "s", "yes", "y", "x", "seleccionada", "verdadero"]
FALSE_WORDS = ["0", "false", "no", "n", "no seleccionada", "falso"]
DECIMAL_BOUND = "99999999999999.999999"


def clean_raw(c: Column) -> Column:
    """Trimmed raw value; the raw spellings of null become null."""
    t = utrim(c)
    return F.when(~F.upper(t).isin(RAW_NULLS), t)


def clean(c: Column) -> Column:
    """Trimmed value; spellings of null and the null dates, with or without midnight, become null."""
    t = utrim(c)
    return F.when(~F.upper(t).isin(VALUE_NULLS + NULL_DATES + [f"{d} 00:00:00" for d in NULL_DATES]), t)


def pick(raw: Column, *names: str) -> Column:
    """First value of map ``raw`` under ``names`` that is not null once cleaned; missing names are null."""
    return F.coalesce(*[clean(F.try_element_at(raw, F.lit(n))) for n in names])


def decimal(c: Column) -> Column:
    """decimal(20,6) of a tolerant number: all but digits, signs, marks and exponents dropped; of dots and
    commas the last is the decimal mark, a lone comma too; scientific notation; null beyond the bound."""
    t = F.regexp_replace(clean(c), r"[^0-9,.\-+eE]", "")
    dot, comma = F.length(t) - F.locate(".", F.reverse(t)), F.length(t) - F.locate(",", F.reverse(t))
    both = t.contains(".") & t.contains(",")
    plain = (
        F.when(both & (comma > dot), F.translate(F.regexp_replace(t, r"\.", ""), ",", "."))
        .when(both, F.regexp_replace(t, ",", ""))
        .when(t.contains(",") & ~F.regexp_replace(t, r"^[^,]*,", "").contains(","), F.translate(t, ",", "."))
        .otherwise(t)
    )
    number = F.when(plain.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d{1,3})?$"), plain).try_cast("decimal(38,18)")
    return F.when(F.abs(number) <= F.lit(DECIMAL_BOUND).cast("decimal(38,18)"), number.cast("decimal(20,6)"))


def integer(c: Column) -> Column:
    """Integer part of the tolerant number; null out of range."""
    return decimal(c).try_cast("int")


def timestamp(c: Column) -> Column:
    """timestamp_ntz of the first pattern that fits, else of an ISO text, its offset brought to UTC."""
    t = clean(c)
    tried = [F.try_to_timestamp(F.when(t.rlike(shape), t), F.lit(pattern)) for pattern, shape in TIMESTAMPS]
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?$"), t)
    offset = iso.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    naive = [x.cast("timestamp_ntz") for x in tried]
    return F.coalesce(*naive, F.when(offset, F.to_utc_timestamp(iso.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")).otherwise(iso.try_cast("timestamp_ntz")))


def boolean(c: Column) -> Column:
    """True, false or null by the fixed words."""
    t = normalise(clean(c))
    return F.when(t.isin(TRUE_WORDS), True).when(t.isin(FALSE_WORDS), False)


def boolean_or_false(c: Column) -> Column:
    return F.coalesce(boolean(c), F.lit(False))


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two times, rounded down (half a day before is -1)."""
    seconds = F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(earlier.cast("timestamp"))
    return F.floor(seconds / 86400).cast("int")


def code_prefix(c: Column) -> Column:
    """What comes before the first dash."""
    return F.substring_index(c, "-", 1)


def any_present(*cs: Column) -> Column:
    """Whether one of the values is not null once cleaned."""
    return F.coalesce(*[clean(c) for c in cs]).isNotNull()


def hashed_key(*cs: Column) -> Column:
    """SHA-256 of the values joined by a bar, nulls as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in cs]), 256)


def canonical_json(values: Column) -> Column:
    """JSON of a map of texts: keys sorted, no blanks, nulls kept, letters as they are, control characters in lower-case hex."""
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))), {"ignoreNullFields": "false"})
    for letter in "ABCDEF":
        text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*)\\u00([01]){letter}", rf"$1\\u00$2{letter.lower()}")
    return text


def row_hash(raw: Column) -> Column:
    """SHA-256 of a map's canonical JSON."""
    return F.sha2(canonical_json(raw), 256)


# Parameters that are no part of a request's identity.
SECRETS = ["ticket"]


def request_hash(params: Column) -> Column:
    """SHA-256 of the canonical JSON of request parameters without the secret ones, in whatever case."""
    return row_hash(F.map_filter(params, lambda k, v: ~F.lower(k).isin(SECRETS)))


@F.pandas_udf(T.StringType())
def canonical_document(texts: pd.Series) -> pd.Series:
    """JSON documents written with sorted keys and without blanks; null where a text is no JSON. Nesting has no schema, so this is an Arrow function."""

    def written(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(written)


def payload_hash(payload: Column) -> Column:
    """SHA-256 of a JSON document, whatever the order of its keys and its blanks."""
    return F.sha2(canonical_document(payload), 256)


def prefixed(*choices: tuple[str, Column]) -> Column:
    """First choice whose value is not null, with its prefix (``codigo:``, ``rut:`` and the like)."""
    return F.coalesce(*[F.concat(F.lit(p), c) for p, c in choices])
