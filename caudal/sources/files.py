"""Plain file sources and sinks: JSON lines with a declared schema, delimited export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines under a declared schema; a line that is no object gives a row of nulls and is kept in ``bad_line``."""
    return spark.read.schema(f"{schema}, bad_line string").option("columnNameOfCorruptRecord", "bad_line").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row, nulls written, so that reading back gives the same columns."""
    df.write.option("ignoreNullFields", "false").mode("error").json(path)


def export_delimited(df: DataFrame, path: str, sep: str = ";") -> None:
    """Export for spreadsheets: every value quoted, quotes doubled, a header, CRLF line ends; nulls are empty.

    Texts that a spreadsheet would run as a formula get a leading apostrophe.
    """
    safe = [F.when(F.col(f"`{c}`").cast("string").rlike(r"^[=+@\t\r]|^-\D"), F.concat(F.lit("'"), F.col(f"`{c}`").cast("string"))).otherwise(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns]
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]
    lines = df.select(*safe).select(F.concat_ws(sep, *quoted).alias("value"))
    header = sep.join('"' + c.replace('"', '""') + '"' for c in df.columns)
    # The text writer ends records with lineSep; each file starts with its own header.
    numbered = lines.mapInPandas(lambda batches: _with_header(batches, header), "value string")
    numbered.write.option("lineSep", "\r\n").mode("error").text(path)


def _with_header(batches, header: str):  # noqa: ANN001, ANN202
    import pandas as pd

    yield pd.DataFrame({"value": [header]})
    yield from batches
