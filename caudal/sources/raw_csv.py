"""Raw CSV lane: discover, read with lineage and row numbers, hash, append once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.functions.parsers import clean_raw, row_hash
from caudal.operators.merge import canonical_headers, required_columns
from caudal.sources.delimited import split_record

# Folders of the data sets, header aliases, required headers.
FOLDERS = {"licitacion": ["licitacion"], "orden_compra": ["orden_compra", "orden-compra"]}
ALIASES = {"licitacion": {"CodigoItem": "Codigoitem"}, "orden_compra": {"CodigoProductoONU": "codigoProductoONU", "TotalLineaNeto": "totalLineaNeto"}}
REQUIRED = {
    "licitacion": ["Codigo", "CodigoExterno", "Tipo de Adquisicion", "FechaPublicacion", "FechaCierre", "Codigoitem"],
    "orden_compra": ["Codigo", "FechaEnvio", "Estado", "DescripcionTipoOC", "IDItem", "codigoProductoONU", "totalLineaNeto"],
}
ENCODINGS = ["utf-8-sig", "utf-8", "latin-1"]
# Content types that an upload may come as.
CONTENT_TYPES = ["application/csv", "application/octet-stream", "application/vnd.ms-excel", "text/csv", "text/plain"]

RAW = T.StructType(
    [
        T.StructField("source_file", T.StringType()), T.StructField("source_file_id", T.StringType()), T.StructField("raw_row_num", T.LongType()),
        T.StructField("raw", T.MapType(T.StringType(), T.StringType())), T.StructField("problem", T.StringType()),
    ]
)


def discover(root: str) -> list[tuple[str, str]]:
    """(data set, path) of the CSV files below ``root``, sorted, each real file once."""
    seen, out = set(), []
    for dataset, folders in FOLDERS.items():
        for path in sorted(p for f in folders for p in Path(root, f).glob("*.csv")):
            if path.resolve() not in seen:
                seen.add(path.resolve())
                out.append((dataset, str(path)))
    return out


def still_open(line: str, inside: bool, sep: str = ";", quote: str = '"') -> bool:
    """Whether a quoted field is open after ``line``, if one was (``inside``) before it."""
    at, n = 0, len(line.rstrip("\r\n"))
    while True:
        if inside or line.startswith(quote, at):
            close = line.find(quote, at if inside else at + 1)
            while close >= 0 and line.startswith(quote, close + 1):
                close = line.find(quote, close + 2)
            if close < 0:
                return True
            inside, at = False, close + 1
        at = line.find(sep, at, n)
        if at < 0:
            return False
        at += 1


def records(text: str, quote: str = '"') -> Iterator[str]:
    """Records of a CSV text; line ends inside quoted fields belong to the record. One pass: each line is looked at once."""
    held, inside = [], False
    for line in text.splitlines(keepends=True):
        held.append(line)
        inside = still_open(line, inside, quote=quote)
        if not inside:
            yield "".join(held)
            held = []
    if held:
        yield "".join(held)


def _rows(batches: Iterator[pd.DataFrame], aliases: dict[str, str]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            raw = bytes(content)
            digest = hashlib.sha256(raw).hexdigest()
            text = next(t for t in (_decoded(raw, e) for e in ENCODINGS) if t is not None)
            header, rows = None, []
            for n, record in enumerate(records(text)):
                fields, problem = split_record(record)
                if header is None:
                    header = canonical_headers(fields, aliases)
                    continue
                if problem is None and len(fields) != len(header):
                    problem = "field_count"
                rows.append((path, digest, n, dict(zip(header, fields)), problem))
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=["source_file", "source_file_id", "raw_row_num", "raw", "problem"])
                    rows = []
            yield pd.DataFrame(rows, columns=["source_file", "source_file_id", "raw_row_num", "raw", "problem"])


def _decoded(raw: bytes, encoding: str) -> str | None:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return None


def read_raw(spark: SparkSession, paths: list[str], dataset: str) -> DataFrame:
    """Raw rows of whole files: lineage, row number from 1 in the file, cleaned map of values, problem, hash.

    A file is one unit of work, so that row numbers are those of the file however it is quoted; its id is
    the SHA-256 of its bytes. Empty files give no rows; problem rows keep the fields that could be read.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    aliases = ALIASES[dataset]
    rows = files.mapInPandas(lambda b: _rows(b, aliases), RAW)
    cleaned = F.transform_values("raw", lambda k, v: clean_raw(v))
    return rows.withColumn("raw", cleaned).withColumn("row_hash_sha256", row_hash(F.col("raw")))


def unregistered(spark: SparkSession, paths: list[str], stored: DataFrame, force: bool = False) -> list[str]:
    """Paths whose content no stored row is of; all of them with ``force``. Files are hashed where they lie, each by one task."""
    if force or not paths:
        return list(paths)
    files = spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("source_file_id"))
    fresh = files.join(stored.select("source_file_id").distinct(), "source_file_id", "left_anti").select("path").collect()  # at most the paths
    names = {r["path"].split(":", 1)[-1].lstrip("/") for r in fresh}
    return [p for p in paths if p.split(":", 1)[-1].lstrip("/") in names]


def profile(raw: DataFrame, dataset: str) -> DataFrame:
    """One row a file: rows, columns, rows with a problem, and the required headers it lacks. A file without rows has none."""
    columns = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("raw")))))
    files = raw.groupBy("source_file", "source_file_id").agg(F.count("*").alias("n_rows"), F.count("problem").alias("n_problems"), columns.alias("columns"))
    required = F.array(*[F.lit(c) for c in sorted(REQUIRED[dataset])])
    return files.withColumns({"n_columns": F.size("columns"), "missing": F.array_except(required, "columns")})


def append_new(stored: DataFrame, raw: DataFrame) -> DataFrame:
    """Rows not stored yet, by (file, row number): reading a file again appends nothing."""
    return raw.dropDuplicates(["source_file_id", "raw_row_num"]).join(stored.select("source_file_id", "raw_row_num"), ["source_file_id", "raw_row_num"], "left_anti")


def preflight(content: bytes, name: str, dataset: str, most_bytes: int = 50 * 1024 * 1024, content_type: str | None = None) -> dict:
    """What can be said of an upload before it is taken: errors, encoding, hash, headers, rows that are not blank."""
    errors = []
    if not name.lower().endswith(".csv"):
        errors.append("not_a_csv_name")
    kind = (content_type or "").split(";", 1)[0].strip().lower()
    if kind and kind not in CONTENT_TYPES:
        errors.append("content_type")
    if not content:
        errors.append("empty")
    if len(content) > most_bytes:
        errors.append("too_large")
    if b"\x00" in content:
        errors.append("nul_bytes")
    encoding = next(e for e in ENCODINGS if _decoded(content, e) is not None)
    rows = list(records(content.decode(encoding)))
    header = canonical_headers(split_record(rows[0])[0], ALIASES[dataset]) if rows else []
    missing = sorted(set(REQUIRED[dataset]) - set(header))
    errors += [f"missing:{m}" for m in missing]
    return {
        "errors": errors, "encoding": encoding, "sha256": hashlib.sha256(content).hexdigest(), "headers": header,
        "rows": sum(any(f.strip() for f in split_record(r)[0]) for r in rows[1:]),
    }


def contract(df: DataFrame, dataset: str) -> list[str]:
    """Required headers that ``df`` lacks."""
    return required_columns(df, REQUIRED[dataset])
