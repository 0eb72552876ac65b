"""Queries p2, p3 and p5 over the procurement tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.functions.text import squeeze, utrim
from caudal.operators.profile import DIFFERENCES, departures, measure, profile
from caudal.operators.snapshot_diff import snapshot_changes
from caudal.scale import materialize, read
from caudal.sources.delimited import Feed, loaded, parse_feed, rejected

FEEDS = {
    "licitacion": Feed(keys=["Codigo", "CodigoExterno", "Codigoitem"], dates=["FechaPublicacion", "FechaCierre"]),
    "orden_compra": Feed(keys=["Codigo", "IDItem"], dates=["FechaEnvio"], numbers=["totalLineaNeto"]),
}
LOADED = {
    "licitacion": {
        "Codigo": "text", "CodigoExterno": "text", "Codigoitem": "text", "Tipo de Adquisicion": "text", "FechaPublicacion": "date", "FechaCierre": "date",
        "CodigoProveedor": "text", "NombreProveedor": "text", "Estado Oferta": "text", "Nombre de la Oferta": "text",
    },
    "orden_compra": {
        "Codigo": "text", "FechaEnvio": "date", "Estado": "text", "DescripcionTipoOC": "text", "IDItem": "text", "codigoProductoONU": "text", "totalLineaNeto": "number",
    },
}


def _parsed(spark: SparkSession, d: str, dataset: str, keep_values: bool = True) -> DataFrame:
    return parse_feed(read(spark, d, f"reliability_gate_{dataset}"), FEEDS[dataset], keep_values=keep_values)


def p2_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Rejected records of both feeds with their reasons."""
    parts = [rejected(_parsed(spark, d, k, False)).select(F.lit(k).alias("dataset"), F.col("file").alias("source_file_id"), F.col("row").alias("raw_row_num"), "reasons") for k in FEEDS]
    return reduce(DataFrame.unionByName, parts)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_rejects(spark, d).select("dataset", "source_file_id", "raw_row_num").distinct()


# SQL templates with @ for the value. Separators and quotes as the problem states them.
_FIELD = '(?:"(?:[^"]|"")*"|[^";][^;]*|)'
_BLANK = r"[\s\p{Z}\x{0085}]"
_SPLIT_SQL = f"""[regexp_replace(CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END, '^{_BLANK}+|{_BLANK}+$', '', 'g') for x in regexp_extract_all(';' || @, ';({_FIELD})', 1)]"""
_NULL_SQL = "coalesce(upper(@), '') IN ('', 'NA', 'N/A', 'NULL', '1900-01-01')"
_DATE_SQL = " OR ".join(f"regexp_full_match(@, '{shape}') AND try_strptime(@, '{form}') IS NOT NULL" for shape, form in (
    (r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d"), (r"\d{2}/\d{2}/\d{4}", "%d/%m/%Y"), (r"\d{8}", "%d%m%Y"), (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "%Y-%m-%dT%H:%M:%S"),
))
_TIGHT_SQL = f"regexp_replace(@, '{_BLANK}', '', 'g')"
_NUMBER_SQL = " OR ".join(rf"regexp_full_match({_TIGHT_SQL}, '(?:[+-]?\$?|\$[+-]){digits}(?:[eE][+-]?\d+)?') AND abs(TRY_CAST(regexp_replace({bare.replace('@', _TIGHT_SQL)}, '[$+]', '', 'g') AS DOUBLE)) < 1e14" for digits, bare in (
    (r"\d{1,3}(?:\.\d{3})+(?:,\d+)?", "replace(replace(@, '.', ''), ',', '.')"), (r"\d{1,3}(?:,\d{3})+(?:\.\d+)?", "replace(@, ',', '')"), (r"\d+(?:[.,]\d+)?", "replace(@, ',', '.')"),
))


def _feed_sql(dataset: str) -> str:
    """Failing records of a feed: split by a regular expression, each value checked where it stands."""
    feed = FEEDS[dataset]
    at = "q[list_position(h, '{}')]".format
    bad = [_NULL_SQL.replace("@", at(x)) for x in feed.keys]
    for names, good in ((feed.dates, _DATE_SQL), (feed.numbers, _NUMBER_SQL)):
        bad += [f"NOT ({_NULL_SQL} OR coalesce({good}, false))".replace("@", at(x)) for x in names]
    body, header = "regexp_replace(raw_text, '(\r\n|\r|\n)$', '')", "regexp_replace(regexp_replace(min(raw_text), '(\r\n|\r|\n)$', ''), '^' || chr(65279), '')"
    return f"""SELECT '{dataset}' AS dataset, f AS source_file_id, n AS raw_row_num FROM (
        SELECT *, regexp_full_match(t, '{_FIELD}(?:;{_FIELD})*') AS ok, {_SPLIT_SQL.replace('@', 't')} AS q FROM (SELECT source_file_id AS f, raw_row_num AS n, {body} AS t FROM reliability_gate_{dataset} WHERE raw_row_num IS DISTINCT FROM 0) a
        LEFT JOIN (SELECT g, {_SPLIT_SQL.replace('@', 'x')} AS h FROM (SELECT source_file_id AS g, {header} AS x FROM reliability_gate_{dataset} WHERE raw_row_num = 0 GROUP BY 1) z) b ON f = g) r
        WHERE t IS NULL OR h IS NULL OR NOT ok OR len(q) <> len(h) OR {' OR '.join(bad)}"""


P2_FOUND_SQL = "SELECT DISTINCT * FROM (" + " UNION ALL ".join(_feed_sql(k) for k in FEEDS) + ") u"


def p2_loaded_licitacion(spark: SparkSession, d: str) -> DataFrame:
    return loaded(_parsed(spark, d, "licitacion"), LOADED["licitacion"])


def p2_loaded_orden_compra(spark: SparkSession, d: str) -> DataFrame:
    return loaded(_parsed(spark, d, "orden_compra"), LOADED["orden_compra"])


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    """Notices added, removed or changed between consecutive snapshots, with the values before and after."""
    return snapshot_changes(
        read(spark, d, "mercado_publico_notice_snapshot"),
        F.date_format("snapshot_date", "yyyy-MM-dd"),
        F.upper(utrim(F.col("external_notice_code"))),
        [F.col("synced_at")],
        {"status": F.col("official_status_code"), "sha256": F.lower(utrim(F.col("payload_sha256")))},
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_changes(spark, d).select(F.col("snapshot").alias("snapshot_date"), F.col("key").alias("external_notice_code"), "change_kind")


P3_FOUND_SQL = """
WITH latest AS (
  SELECT strftime(snapshot_date, '%Y-%m-%d') AS s, upper(trim(external_notice_code)) AS k, official_status_code AS st, lower(trim(payload_sha256)) AS h,
    row_number() OVER (PARTITION BY snapshot_date, upper(trim(external_notice_code)) ORDER BY synced_at DESC NULLS LAST, official_status_code DESC NULLS LAST, lower(trim(payload_sha256)) DESC NULLS LAST) AS rn
  FROM mercado_publico_notice_snapshot WHERE snapshot_date IS NOT NULL),
cur AS (SELECT * FROM latest WHERE rn = 1),
dates AS (SELECT s, lag(s) OVER (ORDER BY s) AS before FROM (SELECT DISTINCT s FROM cur)),
n AS (SELECT d.s, c.k, c.st, c.h FROM dates d JOIN cur c ON c.s = d.s WHERE d.before IS NOT NULL),
o AS (SELECT d.s, c.k, c.st, c.h FROM dates d JOIN cur c ON c.s = d.before)
SELECT coalesce(n.s, o.s) AS snapshot_date, coalesce(n.k, o.k) AS external_notice_code,
  CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM n FULL JOIN o ON n.s = o.s AND n.k IS NOT DISTINCT FROM o.k
WHERE o.s IS NULL OR n.s IS NULL OR n.st IS DISTINCT FROM o.st OR n.h IS DISTINCT FROM o.h
"""

# Regular forms of some columns; the profile counts the values outside of them.
PATTERNS = {
    "codigo_externo": r"\d+-\d+-[A-Z]{1,2}\d{2,3}", "external_notice_code": r"\d+-\d+-[A-Z]{1,2}\d{2,3}", "notice_id": r"\d+-\d+-[A-Z]{1,2}\d{2,3}",
    "onu_product_code": r"\d{8}", "row_hash_sha256": r"[0-9a-f]{64}", "payload_sha256": r"[0-9a-f]{64}",
    "rut_proveedor": r"\d{1,3}(\.?\d{3}){2}-[0-9Kk]", "region_unidad": r"Región .*\S", "moneda_adquisicion": r"[A-Z]{3}", "currency_code": r"[A-Z]{3}",
}
#: Table: (load column, origin of its dates); a table of one load has none.
PROFILED = {
    "normalized_licitaciones": ("source_file_id", "created_at"), "normalized_suppliers": ("source_file_id", None), "normalized_buyers": ("source_file_id", None),
    "mercado_publico_notice_snapshot": ("snapshot_date", None), "silver_notice_line": ("source_file_id", None), "silver_purchase_order": ("source_file_id", None),
    "silver_purchase_order_line": ("source_file_id", None), "silver_notice_purchase_order_link": ("source_file_id", None), "documents": (None, None),
    "reliability_gate_licitacion": ("source_file_id", None), "reliability_gate_orden_compra": ("source_file_id", None),
}


#: Tables profiled at a time.
TABLES_AT_ONCE = 4


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile of every column of the large tables, per load (snapshot date of the snapshots)."""

    def one(table: str) -> DataFrame:
        load, origin = PROFILED[table]
        df = read(spark, d, table)
        columns = df.columns
        df = df.withColumn("__load_id", F.col(load).cast("string") if load else F.lit("all"))
        return profile(df, "__load_id", columns, {k: v for k, v in PATTERNS.items() if k in columns}, origin).select(F.lit(table).alias("table_name"), "*")

    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:  # the tables' jobs overlap, so the tail of one leaves no core idle
        return reduce(DataFrame.unionByName, list(pool.map(one, PROFILED)))


def _shape(c: Column) -> Column:
    """Form of a text: runs of capitals, small letters and digits each become one letter."""
    c = F.regexp_replace(squeeze(c), r"\p{Lu}+", "A")
    return F.regexp_replace(F.regexp_replace(c, r"\p{Ll}+", "a"), r"\d+", "9")


#: Least share of departing rows, and least standardised difference of a load that is looked at for it.
DEPARTING = 0.3
DIFFERING = 0.1


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "normalized_licitaciones").select("source_file_id", "monto_estimado", "region_unidad", "fecha_cierre", "created_at")


def _form(monto: Column) -> Column:
    form = F.when(monto != F.floor(monto), "fraction").when(monto % 1000 == 0, "thousands").when(monto % 10 == 0, "tens").when(monto.isNotNull(), "whole")
    return F.concat(form, F.when(monto < 0, "-").otherwise(""))


def _clock(close: Column) -> Column:
    clock = F.date_format(close, "HH:mm:ss")
    return F.when(clock == "00:00:00", "midnight").when(clock.isNotNull(), F.substring(clock, 1, 2))


def p5_differences(spark: SparkSession, d: str) -> DataFrame:
    """Standardised differences of each load's monto_estimado, region_unidad and fecha_cierre, and of their forms, from
    the other loads': load_id, column_name, statistic, difference. All from the profile."""
    df = _judged(spark, d).withColumns({"monto_estimado#form": _form(F.col("monto_estimado")), "region_unidad#form": _shape(F.col("region_unidad")), "fecha_cierre#form": _clock(F.col("fecha_cierre"))})
    columns = [c for c in df.columns if c not in ("source_file_id", "created_at")]
    p = profile(df, "source_file_id", columns, {"region_unidad": PATTERNS["region_unidad"], "monto_estimado": r"\d+(?:\.0+)?"}, "created_at")
    stats = F.explode(F.array(*[F.struct(F.concat(F.lit(c), F.when(F.col("column_name").contains("#"), "#form").otherwise("")).alias("statistic"), F.col(c).alias("difference")) for c in DIFFERENCES])).alias("s")
    return p.select(F.coalesce("load_id", F.lit("")).alias("load_id"), stats, F.substring_index("column_name", "#", 1).alias("column_name")).select("load_id", "column_name", "s.*").where("difference IS NOT NULL")


def p5_departures(spark: SparkSession, d: str) -> DataFrame:
    """How far each load's monto_estimado, region_unidad and fecha_cierre depart from the other loads."""
    df = _judged(spark, d)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    monto, region, close, load_time = (F.col(c) for c in ("monto_estimado", "region_unidad", "fecha_cierre", "created_at"))
    size = measure(monto, kinds["monto_estimado"])
    days = F.datediff(close.cast("date"), load_time.cast("date"))
    features = {
        ("monto_estimado", "size"): F.floor(size / 250), ("monto_estimado", "form"): _form(monto), ("monto_estimado", "value"): monto,
        ("region_unidad", "value"): region, ("region_unidad", "form"): _shape(region),
        ("fecha_cierre", "days"): F.when(days < -365, -9999).when(days > 730, 9999).otherwise(F.floor(days / 7)), ("fecha_cierre", "clock"): _clock(close),
    }
    return departures(df, "source_file_id", features)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Loads and columns that the profile's standardised differences point at and of which 30 % of the rows depart."""
    keys = ["load_id", "column_name"]
    differing = materialize(p5_differences(spark, d).where(F.abs("difference") >= DIFFERING).select(*keys).distinct())
    departing = materialize(p5_departures(spark, d).where(F.col("departing") >= DEPARTING).select(*keys).distinct())
    return differing.join(departing, keys).select(F.col("load_id").alias("source_file_id"), "column_name")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts of the profile: rows, nulls, and distinct values of every column in every load."""
    return p5_profile(spark, d).select("table_name", "load_id", "column_name", "n_rows", "n_nulls", "n_distinct")


def p5_sums(spark: SparkSession, d: str) -> DataFrame:
    """Measured values and power sums of the amounts, dates and flags of tenders, per load."""
    df = read(spark, d, "normalized_licitaciones")
    names = [f.name for f in df.schema.fields if f.name in MEASURED]
    sums = [F.col(f"power_sum_{k}").cast("string").alias(f"power_sum_{k}") for k in (1, 2, 3, 4)]
    return profile(df, "source_file_id", names).select("load_id", "column_name", "n_measured", *sums)


# Columns of the profiled tables, for the SQL of the counts.
_COLUMNS = {
    "normalized_licitaciones": "codigo_externo codigo nombre descripcion tipo_adquisicion tipo_adquisicion_norm codigo_estado estado tipo moneda_adquisicion visibilidad_monto_raw monto_estimado numero_oferentes codigo_organismo nombre_organismo codigo_unidad nombre_unidad comuna_unidad region_unidad fecha_publicacion fecha_cierre fecha_adjudicacion cantidad_dias_licitacion flag_licitacion_publica flag_menos_100_utm row_hash_sha256 created_at updated_at source_file_id",
    "normalized_suppliers": "supplier_key codigo_proveedor rut_proveedor nombre_proveedor razon_social_proveedor actividad_proveedor comuna_proveedor region_proveedor pais_proveedor created_at updated_at source_file_id",
    "normalized_buyers": "buyer_key codigo_unidad_compra rut_unidad_compra unidad_compra codigo_organismo_publico organismo_publico sector actividad_comprador ciudad_unidad_compra region_unidad_compra pais_unidad_compra created_at updated_at source_file_id",
    "mercado_publico_notice_snapshot": "id payload_id endpoint_name source_mode external_notice_code notice_title official_status_code official_status_name publication_date close_date buyer_org_code buyer_org_name buyer_unit_code buyer_unit_name currency_code estimated_amount payload_sha256 observed_at synced_at snapshot_date",
    "silver_notice_line": "notice_line_id notice_id line_number item_code onu_product_code category_level_1 category_level_2 category_level_3 generic_product_name line_name line_description_raw line_description_clean unit_of_measure quantity_requested row_hash_sha256 created_at updated_at source_file_id",
    "silver_purchase_order": "purchase_order_id purchase_order_code purchase_order_name purchase_order_description_raw purchase_order_type purchase_order_status_code purchase_order_status_name order_created_at order_accepted_at total_amount net_total_amount currency_code supplier_key linked_notice_id is_linked_to_notice_flag is_direct_award_flag is_agile_purchase_flag created_at updated_at source_file_id",
    "silver_purchase_order_line": "purchase_order_line_id purchase_order_id line_item_id linked_notice_id onu_product_code category_code category_name category_level_1 category_level_3 generic_product_name buyer_item_spec_raw buyer_item_spec_clean supplier_item_spec_raw quantity_ordered unit_of_measure line_currency unit_net_price line_net_total row_hash_sha256 created_at updated_at source_file_id",
    "silver_notice_purchase_order_link": "notice_purchase_order_link_id notice_id purchase_order_id link_type link_confidence source_system source_file_id created_at updated_at",
    "documents": "doc_id text lang source n_chars codigo_organismo codigo_externo page_url published_at",
    "reliability_gate_licitacion": "source_file_id raw_row_num raw_text", "reliability_gate_orden_compra": "source_file_id raw_row_num raw_text",
}
P5_COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {load} AS load_id, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct FROM {t} GROUP BY {load}"
    for t, cs in _COLUMNS.items()
    for c in cs.split()
    for load in ["CAST(" + PROFILED[t][0] + " AS VARCHAR)" if PROFILED[t][0] else "'all'"]
)
#: Columns of tenders whose power sums are compared, by kind.
MEASURED = {
    **dict.fromkeys(["codigo_estado", "monto_estimado", "numero_oferentes", "cantidad_dias_licitacion"], "CAST(round(sign({0}) * log10(1 + abs(CAST({0} AS DOUBLE))) * 1000) AS HUGEINT)"),
    **dict.fromkeys(["flag_licitacion_publica", "flag_menos_100_utm"], "CAST({0} AS HUGEINT)"),
    **dict.fromkeys(["fecha_publicacion", "fecha_cierre", "fecha_adjudicacion"], "CAST(floor(epoch({0}) / 86400) AS HUGEINT)"),
}
P5_SUMS_SQL = " UNION ALL ".join(
    f"SELECT source_file_id AS load_id, '{c}' AS column_name, count(m) AS n_measured, CAST(sum(m) AS VARCHAR) AS power_sum_1, CAST(sum(m * m) AS VARCHAR) AS power_sum_2, CAST(sum(m * m * m) AS VARCHAR) AS power_sum_3, CAST(sum(m * m * m * m) AS VARCHAR) AS power_sum_4 FROM (SELECT source_file_id, {m.format(c)} AS m FROM normalized_licitaciones) t GROUP BY source_file_id"
    for c, m in MEASURED.items()
)
P3_CHANGES_SQL = P3_FOUND_SQL.replace(
    "END AS change_kind\n", "END AS change_kind, o.st AS old_status, o.h AS old_sha256, n.st AS new_status, n.h AS new_sha256\n"
).replace("AS snapshot_date, coalesce", "AS snapshot, coalesce").replace("AS external_notice_code,\n", "AS key,\n")

QUERIES = {f.__name__: f for f in (p2_found, p2_rejects, p2_loaded_licitacion, p2_loaded_orden_compra, p3_found, p3_changes, p5_found, p5_departures, p5_differences, p5_profile, p5_counts, p5_sums)}
ORACLE = {"p2_found": P2_FOUND_SQL, "p3_found": P3_FOUND_SQL, "p3_changes": P3_CHANGES_SQL, "p5_counts": P5_COUNTS_SQL, "p5_sums": P5_SUMS_SQL}
