"""Whole lanes run over raw rows made of the test tables, with SQL that counts and sums the same tables by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.functions.text import normalise
from caudal.operators import latest, serve
from caudal.plans import lanes
from caudal.plans.eda import ORACLE_ENTITIES, entity
from caudal.scale import materialize, read

c = F.col
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_NORM = "trim(regexp_replace(strip_accents(lower({})), '\\s+', ' ', 'g'))"


def _clean(x: str) -> str:
    return f"CASE WHEN upper(trim({x})) NOT IN ('', 'NA', 'N/A', 'NULL') THEN trim({x}) END"


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def text_of(x: str, kind: str) -> Column:
    """A column written as the source writes it: decimals with a comma, times in ISO form."""
    if kind.startswith("decimal"):
        return F.translate(c(x).cast("string"), ".", ",")
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if kind.startswith("timestamp") else c(x).cast("string")


def raw_rows(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Rows as maps of header to text, with lineage and the order of delivery."""
    kinds = dict(df.dtypes)
    pairs = [x for h, name in headers.items() for x in (F.lit(h), text_of(name, kinds[name]))]
    return df.select(F.create_map(*pairs).alias("raw"), "source_file_id", "row_hash_sha256", F.unix_micros("updated_at").alias("seq"))


_TENDER = {
    "CodigoExterno": "notice_id", "Codigo": "codigo", "Nombre": "nombre", "Descripcion": "descripcion", "Tipo de Adquisicion": "tipo_adquisicion", "CodigoEstado": "codigo_estado", "Estado": "estado", "MontoEstimado": "monto_estimado", "CodigoOrganismo": "codigo_organismo",
    "NombreOrganismo": "nombre_organismo", "CodigoUnidad": "codigo_unidad", "NombreUnidad": "nombre_unidad", "RegionUnidad": "region_unidad", "FechaPublicacion": "fecha_publicacion", "FechaCierre": "fecha_cierre", "FechaAdjudicacion": "fecha_adjudicacion", "Codigoitem": "item_code",
    "Correlativo": "line_number", "CodigoProductoONU": "onu_product_code", "Rubro1": "category_level_1", "Nombre producto genrico": "generic_product_name", "Descripcion linea Adquisicion": "line_description_raw", "UnidadMedida": "unit_of_measure", "Cantidad": "quantity_requested",
    "CodigoProveedor": "supplier", "Nombre de la Oferta": "offer", "Valor Total Ofertado": "offered", "Oferta seleccionada": "selected", "MontoLineaAdjudica": "awarded",
}
# A line's bid: one supplier, chosen by its number and code, that wins every other line.
_N = "CAST(coalesce(TRY_CAST(line_number AS INTEGER), 0) AS INTEGER)"
_BID = {
    "supplier": f"CASE WHEN (length(item_code) + {_N}) % 7 <> 0 THEN concat('7', CAST((length(item_code) + length(notice_id) + {_N}) % 9 AS VARCHAR(9))) END", "offer": "concat('Oferta ', line_number)", "offered": "CAST(quantity_requested * 1000 AS DECIMAL(20, 2))",
    "selected": f"CASE WHEN {_N} % 2 = 0 THEN '1' ELSE '0' END", "awarded": f"CASE WHEN {_N} % 2 = 0 THEN CAST(quantity_requested * 1000 AS DECIMAL(20, 2)) END",
}


def raw_tenders(spark: SparkSession, d: str) -> DataFrame:
    own = ["codigo_externo", "codigo", "nombre", "descripcion", "tipo_adquisicion", "codigo_estado", "estado", "monto_estimado", "codigo_organismo", "nombre_organismo", "codigo_unidad", "nombre_unidad", "region_unidad", "fecha_publicacion", "fecha_cierre", "fecha_adjudicacion"]
    n = entity(spark, d, "notice", own).withColumnRenamed("codigo_externo", "notice_id")
    l = read(spark, d, "silver_notice_line").join(n, "notice_id", "left")  # noqa: E741
    return raw_rows(l.withColumns({k: F.expr(x) for k, x in _BID.items()}), _TENDER)


_RAW_TENDERS = f"""n AS (SELECT * FROM {ORACLE_ENTITIES['notice']} q), r AS (SELECT {_clean('l.notice_id')} AS notice_id, {_clean('l.item_code')} AS item_code, {_clean('CAST(l.line_number AS VARCHAR)')} AS line, {_clean('l.onu_product_code')} AS onu,
    {_clean('n.codigo_organismo')} AS org, {_clean('n.codigo_unidad')} AS unit, n.fecha_adjudicacion AS award_date, l.updated_at, {', '.join(f'{x} AS {k}' for k, x in _BID.items())} FROM silver_notice_line l LEFT JOIN n ON n.codigo_externo = l.notice_id)"""
_BIDS = "(SELECT DISTINCT notice_id, item_code, line, supplier, offer, selected FROM r WHERE offer IS NOT NULL AND supplier IS NOT NULL AND notice_id IS NOT NULL)"
_AWARDS = "(SELECT DISTINCT notice_id, item_code, supplier, awarded, award_date, selected FROM r WHERE supplier IS NOT NULL AND notice_id IS NOT NULL)"
_LINES = "(SELECT DISTINCT notice_id, item_code FROM r WHERE notice_id IS NOT NULL AND item_code IS NOT NULL)"


def counts(tables: lanes.Tables) -> DataFrame:
    """Rows of each entity: the plans are run together, as one union."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("entity"), "n") for k, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {_RAW_TENDERS} " + " UNION ALL ".join(f"SELECT '{k}' AS entity, count(*) AS n FROM {x} q" for k, x in {
    "tender": "(SELECT DISTINCT notice_id FROM r WHERE notice_id IS NOT NULL)", "notice": "(SELECT DISTINCT notice_id FROM r WHERE notice_id IS NOT NULL)", "tender_item": _LINES, "notice_line": _LINES, "bid": _BIDS, "bid_submission": _BIDS, "award": _AWARDS,
    "buying_org": "(SELECT DISTINCT org FROM r WHERE org IS NOT NULL)", "contracting_unit": "(SELECT DISTINCT unit FROM r WHERE unit IS NOT NULL)", "supplier": "(SELECT DISTINCT supplier FROM r WHERE supplier IS NOT NULL)", "supplier_master": "(SELECT DISTINCT supplier FROM r WHERE supplier IS NOT NULL)",
    "category_ref": "(SELECT DISTINCT onu FROM r WHERE onu IS NOT NULL)", "participation": "(SELECT DISTINCT supplier, notice_id FROM r WHERE supplier IS NOT NULL AND notice_id IS NOT NULL)",
}.items()))
def lane_tender_entities(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the tender lane makes of each of its thirteen entities."""
    return counts(lanes.tender_lane(materialize(raw_tenders(spark, d))))


@query(f"""WITH {_RAW_TENDERS}, k AS (SELECT DISTINCT notice_id FROM r WHERE notice_id IS NOT NULL), l AS (SELECT notice_id, count(*) AS n FROM {_LINES} q GROUP BY 1),
    b AS (SELECT notice_id, count(*) AS n, count(DISTINCT supplier) AS s, count(*) FILTER (WHERE selected = '1') AS w FROM {_BIDS} q GROUP BY 1), a AS (SELECT notice_id, count(*) FILTER (WHERE selected = '1' OR awarded IS NOT NULL) AS n FROM {_AWARDS} q GROUP BY 1),
    o AS (SELECT notice_id, count(*) AS n FROM silver_notice_purchase_order_link GROUP BY 1)
    SELECT k.notice_id, coalesce(l.n, 0) AS notice_line_count, coalesce(b.n, 0) AS notice_bid_count, coalesce(b.s, 0) AS notice_supplier_count, coalesce(b.w, 0) AS notice_selected_bid_count, coalesce(a.n, 0) AS notice_awarded_line_count, coalesce(o.n, 0) AS notice_purchase_order_count,
      coalesce(o.n, 0) > 0 AS notice_has_purchase_order_flag, coalesce(o.n, 0) > 0 AND coalesce(a.n, 0) > 0 AS notice_awarded_to_order_conversion_flag FROM k LEFT JOIN l USING (notice_id) LEFT JOIN b USING (notice_id) LEFT JOIN a USING (notice_id) LEFT JOIN o USING (notice_id)""")
def lane_notice_counts(spark: SparkSession, d: str) -> DataFrame:
    """Notices of the tender lane with the counts of their lines, bids, awards and orders."""
    t = lanes.tender_lane(materialize(raw_tenders(spark, d)))
    out = lanes.postprocess_notices(t["notice"], t["notice_line"], t["bid_submission"], t["award"], read(spark, d, "silver_notice_purchase_order_link"))
    return out.select("notice_id", *[x for x in out.columns if x.startswith("notice_") and x.endswith(("_count", "_flag"))])


@query(f"""WITH {_RAW_TENDERS}, b AS (SELECT notice_id, item_code, supplier, CAST(arg_max(offered, updated_at) AS DOUBLE) AS x FROM r WHERE offer IS NOT NULL AND supplier IS NOT NULL AND notice_id IS NOT NULL GROUP BY notice_id, item_code, line, supplier, offer)
    SELECT l.notice_id, l.item_code, count(b.notice_id) AS line_bid_count, count(DISTINCT b.supplier) AS line_supplier_count, min(b.x) AS line_min_offer_amount, max(b.x) AS line_max_offer_amount, median(b.x) AS line_median_offer_amount
    FROM {_LINES} l LEFT JOIN b ON b.notice_id = l.notice_id AND b.item_code = l.item_code GROUP BY 1, 2""")
def lane_line_measures(spark: SparkSession, d: str) -> DataFrame:
    """Notice lines of the tender lane with the measures of their bids."""
    t = lanes.tender_lane(materialize(raw_tenders(spark, d)))
    out = lanes.postprocess_lines(t["notice_line"], t["bid_submission"])
    return out.select("notice_id", "item_code", "line_bid_count", "line_supplier_count", *[c(x).cast("double").alias(x) for x in ("line_min_offer_amount", "line_max_offer_amount", "line_median_offer_amount")])


_ORDER = {
    "Codigo": "purchase_order_id", "ID": "purchase_order_code", "Nombre": "purchase_order_name", "Tipo": "purchase_order_type", "FechaCreacion": "order_created_at", "FechaAceptacion": "order_accepted_at", "MontoTotalOC": "total_amount", "TipoMonedaOC": "currency_code",
    "CodigoLicitacion": "named_notice", "CodigoUnidadCompra": "unit", "CodigoOrganismoPublico": "org", "CodigoProveedor": "codigo_proveedor", "RutProveedor": "rut_proveedor", "NombreProveedor": "nombre_proveedor", "IDItem": "line_item_id", "codigoProductoONU": "onu_product_code", "codigoCategoria": "category_code",
    "Categoria": "category_name", "RubroN1": "category_level_1", "RubroN3": "category_level_3", "EspecificacionComprador": "buyer_item_spec_raw", "cantidad": "quantity_ordered", "UnidadMedida": "unit_of_measure", "precioNeto": "unit_net_price", "totalLineaNeto": "line_net_total",
}


def raw_orders(spark: SparkSession, d: str) -> DataFrame:
    po = read(spark, d, "silver_purchase_order").select("purchase_order_id", "purchase_order_code", "purchase_order_name", "purchase_order_type", "order_created_at", "order_accepted_at", "total_amount", "currency_code", "supplier_key", c("linked_notice_id").alias("named_notice"))
    supplier = entity(spark, d, "supplier_dim", ["supplier_key", "codigo_proveedor", "rut_proveedor", "nombre_proveedor"])
    unit = F.split_part("purchase_order_id", F.lit("-"), F.lit(1))
    buyer = entity(spark, d, "buyer", ["buyer_key", "codigo_organismo_publico"]).select(c("buyer_key").alias("unit"), c("codigo_organismo_publico").alias("org"))
    l = read(spark, d, "silver_purchase_order_line").join(po, "purchase_order_id", "left").join(supplier, "supplier_key", "left").withColumn("unit", unit).join(buyer, "unit", "left")  # noqa: E741
    return raw_rows(l, _ORDER)


_RAW_ORDERS = f"""k AS (SELECT * FROM {ORACLE_ENTITIES['supplier_dim']} q), y AS (SELECT * FROM {ORACLE_ENTITIES['buyer']} q),
    r AS (SELECT {_clean('l.purchase_order_id')} AS po, {_clean('l.line_item_id')} AS item, {_clean("split_part(l.purchase_order_id, '-', 1)")} AS unit, {_clean('y.codigo_organismo_publico')} AS org, coalesce('codigo:' || {_clean('k.codigo_proveedor')}, 'rut:' || {_clean('k.rut_proveedor')}) AS supplier,
      {_clean('l.category_code')} AS cat, {_clean('l.onu_product_code')} AS onu, {_clean('p.linked_notice_id')} AS notice, l.quantity_ordered AS q, l.line_net_total AS t, l.updated_at FROM silver_purchase_order_line l
      LEFT JOIN silver_purchase_order p ON p.purchase_order_id = l.purchase_order_id LEFT JOIN k ON k.supplier_key = p.supplier_key LEFT JOIN y ON y.buyer_key = split_part(l.purchase_order_id, '-', 1))"""


@query(f"WITH {_RAW_ORDERS} " + " UNION ALL ".join(f"SELECT '{k}' AS entity, count(*) AS n FROM (SELECT DISTINCT {x} FROM r WHERE ({x}) IS NOT NULL {more}) q" for k, x, more in (
    ("order", "po", ""), ("purchase_order", "po", ""), ("order_item", "po, item", "AND po IS NOT NULL AND item IS NOT NULL"), ("purchase_order_line", "po, item", "AND po IS NOT NULL AND item IS NOT NULL"), ("buyer", "unit", ""), ("contracting_unit", "unit", ""), ("buying_org", "org", ""),
    ("supplier", "supplier", ""), ("supplier_master", "supplier", ""), ("category", "coalesce(cat, 'onu:' || onu)", ""), ("category_ref", "coalesce('cat:' || cat, 'onu:' || onu)", ""), ("link", "notice, po", "AND po IS NOT NULL AND notice IS NOT NULL"),
)))
def lane_order_entities(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the order lane makes of each of its twelve entities."""
    return counts(lanes.order_lane(materialize(raw_orders(spark, d))))


@query(f"""WITH {_RAW_ORDERS}, l AS (SELECT po, item, max(struct_pack(o := updated_at, v := q)) FILTER (WHERE q IS NOT NULL) AS q, max(struct_pack(o := updated_at, v := t)) FILTER (WHERE t IS NOT NULL) AS t, max(struct_pack(o := updated_at, v := onu)) FILTER (WHERE onu IS NOT NULL) AS onu
      FROM r WHERE po IS NOT NULL AND item IS NOT NULL GROUP BY 1, 2)
    SELECT po AS purchase_order_id, count(*) AS purchase_order_line_count, CAST(sum(q.v) AS DOUBLE) AS quantity, CAST(sum(t.v) AS DOUBLE) AS net_amount, count(DISTINCT onu.v) AS purchase_order_unique_product_count FROM l GROUP BY 1""")
def lane_order_totals(spark: SparkSession, d: str) -> DataFrame:
    """Orders of the order lane that have lines, with their totals; of redelivered lines the last filled values count."""
    o = lanes.order_lane(materialize(raw_orders(spark, d)))
    out = lanes.postprocess_orders(o["purchase_order"], o["purchase_order_line"]).where("purchase_order_line_count > 0")
    return out.select("purchase_order_id", "purchase_order_line_count", c("purchase_order_total_quantity").cast("double").alias("quantity"), c("purchase_order_total_net_amount").cast("double").alias("net_amount"), "purchase_order_unique_product_count")


# --- snapshots

_STATE = "CASE official_status_code " + " ".join(f"WHEN {k} THEN '{v}'" for k, (_, v) in lanes.STATES.items()) + f" ELSE {_NORM.format(_clean('official_status_name'))} END"
_SEEN = "(SELECT *, row_number() OVER (PARTITION BY trim(external_notice_code) ORDER BY {} synced_at DESC, id DESC) AS rn FROM mercado_publico_notice_snapshot WHERE trim(external_notice_code) <> '')"


@query(f"""WITH s AS (SELECT *, {_STATE} AS st FROM {_SEEN.format('')} q WHERE rn = 1)
    SELECT trim(external_notice_code) AS notice_id, st AS mp_estado_canonical, CASE WHEN source_mode = 'detail-by-codigo' THEN 'api_detail' WHEN st = 'publicada' THEN 'api_publicada' WHEN source_mode IN ('active-discovery', 'rolling-window') THEN 'api_historical' ELSE 'api_unknown' END AS data_source_kind,
      CASE WHEN st = 'publicada' AND source_mode = 'detail-by-codigo' THEN 'current_publicada_detail' WHEN st = 'publicada' THEN 'current_publicada_discovery' ELSE 'historical_full_cycle' END AS availability_context, date_diff('day', publication_date, close_date) AS days_publication_to_close FROM s""")
def snapshot_notices(spark: SparkSession, d: str) -> DataFrame:
    """Notices made of the latest snapshots, with state and source."""
    return lanes.notices_from_snapshots(read(spark, d, "mercado_publico_notice_snapshot")).select("notice_id", "mp_estado_canonical", "data_source_kind", "availability_context", "days_publication_to_close")


_MODE = "CASE source_mode WHEN 'detail-by-codigo' THEN 0 WHEN 'rolling-window' THEN 1 ELSE 2 END,"


@query(f"""SELECT trim(external_notice_code) AS codigo_externo, trim(external_notice_code) AS codigo, notice_title AS nombre, official_status_name AS estado, CAST(estimated_amount AS DOUBLE) AS monto_estimado, buyer_unit_code AS codigo_unidad, date_diff('day', publication_date, close_date) AS cantidad_dias_licitacion
    FROM {_SEEN.format(_MODE)} q WHERE rn = 1""")
def snapshot_tenders(spark: SparkSession, d: str) -> DataFrame:
    """Tenders made of the most trusted snapshots."""
    t = lanes.tenders_from_snapshots(read(spark, d, "mercado_publico_notice_snapshot"))
    return t.select("codigo_externo", "codigo", "nombre", "estado", c("monto_estimado").cast("double").alias("monto_estimado"), "codigo_unidad", "cantidad_dias_licitacion")


@query(f"""WITH n AS (SELECT codigo_externo, estado, monto_estimado, numero_oferentes FROM {ORACLE_ENTITIES['notice']} q WHERE codigo_externo IS NOT NULL), s AS (SELECT trim(external_notice_code) AS k, official_status_name, estimated_amount FROM {_SEEN.format(_MODE)} q WHERE rn = 1)
    SELECT coalesce(s.k, n.codigo_externo) AS codigo_externo, CASE WHEN trim(s.official_status_name) <> '' THEN s.official_status_name ELSE n.estado END AS estado, CAST(coalesce(s.estimated_amount, n.monto_estimado) AS DOUBLE) AS monto_estimado, n.numero_oferentes FROM n FULL JOIN s ON s.k = n.codigo_externo""")
def canonical_tenders(spark: SparkSession, d: str) -> DataFrame:
    """Tenders with the snapshots merged in: what the snapshots have filled wins, the rest stays, unknown codes are added."""
    n = entity(spark, d, "notice", ["codigo_externo", "estado", "monto_estimado", "numero_oferentes"]).where("codigo_externo IS NOT NULL")
    out = lanes.canonicalize(read(spark, d, "mercado_publico_notice_snapshot"), n)
    return out.select("codigo_externo", "estado", c("monto_estimado").cast("double").alias("monto_estimado"), "numero_oferentes")


# --- flags and summaries


@query(f"""WITH t AS (SELECT codigo_externo, updated_at, coalesce({_NORM.format('tipo_adquisicion')}, '') AS x FROM normalized_licitaciones) SELECT codigo_externo, updated_at, contains(x, 'licitacion publica') AS flag_licitacion_publica, contains(x, 'licitacion privada') AS flag_licitacion_privada,
    contains(x, 'servicios personales especializados') OR contains(x, 'licitacion de servicios') AS flag_licitacion_servicios, contains(x, 'menor a 100 utm') OR contains(x, 'inferior a 100 utm') AS flag_menos_100_utm FROM t""")
def t9_tender_flags(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of tenders by what their normalised type says."""
    return read(spark, d, "normalized_licitaciones").select("codigo_externo", "updated_at", *[x.alias(k) for k, x in lanes.tender_flags(normalise(c("tipo_adquisicion"))).items()])


@query("""SELECT count(*) AS notices_seen, count(*) FILTER (WHERE trim(descripcion) <> '') AS notices_with_description, count(*) FILTER (WHERE trim(region_unidad) <> '') AS notices_with_buyer_region, count(*) FILTER (WHERE k.n > 0) AS notices_with_items,
    count(*) - count(*) FILTER (WHERE trim(descripcion) <> '') AS notices_missing_description, count(*) - count(*) FILTER (WHERE trim(region_unidad) <> '') AS notices_missing_buyer_region, count(*) - count(*) FILTER (WHERE k.n > 0) AS notices_missing_items, CAST(coalesce(sum(k.n), 0) AS BIGINT) AS items_seen
    FROM normalized_licitaciones t LEFT JOIN (SELECT notice_id, count(DISTINCT item_code) AS n FROM silver_notice_line GROUP BY 1) k ON k.notice_id = t.codigo_externo""")
def a25_sync_summary(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of delivered notices: descriptions, regions and items."""
    items = read(spark, d, "silver_notice_line").groupBy(c("notice_id").alias("codigo_externo")).agg(F.collect_set("item_code").alias("items"))
    n = read(spark, d, "normalized_licitaciones").select("codigo_externo", c("descripcion").alias("description"), c("region_unidad").alias("buyer_region")).join(items, "codigo_externo", "left")
    return lanes.sync_summary(n)


_TABLES = ["normalized_licitaciones", "normalized_suppliers", "normalized_buyers", "silver_notice_line", "silver_purchase_order", "silver_purchase_order_line", "silver_notice_purchase_order_link", "documents"]
# Kinds of columns that are listed: texts, times, and numbers whose name speaks of money or amounts.
_AMOUNTS = "monto|amount|price|total|cantidad|quantity|count"


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the tables with their kinds."""
    rows = [(t, f.name, "text" if f.dataType.typeName() == "string" else "time" if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else "number" if f.dataType.typeName() in ("decimal", "integer", "long", "double", "float") else "other") for t in _TABLES for f in read(spark, d, t).schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, kind string")


_COLUMNS = "SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN (" + ", ".join(repr(t) for t in _TABLES) + ") AND "


@query(_COLUMNS + "data_type = 'VARCHAR'")
def a5q_text_columns(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).where("kind = 'text'").drop("kind")


@query(_COLUMNS + "(data_type = 'DATE' OR data_type LIKE 'TIMESTAMP%')")
def a6q_time_columns(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).where("kind = 'time'").drop("kind")


@query(_COLUMNS + f"(data_type LIKE 'DECIMAL%' OR data_type IN ('INTEGER', 'BIGINT', 'DOUBLE', 'FLOAT')) AND regexp_matches(lower(column_name), '{_AMOUNTS}')")
def a7q_amount_columns(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).where("kind = 'number'").where(F.lower("column_name").rlike(_AMOUNTS)).drop("kind")


_KEYS = {"silver_notice_line": ["notice_line_id"], "silver_purchase_order": ["purchase_order_id"], "silver_purchase_order_line": ["purchase_order_line_id"], "normalized_licitaciones": ["codigo_externo"], "normalized_suppliers": ["supplier_key"], "normalized_buyers": ["buyer_key"]}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{','.join(k)}' AS key_columns, count(*) AS n_rows, count(DISTINCT {k[0]}) AS n_keys, count(*) FILTER (WHERE {k[0]} IS NULL) AS null_keys FROM {t}" for t, k in _KEYS.items()))
def a3q_declared_keys(spark: SparkSession, d: str) -> DataFrame:
    """Declared keys of the tables and whether they hold: a folder of files has no constraints to list, so they are measured."""
    parts = [read(spark, d, t).agg(F.count("*").alias("n_rows"), F.count_distinct(*k).alias("n_keys"), F.count_if(c(k[0]).isNull()).alias("null_keys")).select(F.lit(t).alias("table_name"), F.lit(",".join(k)).alias("key_columns"), "*") for t, k in _KEYS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- serving


@query("""SELECT purchase_order_id AS "purchaseOrderId", CAST(total_amount AS DOUBLE) AS "totalAmount", CASE WHEN date_trunc('second', order_created_at) = order_created_at THEN strftime(order_created_at, '%Y-%m-%dT%H:%M:%S') ELSE strftime(order_created_at, '%Y-%m-%dT%H:%M:%S.%f') END AS "orderCreatedAt",
    is_direct_award_flag AS "isDirectAwardFlag" FROM silver_purchase_order""")
def f13_served_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the names and values that callers get."""
    return serve.served(read(spark, d, "silver_purchase_order").select("purchase_order_id", "total_amount", "order_created_at", "is_direct_award_flag"))


@query("SELECT notice_id, first_line, n_lines FROM (SELECT notice_id, min(notice_line_id) AS first_line, count(DISTINCT notice_line_id) AS n_lines FROM silver_notice_line WHERE notice_id IS NOT NULL GROUP BY 1)")
def o9_first_lines(spark: SparkSession, d: str) -> DataFrame:
    """First line of each notice, with the number of its lines."""
    l = read(spark, d, "silver_notice_line").select("notice_id", "notice_line_id")  # noqa: E741
    first = serve.first_of_each(l, "notice_id", "notice_line_id").withColumnRenamed("notice_line_id", "first_line")
    return first.join(l.groupBy("notice_id").agg(F.count_distinct("notice_line_id").alias("n_lines")), "notice_id")


@query("SELECT DISTINCT notice_line_id FROM (SELECT notice_line_id FROM (SELECT DISTINCT notice_line_id FROM silver_notice_line) q WHERE notice_line_id > 100 ORDER BY notice_line_id LIMIT 50)")
def o8_next_page(spark: SparkSession, d: str) -> DataFrame:
    """The fifty lines after a key."""
    return serve.next_by_key(read(spark, d, "silver_notice_line").select("notice_line_id").distinct(), "notice_line_id", 100, 50)


@query("SELECT source_file_id, count(*) AS total_rows, max(raw_row_num) AS max_id, count(*) FILTER (WHERE raw_row_num > 100) AS new_rows FROM reliability_gate_orden_compra GROUP BY 1")
def a1_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Rows and greatest number of each raw file, and the rows after the hundredth: what an incremental run would read."""
    g = read(spark, d, "reliability_gate_orden_compra")
    fresh = lanes.after(g, "raw_row_num", {"last_processed_raw_id": 100}).groupBy("source_file_id").agg(F.count("*").alias("new_rows"))
    all_ = g.groupBy("source_file_id").agg(F.count("*").alias("total_rows"), F.max("raw_row_num").alias("max_id"))
    return all_.join(fresh, "source_file_id", "left").withColumn("new_rows", F.coalesce("new_rows", F.lit(0)))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES))
def a22_table_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table, for the summary of the data."""
    return serve.table_counts({t: read(spark, d, t) for t in _TABLES})


@query("SELECT payload_id, max(CAST(synced_at AS TIMESTAMP)) AS synced_at, min(CASE source_mode WHEN 'detail-by-codigo' THEN 0 WHEN 'rolling-window' THEN 1 ELSE 2 END) AS mode_rank FROM mercado_publico_notice_snapshot GROUP BY 1")
def a24_payload_scope(spark: SparkSession, d: str) -> DataFrame:
    """Last sight and most trusted mode of each payload."""
    s = read(spark, d, "mercado_publico_notice_snapshot")
    return s.groupBy("payload_id").agg(F.max("synced_at").cast("timestamp_ntz").alias("synced_at"), F.min(latest.mode_rank(c("source_mode"), latest.MODES, 2)).alias("mode_rank"))


@query("SELECT s.id, CASE WHEN s.source_mode = 'detail-by-codigo' THEN s.buyer_unit_name END AS informed FROM mercado_publico_notice_snapshot s")
def j4_payload_field(spark: SparkSession, d: str) -> DataFrame:
    """A field of the payload of each snapshot, where the payload is kept: left join by id, then one path into the text."""
    s = read(spark, d, "mercado_publico_notice_snapshot")
    payloads = s.where("source_mode = 'detail-by-codigo'").select(c("id").alias("pid"), F.to_json(F.struct(c("buyer_unit_name").alias("Informada"))).alias("payload_json"))
    return s.select("id").join(payloads, c("id") == c("pid"), "left").select("id", F.get_json_object("payload_json", "$.Informada").alias("informed"))
