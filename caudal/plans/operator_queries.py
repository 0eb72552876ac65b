"""Queries that exercise the operators one by one over the test tables, and their independent SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.functions import parsers as p
from caudal.functions import text as t
from caudal.operators import enrich as en
from caudal.operators import latest as la
from caudal.operators import ledger, merge, quality
from caudal.plans.entities import ORDER_LANE, TENDER_LANE, project
from caudal.scale import read, shared_dir
from caudal.sources import api_json

c = F.col
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with its SQL."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- parsing


@query("SELECT o_orderkey AS id, CAST(round(o_totalprice, 2) AS DOUBLE) AS value, CAST(round(o_totalprice, 2) AS DOUBLE) AS scientific, CAST(trunc(o_totalprice) AS INTEGER) AS whole, CAST(NULL AS DOUBLE) AS bad FROM orders")
def t3_decimals(spark: SparkSession, d: str) -> DataFrame:
    """Numbers written with thousands dots, money signs and decimal commas, or scientific, and read back."""
    o = read(spark, d, "orders")
    plain = F.format_number("o_totalprice", 2)
    latin = F.concat(F.lit("$ "), F.translate(plain, ",.", ".,"))
    scientific = F.concat(F.translate((F.round("o_totalprice", 2) / 100).cast("decimal(20,4)").cast("string"), ".", ","), F.lit("e+02"))
    return o.select(c("o_orderkey").alias("id"), p.decimal(latin).cast("double").alias("value"), p.decimal(scientific).cast("double").alias("scientific"), p.integer(latin).alias("whole"), p.decimal(F.lit("1e20")).cast("double").alias("bad"))


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS a, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS b, CAST(o_orderdate AS TIMESTAMP) AS c, CAST(NULL AS TIMESTAMP) AS bad FROM orders")
def t5_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Times written in three styles, one with an offset, and read back."""
    at = c("o_orderdate").cast("timestamp_ntz")
    styles = {"a": F.date_format(at, "dd/MM/yyyy HH:mm:ss"), "b": F.date_format(at, "d-M-yyyy"), "c": F.concat(F.date_format(at + F.expr("interval 3 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+03:00")), "bad": F.lit("1900-01-01 00:00:00")}
    return read(spark, d, "orders").select(c("o_orderkey").alias("id"), *[p.timestamp(s).alias(k) for k, s in styles.items()])


@query("SELECT codigo_externo, updated_at, CASE WHEN lower(trim(visibilidad_monto_raw)) IN ('1','si','sí') THEN true WHEN lower(trim(visibilidad_monto_raw)) IN ('0','no') THEN false END AS visible FROM normalized_licitaciones")
def t6_booleans(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "normalized_licitaciones").select("codigo_externo", "updated_at", p.boolean(c("visibilidad_monto_raw")).alias("visible"))


@query("SELECT supplier_key, sha256(coalesce(codigo_proveedor, '') || '|' || coalesce(rut_proveedor, '') || '|' || coalesce(nombre_proveedor, '')) AS key, coalesce('codigo:' || codigo_proveedor, 'rut:' || rut_proveedor) AS identity FROM normalized_suppliers")
def t11_keys(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "normalized_suppliers")
    return s.select("supplier_key", p.hashed_key(c("codigo_proveedor"), c("rut_proveedor"), c("nombre_proveedor")).alias("key"), p.prefixed(("codigo:", c("codigo_proveedor")), ("rut:", c("rut_proveedor"))).alias("identity"))


@query("SELECT codigo_externo, updated_at, CAST(floor((epoch(fecha_cierre) - epoch(fecha_publicacion)) / 86400) AS INTEGER) AS days, split_part(codigo_externo, '-', 1) AS prefix FROM normalized_licitaciones")
def t20_whole_days(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "normalized_licitaciones")
    return n.select("codigo_externo", "updated_at", p.whole_days(c("fecha_cierre"), c("fecha_publicacion")).alias("days"), p.code_prefix(c("codigo_externo")).alias("prefix"))


# --- entity projections: the columns written as source text and read back

_TENDER = {
    "CodigoExterno": "codigo_externo", "Codigo": "codigo", "Nombre": "nombre", "Descripcion": "descripcion", "Tipo de Adquisicion": "tipo_adquisicion", "CodigoEstado": "codigo_estado", "Estado": "estado", "MontoEstimado": "monto_estimado",
    "NumeroOferentes": "numero_oferentes", "CodigoOrganismo": "codigo_organismo", "CodigoUnidad": "codigo_unidad", "RegionUnidad": "region_unidad", "FechaPublicacion": "fecha_publicacion", "FechaCierre": "fecha_cierre",
}
_ORDER = {
    "Codigo": "purchase_order_id", "ID": "purchase_order_code", "Nombre": "purchase_order_name", "Tipo": "purchase_order_type", "codigoEstado": "purchase_order_status_code", "FechaCreacion": "order_created_at", "FechaAceptacion": "order_accepted_at",
    "MontoTotalOC": "total_amount", "TotalNetoOC": "net_total_amount", "TipoMonedaOC": "currency_code", "CodigoLicitacion": "linked_notice_id", "EsTratoDirecto": "is_direct_award_flag",
}
_ORDER_LINE = {
    "Codigo": "purchase_order_id", "IDItem": "line_item_id", "codigoProductoONU": "onu_product_code", "codigoCategoria": "category_code", "Categoria": "category_name", "RubroN1": "category_level_1", "EspecificacionComprador": "buyer_item_spec_raw",
    "cantidad": "quantity_ordered", "UnidadMedida": "unit_of_measure", "precioNeto": "unit_net_price", "totalLineaNeto": "line_net_total",
}
_NOTICE_LINE = {
    "CodigoExterno": "notice_id", "Correlativo": "line_number", "CodigoItem": "item_code", "CodigoProductoONU": "onu_product_code", "Rubro1": "category_level_1", "Nombre producto genrico": "generic_product_name", "Descripcion linea Adquisicion": "line_description_raw", "Cantidad": "quantity_requested",
}


def as_raw(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Rows as a map of source headers to text, numbers with decimal commas, dates day first."""
    kinds = dict(df.dtypes)

    def written(name: str) -> Column:
        kind = kinds[name]
        if kind.startswith("decimal"):
            return F.translate(c(name).cast("string"), ".", ",")
        if kind.startswith("timestamp"):
            return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return c(name).cast("string")

    pairs = [x for h, name in headers.items() for x in (F.lit(h), written(name))]
    return df.select(F.create_map(*pairs).alias("raw"), "row_hash_sha256" if "row_hash_sha256" in df.columns else F.lit(None).cast("string").alias("row_hash_sha256"))


def _clean_sql(col: str) -> str:
    return f"CASE WHEN upper(trim({col})) NOT IN ('', 'NA', 'N/A', 'NULL') THEN trim({col}) END"


@query(f"""SELECT codigo_externo, codigo, {_clean_sql('nombre')} AS nombre, codigo_estado, CAST(monto_estimado AS DOUBLE) AS monto_estimado, numero_oferentes, {_clean_sql('region_unidad')} AS region_unidad, fecha_publicacion, fecha_cierre,
    CAST(floor((epoch(fecha_cierre) - epoch(fecha_publicacion)) / 86400) AS INTEGER) AS cantidad_dias_licitacion, row_hash_sha256 FROM normalized_licitaciones""")
def entity_tender(spark: SparkSession, d: str) -> DataFrame:
    out = project(as_raw(read(spark, d, "normalized_licitaciones"), _TENDER), TENDER_LANE["tender"])
    return out.select("codigo_externo", "codigo", "nombre", "codigo_estado", c("monto_estimado").cast("double").alias("monto_estimado"), "numero_oferentes", "region_unidad", "fecha_publicacion", "fecha_cierre", "cantidad_dias_licitacion", "row_hash_sha256")


@query(f"SELECT notice_id, line_number, item_code, {_clean_sql('onu_product_code')} AS onu_product_code, category_level_1, generic_product_name, CAST(quantity_requested AS DOUBLE) AS quantity_requested, row_hash_sha256 FROM silver_notice_line")
def entity_notice_line(spark: SparkSession, d: str) -> DataFrame:
    out = project(as_raw(read(spark, d, "silver_notice_line"), _NOTICE_LINE), TENDER_LANE["notice_line"])
    return out.select("notice_id", "line_number", "item_code", "onu_product_code", "category_level_1", "generic_product_name", c("quantity_requested").cast("double").alias("quantity_requested"), "row_hash_sha256")


@query("""SELECT purchase_order_id, purchase_order_code, order_created_at, order_accepted_at, CAST(total_amount AS DOUBLE) AS total_amount, linked_notice_id, linked_notice_id IS NOT NULL AS is_linked_to_notice_flag, coalesce(is_direct_award_flag, false) AS is_direct_award_flag,
    CAST(floor((epoch(order_accepted_at) - epoch(order_created_at)) / 86400) AS INTEGER) AS days_to_acceptance FROM silver_purchase_order""")
def entity_purchase_order(spark: SparkSession, d: str) -> DataFrame:
    out = project(as_raw(read(spark, d, "silver_purchase_order"), _ORDER), ORDER_LANE["purchase_order"])
    return out.select("purchase_order_id", "purchase_order_code", "order_created_at", "order_accepted_at", c("total_amount").cast("double").alias("total_amount"), "linked_notice_id", "is_linked_to_notice_flag", "is_direct_award_flag", c("days_order_creation_to_acceptance").alias("days_to_acceptance"))


@query(f"SELECT purchase_order_id, line_item_id, {_clean_sql('onu_product_code')} AS onu_product_code, category_code, CAST(quantity_ordered AS DOUBLE) AS quantity_ordered, CAST(unit_net_price AS DOUBLE) AS unit_net_price, row_hash_sha256 FROM silver_purchase_order_line")
def entity_purchase_order_line(spark: SparkSession, d: str) -> DataFrame:
    out = project(as_raw(read(spark, d, "silver_purchase_order_line"), _ORDER_LINE), ORDER_LANE["purchase_order_line"])
    return out.select("purchase_order_id", "line_item_id", "onu_product_code", "category_code", c("quantity_ordered").cast("double").alias("quantity_ordered"), c("unit_net_price").cast("double").alias("unit_net_price"), "row_hash_sha256")


# --- text

_NORM = "trim(regexp_replace(strip_accents(lower({})), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS digest, length({_NORM.format('text')}) AS n FROM documents")
def n1_normalise(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").withColumn("x", t.normalise(c("text"))).select("doc_id", F.md5("x").alias("digest"), F.length("x").alias("n"))


@query(f"""WITH k AS (SELECT doc_id, regexp_extract_all({_NORM.format('text')}, '[a-z0-9]+')[1:128] AS w FROM documents),
    g AS (SELECT doc_id, unnest(w) AS ngram FROM k UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] AS ngram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM k) x),
    n AS (SELECT doc_id, ngram, count(*) AS n FROM g GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ngram) AS pos FROM n)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, ngram, CAST(n AS INTEGER) AS n FROM r WHERE pos <= 24""")
def n6_top_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent single words and pairs of each document; counted in Arrow batches, no shuffle."""
    words = t.annotation_tokens(t.normalise(c("text")))
    rows = read(spark, d, "documents").select("doc_id", words.alias("w")).select("doc_id", F.posexplode(t.top_ngrams(c("w"))).alias("pos", "g"))
    return rows.select("doc_id", (c("pos") + 1).alias("pos"), "g.ngram", c("g.count").alias("n"))


# Keywords of the text domains.
DOMAINS = {
    "health": ["salud", "hospital", "medic", "farmac", "clinica"],
    "construction": ["obra", "construccion", "infraestructura", "edificio", "mantencion vial"],
    "it_services": ["software", "licencia", "tecnolog", "comput", "servidor", "red"],
    "maintenance": ["mantencion", "mantenimiento", "reparacion", "soporte", "servicio tecnico"],
    "outsourcing": ["outsourcing", "externalizacion", "servicio externo"],
}
VERSION = "silver_nlp_v1"


def _flag_sql(domain: str) -> str:
    return "(" + " OR ".join(f"contains(j, '{k}')" for k in DOMAINS[domain]) + ")"


@query(f"""WITH k AS (SELECT notice_line_id, row_hash_sha256, array_to_string(regexp_extract_all({_NORM.format('line_description_raw')}, '[a-z0-9]+')[1:128], ' ') AS j, len(regexp_extract_all({_NORM.format('line_description_raw')}, '[a-z0-9]+')) AS n,
      sha256(coalesce(notice_id || ':' || item_code, '') || '|' || coalesce({_NORM.format('line_description_raw')}, '')) AS h FROM silver_notice_line)
    SELECT DISTINCT notice_line_id, row_hash_sha256, CASE WHEN n < 2 THEN 'und' ELSE 'es' END AS language, {', '.join(f'{_flag_sql(x)} AS {x}' for x in DOMAINS)}, CASE {' '.join(f"WHEN {_flag_sql(x)} THEN '{x}'" for x in DOMAINS)} END AS label, 'tfidf://silver_notice_line/{VERSION}/' || h AS ref FROM k""")
def n11_line_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Text annotation of notice lines: language, domain flags, first domain, artifact reference."""
    clean = t.annotation_text(c("line_description_raw"))
    base = read(spark, d, "silver_notice_line").withColumn("clean", clean).withColumn("w", t.annotation_tokens(c("clean"))).withColumn("f", t.keyword_flags(c("w"), DOMAINS))
    ref = t.artifact_ref("tfidf", "silver_notice_line", VERSION, F.concat_ws(":", "notice_id", "item_code"), c("clean"))
    return base.select("notice_line_id", "row_hash_sha256", t.language(c("w")).alias("language"), *[c("f")[x].alias(x) for x in DOMAINS], F.get(t.tags(c("f"), DOMAINS), F.lit(0)).alias("label"), ref.alias("ref")).distinct()


@query()
def n11_notice_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Text annotation of notices; rows without a code have none. DuckDB lacks the compatibility form, so a test compares it with brute force."""
    n = read(spark, d, "normalized_licitaciones").where("codigo_externo IS NOT NULL").select(c("codigo_externo").alias("notice_id"), "row_hash_sha256", t.annotation_text(c("descripcion")).alias("clean"))
    base = n.withColumn("w", t.annotation_tokens(c("clean"))).withColumn("f", t.keyword_flags(c("w"), DOMAINS))
    ref = t.artifact_ref("tfidf", "silver_notice", VERSION, c("notice_id"), c("clean"))
    return base.select("notice_id", "row_hash_sha256", F.lit("notice_description").alias("scope"), t.language(c("w")).alias("language"), *[c("f")[x].alias(x) for x in DOMAINS], F.get(t.tags(c("f"), DOMAINS), F.lit(0)).alias("label"), ref.alias("ref"))


_TWO = [_NORM.format("buyer_item_spec_raw"), _NORM.format("supplier_item_spec_raw")]


def _side_sql(text: str) -> str:
    j = f"array_to_string(regexp_extract_all({text}, '[a-z0-9]+')[1:128], ' ')"
    return "CASE WHEN " + " OR ".join(f"contains({j}, '{k}')" for k in DOMAINS["health"]) + " THEN true ELSE false END"


@query(f"""WITH b AS (SELECT purchase_order_line_id, purchase_order_id, line_item_id, row_hash_sha256, {_TWO[0]} AS x, {_TWO[1]} AS y FROM silver_purchase_order_line WHERE purchase_order_id IS NOT NULL AND line_item_id IS NOT NULL),
    k AS (SELECT *, concat_ws(' ', nullif(x, ''), nullif(y, '')) AS t FROM b), g AS (SELECT *, array_to_string(regexp_extract_all(t, '[a-z0-9]+')[1:128], ' ') AS j, len(regexp_extract_all(t, '[a-z0-9]+')) AS n FROM k)
    SELECT DISTINCT purchase_order_line_id, row_hash_sha256, CASE WHEN n < 2 THEN 'und' ELSE 'es' END AS language, {_side_sql('x')} AS buyer_health, {_side_sql('y')} AS supplier_health, CASE {' '.join(f"WHEN {_flag_sql(x)} THEN '{x}'" for x in DOMAINS)} END AS label,
      'tfidf://silver_purchase_order_line/{VERSION}/' || sha256(purchase_order_id || ':' || line_item_id || '|' || t) AS ref FROM g""")
def n11_order_line_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Text annotation of order lines, of both specifications together, with the flags of each; no key, no annotation."""
    l = read(spark, d, "silver_purchase_order_line").where("purchase_order_id IS NOT NULL AND line_item_id IS NOT NULL")  # noqa: E741
    l = l.select("purchase_order_line_id", "purchase_order_id", "line_item_id", "row_hash_sha256", t.annotation_text(c("buyer_item_spec_raw")).alias("x"), t.annotation_text(c("supplier_item_spec_raw")).alias("y"))  # noqa: E741
    both = l.withColumn("clean", F.concat_ws(" ", F.nullif("x", F.lit("")), F.nullif("y", F.lit("")))).withColumn("w", t.annotation_tokens(c("clean"))).withColumn("f", t.keyword_flags(c("w"), DOMAINS))
    sides = [t.keyword_flags(t.annotation_tokens(c(x)), DOMAINS)["health"].alias(f"{k}_health") for k, x in (("buyer", "x"), ("supplier", "y"))]
    ref = t.artifact_ref("tfidf", "silver_purchase_order_line", VERSION, F.concat_ws(":", "purchase_order_id", "line_item_id"), c("clean"))
    return both.select("purchase_order_line_id", "row_hash_sha256", t.language(c("w")).alias("language"), *sides, F.get(t.tags(c("f"), DOMAINS), F.lit(0)).alias("label"), ref.alias("ref")).distinct()


_JSON = "coalesce(to_json({})::VARCHAR, 'null')".format


@query(f"""SELECT id, sha256('{{"codigo":' || {_JSON('external_notice_code')} || ',"estado":' || {_JSON('official_status_name')} || ',"modo":' || {_JSON('source_mode')} || '}}') AS request_hash FROM mercado_publico_notice_snapshot""")
def n13_request_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Identity of requests: canonical JSON of the parameters without the secret one."""
    s = read(spark, d, "mercado_publico_notice_snapshot")
    params = F.create_map(F.lit("modo"), c("source_mode"), F.lit("Ticket"), F.lit("secret"), F.lit("codigo"), c("external_notice_code"), F.lit("estado"), c("official_status_name"))
    return s.select("id", p.request_hash(params).alias("request_hash"))


@query(f"""SELECT source_file_id, raw_row_num, sha256('{{"raw_text":' || {_JSON('raw_text')} || ',"row":' || {_JSON('CAST(raw_row_num AS VARCHAR)')} || '}}') AS row_hash FROM reliability_gate_orden_compra""")
def s6_row_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Row hashes of raw records: canonical JSON of the named texts."""
    g = read(spark, d, "reliability_gate_orden_compra")
    return g.select("source_file_id", "raw_row_num", p.row_hash(F.create_map(F.lit("row"), c("raw_row_num").cast("string"), F.lit("raw_text"), c("raw_text"))).alias("row_hash"))


# --- merging and choosing


@query("SELECT supplier_key, nombre_proveedor, rut_proveedor, CAST(updated_at AS TIMESTAMP) AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY supplier_key ORDER BY updated_at DESC) AS r FROM normalized_suppliers) WHERE r = 1")
def u1_last_rows(spark: SparkSession, d: str) -> DataFrame:
    return merge.last_rows(read(spark, d, "normalized_suppliers").select("supplier_key", "nombre_proveedor", "rut_proveedor", "updated_at"), ["supplier_key"], ["updated_at"]).select("supplier_key", "nombre_proveedor", "rut_proveedor", c("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("""SELECT codigo_externo, arg_max(descripcion, updated_at) FILTER (WHERE trim(descripcion) <> '') AS descripcion, arg_max(region_unidad, updated_at) FILTER (WHERE trim(region_unidad) <> '') AS region_unidad,
    CAST(arg_max(monto_estimado, updated_at) FILTER (WHERE monto_estimado IS NOT NULL) AS DOUBLE) AS monto_estimado, arg_max(fecha_cierre, updated_at) FILTER (WHERE fecha_cierre IS NOT NULL) AS fecha_cierre FROM normalized_licitaciones GROUP BY codigo_externo""")
def u2_last_filled(spark: SparkSession, d: str) -> DataFrame:
    """For each tender and column the last value that is filled, over all loads."""
    df = read(spark, d, "normalized_licitaciones").select("codigo_externo", "descripcion", "region_unidad", "monto_estimado", "fecha_cierre", "updated_at")
    return merge.last_filled(df, ["codigo_externo"], "updated_at").select("codigo_externo", "descripcion", "region_unidad", c("monto_estimado").cast("double").alias("monto_estimado"), "fecha_cierre")


_HALF = "source_file_id < '00000050-0000-4000-8000-000000000005'"


@query(f"""WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY codigo_externo ORDER BY updated_at DESC) AS r FROM normalized_licitaciones WHERE {_HALF}) WHERE r = 1),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY codigo_externo ORDER BY updated_at DESC) AS r FROM normalized_licitaciones WHERE NOT {_HALF}) WHERE r = 1)
    SELECT coalesce(b.codigo_externo, a.codigo_externo) AS codigo_externo, coalesce(nullif(trim(b.region_unidad), ''), a.region_unidad) IS NULL AS no_region, coalesce(b.estado, a.estado) AS estado, CAST(coalesce(b.monto_estimado, a.monto_estimado) AS DOUBLE) AS monto_estimado
    FROM a FULL JOIN b ON a.codigo_externo = b.codigo_externo""")
def u2_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Earlier loads merged with later ones; a later null never overwrites."""
    df = read(spark, d, "normalized_licitaciones").select("codigo_externo", "region_unidad", "estado", "monto_estimado", "updated_at", "source_file_id")
    first, then = (merge.last_rows(df.where(w), ["codigo_externo"], ["updated_at"]) for w in (_HALF, f"NOT {_HALF}"))
    out = merge.upsert(first, then, ["codigo_externo"])
    return out.select("codigo_externo", c("region_unidad").isNull().alias("no_region"), "estado", c("monto_estimado").cast("double").alias("monto_estimado"))


@query("SELECT DISTINCT b.supplier_key FROM normalized_suppliers b WHERE b.source_file_id >= '00000051-0000-4000-8000-000000000004' AND b.supplier_key NOT IN (SELECT supplier_key FROM normalized_suppliers WHERE source_file_id < '00000051-0000-4000-8000-000000000004')")
def u3_insert_new(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "normalized_suppliers")
    early = c("source_file_id") < "00000051-0000-4000-8000-000000000004"
    return merge.insert_new(s.where(early), s.where(~early), ["supplier_key"]).select("supplier_key")


@query("SELECT l.notice_purchase_order_link_id FROM silver_notice_purchase_order_link l WHERE EXISTS (SELECT 1 FROM silver_purchase_order p WHERE p.purchase_order_id = l.purchase_order_id) AND EXISTS (SELECT 1 FROM normalized_licitaciones n WHERE n.codigo_externo = l.notice_id)")
def u6_prune_orphans(spark: SparkSession, d: str) -> DataFrame:
    link, po, n = read(spark, d, "silver_notice_purchase_order_link", "silver_purchase_order", "normalized_licitaciones")
    return merge.prune_orphans(link, [(po, "purchase_order_id", "purchase_order_id"), (n, "codigo_externo", "notice_id")]).select("notice_purchase_order_link_id")


@query("SELECT p.linked_notice_id AS notice_id, p.purchase_order_id FROM silver_purchase_order p WHERE p.linked_notice_id IN (SELECT codigo_externo FROM normalized_licitaciones) AND NOT EXISTS (SELECT 1 FROM silver_notice_purchase_order_link l WHERE l.notice_id = p.linked_notice_id AND l.purchase_order_id = p.purchase_order_id)")
def u10_reconcile_links(spark: SparkSession, d: str) -> DataFrame:
    po, n, link = read(spark, d, "silver_purchase_order", "normalized_licitaciones", "silver_notice_purchase_order_link")
    return en.reconcile_links(po, n, link, "purchase_order_id", "linked_notice_id", "codigo_externo")


@query("""SELECT p.linked_notice_id AS notice_id, p.purchase_order_id FROM silver_purchase_order p WHERE p.linked_notice_id IN (SELECT codigo_externo FROM normalized_licitaciones)
    AND NOT EXISTS (SELECT 1 FROM silver_notice_purchase_order_link l WHERE l.notice_id = p.linked_notice_id AND l.purchase_order_id = p.purchase_order_id AND l.link_type = 'candidate_review')""")
def u10_reconcile_reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Orders that name a known notice, without a reviewed link."""
    po, n, link = read(spark, d, "silver_purchase_order", "normalized_licitaciones", "silver_notice_purchase_order_link")
    return en.reconcile_links(po, n, link.where("link_type = 'candidate_review'"), "purchase_order_id", "linked_notice_id", "codigo_externo")


@query("SELECT count(*) FILTER (WHERE notice_line_id IS NULL) AS null_keys, count(*) FILTER (WHERE n > 1) AS repeated_keys, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS repeated_rows FROM (SELECT notice_line_id, count(*) AS n FROM silver_notice_line GROUP BY 1)")
def u11_key_problems(spark: SparkSession, d: str) -> DataFrame:
    return merge.key_problems(read(spark, d, "silver_notice_line"), ["notice_line_id"])


_RANK = "CASE source_mode WHEN 'detail-by-codigo' THEN 0 WHEN 'rolling-window' THEN 1 ELSE 2 END"


@query(f"SELECT external_notice_code, id, source_mode FROM (SELECT *, row_number() OVER (PARTITION BY external_notice_code ORDER BY {_RANK}, synced_at DESC, id DESC) AS r FROM mercado_publico_notice_snapshot) WHERE r = 1")
def w4_latest_by_mode(spark: SparkSession, d: str) -> DataFrame:
    return la.latest_snapshots(read(spark, d, "mercado_publico_notice_snapshot"), "external_notice_code", "source_mode", "synced_at", "id", ["external_notice_code", "id", "source_mode"])


@query("SELECT external_notice_code, id FROM (SELECT *, row_number() OVER (PARTITION BY external_notice_code ORDER BY synced_at DESC, id DESC) AS r FROM mercado_publico_notice_snapshot) WHERE r = 1")
def w5_latest_by_time(spark: SparkSession, d: str) -> DataFrame:
    return la.latest_snapshots(read(spark, d, "mercado_publico_notice_snapshot"), "external_notice_code", None, "synced_at", "id", ["external_notice_code", "id"])


@query("""SELECT n.codigo_externo, coalesce(nullif(trim(n.region_unidad), ''), 'x') = 'x' AS no_region, CAST(coalesce(n.monto_estimado, s.estimated_amount) AS DOUBLE) AS monto_estimado
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY codigo_externo ORDER BY updated_at DESC) AS r FROM normalized_licitaciones) WHERE r = 1) n
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY external_notice_code ORDER BY synced_at DESC, id DESC) AS r FROM mercado_publico_notice_snapshot) WHERE r = 1) s ON s.external_notice_code = n.codigo_externo""")
def u12_fill_from_snapshot(spark: SparkSession, d: str) -> DataFrame:
    n, s = read(spark, d, "normalized_licitaciones", "mercado_publico_notice_snapshot")
    rows = merge.last_rows(n.select("codigo_externo", "region_unidad", "monto_estimado", "updated_at"), ["codigo_externo"], ["updated_at"])
    snap = la.latest_snapshots(s, "external_notice_code", None, "synced_at", "id", ["external_notice_code", "estimated_amount"]).withColumnRenamed("external_notice_code", "codigo_externo")
    out = merge.fill_from(rows, snap, ["codigo_externo"], {"monto_estimado": "estimated_amount"})
    return out.select("codigo_externo", F.coalesce(F.trim("region_unidad") == "", F.lit(True)).alias("no_region"), c("monto_estimado").cast("double").alias("monto_estimado"))


# --- enrichment and quality


@query("""SELECT o.o_orderkey AS notice_id, coalesce(b.bid_count, 0) AS bid_count, coalesce(b.supplier_count, 0) AS supplier_count, coalesce(b.selected_bid_count, 0) AS selected_bid_count, b.min_offer, b.max_offer, round(b.avg_offer, 6) AS avg_offer, round(b.median_offer, 6) AS median_offer,
    round(CASE WHEN b.avg_offer <> 0 THEN (b.max_offer - b.min_offer) / b.avg_offer END, 6) AS price_dispersion
    FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS bid_count, count(DISTINCT l_suppkey) AS supplier_count, count(*) FILTER (WHERE l_returnflag <> 'N') AS selected_bid_count, min(l_extendedprice) AS min_offer, max(l_extendedprice) AS max_offer, avg(l_extendedprice) AS avg_offer, median(l_extendedprice) AS median_offer FROM lineitem GROUP BY 1) b ON b.l_orderkey = o.o_orderkey""")
def a5_enrich_notices(spark: SparkSession, d: str) -> DataFrame:
    """Counts, exact median and dispersion of the bids of each notice; notices without bids stay."""
    o, l = read(spark, d, "orders", "lineitem")  # noqa: E741
    bids = l.select(c("l_orderkey").alias("notice_id"), "l_suppkey", "l_extendedprice", (c("l_returnflag") != "N").alias("selected"))
    out = en.enrich(o.select(c("o_orderkey").alias("notice_id")), bids, ["notice_id"], en.offer_measures(c("l_extendedprice"), c("l_suppkey"), c("selected")), ["bid_count", "supplier_count", "selected_bid_count"])
    return out.withColumns({x: F.round(x, 6) for x in ("avg_offer", "median_offer", "price_dispersion")})


@query("SELECT buyer, count(*) AS parties, round(sum(a), 2) AS total, round(sum(a * a) / (sum(a) * sum(a)), 8) AS hhi FROM (SELECT split_part(purchase_order_id, '-', 1) AS buyer, supplier_key, sum(CAST(total_amount AS DOUBLE)) AS a FROM silver_purchase_order GROUP BY 1, 2) g GROUP BY buyer")
def a10_concentration(spark: SparkSession, d: str) -> DataFrame:
    po = read(spark, d, "silver_purchase_order").withColumn("buyer", F.split_part("purchase_order_id", F.lit("-"), F.lit(1)))
    return en.concentration(po, ["buyer"], "supplier_key", c("total_amount").cast("double")).select("buyer", "parties", F.round("total", 2).alias("total"), F.round("hhi", 8).alias("hhi"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE codigo_externo IS NULL OR trim(codigo_externo) = '') AS no_code, count(*) FILTER (WHERE fecha_cierre IS NULL) AS no_close, count(*) FILTER (WHERE fecha_cierre < fecha_publicacion) AS reversed FROM normalized_licitaciones")
def r11_audit(spark: SparkSession, d: str) -> DataFrame:
    return quality.audit(read(spark, d, "normalized_licitaciones"), {"no_code": c("codigo_externo").isNull() | (F.trim("codigo_externo") == ""), "no_close": c("fecha_cierre").isNull(), "reversed": c("fecha_cierre") < c("fecha_publicacion")})


# --- reads

_OPEN = """WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY codigo_externo ORDER BY updated_at DESC, row_hash_sha256 DESC) AS r FROM normalized_licitaciones) WHERE r = 1),
    s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY external_notice_code ORDER BY {rank}, synced_at DESC, id DESC) AS r FROM mercado_publico_notice_snapshot) WHERE r = 1),
    k AS (SELECT notice_id, min(category_level_1) AS category, count(DISTINCT notice_line_id) AS line_count FROM silver_notice_line GROUP BY 1),
    o AS (SELECT n.codigo_externo AS notice_id, coalesce(n.nombre, s.notice_title) AS title, coalesce(n.estado, s.official_status_name) AS status, coalesce(n.nombre_unidad, s.buyer_unit_name) AS unit, coalesce(n.region_unidad, '') AS region, CAST(coalesce(n.monto_estimado, s.estimated_amount) AS DOUBLE) AS amount,
      coalesce(n.moneda_adquisicion, s.currency_code, 'CLP') AS currency, n.fecha_publicacion AS published, n.fecha_cierre AS closes, n.flag_licitacion_publica AS public, n.flag_menos_100_utm AS small, coalesce(k.category, '') AS category, coalesce(k.line_count, 0) AS line_count,
      s.source_mode, s.official_status_name AS snapshot_status
      FROM n LEFT JOIN s ON s.external_notice_code = n.codigo_externo LEFT JOIN k ON k.notice_id = n.codigo_externo)""".format(rank=_RANK)
_FILTER = "WHERE (title ILIKE '%servicio%' OR unit ILIKE '%servicio%') AND published >= TIMESTAMP '2025-09-01' AND published < TIMESTAMP '2026-03-01' AND amount >= 100000"
_SHOWN = "notice_id, title, unit, region, amount, currency, published, closes, category, line_count"


def opportunities(spark: SparkSession, d: str) -> DataFrame:
    """Notices with what is shown of them, from tender, latest snapshot and lines; one join a side, one row a notice."""
    n, s, line = read(spark, d, "normalized_licitaciones", "mercado_publico_notice_snapshot", "silver_notice_line")
    own = ["codigo_externo", "nombre", "estado", "nombre_unidad", "region_unidad", "monto_estimado", "moneda_adquisicion", "fecha_publicacion", "fecha_cierre", "flag_licitacion_publica", "flag_menos_100_utm"]
    n = la.latest(n, ["codigo_externo"], [c("updated_at"), c("row_hash_sha256")], own)
    seen = ["external_notice_code", "notice_title", "buyer_unit_name", "estimated_amount", "currency_code", "source_mode", "official_status_name"]
    s = la.latest_snapshots(s, "external_notice_code", "source_mode", "synced_at", "id", seen).withColumnRenamed("external_notice_code", "codigo_externo")
    k = line.groupBy(c("notice_id").alias("codigo_externo")).agg(F.min("category_level_1").alias("category"), F.count_distinct("notice_line_id").alias("line_count"))
    return n.join(s, "codigo_externo", "left").join(k, "codigo_externo", "left").select(
        c("codigo_externo").alias("notice_id"), F.coalesce("nombre", "notice_title").alias("title"), F.coalesce("estado", "official_status_name").alias("status"), F.coalesce("nombre_unidad", "buyer_unit_name").alias("unit"), F.coalesce("region_unidad", F.lit("")).alias("region"),
        F.coalesce("monto_estimado", "estimated_amount").cast("double").alias("amount"), F.coalesce("moneda_adquisicion", "currency_code", F.lit("CLP")).alias("currency"), c("fecha_publicacion").alias("published"), c("fecha_cierre").alias("closes"),
        c("flag_licitacion_publica").alias("public"), c("flag_menos_100_utm").alias("small"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("line_count", F.lit(0)).alias("line_count"), "source_mode", c("official_status_name").alias("snapshot_status"),
    )


def _found(spark: SparkSession, d: str) -> DataFrame:
    return la.search(opportunities(spark, d), contains={"q": (["title", "unit"], "servicio"), "buyer": (["unit"], None)}, equal={"region": None}, ranges={"amount": (100000, None)}, days={"published": ("2025-09-01", "2026-02-28")})


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*_SHOWN.split(", "))


@query(f"{_OPEN} SELECT {_SHOWN} FROM o {_FILTER} ORDER BY amount DESC NULLS LAST, notice_id LIMIT 20 OFFSET 20")
def r1_list(spark: SparkSession, d: str) -> DataFrame:
    """Second page of the notices that a search finds, by amount."""
    return la.page(_shown(_found(spark, d)), "amount", True, ["notice_id"], 2, 20)


@query(f"""{_OPEN} SELECT {_SHOWN} FROM o WHERE (notice_id ILIKE '%25%' OR title ILIKE '%25%') AND status ILIKE 'cerrada' AND region ILIKE '%regi%' AND category ILIKE '%a%' AND published >= TIMESTAMP '2025-01-01' AND published < TIMESTAMP '2027-01-01'
    AND closes >= TIMESTAMP '2025-01-01' AND closes < TIMESTAMP '2027-01-01' AND amount BETWEEN 1000 AND 1e15 AND small IS NOT NULL AND NOT small AND public ORDER BY closes ASC NULLS LAST, notice_id LIMIT 20""")
def r1_every_filter(spark: SparkSession, d: str) -> DataFrame:
    """First page of a search by text, status, region, category, both dates, amounts, size and kind at once."""
    found = la.search(
        opportunities(spark, d), contains={"q": (["notice_id", "title"], "25"), "region": (["region"], "regi"), "category": (["category"], "a")}, equal={"small": False, "public": True},
        ranges={"amount": (1000, 1e15)}, days={"published": ("2025-01-01", "2026-12-31"), "closes": ("2025-01-01", "2026-12-31")},
    ).where(c("status").ilike("cerrada"))
    return la.page(_shown(found), "closes", False, ["notice_id"], 1, 20)


SORTS = [(by, down) for by in ("closes", "published", "amount") for down in (False, True)]


@query(f"{_OPEN} " + " UNION ALL ".join(f"SELECT '{by}' AS by, {str(down).lower()} AS descending, notice_id FROM (SELECT notice_id FROM o ORDER BY {by} {'DESC' if down else 'ASC'} NULLS LAST, notice_id LIMIT 10) q{i}" for i, (by, down) in enumerate(SORTS)))
def r1_sort_keys(spark: SparkSession, d: str) -> DataFrame:
    """First ten notices by each key and direction; days that remain sort as the closing date does."""
    o = opportunities(spark, d).select("notice_id", "closes", "published", "amount")
    return reduce(DataFrame.unionByName, [la.page(o, by, down, ["notice_id"], 1, 10).select(F.lit(by).alias("by"), F.lit(down).alias("descending"), "notice_id") for by, down in SORTS])


@query(f"{_OPEN} SELECT count(*) AS n FROM o {_FILTER}")
def r2_count(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).agg(F.count("*").alias("n"))


_AT = "2026-01-15"


@query(f"""{_OPEN}, m AS (SELECT *, closes - TIMESTAMP '{_AT}' AS left_, lower(coalesce(status, '')) AS st FROM o) SELECT count(*) AS n, count(amount) AS with_amount, round(coalesce(avg(amount), 0), 2) AS mean_amount, round(coalesce(sum(amount), 0), 0) AS total, count(*) FILTER (WHERE closes IS NULL) AS no_close,
    count(*) FILTER (WHERE left_ > INTERVAL 7 DAY) AS closes_later, count(*) FILTER (WHERE left_ > INTERVAL 0 DAY AND left_ <= INTERVAL 7 DAY) AS closes_soon, count(*) FILTER (WHERE left_ <= INTERVAL 0 DAY AND st NOT LIKE '%adjudicada%' AND st NOT LIKE '%revocada%' AND st NOT LIKE '%suspendida%') AS closed,
    count(*) FILTER (WHERE st LIKE '%adjudicada%') AS awarded, count(*) FILTER (WHERE st LIKE '%revocada%' OR st LIKE '%suspendida%') AS withdrawn, count(*) FILTER (WHERE st = 'publicada') AS published_now, count(*) FILTER (WHERE source_mode = 'detail-by-codigo') AS with_detail,
    count(*) FILTER (WHERE source_mode IS NOT NULL) AS in_snapshots, count(*) FILTER (WHERE line_count > 1) AS several_lines, count(DISTINCT unit) AS units FROM m""")
def r3_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all notices by closing (against a given moment), status and source, and their amounts: one aggregate."""
    a, late, soon = c("amount"), F.lit(_AT).cast("timestamp_ntz") + F.expr("interval 7 days"), F.lit(_AT).cast("timestamp_ntz")
    st = F.lower(F.coalesce("status", F.lit("")))
    tests = {
        "no_close": c("closes").isNull(), "closes_later": c("closes") > late, "closes_soon": (c("closes") > soon) & (c("closes") <= late), "closed": (c("closes") <= soon) & ~st.rlike("adjudicada|revocada|suspendida"), "awarded": st.contains("adjudicada"),
        "withdrawn": st.rlike("revocada|suspendida"), "published_now": st == "publicada", "with_detail": c("source_mode") == "detail-by-codigo", "in_snapshots": c("source_mode").isNotNull(), "several_lines": c("line_count") > 1,
    }
    return opportunities(spark, d).agg(
        F.count("*").alias("n"), F.count("amount").alias("with_amount"), F.round(F.coalesce(F.avg(a), F.lit(0.0)), 2).alias("mean_amount"), F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 0).alias("total"),
        *[F.count_if(t).alias(k) for k, t in tests.items()], F.count_distinct("unit").alias("units"),
    )


@query("""SELECT b.l_orderkey AS notice_id, b.l_suppkey AS supplier, b.l_linenumber AS bid, s.s_name AS supplier_name, coalesce(o.item, b.item) AS item, CAST(coalesce(o.amount, b.l_extendedprice) AS DOUBLE) AS amount, o.amount IS NOT NULL AS has_offer
    FROM (SELECT *, CASE WHEN l_partkey % 5 <> 0 THEN l_partkey END AS item FROM lineitem) b
    LEFT JOIN (SELECT l_orderkey, l_suppkey, CASE WHEN l_partkey % 5 <> 0 THEN l_partkey END AS item, l_extendedprice * (1 - l_discount) AS amount FROM lineitem WHERE l_returnflag = 'R') o
      ON o.l_orderkey = b.l_orderkey AND o.l_suppkey = b.l_suppkey AND (o.item = b.item OR o.item IS NULL AND b.item IS NULL) LEFT JOIN supplier s ON s.s_suppkey = b.l_suppkey""")
def r6_detail_offers(spark: SparkSession, d: str) -> DataFrame:
    """Bids with the offers of their notice, supplier and item (an unknown item matches an unknown one) and the supplier's name."""
    l, s = read(spark, d, "lineitem", "supplier")  # noqa: E741
    item = F.when(c("l_partkey") % 5 != 0, c("l_partkey"))
    bids = l.select(c("l_orderkey").alias("notice_id"), c("l_suppkey").alias("supplier"), c("l_linenumber").alias("bid"), item.alias("bid_item"), "l_extendedprice")
    offers = l.where("l_returnflag = 'R'").select(c("l_orderkey").alias("on"), c("l_suppkey").alias("os"), item.alias("offer_item"), (c("l_extendedprice") * (1 - c("l_discount"))).alias("offered"))
    both = bids.join(offers, (c("notice_id") == c("on")) & (c("supplier") == c("os")) & c("bid_item").eqNullSafe(c("offer_item")), "left")
    named = both.join(s.select(c("s_suppkey").alias("supplier"), c("s_name").alias("supplier_name")), "supplier", "left")
    return named.select("notice_id", "supplier", "bid", "supplier_name", F.coalesce("offer_item", "bid_item").alias("item"), F.coalesce("offered", "l_extendedprice").cast("double").alias("amount"), c("offered").isNotNull().alias("has_offer"))


@query("""SELECT l.notice_id, l.notice_line_id, l.onu_product_code, coalesce(p.n, 0) AS order_lines, CASE WHEN p.n > 0 AND m.k > 1 THEN 'low' WHEN p.n > 0 THEN 'medium' ELSE 'none' END AS certainty
    FROM (SELECT DISTINCT notice_id, notice_line_id, onu_product_code FROM silver_notice_line) l
    LEFT JOIN (SELECT linked_notice_id, onu_product_code, count(DISTINCT purchase_order_line_id) AS n FROM silver_purchase_order_line WHERE linked_notice_id IS NOT NULL GROUP BY 1, 2) p ON p.linked_notice_id = l.notice_id AND p.onu_product_code = l.onu_product_code
    LEFT JOIN (SELECT notice_id, onu_product_code, count(DISTINCT notice_line_id) AS k FROM silver_notice_line GROUP BY 1, 2) m ON m.notice_id = l.notice_id AND m.onu_product_code = l.onu_product_code""")
def r5_detail_lines(spark: SparkSession, d: str) -> DataFrame:
    """Notice lines with how many order lines of their product there are, and how sure that relation is."""
    line, poline = read(spark, d, "silver_notice_line", "silver_purchase_order_line")
    on = ["notice_id", "onu_product_code"]
    bought = poline.where("linked_notice_id IS NOT NULL").groupBy(c("linked_notice_id").alias("notice_id"), "onu_product_code").agg(F.count_distinct("purchase_order_line_id").alias("n"))
    alike = line.groupBy(*on).agg(F.count_distinct("notice_line_id").alias("k"))
    out = line.select("notice_id", "notice_line_id", "onu_product_code").distinct().join(bought, on, "left").join(alike, on, "left")
    certainty = F.when((c("n") > 0) & (c("k") > 1), "low").when(c("n") > 0, "medium").otherwise("none")
    return out.select("notice_id", "notice_line_id", "onu_product_code", F.coalesce("n", F.lit(0)).alias("order_lines"), certainty.alias("certainty"))


@query("""SELECT a.purchase_order_line_id, count(b.notice_line_id) AS matches FROM (SELECT DISTINCT purchase_order_line_id, linked_notice_id, onu_product_code FROM silver_purchase_order_line WHERE linked_notice_id IS NOT NULL) a
    LEFT JOIN (SELECT DISTINCT notice_line_id, notice_id, onu_product_code FROM silver_notice_line) b ON b.notice_id = a.linked_notice_id AND b.onu_product_code IS NOT DISTINCT FROM a.onu_product_code GROUP BY 1""")
def j7_null_safe_join(spark: SparkSession, d: str) -> DataFrame:
    """Join on two keys of which the second matches null with null; it stays a hash or merge join."""
    line, poline = read(spark, d, "silver_notice_line", "silver_purchase_order_line")
    a = poline.where("linked_notice_id IS NOT NULL").select("purchase_order_line_id", "linked_notice_id", c("onu_product_code").alias("pc")).distinct()
    b = line.select("notice_line_id", "notice_id", "onu_product_code").distinct()
    return a.join(b, (c("notice_id") == c("linked_notice_id")) & c("pc").eqNullSafe(c("onu_product_code")), "left").groupBy("purchase_order_line_id").agg(F.count("notice_line_id").alias("matches"))


# --- nested payloads


@query("""SELECT payload_id, trim(external_notice_code) AS external_notice_code, notice_title, official_status_code, publication_date, close_date, buyer_org_code, buyer_unit_name, CAST(estimated_amount AS DOUBLE) AS estimated_amount FROM mercado_publico_notice_snapshot""")
def s14_flatten_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots written as nested payloads with mixed date styles, then typed and flattened again."""
    s = read(spark, d, "mercado_publico_notice_snapshot")
    notice = F.struct(
        c("external_notice_code").alias("CodigoExterno"), c("notice_title").alias("Nombre"), c("official_status_code").alias("CodigoEstado"), F.date_format("publication_date", "ddMMyyyy").alias("FechaPublicacion"),
        F.struct(F.date_format("close_date", "dd/MM/yyyy").alias("FechaCierre")).alias("Fechas"), F.struct(c("buyer_org_code").alias("CodigoOrganismo"), c("buyer_unit_name").alias("NombreUnidad")).alias("Comprador"),
        F.translate(c("estimated_amount").cast("string"), ".", ",").alias("MontoEstimado"),
    )
    payloads = s.select("payload_id", "id", F.to_json(F.struct(F.array(notice).alias("Listado"))).alias("payload_json"))
    flat = api_json.flatten(payloads, ["payload_id"])
    return flat.select("payload_id", "external_notice_code", "notice_title", "official_status_code", "publication_date", "close_date", "buyer_org_code", "buyer_unit_name", c("estimated_amount").cast("double").alias("estimated_amount"))


@query("SELECT l.notice_id AS external_notice_code, CAST(l.line_number AS INTEGER) AS item_correlative, l.onu_product_code AS product_code, CAST(l.quantity_requested AS DOUBLE) AS quantity FROM (SELECT DISTINCT notice_id, line_number, onu_product_code, quantity_requested FROM silver_notice_line) l")
def n15_flatten_items(spark: SparkSession, d: str) -> DataFrame:
    """Lines nested into their notices' payloads and exploded again."""
    line = read(spark, d, "silver_notice_line").select("notice_id", "line_number", "onu_product_code", "quantity_requested").distinct()
    item = F.struct(c("line_number").alias("Correlativo"), c("onu_product_code").alias("CodigoProducto"), F.translate(c("quantity_requested").cast("string"), ".", ",").alias("Cantidad"))
    notices = line.groupBy("notice_id").agg(F.collect_list(item).alias("Listado"))  # a notice has a handful of lines
    payloads = notices.select(F.to_json(F.struct(F.array(F.struct(c("notice_id").alias("CodigoExterno"), F.struct("Listado").alias("Items"))).alias("Listado"))).alias("payload_json"))
    return api_json.items(api_json.flatten(payloads, []), []).select("external_notice_code", "item_correlative", "product_code", c("quantity").cast("double").alias("quantity"))


@query("SELECT count(DISTINCT payload_sha256) AS n FROM mercado_publico_notice_snapshot")
def s15_payloads_once(spark: SparkSession, d: str) -> DataFrame:
    return api_json.once(read(spark, d, "mercado_publico_notice_snapshot").select("payload_sha256")).agg(F.count("*").alias("n"))


# --- stateful

_NOW = "2024-01-15 00:00:00"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(c("event_id") % 5 == 0, "retry").when(c("event_id") % 7 == 0, "running").otherwise("available")
    return read(spark, d, "events").select(
        c("event_id").alias("id"), kind.alias("status"), (c("user_id") % 3).cast("int").alias("priority"), c("ts").cast("timestamp_ntz").alias("available_at"), c("ts").cast("timestamp_ntz").alias("created_at"),
        (c("event_id") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), F.lit(None).cast("string").alias("worker"),
    )


@query(f"""WITH j AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 AND ts <= TIMESTAMP '{_NOW}' THEN 'available' WHEN event_id % 5 = 0 THEN 'retry' WHEN event_id % 7 = 0 THEN 'running' ELSE 'available' END AS status, CAST(user_id % 3 AS INTEGER) AS priority, CAST(ts AS TIMESTAMP) AS ts, CAST(event_id % 4 AS INTEGER) AS attempts FROM events),
    f AS (SELECT id FROM j WHERE status = 'available' AND ts <= TIMESTAMP '{_NOW}' ORDER BY priority, ts, ts, id LIMIT 1)
    SELECT j.id, CASE WHEN f.id IS NULL THEN j.status ELSE 'running' END AS status, j.attempts + CASE WHEN f.id IS NULL THEN 0 ELSE 1 END AS attempts, CASE WHEN f.id IS NOT NULL THEN 'w1' END AS worker FROM j LEFT JOIN f ON f.id = j.id""")
def l5_claim_job(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(_NOW).cast("timestamp_ntz")
    return ledger.claim_next(ledger.promote_retries(_jobs(spark, d), now), now, "w1").select("id", "status", "attempts", "worker")


@query("SELECT event_id AS id, CASE WHEN event_id IN (11, 22) THEN CASE WHEN event_id % 4 < 3 THEN 'retry' ELSE 'dead' END WHEN event_id % 5 = 0 THEN 'retry' WHEN event_id % 7 = 0 THEN 'running' ELSE 'available' END AS status FROM events")
def l6_fail_jobs(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(_NOW).cast("timestamp_ntz")
    jobs = reduce(lambda j, i: ledger.fail_job(j, i, True, 60, now), (11, 22), _jobs(spark, d))
    return jobs.select("id", "status")


@query("""SELECT code FROM (SELECT external_notice_code AS code, max(close_date) AS close_date, max(CAST(synced_at AS DATE)) FILTER (WHERE source_mode = 'detail-by-codigo') AS detail_date FROM mercado_publico_notice_snapshot GROUP BY 1)
    WHERE detail_date IS NULL OR date_diff('day', detail_date, DATE '2026-03-20') >= 7
    ORDER BY CASE WHEN close_date > DATE '2026-03-20' AND close_date <= DATE '2026-03-27' THEN 0 ELSE 1 END, close_date ASC NULLS LAST, detail_date ASC NULLS FIRST, code LIMIT 50""")
def o5_detail_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "mercado_publico_notice_snapshot")
    detail = F.max(F.when(c("source_mode") == "detail-by-codigo", F.to_date("synced_at")))
    notices = s.groupBy(c("external_notice_code").alias("code")).agg(F.max("close_date").alias("close_date"), detail.alias("detail_date"))
    return ledger.detail_candidates(notices, F.lit("2026-03-20").cast("date")).select("code")


@query(ORACLE["w4_latest_by_mode"])
def l3_stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest snapshot of each notice kept by a stream over the arriving files; equals the batch choice."""
    import uuid

    from caudal.streaming.snapshots import BucketedTable, merge_latest

    path = f"{d}/mercado_publico_notice_snapshot.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/mercado_publico_notice_snapshot.parque[t]")
    at = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    table = BucketedTable(spark, f"{at}/table")
    merge_latest(stream, table, "external_notice_code", "source_mode", "synced_at", "id", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table.read().select("external_notice_code", "id", "source_mode")


@query(f"{_OPEN} SELECT {_SHOWN}, status, source_mode, snapshot_status FROM o")
def r4_detail_header(spark: SparkSession, d: str) -> DataFrame:
    """Header of every notice with the source of its latest snapshot."""
    return opportunities(spark, d).select(*_SHOWN.split(", "), "status", "source_mode", "snapshot_status")


@query("""SELECT linked_notice_id AS notice_id, purchase_order_id, purchase_order_status_name, order_created_at, CAST(total_amount AS DOUBLE) AS total_amount,
    CAST(row_number() OVER (PARTITION BY linked_notice_id ORDER BY order_created_at ASC NULLS LAST, purchase_order_id) AS INTEGER) AS position FROM silver_purchase_order WHERE linked_notice_id IS NOT NULL""")
def r7_detail_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each notice in the order of their creation."""
    from pyspark.sql import Window

    po = read(spark, d, "silver_purchase_order").where("linked_notice_id IS NOT NULL")
    position = F.row_number().over(Window.partitionBy("linked_notice_id").orderBy(c("order_created_at").asc_nulls_last(), "purchase_order_id"))
    return po.select(c("linked_notice_id").alias("notice_id"), "purchase_order_id", "purchase_order_status_name", "order_created_at", c("total_amount").cast("double").alias("total_amount"), position.alias("position"))


_LISTED = ["normalized_licitaciones", "normalized_suppliers", "normalized_buyers", "silver_notice_line", "silver_purchase_order", "silver_purchase_order_line", "silver_notice_purchase_order_link", "documents"]


@query(f"SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ({', '.join(repr(x) for x in _LISTED)})")
def a1q_catalog_columns(spark: SparkSession, d: str) -> DataFrame:
    """Tables and their columns."""
    return spark.createDataFrame([(x, n) for x in _LISTED for n in read(spark, d, x).columns], "table_name string, column_name string")


@query("SELECT event_id, event_type FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 200")
def r9_newest_runs(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return ledger.newest(e, "ts", "event_id", event_type=e.agg(F.min("event_type")).first()[0]).select("event_id", "event_type")
