"""Typed entities from raw rows: one declared projection each.

A raw row is its lineage columns and a map ``raw`` of header to text. A declaration names, line by line,
an output column, how it is parsed, and the headers it is taken from, first present one first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.functions import parsers as p
from caudal.functions.text import normalise, utm_amounts

# Source headers and entity columns.
TENDER = """
codigo_externo text CodigoExterno
codigo code Codigo
nombre text Nombre
descripcion text Descripcion
tipo_adquisicion text Tipo de Adquisicion
tipo_adquisicion_norm normtype Tipo de Adquisicion
codigo_estado int CodigoEstado
estado text Estado
tipo text Tipo
tipo_convocatoria text TipoConvocatoria
moneda_adquisicion text Moneda Adquisicion
visibilidad_monto_raw text VisibilidadMonto
monto_estimado dec MontoEstimado
numero_oferentes int NumeroOferentes
codigo_organismo text CodigoOrganismo
nombre_organismo text NombreOrganismo
codigo_unidad text CodigoUnidad
nombre_unidad text NombreUnidad
comuna_unidad text ComunaUnidad
region_unidad text RegionUnidad
fecha_publicacion ts FechaPublicacion
fecha_cierre ts FechaCierre
fecha_adjudicacion ts FechaAdjudicacion
fecha_estimada_adjudicacion ts FechaEstimadaAdjudicacion
fecha_inicio ts FechaInicio
fecha_final ts FechaFinal
cantidad_dias_licitacion days FechaCierre FechaPublicacion
"""
TENDER_ITEM = """
codigo_externo text CodigoExterno
codigo_item text Codigoitem | CodigoItem
correlativo text Correlativo
codigo_producto_onu text CodigoProductoONU
nombre_producto_generico text Nombre producto genrico
nombre_linea_adquisicion text Nombre linea Adquisicion
descripcion_linea_adquisicion text Descripcion linea Adquisicion
unidad_medida text UnidadMedida
cantidad dec Cantidad
rubro1 text Rubro1
rubro2 text Rubro2
rubro3 text Rubro3
"""
BID = """
oferta_key_sha256 bidkey
codigo_externo text CodigoExterno
codigo_item text Codigoitem | CodigoItem
correlativo text Correlativo
codigo_proveedor text CodigoProveedor
rut_proveedor text RutProveedor
nombre_proveedor text NombreProveedor
razon_social_proveedor text RazonSocialProveedor
estado_oferta text Estado Oferta
nombre_oferta text Nombre de la Oferta
cantidad_ofertada dec Cantidad Ofertada
monto_unitario_oferta dec MontoUnitarioOferta
valor_total_ofertado dec Valor Total Ofertado
oferta_seleccionada bool Oferta seleccionada
fecha_envio_oferta ts FechaEnvioOferta
cantidad_adjudicada dec CantidadAdjudicada
monto_linea_adjudica dec MontoLineaAdjudica
monto_estimado_adjudicado dec Monto Estimado Adjudicado
"""
ORDER = """
codigo_oc text Codigo
id_oc_raw text ID
link text Link
nombre text Nombre
descripcion_observaciones text Descripcion/Obervaciones
tipo text Tipo
procedencia_oc text ProcedenciaOC
es_trato_directo bool EsTratoDirecto
es_compra_agil bool EsCompraAgil
codigo_tipo text CodigoTipo
codigo_abreviado_tipo_oc text CodigoAbreviadoTipoOC
descripcion_tipo_oc text DescripcionTipoOC
codigo_estado text codigoEstado
estado text Estado
codigo_estado_proveedor text codigoEstadoProveedor
estado_proveedor text EstadoProveedor
fecha_creacion ts FechaCreacion
fecha_envio ts FechaEnvio
fecha_solicitud_cancelacion ts FechaSolicitudCancelacion
fecha_aceptacion ts FechaAceptacion
fecha_cancelacion ts FechaCancelacion
fecha_ultima_modificacion ts fechaUltimaModificacion
tiene_items bool tieneItems
promedio_calificacion dec PromedioCalificacion
cantidad_evaluacion int CantidadEvaluacion
tipo_moneda_oc text TipoMonedaOC
monto_total_oc dec MontoTotalOC
monto_total_oc_pesos_chilenos dec MontoTotalOC_PesosChilenos
impuestos dec Impuestos
tipo_impuesto text TipoImpuesto
descuentos dec Descuentos
cargos dec Cargos
total_neto_oc dec TotalNetoOC
total_cargos dec totalCargos
total_descuentos dec totalDescuentos
total_impuestos dec totalImpuestos
porcentaje_iva dec PorcentajeIva
codigo_licitacion text CodigoLicitacion
codigo_convenio_marco text Codigo_ConvenioMarco
has_codigo_licitacion present CodigoLicitacion
codigo_unidad_compra text CodigoUnidadCompra
rut_unidad_compra text RutUnidadCompra
unidad_compra text UnidadCompra
codigo_organismo_publico text CodigoOrganismoPublico
organismo_publico text OrganismoPublico
sector text sector
actividad_comprador text ActividadComprador
ciudad_unidad_compra text CiudadUnidadCompra
region_unidad_compra text RegionUnidadCompra
pais_unidad_compra text PaisUnidadCompra
codigo_sucursal text CodigoSucursal
rut_sucursal text RutSucursal
sucursal text Sucursal
codigo_proveedor text CodigoProveedor
nombre_proveedor text NombreProveedor
actividad_proveedor text ActividadProveedor
comuna_proveedor text ComunaProveedor
region_proveedor text RegionProveedor
pais_proveedor text PaisProveedor
financiamiento text Financiamiento
pais text Pais
tipo_despacho text TipoDespacho
forma_pago text Forma de Pago | FormaPago
"""
ORDER_ITEM = """
codigo_oc text Codigo
id_item text IDItem
codigo_producto_onu text codigoProductoONU
codigo_categoria text codigoCategoria
categoria text Categoria
nombre_producto_generico text NombreroductoGenerico | NombreProductoGenerico
rubro_n1 text RubroN1
rubro_n2 text RubroN2
rubro_n3 text RubroN3
especificacion_comprador text EspecificacionComprador
especificacion_proveedor text EspecificacionProveedor
cantidad dec cantidad
unidad_medida text UnidadMedida
moneda_item text monedaItem
precio_neto dec precioNeto
total_cargos dec totalCargos
total_descuentos dec totalDescuentos
total_impuestos dec totalImpuestos
total_linea_neto dec totalLineaNeto
"""
BUYER = """
buyer_key text CodigoUnidadCompra | CodigoUnidad
codigo_unidad_compra text CodigoUnidadCompra | CodigoUnidad
rut_unidad_compra text RutUnidadCompra
unidad_compra text UnidadCompra
codigo_organismo_publico text CodigoOrganismoPublico
organismo_publico text OrganismoPublico
sector text sector
actividad_comprador text ActividadComprador
ciudad_unidad_compra text CiudadUnidadCompra
region_unidad_compra text RegionUnidadCompra
pais_unidad_compra text PaisUnidadCompra
"""
SUPPLIER = """
supplier_key supplier
codigo_proveedor text CodigoProveedor
rut_proveedor text RutProveedor
nombre_proveedor text NombreProveedor
razon_social_proveedor text RazonSocialProveedor
actividad_proveedor text ActividadProveedor
comuna_proveedor text ComunaProveedor
region_proveedor text RegionProveedor
pais_proveedor text PaisProveedor
"""
CATEGORY = """
category_key category
codigo_categoria category
categoria text Categoria
rubro_n1 text RubroN1
rubro_n2 text RubroN2
rubro_n3 text RubroN3
"""
NOTICE = """
notice_id text CodigoExterno
external_notice_code text CodigoExterno
notice_url text Link
notice_title text Nombre
notice_description_raw text Descripcion
notice_description_clean norm Descripcion
procurement_method_name text Tipo de Adquisicion | Tipo
procurement_method_code text CodigoTipo
publication_date ts FechaPublicacion
created_date ts FechaCreacion
close_date ts FechaCierre
award_date ts FechaAdjudicacion
estimated_award_date ts FechaEstimadaAdjudicacion
estimated_amount dec MontoEstimado
currency_code text CodigoMoneda | Moneda
currency_name text Moneda Adquisicion | Moneda
number_of_bidders_reported int NumeroOferentes
complaint_count int CantidadReclamos
days_publication_to_close days FechaCierre FechaPublicacion
days_creation_to_close days FechaCierre FechaCreacion
days_close_to_award days FechaAdjudicacion FechaCierre
requires_toma_razon_flag bool0 TomaRazon
has_extension_flag bool0 ExtensionPlazo
has_site_visit_flag tspresent FechaVisitaTerreno
"""
NOTICE_LINE = """
notice_id text CodigoExterno
line_number text Correlativo
item_code text Codigoitem | CodigoItem
onu_product_code text CodigoProductoONU
category_level_1 text Rubro1
category_level_2 text Rubro2
category_level_3 text Rubro3
generic_product_name text Nombre producto genrico
line_name text Nombre linea Adquisicion
line_description_raw text Descripcion linea Adquisicion
line_description_clean norm Descripcion linea Adquisicion
unit_of_measure text UnidadMedida
quantity_requested dec Cantidad
"""
BID_SUBMISSION = """
bid_submission_id bidkey
notice_id text CodigoExterno
item_code text Codigoitem | CodigoItem
supplier_key supplier
supplier_branch_id text CodigoSucursalProveedor
offer_name text Nombre de la Oferta
offer_status text Estado Oferta
offer_submission_date ts FechaEnvioOferta
offered_quantity dec Cantidad Ofertada
offer_currency_name text Moneda de la Oferta
unit_price_offered dec MontoUnitarioOferta
total_price_offered dec Valor Total Ofertado
selected_offer_flag bool Oferta seleccionada
"""
AWARD = """
award_outcome_id awardkey
notice_id text CodigoExterno
item_code text Codigoitem | CodigoItem
supplier_key supplier
selected_offer_flag bool Oferta seleccionada
awarded_quantity dec CantidadAdjudicada
awarded_line_amount dec MontoLineaAdjudica
award_date ts FechaAdjudicacion
award_status text Estado
"""
PURCHASE_ORDER = """
purchase_order_id text Codigo
purchase_order_code text ID
purchase_order_url text Link
purchase_order_name text Nombre
purchase_order_description_raw text Descripcion/Obervaciones
purchase_order_description_clean norm Descripcion/Obervaciones
purchase_order_type text Tipo
purchase_order_type_code text CodigoTipo
purchase_order_status_code text codigoEstado
purchase_order_status_name text Estado
supplier_status_code text codigoEstadoProveedor
supplier_status_name text EstadoProveedor
order_created_at ts FechaCreacion
order_sent_at ts FechaEnvio
order_accepted_at ts FechaAceptacion
order_cancelled_at ts FechaCancelacion
order_last_modified_at ts fechaUltimaModificacion
days_order_creation_to_acceptance days FechaAceptacion FechaCreacion
days_order_creation_to_cancellation days FechaCancelacion FechaCreacion
total_amount dec MontoTotalOC
net_total_amount dec TotalNetoOC
tax_amount dec Impuestos
discount_amount dec Descuentos
charge_amount dec Cargos
currency_code text TipoMonedaOC
currency_name text TipoMonedaOC
supplier_key supplier
supplier_branch_id text CodigoSucursal
linked_notice_id text CodigoLicitacion
is_linked_to_notice_flag present CodigoLicitacion
is_direct_award_flag bool0 EsTratoDirecto
is_agile_purchase_flag bool0 EsCompraAgil
has_items_flag bool0 tieneItems
"""
PURCHASE_ORDER_LINE = """
purchase_order_id text Codigo
line_item_id text IDItem
linked_notice_id text CodigoLicitacion
onu_product_code text codigoProductoONU
category_code text codigoCategoria
category_name text Categoria
category_level_1 text RubroN1
category_level_2 text RubroN2
category_level_3 text RubroN3
generic_product_name text NombreroductoGenerico | NombreProductoGenerico
buyer_item_spec_raw text EspecificacionComprador
buyer_item_spec_clean norm EspecificacionComprador
supplier_item_spec_raw text EspecificacionProveedor
supplier_item_spec_clean norm EspecificacionProveedor
quantity_ordered dec cantidad
unit_of_measure text UnidadMedida
line_currency text monedaItem
unit_net_price dec precioNeto
line_net_total dec totalLineaNeto
line_tax_total dec totalImpuestos
line_discount_total dec totalDescuentos
line_charge_total dec totalCargos
"""
BUYING_ORG = """
buying_org_id text CodigoOrganismoPublico | CodigoOrganismo
org_name text OrganismoPublico | NombreOrganismo
org_sector text sector
"""
CONTRACTING_UNIT = """
contracting_unit_id text CodigoUnidadCompra | CodigoUnidad
buying_org_id text CodigoOrganismoPublico | CodigoOrganismo
unit_rut text RutUnidadCompra | RutUnidad
unit_name text UnidadCompra | NombreUnidad
unit_address text DireccionUnidad
unit_commune text ComunaUnidad
unit_region text RegionUnidad | RegionUnidadCompra
unit_city text CiudadUnidadCompra
unit_country text PaisUnidadCompra
"""
SUPPLIER_MASTER = """
supplier_id supplier
supplier_branch_id text CodigoSucursalProveedor | CodigoSucursal
supplier_rut text RutProveedor
supplier_trade_name text NombreProveedor
supplier_legal_name text RazonSocialProveedor
supplier_activity text ActividadProveedor
supplier_commune text ComunaProveedor
supplier_region text RegionProveedor
supplier_country text PaisProveedor
"""
CATEGORY_REF = """
category_ref_id categoryref
onu_product_code text codigoProductoONU | CodigoProductoONU
category_code text codigoCategoria
category_name text Categoria
category_level_1 text RubroN1 | Rubro1
category_level_2 text RubroN2 | Rubro2
category_level_3 text RubroN3 | Rubro3
generic_product_name_canonical text NombreroductoGenerico | NombreProductoGenerico | Nombre producto genrico
"""
LINK = """
notice_id text CodigoLicitacion
purchase_order_id text Codigo
"""
PARTICIPATION = """
supplier_id supplier
notice_id text CodigoExterno | CodigoLicitacion
was_selected_flag bool0 Oferta seleccionada
"""

LINEAGE = ["source_file_id", "row_hash_sha256"]


@dataclass(frozen=True)
class Entity:
    """An entity: its key, declaration, and what must be present for a row to give one."""

    key: list[str]
    declaration: str
    signals: tuple[str, ...] = ()
    also: tuple[str, ...] = ()


# Headers one of which must be present for a row to hold a bid.
BID_SIGNALS = ("Nombre de la Oferta", "Estado Oferta", "FechaEnvioOferta")
# Headers one of which must be present for a row to hold an award.
AWARD_SIGNALS = ("CantidadAdjudicada", "MontoLineaAdjudica", "Oferta seleccionada")
# Headers whose values identify a bid, and an award.
BID_KEY = (("CodigoExterno",), ("Codigoitem", "CodigoItem"), ("Correlativo",), ("CodigoProveedor",), ("RutProveedor",), ("Nombre de la Oferta",), ("FechaEnvioOferta",))
AWARD_KEY = (("CodigoExterno",), ("Codigoitem", "CodigoItem"), ("CodigoProveedor",), ("RutProveedor",), ("CantidadAdjudicada",), ("MontoLineaAdjudica",), ("FechaAdjudicacion",), ("Oferta seleccionada",))
# Headers that identify the supplier; a bid needs one of them.
SUPPLIER_SIGNALS = ("CodigoProveedor", "RutProveedor")

TENDER_LANE = {
    "tender": Entity(["codigo_externo"], TENDER), "tender_item": Entity(["codigo_externo", "codigo_item"], TENDER_ITEM), "bid": Entity(["oferta_key_sha256", "codigo_externo"], BID, BID_SIGNALS, SUPPLIER_SIGNALS),
    "notice": Entity(["notice_id"], NOTICE), "notice_line": Entity(["notice_id", "item_code"], NOTICE_LINE), "bid_submission": Entity(["bid_submission_id", "notice_id"], BID_SUBMISSION, BID_SIGNALS, SUPPLIER_SIGNALS),
    "award": Entity(["award_outcome_id", "notice_id"], AWARD, AWARD_SIGNALS, SUPPLIER_SIGNALS), "buying_org": Entity(["buying_org_id"], BUYING_ORG), "contracting_unit": Entity(["contracting_unit_id"], CONTRACTING_UNIT),
    "supplier": Entity(["supplier_key"], SUPPLIER), "supplier_master": Entity(["supplier_id"], SUPPLIER_MASTER), "category_ref": Entity(["category_ref_id"], CATEGORY_REF),
    "participation": Entity(["supplier_id", "notice_id"], PARTICIPATION),
}
ORDER_LANE = {
    "order": Entity(["codigo_oc"], ORDER), "order_item": Entity(["codigo_oc", "id_item"], ORDER_ITEM), "buyer": Entity(["buyer_key"], BUYER), "supplier": Entity(["supplier_key"], SUPPLIER),
    "category": Entity(["category_key"], CATEGORY), "purchase_order": Entity(["purchase_order_id"], PURCHASE_ORDER), "purchase_order_line": Entity(["purchase_order_id", "line_item_id"], PURCHASE_ORDER_LINE),
    "buying_org": Entity(["buying_org_id"], BUYING_ORG), "contracting_unit": Entity(["contracting_unit_id"], CONTRACTING_UNIT), "supplier_master": Entity(["supplier_id"], SUPPLIER_MASTER),
    "category_ref": Entity(["category_ref_id"], CATEGORY_REF), "link": Entity(["notice_id", "purchase_order_id"], LINK),
}


def _parsed(kind: str, v: list[Column]) -> Column:
    """Typed value of the cleaned header values ``v``."""
    if kind == "days":
        return p.whole_days(p.timestamp(v[0]), p.timestamp(v[1]))
    if kind in ("bidkey", "awardkey"):
        return p.hashed_key(*v)
    if kind in PREFIXES:
        return p.prefixed(*zip(PREFIXES[kind], v))
    if kind == "code":
        return F.coalesce(v[0], p.code_prefix(v[1]))
    return {
        "text": lambda c: c,
        "norm": normalise,
        "normtype": lambda c: utm_amounts(normalise(c)),
        "dec": p.decimal,
        "int": p.integer,
        "ts": p.timestamp,
        "bool": p.boolean,
        "bool0": p.boolean_or_false,
        "present": lambda c: c.isNotNull(),
        "tspresent": lambda c: p.timestamp(c).isNotNull(),
    }[kind](v[0])


# Prefixes of identities, in order of precedence, and the headers they are made of.
PREFIXES = {"supplier": ["codigo:", "rut:"], "category": ["", "onu:"], "categoryref": ["cat:", "onu:"]}
IDENTITIES = {
    "supplier": [["CodigoProveedor"], ["RutProveedor"]],
    "category": [["codigoCategoria"], ["codigoProductoONU"]],
    "categoryref": [["codigoCategoria"], ["codigoProductoONU", "CodigoProductoONU"]],
}


def _sources(kind: str, headers: list[str]) -> list[list[str]]:
    """Lists of alternative headers that a column of ``kind`` is made of."""
    if kind in IDENTITIES:
        return IDENTITIES[kind]
    if kind == "bidkey":
        return [list(n) for n in BID_KEY]
    if kind == "awardkey":
        return [list(n) for n in AWARD_KEY]
    if kind == "days":
        return [[h] for h in headers]
    return [headers, ["CodigoExterno"]] if kind == "code" else [headers]


def fields(declaration: str) -> list[tuple[str, str, list[str]]]:
    """(column, kind, headers) of a declaration."""
    out = []
    for line in declaration.strip().splitlines():
        name, kind, *rest = line.split(" ", 2)
        headers = rest[0].split(" ") if rest and kind == "days" else [h.strip() for h in rest[0].split("|")] if rest else []
        out.append((name, kind, headers))
    return out


def project(raw: DataFrame, entity: Entity, raw_column: str = "raw") -> DataFrame:
    """Rows of ``entity`` from raw rows; rows whose key is incomplete or that lack every signal give none.

    One narrow projection: headers nobody asks for are never parsed. Lineage columns and a ``seq`` column,
    where present, pass through. Values that do not parse are null.
    """
    columns = [(name, kind, _sources(kind, headers)) for name, kind, headers in fields(entity.declaration)]
    wanted = list(dict.fromkeys(tuple(alternatives) for _, _, sources in columns for alternatives in sources))
    at = {alternatives: f"v{i}" for i, alternatives in enumerate(wanted)}
    keep = [c for c in [*LINEAGE, "seq"] if c in raw.columns]
    present = F.lit(True)
    for group in (entity.signals, entity.also):
        if group:
            present = present & p.any_present(*[F.try_element_at(F.col(raw_column), F.lit(s)) for s in group])
    # Each header is cleaned once, in a projection of its own; the parsers use its value several times.
    cleaned = raw.where(present).select(*keep, *[p.pick(F.col(raw_column), *alternatives).alias(c) for alternatives, c in at.items()])
    out = cleaned.select(*[_parsed(kind, [F.col(at[tuple(a)]) for a in sources]).alias(name) for name, kind, sources in columns], *keep)
    return out.where(" AND ".join(f"{k} IS NOT NULL" for k in entity.key))


def rejected_count(raw: DataFrame, entity: Entity) -> int:
    """Rows that gave no entity."""
    return raw.count() - project(raw, entity).count()
