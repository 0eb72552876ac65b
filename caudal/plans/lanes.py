"""Whole lanes: raw rows to merged entities, snapshots to entities, enrichment, and the daily run over them.

A lane projects every entity from one raw frame, reduces each to one row a key (the last filled value of every
column, in the order of ``seq``), and merges that into what is stored, where nothing filled is overwritten by
nothing. Derived counts are never merged: ``postprocess_*`` computes them anew from the children.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.functions.parsers import clean, row_hash
from caudal.functions.text import normalise
from caudal.operators import enrich, latest, merge, quality
from caudal.plans.entities import ORDER_LANE, TENDER_LANE, Entity, project
from caudal.scale import materialize

Tables = dict[str, DataFrame]


# --- lanes


def tender_flags(norm: Column) -> dict[str, Column]:
    """What a normalised kind of acquisition says of a tender; false where it is unknown."""
    text = F.coalesce(norm, F.lit(""))
    return {
        "flag_licitacion_publica": text.contains("licitacion publica"), "flag_licitacion_privada": text.contains("licitacion privada"),
        "flag_licitacion_servicios": text.contains("servicios personales especializados") | text.contains("licitacion de servicios"), "flag_menos_100_utm": text.contains("menor a 100 utm") | text.contains("inferior a 100 utm"),
    }


def build(raw: DataFrame, lane: dict[str, Entity], stored: Tables | None = None) -> Tables:
    """The entities of ``lane`` from raw rows (``raw`` map, ``seq``, lineage), merged into ``stored``.

    Each entity is its own narrow plan over the raw frame, which should be a table or materialised. A key that
    holds a third of the rows costs one row a map task. An entity without stored rows starts empty.
    """
    out: Tables = {}
    for name, entity in lane.items():
        rows = merge.last_filled(project(raw, entity), entity.key, "seq").drop("seq")
        before = (stored or {}).get(name)
        rows = rows if before is None else merge.upsert(before, rows, entity.key)
        # Flags follow from the merged kind; a row without one must not unset them.
        out[name] = rows.withColumns(tender_flags(F.col("tipo_adquisicion_norm"))) if name == "tender" else rows
    return out


def tender_lane(raw: DataFrame, stored: Tables | None = None) -> Tables:
    return build(raw, TENDER_LANE, stored)


def order_lane(raw: DataFrame, stored: Tables | None = None) -> Tables:
    return build(raw, ORDER_LANE, stored)


def lane_metrics(raw: DataFrame, lane: dict[str, Entity], stored: Tables | None = None) -> list[quality.LoadMetrics]:
    """Rows read, accepted, distinct, new and already there, of each entity."""
    out = []
    for name, entity in lane.items():
        rows = project(raw, entity)
        before = (stored or {}).get(name)
        out.append(quality.load_metrics(name, raw, rows, rows.limit(0) if before is None else before, entity.key))
    return out


# --- enrichment


def postprocess_notices(notice: DataFrame, line: DataFrame, bid: DataFrame, award: DataFrame, link: DataFrame) -> DataFrame:
    """Notices with the counts of their lines, bids, suppliers, awards and orders; each child table is grouped before it joins."""
    lines = line.groupBy("notice_id").agg(F.count("*").alias("notice_line_count"))
    bids = bid.groupBy("notice_id").agg(F.count("*").alias("notice_bid_count"), F.count_distinct("supplier_key").alias("notice_supplier_count"), F.count_if("selected_offer_flag").alias("notice_selected_bid_count"))
    awarded = F.coalesce("selected_offer_flag", F.lit(False)) | F.col("awarded_line_amount").isNotNull()
    awards = award.groupBy("notice_id").agg(F.count_if(awarded).alias("notice_awarded_line_count"))
    orders = link.groupBy("notice_id").agg(F.count("*").alias("notice_purchase_order_count"))
    out, counts = notice, []
    for child in (lines, bids, awards, orders):
        counts += [c for c in child.columns if c != "notice_id"]
        out = out.drop(*[c for c in child.columns if c != "notice_id"]).join(child, "notice_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})
    ordered = F.col("notice_purchase_order_count") > 0
    return out.withColumns({"notice_has_purchase_order_flag": ordered, "notice_awarded_to_order_conversion_flag": ordered & (F.col("notice_awarded_line_count") > 0)})


def postprocess_lines(line: DataFrame, bid: DataFrame) -> DataFrame:
    """Notice lines with the measures of the bids on their item."""
    amount = F.col("total_price_offered")
    avg = F.avg(amount)
    measures = [
        F.count("*").alias("line_bid_count"), F.count_distinct("supplier_key").alias("line_supplier_count"), F.min(amount).alias("line_min_offer_amount"), F.max(amount).alias("line_max_offer_amount"), avg.alias("line_avg_offer_amount"),
        F.percentile(amount, 0.5).alias("line_median_offer_amount"), F.when(avg != 0, (F.max(amount) - F.min(amount)) / avg).alias("line_price_dispersion_ratio"),
    ]
    return enrich.enrich(line, bid, ["notice_id", "item_code"], measures, ["line_bid_count", "line_supplier_count"])


def postprocess_orders(order: DataFrame, line: DataFrame) -> DataFrame:
    """Orders with the count, quantity, amount and products of their lines, and whether they name a notice."""
    measures = [
        F.count("*").alias("purchase_order_line_count"), F.sum("quantity_ordered").alias("purchase_order_total_quantity"), F.sum("line_net_total").alias("purchase_order_total_net_amount"),
        F.count_distinct("onu_product_code").alias("purchase_order_unique_product_count"),
    ]
    out = enrich.enrich(order, line, ["purchase_order_id"], measures, ["purchase_order_line_count", "purchase_order_unique_product_count"])
    return out.withColumn("is_linked_to_notice_flag", F.col("linked_notice_id").isNotNull())


def new_links(order: DataFrame, notice: DataFrame, link: DataFrame) -> DataFrame:
    """Certain links that orders name and the table of links lacks."""
    missing = enrich.reconcile_links(order, notice, link, "purchase_order_id", "linked_notice_id", "notice_id")
    return missing.withColumns({"link_type": F.lit("explicit_code_match"), "link_confidence": F.lit(1).cast("decimal(10,6)"), "source_system": F.lit("mercado_publico_csv")})


# --- snapshots

# Official states by code, as name and canonical form.
STATES = {5: ("Publicada", "publicada"), 6: ("Cerrada", "cerrada"), 7: ("Desierta", "desierta"), 8: ("Adjudicada", "adjudicada"), 18: ("Revocada", "revocada"), 19: ("Suspendida", "suspendida")}


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _lookup(pairs: dict[object, object], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def official_state(code: Column, name: Column) -> tuple[Column, Column, Column]:
    """Code, name and canonical form of a state: by the code where it is known, else by the name."""
    text = clean(name)
    norm = normalise(text)
    by_code, by_name = _lookup({c: n for c, (n, _) in STATES.items()}, code), _lookup({n: c for c, (_, n) in STATES.items()}, norm)
    return F.coalesce(code, by_name), F.coalesce(text, by_code), F.coalesce(_lookup({c: n for c, (_, n) in STATES.items()}, code), norm)


def notices_from_snapshots(snapshots: DataFrame, source_file_id: Column | None = None) -> DataFrame:
    """Notices in the form of the tender lane from the latest snapshot of each, with the state and where it is known from.

    Snapshots without a code give none. Columns that the snapshots lack are null.
    """
    s = snapshots.withColumn("__id", F.trim(F.coalesce(_optional(snapshots, "notice_id"), F.col("external_notice_code")))).where("__id <> ''")
    used = ["__id", "external_notice_code", "notice_title", "official_status_code", "official_status_name", "publication_date", "close_date", "estimated_amount", "currency_code", "source_mode", "id"]
    more = ["description", "tipo", "codigo_tipo", "created_date", "award_date", "estimated_award_date", "claim_count", "visibility_amount"]
    s = latest.latest(s, ["__id"], [F.col("synced_at"), F.col("id")], used + [c for c in more if c in s.columns])
    code, name, canonical = official_state(F.col("official_status_code"), F.col("official_status_name"))
    mode, detail = normalise(F.col("source_mode")), F.lit("detail-by-codigo")
    day = {c: _optional(s, c, "date").cast("timestamp_ntz") for c in ("publication_date", "created_date", "close_date", "award_date", "estimated_award_date")}
    kind, hidden = F.coalesce(normalise(_optional(s, "tipo")), F.lit("")), normalise(_optional(s, "visibility_amount"))
    first = s.select(
        F.col("__id").alias("notice_id"), "external_notice_code", "notice_title", clean(_optional(s, "description")).alias("notice_description_raw"), normalise(clean(_optional(s, "description"))).alias("notice_description_clean"),
        clean(_optional(s, "tipo")).alias("procurement_method_name"), clean(_optional(s, "codigo_tipo")).alias("procurement_method_code"), code.alias("mp_estado_codigo"), name.alias("notice_status_name"), canonical.alias("mp_estado_canonical"),
        mode.alias("__mode"), *[d.alias(c) for c, d in day.items()], "estimated_amount", "currency_code", _optional(s, "claim_count", "int").cast("int").alias("complaint_count"),
        kind.contains("publica").alias("is_public_tender_flag"), kind.contains("privada").alias("is_private_tender_flag"), F.coalesce(hidden.isin("0", "no", "oculto", "reservado"), F.lit(False)).alias("hidden_budget_flag"),
    )
    published = F.coalesce(F.col("mp_estado_canonical") == "publicada", F.lit(False))
    seen = F.when(F.col("__mode") == detail, "api_detail").when(published, "api_publicada").when(F.col("__mode").isin("active-discovery", "rolling-window"), "api_historical").otherwise("api_unknown")
    context = F.when(published, F.when(F.col("__mode") == detail, "current_publicada_detail").otherwise("current_publicada_discovery")).otherwise("historical_full_cycle")
    out = first.withColumns({
        "notice_status_code": F.col("mp_estado_codigo").cast("string"), "data_source_kind": seen, "availability_context": context, "has_missing_date_chain_flag": F.col("publication_date").isNull() | F.col("close_date").isNull() | F.col("award_date").isNull(),
        "days_publication_to_close": F.datediff("close_date", "publication_date"), "days_creation_to_close": F.datediff("close_date", "created_date"), "days_close_to_award": F.datediff("award_date", "close_date"),
    }).drop("__mode")
    return _hashed(out, source_file_id)


def _hashed(df: DataFrame, source_file_id: Column | None) -> DataFrame:
    """Lineage: the hash of all columns as texts, and the file."""
    pairs = [x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))]
    return df.withColumns({"row_hash_sha256": row_hash(F.create_map(*pairs)), "source_file_id": F.lit(None).cast("string") if source_file_id is None else source_file_id})


def tenders_from_snapshots(snapshots: DataFrame, source_file_id: Column | None = None) -> DataFrame:
    """Tenders in the form of the tender lane from the most trusted, then latest, snapshot of each code."""
    s = snapshots.withColumn("external_notice_code", F.trim("external_notice_code")).where("external_notice_code <> ''")
    names = {
        "codigo": "notice_id", "nombre": "notice_title", "descripcion": "description", "tipo_adquisicion": "tipo", "codigo_estado": "official_status_code", "estado": "official_status_name", "tipo": "tipo", "tipo_convocatoria": "tipo_convocatoria",
        "moneda_adquisicion": "currency_code", "visibilidad_monto_raw": "visibility_amount", "monto_estimado": "estimated_amount", "codigo_organismo": "buyer_org_code", "nombre_organismo": "buyer_org_name", "codigo_unidad": "buyer_unit_code",
        "nombre_unidad": "buyer_unit_name", "comuna_unidad": "buyer_unit_commune", "region_unidad": "buyer_unit_region",
    }
    dates = {"fecha_publicacion": "publication_date", "fecha_cierre": "close_date", "fecha_adjudicacion": "award_date", "fecha_estimada_adjudicacion": "estimated_award_date"}
    wanted = dict.fromkeys(["external_notice_code", *names.values(), *dates.values(), "days_to_close"])
    s = latest.latest_snapshots(s, "external_notice_code", "source_mode", "synced_at", "id", [c for c in wanted if c in s.columns])
    columns = {a: F.coalesce(clean(_optional(s, b)), F.col("external_notice_code")) if a == "codigo" else _optional(s, b) for a, b in names.items()}
    out = s.select(F.col("external_notice_code").alias("codigo_externo"), *[c.alias(a) for a, c in columns.items()], *[_optional(s, b, "date").cast("timestamp_ntz").alias(a) for a, b in dates.items()], _optional(s, "days_to_close", "int").alias("__days"))
    days = F.coalesce(F.nullif("__days", F.lit(0)), F.datediff("fecha_cierre", "fecha_publicacion"))
    return _hashed(out.withColumn("cantidad_dias_licitacion", days).drop("__days"), source_file_id)


def canonicalize(snapshots: DataFrame, tenders: DataFrame, source_file_id: Column | None = None) -> DataFrame:
    """``tenders`` with those of the snapshots merged in: filled values win, nothing is lost, new codes are added."""
    incoming = tenders_from_snapshots(snapshots, source_file_id)
    kinds = dict(tenders.dtypes)
    shared = [F.col(c).cast(kinds[c]).alias(c) for c in tenders.columns if c in incoming.columns]
    return merge.upsert(tenders, incoming.select(*shared), ["codigo_externo"])


def refresh_notices(snapshots: DataFrame, notices: DataFrame, source_file_id: Column | None = None) -> DataFrame:
    """``notices`` with those of the snapshots merged in."""
    incoming = notices_from_snapshots(snapshots, source_file_id)
    kinds = dict(notices.dtypes)
    shared = [F.col(c).cast(kinds[c]).alias(c) for c in notices.columns if c in incoming.columns]
    return merge.upsert(notices, incoming.select(*shared), ["notice_id"])


# --- runs


def scope(raw: DataFrame, row_id: str) -> dict[str, int]:
    """Rows and greatest id of a raw table: equal to the last run's, nothing is to be done."""
    r = raw.agg(F.count("*").alias("total_rows"), F.coalesce(F.max(row_id), F.lit(0)).alias("max_id")).first()
    return {"total_rows": int(r["total_rows"]), "max_id": int(r["max_id"])}


def after(raw: DataFrame, row_id: str, state: dict | None, incremental: bool = True) -> DataFrame:
    """Raw rows beyond the last id that ``state`` says was processed; the filter reaches the scan."""
    last = int((state or {}).get("last_processed_raw_id") or 0) if incremental else 0
    return raw.where(F.col(row_id) > max(0, last))


@dataclass
class Run:
    """Outcome of a run: tables, counts a lane, gate decision, and the state the next run starts from."""

    tables: Tables = field(default_factory=dict)
    metrics: list[quality.LoadMetrics] = field(default_factory=list)
    decision: str = "skipped"
    state: dict = field(default_factory=dict)


def run_lane(raw: DataFrame, lane: dict[str, Entity], row_id: str, stored: Tables | None = None, state: dict | None = None, incremental: bool = True) -> Run:
    """Build one lane from the raw rows that are new, with its counts and gate; an unchanged raw table is skipped."""
    now = scope(raw, row_id)
    if incremental and state and state.get("status") == "completed" and all(state.get(f"source_{k}") == v for k, v in now.items()):
        return Run(dict(stored or {}), [], "skipped", state)
    fresh = materialize(after(raw, row_id, state, incremental))
    metrics = lane_metrics(fresh, lane, stored)
    tables = {k: materialize(v) for k, v in build(fresh, lane, stored).items()}
    done = {"status": "completed", "last_processed_raw_id": now["max_id"], **{f"source_{k}": v for k, v in now.items()}}
    return Run(tables, metrics, quality.gate(metrics), done)


def daily(tender_raw: DataFrame, order_raw: DataFrame, snapshots: DataFrame, stored: dict[str, Tables] | None = None, states: dict | None = None, row_id: str = "id") -> dict[str, Run]:
    """Both lanes, then snapshots, then enrichment. Lanes share no table here; what both know of a party is merged by key."""
    stored, states = stored or {}, states or {}
    runs = {"tender": run_lane(tender_raw, TENDER_LANE, row_id, stored.get("tender"), states.get("tender")), "order": run_lane(order_raw, ORDER_LANE, row_id, stored.get("order"), states.get("order"))}
    t, o = runs["tender"].tables, runs["order"].tables
    t["tender"] = materialize(canonicalize(snapshots, t["tender"]))
    link = o["link"]
    found = new_links(o["purchase_order"], t["notice"], link).select("notice_id", "purchase_order_id")
    link = link.unionByName(found, allowMissingColumns=True)
    known = link.join(t["notice"].select("notice_id"), "notice_id", "left_semi")
    t["notice_enriched"] = postprocess_notices(t["notice"], t["notice_line"], t["bid_submission"], t["award"], known)
    t["notice_line_enriched"] = postprocess_lines(t["notice_line"], t["bid_submission"])
    o["purchase_order_enriched"] = postprocess_orders(o["purchase_order"], o["purchase_order_line"])
    o["link"] = link
    return runs


# --- summaries


def sync_summary(notices: DataFrame, items: str = "items", region: str = "buyer_region") -> DataFrame:
    """One row: notices seen, and how many have a description, a buyer's region and items."""
    present = {"description": F.coalesce(F.trim("description") != "", F.lit(False)), "buyer_region": F.coalesce(F.trim(region) != "", F.lit(False)), "items": F.coalesce(F.size(items) > 0, F.lit(False))}
    seen = F.count("*")
    return notices.agg(seen.alias("notices_seen"), *[F.count_if(t).alias(f"notices_with_{k}") for k, t in present.items()], *[(seen - F.count_if(t)).alias(f"notices_missing_{k}") for k, t in present.items()], F.coalesce(F.sum(F.when(present["items"], F.size(items))), F.lit(0)).alias("items_seen"))


def upload_telemetry(raw: quality.LoadMetrics, entities: list[quality.LoadMetrics], curated: set[str]) -> dict[str, int]:
    """Counts of an upload: of its raw rows, and of new rows in curated and in other entities."""
    silver = sum(m.inserted for m in entities if m.entity in curated)
    return {
        "processed_rows": raw.processed, "accepted_rows": raw.accepted, "inserted_delta_rows": raw.inserted, "duplicate_existing_rows": raw.existing, "rejected_rows": raw.rejected,
        "silver_inserted_delta_rows": silver, "normalized_inserted_delta_rows": sum(m.inserted for m in entities) - silver,
    }
