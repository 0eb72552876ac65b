"""Whole lanes, snapshots merged into them, serving and settings."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from caudal.functions import config
from caudal.operators import quality, serve
from caudal.plans import lanes
from caudal.plans.entities import ORDER_LANE, TENDER_LANE

RAW = "id long, seq long, source_file_id string, row_hash_sha256 string, raw map<string,string>"


def tender(i, code, item=None, **more):
    return (i, i, "f", f"h{i}", {"CodigoExterno": code, "Codigoitem": item, **more})


def order(i, code, item, **more):
    return (i, i, "f", f"h{i}", {"Codigo": code, "IDItem": item, **more})


TENDERS = [
    tender(1, "1-1-LE26", "a", Nombre="Obra", MontoEstimado="1.000,50", FechaPublicacion="2026-01-01", FechaCierre="2026-01-11", CodigoProveedor="7", Correlativo="1", **{"Nombre de la Oferta": "o", "Valor Total Ofertado": "10", "Oferta seleccionada": "1", "Tipo de Adquisicion": "Licitación Pública menor a 100 UTM"}),
    tender(2, "1-1-LE26", "a", Nombre="NA", CodigoProveedor="8", Correlativo="1", **{"Nombre de la Oferta": "p", "Valor Total Ofertado": "30", "Oferta seleccionada": "0"}), tender(3, "1-1-LE26", "b", Nombre="Obra nueva"), tender(4, None, "c"), tender(5, "2-1-LE26", None),
]
ORDERS = [order(1, "9-1-SE26", "1", CodigoLicitacion="1-1-LE26", cantidad="2", totalLineaNeto="100"), order(2, "9-1-SE26", "2", cantidad="3", totalLineaNeto="50"), order(3, "9-2-SE26", "1"), order(4, None, "1")]
SNAPSHOTS = [
    (1, "1-1-LE26", "rolling-window", "Nuevo título", 8, None, dt.date(2026, 1, 1), dt.date(2026, 1, 20), Decimal("5.00"), dt.datetime(2026, 1, 2)), (2, "1-1-LE26", "detail-by-codigo", None, 5, "Publicada", None, dt.date(2026, 1, 21), None, dt.datetime(2026, 1, 1)),
    (3, " 3-1-LE26 ", "other", "Tercero", None, "Adjudicada", None, None, None, dt.datetime(2026, 1, 1)), (4, " ", "other", "x", None, None, None, None, None, dt.datetime(2026, 1, 1)), (5, None, "other", "x", None, None, None, None, None, dt.datetime(2026, 1, 1)),
]
SEEN = "id long, external_notice_code string, source_mode string, notice_title string, official_status_code int, official_status_name string, publication_date date, close_date date, estimated_amount decimal(20,2), synced_at timestamp"


def snapshots(spark):
    return spark.createDataFrame(SNAPSHOTS, SEEN).withColumns({"currency_code": F.lit("CLP"), "buyer_org_code": F.lit("o"), "buyer_org_name": F.lit("on"), "buyer_unit_code": F.lit("u"), "buyer_unit_name": F.lit("un")})


def test_daily_run(spark):
    runs = lanes.daily(spark.createDataFrame(TENDERS, RAW), spark.createDataFrame(ORDERS, RAW), snapshots(spark))
    t, o = runs["tender"].tables, runs["order"].tables
    rows = {r["codigo_externo"]: r for r in t["tender"].collect()}
    assert set(rows) == {"1-1-LE26", "2-1-LE26", "3-1-LE26"}
    first = rows["1-1-LE26"]
    assert first["nombre"] == "Obra nueva" and first["monto_estimado"] == Decimal("1000.50") and first["estado"] == "Publicada" and first["fecha_cierre"] == dt.datetime(2026, 1, 21) and first["flag_menos_100_utm"] is True
    n = {r["notice_id"]: r for r in t["notice_enriched"].collect()}
    assert [n["1-1-LE26"][f"notice_{k}_count"] for k in ("line", "bid", "supplier", "selected_bid", "awarded_line", "purchase_order")] == [2, 2, 2, 1, 1, 1] and n["1-1-LE26"]["notice_awarded_to_order_conversion_flag"]
    assert [n["2-1-LE26"][f"notice_{k}_count"] for k in ("line", "bid", "purchase_order")] == [0, 0, 0]
    line = {r["item_code"]: r for r in t["notice_line_enriched"].collect()}
    assert (line["a"]["line_bid_count"], line["a"]["line_median_offer_amount"], line["a"]["line_price_dispersion_ratio"], line["b"]["line_bid_count"]) == (2, 20, 1, 0)
    po = {r["purchase_order_id"]: r for r in o["purchase_order_enriched"].collect()}
    assert (po["9-1-SE26"]["purchase_order_line_count"], po["9-1-SE26"]["purchase_order_total_net_amount"], po["9-1-SE26"]["is_linked_to_notice_flag"], po["9-2-SE26"]["is_linked_to_notice_flag"]) == (2, 150, True, False)
    assert runs["tender"].decision == "failed" and next(m for m in runs["tender"].metrics if m.entity == "tender").rejected == 1


def test_incremental_runs(spark):
    first = lanes.run_lane(spark.createDataFrame(TENDERS, RAW), TENDER_LANE, "id")
    again = lanes.run_lane(spark.createDataFrame(TENDERS, RAW), TENDER_LANE, "id", first.tables, first.state)
    assert again.decision == "skipped" and again.state == first.state
    more = [*TENDERS, tender(6, "1-1-LE26", "a", Nombre="", Estado="Cerrada"), tender(7, "4-1-LE26", "z")]
    then = lanes.run_lane(spark.createDataFrame(more, RAW), TENDER_LANE, "id", first.tables, first.state)
    rows = {r["codigo_externo"]: (r["nombre"], r["estado"]) for r in then.tables["tender"].collect()}
    assert rows["1-1-LE26"] == ("Obra nueva", "Cerrada") and "4-1-LE26" in rows and then.state["last_processed_raw_id"] == 7
    m = next(m for m in then.metrics if m.entity == "tender")
    assert (m.processed, m.accepted, m.inserted, m.existing) == (2, 2, 1, 1)


@pytest.mark.parametrize("lane", [TENDER_LANE, ORDER_LANE])
def test_empty_lanes(spark, lane):
    assert all(df.count() == 0 for df in lanes.build(spark.createDataFrame([], RAW), lane).values())


def test_snapshots(spark):
    got = {r["notice_id"]: r for r in lanes.notices_from_snapshots(snapshots(spark)).collect()}
    assert set(got) == {"1-1-LE26", "3-1-LE26"}
    assert (got["1-1-LE26"]["mp_estado_canonical"], got["1-1-LE26"]["notice_status_name"], got["1-1-LE26"]["data_source_kind"], got["1-1-LE26"]["days_publication_to_close"]) == ("adjudicada", "Adjudicada", "api_historical", 19)
    assert (got["3-1-LE26"]["mp_estado_codigo"], got["3-1-LE26"]["data_source_kind"], got["3-1-LE26"]["has_missing_date_chain_flag"]) == (8, "api_unknown", True)
    tenders = {r["codigo_externo"]: r for r in lanes.tenders_from_snapshots(snapshots(spark)).collect()}
    assert tenders["1-1-LE26"]["estado"] == "Publicada" and tenders["1-1-LE26"]["codigo"] == "1-1-LE26" and len(tenders["3-1-LE26"]["row_hash_sha256"]) == 64
    refreshed = lanes.refresh_notices(snapshots(spark), lanes.notices_from_snapshots(snapshots(spark).where("id = 2")))
    assert {r["notice_id"]: r["notice_title"] for r in refreshed.collect()} == {"1-1-LE26": "Nuevo título", "3-1-LE26": "Tercero"}


def test_served(spark):
    df = spark.createDataFrame([(Decimal("1.50"), dt.date(2026, 1, 2), dt.datetime(2026, 1, 2, 3, 4, 5), dt.datetime(2026, 1, 2, 3, 4, 5, 600), None)], "total_amount decimal(10,2), day_of date, at_time timestamp, then timestamp, note string")
    assert serve.served(df).first().asDict() == {"totalAmount": 1.5, "dayOf": "2026-01-02", "atTime": "2026-01-02T03:04:05", "then": "2026-01-02T03:04:05.000600", "note": None}
    first = serve.first_of_each(spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 0, "z")], "k string, pos int, v string"), "k", "pos").collect()
    assert [tuple(r) for r in first] == [("a", 1, "y")]


def test_worker(spark):
    now = dt.datetime(2026, 1, 1)
    jobs = spark.createDataFrame([(1, "noop", "available", 1, now, now, 0, 3, None), (2, "bad", "available", 2, now, now, 0, 3, None), (3, "flaky", "available", 3, now, now, 0, 3, None)], "id int, kind string, status string, priority int, available_at timestamp_ntz, created_at timestamp_ntz, attempts int, max_attempts int, worker string")
    seen = []

    def flaky(job):
        raise OSError("later")

    at = F.lit("2026-01-02").cast("timestamp_ntz")
    for _ in range(3):
        jobs = serve.work(jobs, at, "w", {"noop": lambda j: seen.append(j["id"]), "flaky": flaky})
    assert {r["id"]: r["status"] for r in jobs.collect()} == {1: "done", 2: "dead", 3: "retry"} and seen == [1]
    assert serve.work(jobs.limit(0), at, "w", {}).count() == 0


def test_settings(tmp_path):
    good = {"nlp_version": "v1", "canonical_model": "m", "default_language": "es", "low_confidence_language_label": "und", "minimum_language_tokens": 2, "max_annotation_tokens": 128, "max_annotation_ngrams": 24, "supported_source_profiles": ["chile", "other"]}
    (tmp_path / config.PATTERNS).write_text(json.dumps({"health": ["salud", " "]}))
    with pytest.raises(FileNotFoundError):
        config.load_settings(str(tmp_path))
    for broken in ({"nlp_version": " "}, {"max_annotation_tokens": 0}, {"supported_source_profiles": []}, {"supported_source_profiles": "x"}):
        (tmp_path / config.GENERAL).write_text(json.dumps({**good, **broken}))
        with pytest.raises(ValueError):
            config.load_settings(str(tmp_path))
    (tmp_path / config.GENERAL).write_text(json.dumps(good))
    s = config.load_settings(str(tmp_path))
    assert s.domains == {"health": ("salud",)} and s.counts["max_annotation_ngrams"] == 24 and config.source_profile(" Chile ", s) == "chile" and config.dataset_type("Licitacion") == "licitacion"
    with pytest.raises(ValueError):
        config.source_profile("other", s)
    with pytest.raises(ValueError):
        config.dataset_type("x")


def test_telemetry():
    raw = quality.LoadMetrics("raw", 10, 9, 9, 7, 2)
    got = lanes.upload_telemetry(raw, [quality.LoadMetrics("tender", 9, 9, 5, 4, 1), quality.LoadMetrics("notice", 9, 9, 5, 3, 2)], {"notice"})
    assert (got["rejected_rows"], got["duplicate_existing_rows"], got["silver_inserted_delta_rows"], got["normalized_inserted_delta_rows"]) == (1, 2, 3, 4)
