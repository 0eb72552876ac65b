"""Parsers, projections, merging, sources, reads and stateful operators on small cases."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caudal.functions import parsers as p
from caudal.functions import text as t
from caudal.operators import enrich, latest, ledger, merge, quality
from caudal.plans.entities import ORDER_LANE, TENDER_LANE, project
from caudal.scale import broadcast_if_small, materialize
from caudal.sources import api_json, raw_csv
from caudal.streaming.snapshots import VersionedTable, drop_repeats, merge_latest, windowed_counts

c = F.col


def values(spark, fn, texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    return [r["v"] for r in df.select("i", fn(c("x")).alias("v")).orderBy("i").collect()]


def test_decimals(spark):
    got = values(spark, p.decimal, ["6,8e+08", "$1.234,56", "1,234.56", "100000000000000", "99999999999999.999999", "99999999999999.9999999", "1e20", "1.234", "1.234.567,8", " 12 ", "NA", "", None, "abc", "--1"])
    assert got == [Decimal("680000000"), Decimal("1234.56"), Decimal("1234.56"), None, Decimal("99999999999999.999999"), None, None, Decimal("1.234"), Decimal("1234567.8"), Decimal(12), None, None, None, None, None]


def test_integers_and_booleans(spark):
    assert values(spark, p.integer, ["12,9", "-3.7", "9999999999", "x", None]) == [12, -3, None, None, None]
    assert values(spark, p.boolean, ["Sí", "1", "verdadero", "No", "0", "falso", "x", "tal vez", None]) == [True, True, True, False, False, False, True, None, None]
    assert values(spark, p.boolean_or_false, ["x?", None]) == [False, False]


def test_timestamps(spark):
    got = values(spark, p.timestamp, ["2026-01-15 13:45:00", "1900-01-01 00:00:00", "5/1/2026", "05-01-2026 1:2:3", "2026-01-15T10:00:00-03:00", "2026-01-15T10:00:00", "2026-02-30", "15/01/26", "x", None])
    assert got == [dt.datetime(2026, 1, 15, 13, 45), None, dt.datetime(2026, 1, 5), dt.datetime(2026, 1, 5, 1, 2, 3), dt.datetime(2026, 1, 15, 13), dt.datetime(2026, 1, 15, 10), None, None, None, None]


def test_whole_days_round_down(spark):
    df = spark.sql("SELECT timestamp_ntz'2026-01-01 12:00:00' AS a, timestamp_ntz'2026-01-02 00:00:00' AS b, timestamp_ntz'2026-01-01 23:50:00' AS d, timestamp_ntz'2026-01-02 00:10:00' AS e")
    assert tuple(df.select(p.whole_days(c("a"), c("b")), p.whole_days(c("e"), c("d"))).first()) == (-1, 0)


def test_text(spark):
    assert values(spark, t.normalise, ["  Servicio   de Mantención  ", "\xa0ÑANDÚ\xa0", "", None]) == ["servicio de mantencion", "nandu", "", None]
    assert values(spark, t.annotation_text, ["ﬁn de Año", "Ａ１"]) == ["fin de ano", "a1"]
    assert values(spark, t.utm_amounts, ["menor a 1.000 utm", "1.000.000 utm", "1.000 pesos"]) == ["menor a 1000 utm", "1000000 utm", "1.000 pesos"]
    words = values(spark, lambda x: t.top_ngrams(t.annotation_tokens(x)), ["b a b", "a", "", None])
    assert [[(g["ngram"], g["count"]) for g in w] for w in words] == [[("b", 2), ("a", 1), ("a b", 1), ("b a", 1)], [("a", 1)], [], []]
    flags = {"it": ["soporte", "red"], "m": ["soporte"], "z": ["nada"]}
    got = values(spark, lambda x: t.tags(t.keyword_flags(t.annotation_tokens(x), flags), flags), ["soporte tecnico", "", None])
    assert got == [["it", "m"], [], []]
    assert values(spark, lambda x: t.language(t.annotation_tokens(x)), ["soporte", "dos palabras", None]) == ["und", "es", "und"]


def test_row_hash_ignores_order(spark):
    df = spark.createDataFrame([({"a": "1", "b": None},), ({"b": None, "a": "1"},), ({"a": "1"},), ({},)], "m map<string,string>")
    h = [r[0] for r in df.select(p.row_hash(c("m"))).collect()]
    assert h[0] == h[1] and len(set(h)) == 3


def raw_rows(spark, *maps):
    return spark.createDataFrame([(m,) for m in maps], "raw map<string,string>")


def test_projection(spark):
    rows = raw_rows(
        spark,
        {"CodigoExterno": "1000813-8-LE26", "Nombre": " X ", "MontoEstimado": "$1.000,5", "FechaPublicacion": "2026-01-01", "FechaCierre": "11/01/2026", "Tipo de Adquisicion": "Licitación Menor a 1.000 UTM"},
        {"Nombre": "no key"}, {"CodigoExterno": "NA"}, {},
    )
    out = project(rows, TENDER_LANE["tender"]).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["codigo"], r["nombre"], r["monto_estimado"], r["cantidad_dias_licitacion"], r["tipo_adquisicion_norm"], r["estado"]) == ("1000813", "X", Decimal("1000.5"), 10, "licitacion menor a 1000 utm", None)


def test_bids_need_supplier_and_signal(spark):
    full = {"CodigoExterno": "1-2-LE26", "CodigoItem": "7", "RutProveedor": "1-9", "Estado Oferta": "Aceptada", "Oferta seleccionada": "Si"}
    rows = raw_rows(spark, full, {k: v for k, v in full.items() if k != "RutProveedor"}, {k: v for k, v in full.items() if k != "Estado Oferta"})
    out = project(rows, TENDER_LANE["bid_submission"]).collect()
    assert [(r["supplier_key"], r["item_code"], r["selected_offer_flag"]) for r in out] == [("rut:1-9", "7", True)]
    assert len(out[0]["bid_submission_id"]) == 64


def test_all_entities_project(spark):
    rows = raw_rows(spark, {})
    for e in {**TENDER_LANE, **ORDER_LANE}.values():
        assert project(rows, e).count() == 0


def test_last_rows_and_last_filled(spark):
    df = spark.createDataFrame([("a", 1, "x", [1]), ("a", 2, None, []), ("b", 1, " ", None), (None, 1, "n", None), ("a", 3, "", None)], "k string, s int, v string, l array<int>")
    assert {(r["k"], r["s"], r["v"]) for r in merge.last_rows(df, ["k"], ["s"]).collect()} == {("a", 3, ""), ("b", 1, " "), (None, 1, "n")}
    assert {(r["k"], r["s"], r["v"], tuple(r["l"] or ())) for r in merge.last_filled(df, ["k"], "s").collect()} == {("a", 3, "x", (1,)), ("b", 1, None, ()), (None, 1, "n", ())}
    assert merge.last_rows(df.limit(0), ["k"], ["s"]).count() == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.sampled_from(["", "x", "y"])), st.one_of(st.none(), st.integers(0, 3))), min_size=1, max_size=12))
def test_last_filled_equals_row_by_row_merge(spark, rows):
    model: dict = {}
    for k, v, n in rows:
        old = model.get(k, (None, None))
        model[k] = (v if v else old[0], n if n is not None else old[1])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, k int, v string, n int")
    assert {r["k"]: (r["v"], r["n"]) for r in merge.last_filled(df, ["k"], "seq").collect()} == model


def test_upsert(spark):
    a = spark.createDataFrame([("a", "x", 1, 5), ("b", "y", 2, 6), (None, "n", 0, 7)], "k string, v string, n int, count int")
    b = spark.createDataFrame([("a", " ", None, 0), ("c", "z", 3, 0), (None, "m", None, 0)], "k string, v string, n int, count int")
    got = {r["k"]: (r["v"], r["n"], r["count"]) for r in merge.upsert(a, b, ["k"], keep=["count"]).collect()}
    assert got == {"a": ("x", 1, 5), "b": ("y", 2, 6), None: ("m", 0, 7), "c": ("z", 3, 0)}
    again = merge.upsert(merge.upsert(a, b, ["k"]), b, ["k"])
    assert sorted(map(str, again.collect())) == sorted(map(str, merge.upsert(a, b, ["k"]).collect()))
    over = {r["k"]: r["n"] for r in merge.upsert(a, b, ["k"], only_fill=False).collect()}
    assert over["a"] is None and over["b"] == 2
    assert {r["k"] for r in merge.insert_new(a, b, ["k"]).collect()} == {"c", None}


def test_guards_and_keys(spark):
    df = spark.createDataFrame([("a", "tfidf://x"), ("a", "raw"), (None, None)], "win_probability string, ref string")
    assert merge.guard_features(df, "ref") == ["forbidden column win_probability", "1 values of ref are no reference"]
    assert tuple(merge.key_problems(df, ["win_probability"]).first()) == (1, 1, 2)
    assert merge.required_columns(df, ["Ref", "ref"]) == ["Ref"]


def test_enrich_and_concentration(spark):
    parents = spark.createDataFrame([("a",), ("b",)], "k string")
    kids = spark.createDataFrame([("a", 1.0, "s", True), ("a", 3.0, "t", False), ("z", 1.0, "s", True)], "k string, x double, s string, w boolean")
    got = {r["k"]: r for r in enrich.enrich(parents, kids, ["k"], enrich.offer_measures(c("x"), c("s"), c("w")), ["bid_count", "supplier_count", "selected_bid_count"]).collect()}
    assert (got["a"]["bid_count"], got["a"]["median_offer"], got["a"]["price_dispersion"], got["b"]["bid_count"], got["b"]["median_offer"]) == (2, 2.0, 1.0, 0, None)
    assert enrich.concentration(kids, ["k"], "s", c("x")).where("k = 'a'").first()["hhi"] == 0.625


def test_search_and_page(spark):
    df = spark.createDataFrame([(1, "Servicio", 5.0, dt.datetime(2026, 1, 31, 23)), (2, "obra", None, None), (3, "SERVICIOS", 7.0, dt.datetime(2026, 2, 1)), (4, None, 7.0, None)], "id int, t string, a double, d timestamp_ntz")
    ids = lambda x: [r["id"] for r in x.orderBy("id").collect()]
    assert ids(latest.search(df)) == [1, 2, 3, 4]
    assert ids(latest.search(df, contains={"q": (["t"], "servicio")})) == [1, 3]
    assert ids(latest.search(df, days={"d": ("2026-01-01", "2026-01-31")})) == [1]
    assert ids(latest.search(df, ranges={"a": (None, 5)}, equal={"t": None})) == [1]
    order = lambda desc, n: [r["id"] for r in latest.page(df, "a", desc, ["id"], n, 2).collect()]
    assert order(True, 1) == [3, 4] and order(True, 2) == [1, 2] and order(False, 1) == [1, 3] and order(False, 3) == []


def test_quality_gate(spark):
    ok, some, many = (quality.LoadMetrics("e", 1000, n, n, n, 0) for n in (1000, 999, 900))
    assert [quality.gate([m]) for m in (ok, some, many)] == ["passed", "warning", "failed"] and quality.gate([ok], 1) == "warning"
    with pytest.raises(ValueError, match="add up"):
        quality.LoadMetrics("e", 1, 1, 1, 1, 1).check()
    raw, stored = spark.range(5), spark.range(2)
    m = quality.load_metrics("e", raw, raw.where("id > 0"), stored, ["id"])
    assert (m.processed, m.accepted, m.inserted, m.existing, m.rejected) == (5, 4, 3, 1, 1)


def test_raw_csv(spark, tmp_path):
    folder = tmp_path / "licitacion"
    folder.mkdir()
    text = 'Codigo;CodigoExterno;Tipo de Adquisicion;FechaPublicacion;FechaCierre;CodigoItem\n1;"a\nb";x;NA;1900-01-01;7\n2;c;x;y\n3;"d;x;y;z;1\n'
    (folder / "a.csv").write_bytes(text.encode("latin-1"))
    (folder / "ñ.csv").write_bytes(("﻿" + text.replace("x", "ñ")).encode("utf-8"))
    (folder / "empty.csv").write_bytes(b"")
    found = raw_csv.discover(str(tmp_path))
    assert [d for d, _ in found] == ["licitacion"] * 3
    raw = raw_csv.read_raw(spark, [f for _, f in found], "licitacion")
    rows = {(r["source_file"].rsplit("/", 1)[1], r["raw_row_num"]): r for r in raw.collect()}
    assert len(rows) == 6
    first = rows["a.csv", 1]
    assert first["raw"] == {"Codigo": "1", "CodigoExterno": "a\nb", "Tipo de Adquisicion": "x", "FechaPublicacion": None, "FechaCierre": None, "Codigoitem": "7"} and first["problem"] is None
    assert (rows["a.csv", 2]["problem"], rows["a.csv", 3]["problem"]) == ("field_count", "quote_not_closed")
    assert raw_csv.append_new(raw, raw).count() == 0 and raw_csv.append_new(raw.limit(0), raw.unionAll(raw)).count() == 6
    check = raw_csv.preflight((folder / "a.csv").read_bytes(), "a.csv", "licitacion")
    assert check["errors"] == [] and check["rows"] == 3
    assert raw_csv.preflight(b"Codigo\x00;x\n", "a.txt", "licitacion")["errors"][:2] == ["not_a_csv_name", "nul_bytes"]


NOTICE = {
    "CodigoExterno": "1-2-LE26", "Nombre": "X", "CodigoEstado": 5, "FechaCierre": "08052026", "MontoEstimado": "1.000,5", "Fechas": {"FechaPublicacion": "2026-05-07T10:00:00", "FechaCierre": "2026-05-09"}, "NombreUnidad": "plana",
    "Comprador": {"NombreUnidad": "anidada"}, "Items": {"Listado": [{"Correlativo": 3, "CodigoProducto": "9", "Cantidad": "2,5"}, {"CodigoProducto": "8"}]},
}


def test_payloads(spark, tmp_path):
    for i, x in enumerate([{"Listado": [NOTICE, {"Nombre": "no code"}]}, {"Listado": [NOTICE, {"Nombre": "no code"}]}, {}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(x))
    (tmp_path / "bad.json").write_text("{not json")
    landed = api_json.read_landing(spark, str(tmp_path))
    once = api_json.once(landed)
    assert once.count() == 3 and api_json.once(landed, once).count() == 0
    flat = api_json.flatten(once, ["payload_sha256"])
    r = flat.collect()
    assert len(r) == 1
    assert (r[0]["publication_date"], r[0]["close_date"], r[0]["buyer_unit_name"], r[0]["estimated_amount"], r[0]["official_status_code"]) == (dt.date(2026, 5, 7), dt.date(2026, 5, 9), "anidada", Decimal("1000.50"), 5)
    items = {(x["item_correlative"], x["product_code"], x["quantity"]) for x in api_json.items(flat, []).collect()}
    assert items == {(3, "9", Decimal("2.5")), (-2, "8", None)}
    a, b = api_json.source_identity(landed).first()[0], api_json.source_identity(landed.repartition(5)).first()[0]
    assert a == b and len(a) == 64


def test_queue(spark):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp_ntz")
    t0 = dt.datetime(2026, 1, 1)
    rows = [(1, "available", 2, t0, t0, 0, 2, None), (2, "retry", 1, t0, t0, 1, 2, None), (3, "available", 1, dt.datetime(2026, 3, 1), t0, 0, 2, None)]
    jobs = spark.createDataFrame(rows, "id int, status string, priority int, available_at timestamp_ntz, created_at timestamp_ntz, attempts int, max_attempts int, worker string")
    claimed = ledger.claim_next(ledger.promote_retries(jobs, now), now, "w")
    assert {r["id"]: (r["status"], r["attempts"], r["worker"]) for r in claimed.collect()} == {1: ("available", 0, None), 2: ("running", 2, "w"), 3: ("available", 0, None)}
    failed = {r["id"]: r["status"] for r in ledger.fail_job(ledger.fail_job(claimed, 2, True, 60, now), 1, True, 60, now).collect()}
    assert failed == {1: "retry", 2: "dead", 3: "available"}
    assert ledger.claim_next(jobs.limit(0), now, "w").count() == 0


def test_calendar(spark):
    assert ledger.rolling_days(dt.date(2026, 3, 2), 3) == [dt.date(2026, 3, 2), dt.date(2026, 3, 1), dt.date(2026, 2, 28)]
    assert [ledger.weekday_anchor(dt.date(2026, 5, d)) for d in (8, 9, 10, 11)] == [dt.date(2026, 5, 8)] * 3 + [dt.date(2026, 5, 11)]
    df = spark.createDataFrame([(1, 3), (2, 3), (3, 3)], "seq int, cost_units int")
    assert ledger.within_budget(df, 2, 8).count() == 2


def test_streamed_latest_equals_batch(spark, tmp_path):
    cols = "code string, mode string, synced timestamp, id long"
    parts = [[("a", "rolling-window", dt.datetime(2026, 1, i + 1), i), ("b", "detail-by-codigo" if i == 0 else "active", dt.datetime(2026, 1, i + 1), 10 + i)] for i in range(3)]
    source = str(tmp_path / "in")
    for rows in parts:
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(source)
    table = VersionedTable(spark, str(tmp_path / "table"))
    merge_latest(stream, table, "code", "mode", "synced", "id", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = latest.latest_snapshots(spark.read.parquet(source), "code", "mode", "synced", "id")
    assert sorted(map(str, table.read().select("code", "id").collect())) == sorted(map(str, want.select("code", "id").collect()))
    assert {r["code"]: r["id"] for r in table.read().collect()} == {"a": 2, "b": 10} and len(table.versions()) == 2


def test_stream_windows_and_repeats(spark, tmp_path):
    rows = [(1, dt.datetime(2026, 1, 1, 0, 1), "x"), (1, dt.datetime(2026, 1, 1, 0, 2), "x"), (2, dt.datetime(2026, 1, 1, 0, 30), "y")]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "id long, at timestamp, k string").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("id long, at timestamp, k string").parquet(path)

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    assert run(drop_repeats(stream, ["id"], "at", "1 hour"), "once", "append").count() == 2
    assert {(r["k"], r["n"]) for r in run(windowed_counts(stream, "at", "10 minutes", "1 hour", ["k"]), "win", "complete").collect()} == {("x", 2), ("y", 1)}


def test_materialised_tables_are_in_the_shared_folder(spark):
    df = materialize(spark.range(10))
    assert df.count() == 10 and spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]
    small, large = broadcast_if_small(df), broadcast_if_small(df, limit=10)
    assert "Broadcast" in _plan(df.join(small, "id")) and large is df


def test_cleanup_deletes_what_was_written(spark):
    from pathlib import Path

    from caudal import scale

    path = Path(materialize(spark.range(3)).inputFiles()[0].replace("file://", "")).parent
    assert path.exists()
    scale.cleanup(spark)
    assert not path.exists()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pushdown_and_pruning(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id % 3 AS a", "'x' AS unused").write.parquet(path)
    plan = _plan(latest.search(spark.read.parquet(path), equal={"a": 1}).select("id"))
    assert "PushedFilters: [IsNotNull(a), EqualTo(a,1)]" in plan and "unused" not in plan


def test_json_lines_and_export(spark, tmp_path):
    from caudal.sources import files

    df = spark.createDataFrame([("a", 1, 'x "y"; z'), ("b", None, None), ("c", 3, "=1+1")], "k string, n int, t string")
    files.write_json_lines(df, str(tmp_path / "j"))
    back = files.read_json_lines(spark, str(tmp_path / "j"), "k string, n int, t string")
    assert sorted(map(str, back.drop("bad_line").collect())) == sorted(map(str, df.collect()))
    (tmp_path / "bad.json").write_text('{"k": "a"}\nnot json\n')
    rows = files.read_json_lines(spark, str(tmp_path / "bad.json"), "k string, n int").collect()
    assert {(r["k"], r["bad_line"]) for r in rows} == {("a", None), (None, "not json")}
    files.export_delimited(df.coalesce(1), str(tmp_path / "e"))
    text = next((tmp_path / "e").glob("part-*")).read_bytes().decode()
    assert text == '"k";"n";"t"\r\n"a";"1";"x ""y""; z"\r\n"b";"";""\r\n"c";"3";"\'=1+1"\r\n'
    assert ledger.newest(df, "n", "k", most=2, t=None).count() == 2


def test_canonical_hashes(spark):
    """The bytes are those of sorted JSON without blanks, as any JSON writer gives them."""
    import hashlib
    import json

    odd = {"b": 'say "x" \\ / \u000b \u001f \t ñ €', "a": None, "Z": "", "k": "\\u000B", "Ticket": "s"}
    digest = lambda m: hashlib.sha256(json.dumps(m, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    df = spark.createDataFrame([(odd,), ({},)], "m map<string,string>")
    got = [(r[0], r[1]) for r in df.select(p.row_hash(F.col("m")), p.request_hash(F.col("m"))).collect()]
    assert got == [(digest(odd), digest({k: v for k, v in odd.items() if k != "Ticket"})), (digest({}), digest({}))]
    docs = spark.createDataFrame([('{"b": [1, {"y": null, "x": 2.5}],\n "a": "ñ"}',), ("no json",), (None,)], "t string")
    want = hashlib.sha256('{"a":"ñ","b":[1,{"x":2.5,"y":null}]}'.encode()).hexdigest()
    assert [r[0] for r in docs.select(p.payload_hash(F.col("t"))).collect()] == [want, None, None]


def test_records_in_linear_time():
    import time

    text = '"never closed;x\n' + "a;b;c\n" * 200_000
    began = time.time()
    assert list(raw_csv.records(text)) == [text]
    assert list(raw_csv.records('a;"b\nc";d\r\n"x""";y\n"p"q;"r\ns";t\nu;v"w')) == ['a;"b\nc";d\r\n', '"x""";y\n', '"p"q;"r\ns";t\n', 'u;v"w']
    assert time.time() - began < 5


def test_budget_over_many_ranges(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), F.lit(2).alias("cost_units"), F.lit("x").alias("note")).repartition(7)
    got = sorted(r["seq"] for r in ledger.within_budget(df, 11, 500).collect())
    assert got == list(range(244))
    assert ledger.within_budget(df.limit(0), 0, 5).count() == 0


def test_bucketed_stream_rewrites_only_touched_buckets(spark, tmp_path):
    from caudal.streaming.snapshots import BucketedTable

    cols = "k string, m string, t int, id int"
    table = BucketedTable(spark, str(tmp_path / "t"), 8)
    for i, rows in enumerate([[("a", "x", 1, 1), ("b", "x", 1, 2), ("c", "x", 5, 3)], [("a", "x", 2, 4)], [("a", "x", 1, 5)]]):
        spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "in" / f"f{i}"))
        stream = spark.readStream.schema(cols).parquet(str(tmp_path / "in" / "*"))
        merge_latest(stream, table, "k", None, "t", "id", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["k"], r["id"]) for r in table.read().collect()) == [("a", 4), ("b", 2), ("c", 3)]
    touched = {d.name for d in (tmp_path / "t" / f"v{table.versions()[-1]}").iterdir() if d.name.startswith("bucket=")}
    assert len(touched) == 1


def test_notice_annotations(spark, tmp_path):
    """Against the text's compatibility form taken in Python."""
    import hashlib
    import unicodedata

    from caudal.plans.operator_queries import VERSION, n11_notice_annotations

    rows = [("n1", "h", "Obra de Construcción № ①  ﬁnal"), ("n2", "h", None), ("n3", "h", ""), (None, "h", "obra")]
    spark.createDataFrame(rows, "codigo_externo string, row_hash_sha256 string, descripcion string").write.parquet(f"{tmp_path}/normalized_licitaciones.parquet")
    got = {r["notice_id"]: r for r in n11_notice_annotations(spark, str(tmp_path)).collect()}
    folded = "".join(x for x in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", rows[0][2]).lower()) if not unicodedata.combining(x))
    clean = " ".join(folded.split())
    assert set(got) == {"n1", "n2", "n3"} and got["n1"]["label"] == "construction" and got["n2"]["language"] == "und"
    assert got["n1"]["ref"] == f"tfidf://silver_notice/{VERSION}/" + hashlib.sha256(f"n1|{clean}".encode()).hexdigest()


def test_registered_files_profiles_and_content_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Codigo;CodigoExterno\n1;2\n3\n")
    (tmp_path / "b.csv").write_text("Codigo;Otro\n1;2\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    raw = raw_csv.read_raw(spark, paths, "licitacion")
    stored = raw_csv.read_raw(spark, paths[:1], "licitacion")
    assert raw_csv.unregistered(spark, paths, stored) == paths[1:] and raw_csv.unregistered(spark, paths, raw) == [] and raw_csv.unregistered(spark, paths, raw, force=True) == paths
    got = {r["source_file"][-5:]: r for r in raw_csv.profile(raw, "licitacion").collect()}
    assert (got["a.csv"]["n_rows"], got["a.csv"]["n_problems"], got["a.csv"]["n_columns"]) == (2, 1, 2) and "CodigoExterno" in got["b.csv"]["missing"] and "CodigoExterno" not in got["a.csv"]["missing"]
    errors = lambda kind: raw_csv.preflight(b"Codigo;x\n1;2\n", "a.csv", "licitacion", content_type=kind)["errors"]
    assert "content_type" in errors("image/png") and not any(e == "content_type" for k in (None, "", "Text/CSV; charset=utf-8") for e in errors(k))
