"""Problems 2, 3 and 5 on small cases: nulls, empty tables, ties, repeated rows, extra columns."""

import csv
import datetime as dt
import io
import re
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caudal.operators.profile import departures, profile
from caudal.operators.snapshot_diff import snapshot_changes
from caudal.plans.core_queries import p5_differences, p5_found
from caudal.sources.delimited import Feed, date_problem, loaded, number_problem, number_value, parse_feed, rejected, split_record


def changes(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "d string, k string, t int, v int, h string" + extra)
    out = snapshot_changes(df, F.col("d"), F.col("k"), [F.col("t")], {"v": F.col("v"), "h": F.col("h")})
    return {(r["snapshot"], r["key"], r["change_kind"]) for r in out.collect()}


def test_snapshot_changes(spark):
    rows = [
        ("1", "a", 1, 5, "x"), ("1", "b", 1, 5, "x"), ("1", "c", 1, None, "x"), ("1", "e", 1, 1, "x"), ("1", "e", 2, 2, "x"),
        ("2", "a", 1, 5, "x"), ("2", "c", 1, 7, "x"), ("2", "d", 1, 1, "z"), ("2", "d", 1, 1, "z"), ("2", "e", 1, 2, "x"), ("2", None, 1, 1, "n"),
        ("4", "a", 1, 5, "y"), ("4", "c", 1, 7, "x"), ("4", "d", 1, 1, "z"), ("4", "e", 9, 2, "x"), ("4", None, 1, 1, "n"), (None, "q", 1, 1, "n"),
    ]
    assert changes(spark, rows) == {("2", "b", "removed"), ("2", "c", "changed"), ("2", "d", "added"), ("2", None, "added"), ("4", "a", "changed")}


def test_snapshot_changes_empty_single_and_hot(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [("1", "a", 1, 1, "x")]) == set()
    hot = [("1", "hot", i, 1, "x") for i in range(500)] + [("2", "hot", 1, 1, "x"), ("2", "b", None, None, None)]
    assert changes(spark, hot) == {("2", "b", "added")}


def test_snapshot_changes_clashing_names(spark):
    df = spark.createDataFrame([("1", "a", 1, 5, "x", "s"), ("2", "a", 1, 6, "x", "s")], "d string, k string, t int, v int, snapshot string, key string")
    out = snapshot_changes(df, F.col("d"), F.col("k"), [F.col("t")], {"v": F.col("v")}).collect()
    assert [(r["change_kind"], r["old_v"], r["new_v"]) for r in out] == [("changed", 5, 6)]


@pytest.mark.parametrize(
    ("text", "fields", "problem"),
    [
        ('a;b;c', ["a", "b", "c"], None), ('"a;1";b', ["a;1", "b"], None), ('"a ""q"" b";c', ['a "q" b', "c"], None), ('a "x" b;c', ['a "x" b', "c"], None),
        ('"a;b', ["a;b"], "quote_not_closed"), ('"a"x;b', ["ax", "b"], "text_after_quote"), ('"l1\nl2";b', ["l1\nl2", "b"], None), ("", [""], None), ('"";""', ["", ""], None), (None, [], "no_text"), ('a;"b"\r\n', ["a", "b"], None),
    ],
)
def test_split_record(text, fields, problem):
    assert split_record(text) == (fields, problem)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab;" \né', max_size=12), min_size=1, max_size=6))
def test_split_record_round_trip(fields):
    out = io.StringIO()
    csv.writer(out, delimiter=";", quoting=csv.QUOTE_ALL, lineterminator="").writerow(fields)
    assert split_record(out.getvalue()) == (fields, None)


NUMBERS = {
    "1000": "1000", "$1.234,56": "1234.56", "1,234.56": "1234.56", "-12": "-12", "$ 1 234": "1234", "2 772 545": "2772545", "6,8e+08": "680000000", "1.5": "1.5", "1.234": "1234", "99999999999999.9": "99999999999999.9",
    "100000000000000": None, "1e14": None, "7e18": None, "1,2,3": None, "9%": None, "--9": None, "9-": None, "$": None, "NaN": None, "1.2.3": None, "(9)": None, "1.23,": None, ".5": None, "1e-999999999": "0", "1e999999999": None, "0e999999999": "0", "+5": "5", "$-5": "-5",
}


def test_numbers(spark):
    df = spark.createDataFrame([(k,) for k in NUMBERS], "t string")
    for r in df.select("t", number_problem(F.col("t")).alias("p"), number_value(F.col("t")).alias("v")).collect():
        want = NUMBERS[r["t"]]
        assert (r["p"] is None) == (want is not None), r["t"]
        if want is not None:
            assert r["v"] == Decimal(want), r["t"]


DATES = {"2026-02-28": None, "2026-02-30": "no_such_date", "28/02/2026": None, "31/06/2026": "no_such_date", "28022026": None, "42032026": "no_such_date", "2026-02-28T23:59:59": None, "2026-02-28T24:10:00": "no_such_date",
         "202604": "not_a_date", "2026-2-3": "not_a_date", "NA": None, "1900-01-01": None, "null": None, "por definir": "not_a_date", "2024-02-29": None, "2023-02-29": "no_such_date"}


def test_dates(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "t string")
    assert {r["t"]: r["p"] for r in df.select("t", date_problem(F.col("t")).alias("p")).collect()} == DATES


FEED = Feed(keys=["Id"], dates=["When"], numbers=["Sum"])


def test_feed(spark):
    rows = [
        ("f", 0, "﻿Id;When;Sum;Note"), ("f", 1, "1;2026-01-01;10;x"), ("f", 2, "2;2026-13-01;ten;x"), ("f", 3, "NA;2026-01-01;;x"), ("f", 4, "3;2026-01-01;1"), ("f", 5, '4;2026-01-01;1;"x'),
        ("f", 6, '5;2026-01-01;1;"x"y'), ("f", 7, None), ("f", 8, ""), ("f", 1, "1;2026-01-01;10;x"), ("g", 1, "1;2026-01-01;10;x"), ("h", 0, "Note;Sum;Id"), ("h", 1, "x;5;7"), ("h", None, "x;y;7"), ("e", 0, "Id;When;Sum"),
        ("f", 9, "6;2026-01-01;10;" + "long " * 20000),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "source_file_id string, raw_row_num long, raw_text string, header string").withColumn("file", F.lit("other"))
    parsed = parse_feed(df, FEED)
    got = {(r["file"], r["row"]): r["reasons"] for r in rejected(parsed).collect()}
    assert got == {
        ("f", 2): "no_such_date:When,not_a_number:Sum", ("f", 3): "missing_key:Id", ("f", 4): "field_count", ("f", 5): "quote_not_closed", ("f", 6): "text_after_quote",
        ("f", 7): "no_text", ("f", 8): "field_count", ("g", 1): "no_header", ("h", None): "not_a_number:Sum",
    }
    good = loaded(parsed, {"Id": "text", "When": "date", "Sum": "number"}).collect()
    assert sorted((r["file"], r["row"], r["Id"], r["Sum"]) for r in good) == [("f", 1, "1", Decimal(10)), ("f", 1, "1", Decimal(10)), ("f", 9, "6", Decimal(10)), ("h", 1, "7", Decimal(5))]
    assert {r["When"] for r in good} == {dt.datetime(2026, 1, 1), None}


def test_feed_empty(spark):
    df = spark.createDataFrame([], "source_file_id string, raw_row_num long, raw_text string")
    assert rejected(parse_feed(df, FEED)).count() == 0


def test_profile(spark):
    rows = [("a", 1.0, "x", dt.datetime(2026, 1, 1)), ("a", 100.0, "x", None), ("a", None, None, dt.datetime(2026, 1, 3)), ("b", 1.0, "Y" * 50, dt.datetime(2026, 1, 1)), (None, None, "z", None)]
    df = spark.createDataFrame(rows, "l string, n double, t string, d timestamp")
    got = {(r["load_id"], r["column_name"]): r for r in profile(df, "l", patterns={"t": "[xz]"}).collect()}
    n = got["a", "n"]
    assert (n["n_rows"], n["n_nulls"], n["n_distinct"], n["number_min"], n["number_max"], n["n_measured"]) == (3, 1, 2, 1.0, 100.0, 2)
    assert n["power_sum_1"] == 301 + 2004 and n["power_sum_2"] == 301**2 + 2004**2
    assert (got["b", "t"]["n_violations"], got["b", "t"]["max_chars"], got["a", "t"]["n_violations"]) == (1, 50, 0)
    assert got[None, "t"]["n_rows"] == 1 and got[None, "n"]["mean"] is None
    assert profile(df.limit(0), "l").count() == 0


def test_profile_sums_merge(spark):
    df = spark.range(1000).select(F.lit("a").alias("l"), (F.col("id") % 37).cast("int").alias("n"))
    one, many = profile(df.coalesce(1), "l").first(), profile(df.repartition(16), "l").first()
    assert one == many and one["n_distinct"] == 37


def test_departures(spark):
    usual = [(f"l{i}", "x" if j % 2 else "y") for i in range(6) for j in range(200)]
    odd = [("odd", None if j % 5 < 2 else "x" if j % 2 else "y") for j in range(200)]
    df = spark.createDataFrame(usual + odd + [(None, "x")] * 3, "l string, v string")
    got = {(r["load_id"]): r["departing"] for r in departures(df, "l", {("v", "value"): F.col("v")}).collect()}
    assert abs(got["odd"] - 0.4) < 0.02 and not any(k.startswith("l") for k in got)
    assert departures(df.where("l = 'odd'"), "l", {("v", "value"): F.col("v")}).count() == 0
    assert departures(df.limit(0), "l", {("v", "value"): F.col("v")}).count() == 0


def test_departures_spread_thinly(spark, tmp_path):
    """A third of a load's rows in many bins of under one percent each, with sentinels in all loads."""
    start = dt.datetime(2026, 1, 5, 12)
    letters = "abcdefghijklmnopqrst"
    rows = []
    for load in ("l0", "l1", "l2", "l3", "dates", "regions"):
        for i in range(800):
            moved = i % 20 < 8
            region = f"Región {letters[i // 20 % 20].upper()}{letters[i // 40]}aule" if load == "regions" and moved else "Región Maule" if i % 2 else "Región Ñuble"
            days = (i * 7919) % 1080 - 360 if load == "dates" and moved else 14 + i % 14
            close = dt.datetime(1900, 1, 1) if i % 20 == 19 else start + dt.timedelta(days=days, hours=i % 8)
            rows.append((load, Decimal(1000 * (1 + i % 9)), region, close, start))
    spark.createDataFrame(rows, "source_file_id string, monto_estimado decimal(20,6), region_unidad string, fecha_cierre timestamp_ntz, created_at timestamp").write.parquet(f"{tmp_path}/normalized_licitaciones.parquet")
    assert {tuple(r) for r in p5_found(spark, str(tmp_path)).collect()} == {("dates", "fecha_cierre"), ("regions", "region_unidad")}


def test_whole_text_ranges(spark):
    """Least and greatest texts that agree in their first characters."""
    head = "x" * 40
    df = spark.createDataFrame([("a", head + "b"), ("a", head + "a"), ("a", head + "c" * 9000), ("a", None), ("b", "short"), (None, head + "z")], "l string, t string")
    got = {r["load_id"]: (r["text_min"], r["text_max"]) for r in profile(df, "l").collect()}
    assert got == {"a": (head + "a", head + "c" * 9000), "b": ("short", "short"), None: (head + "z", head + "z")}


def test_differences_find_each_kind_of_departure(spark, tmp_path):
    """Nulls, other forms, another mix of known values, shifted numbers: by the profile's differences alone."""
    start = dt.datetime(2026, 1, 5, 12)
    rows = []
    for load in ("l0", "l1", "l2", "l3", "nulls", "form", "mix", "shift"):
        for i in range(400):
            moved = i % 5 < 2
            region = None if load == "nulls" and moved else "13" if load == "form" and moved else "Región Maule" if load == "mix" and moved else f"Región {'Maule Ñuble Biobío Aysén'.split()[i % 4]}"
            amount = Decimal(1 + i % 9) * (1000000 if load == "shift" and moved else 1000)
            rows.append((load, amount, region, start + dt.timedelta(days=14 + i % 14, hours=i % 8), start))
    spark.createDataFrame(rows, "source_file_id string, monto_estimado decimal(20,6), region_unidad string, fecha_cierre timestamp_ntz, created_at timestamp").write.parquet(f"{tmp_path}/normalized_licitaciones.parquet")
    want = {("nulls", "region_unidad"), ("form", "region_unidad"), ("mix", "region_unidad"), ("shift", "monto_estimado")}
    assert {(r["load_id"], r["column_name"]) for r in p5_differences(spark, str(tmp_path)).where("abs(difference) >= 0.3").collect()} == want
    assert {tuple(r) for r in p5_found(spark, str(tmp_path)).collect()} == want


def test_narrow_reads(spark):
    """Queries over the latest rows read only the columns they use."""
    from caudal.plans import registry

    for name, few in (("h1_days_to_close", 5), ("h8_percentiles", 2), ("w4_latest_by_mode", 12), ("r2_detail", 40)):
        if name in registry.queries():
            plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
                assert schema.count(":") <= few, (name, schema)
