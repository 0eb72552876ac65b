"""Problems 4, 6 and 8 on small cases."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caudal.llm import linkage, mixing, variants
from caudal.llm.blocks import split_hot
from caudal.llm.components import components
from caudal.llm.names import edits, jaro_winkler, parse, similarity

# --- names


def test_jaro_winkler_known_values():
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert jaro_winkler("", "a") == 0.0 and jaro_winkler("a", "a") == 1.0 and edits("abc", "acb", 2) == 1


SAME = [
    ("Agrícola Cobola Chilve y Compañía Limitada", "AGR. COBOLA CHIVE Y CIA LTDA"), ("Pancho Pdrocán Sozanbún", "francisco pidrocán sozanbún"), ("Isabel Tenmo Culdín", "I. Tenmmo Culdín"),
    ("Veré Jucahríc, José", "José Veré Jucharíc"), ("LumecoLincoro, Alimentos S.p.A.", "Alimentos Lumeco Lincoro SpA"), ("MetalÃºrgica Luvia LlolÃ³n Ltda", "Metalúrgica Luvia Llolón Limitada"),
]
DIFFERENT = [
    ("Agrícola Ticubún Gorlucán Limitada", "Agrícola Ticubún Gormelva Limitada"), ("Ximena Drotolte Dunlinrio", "Rosario Drotolte Dunlinrio"), ("Alimentos Boré Tugalla SpA", "Inversiones Boré Tugalla SpA"),
    ("Elena Cortún Dunhuelón", "Tecnologías Corhuetún Dunmo Limitada"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_names(a, b):
    assert similarity(parse(a), parse(b)) >= variants.ACCEPT


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_names(a, b):
    assert similarity(parse(a), parse(b)) < variants.ACCEPT


@settings(max_examples=1500, deadline=None)
@given(st.text("abcñ", max_size=9), st.text("abcñ", max_size=9), st.integers(0, 4))
def test_edits_against_the_whole_table(a, b, most):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    assert edits(a, b, most) == min(d[-1][-1], most + 1)


def test_links(spark, monkeypatch):
    monkeypatch.setattr(variants, "HOT_PAIRS", 3)
    rows = [
        ("a", "Agrícola Cobola Chilve Ltda", None, "Talca", "R", "x", "1.234-5"), ("b", "AGR. COBOLA CHIVE LTDA", None, "TALCA", None, None, None), ("c", "Cobola Chilve, Agricola", None, "Curicó", "R", "x", None),
        ("d", "Agrícola Cobola Chilve Ltda", None, "Talca", "R", "x", "1.234-5"), ("d", "Agrícola Cobola Chilve Ltda", None, "Talca", "R", "x", "1.234-5"), ("e", None, None, "Talca", None, None, None), ("f", "", "", None, None, None, None),
        (None, "Agrícola Cobola Chilve Ltda", None, "Talca", "R", "x", "1.234-5"), ("g", "Importadora Ricán Nohue SpA", "x" * 3000, "Talca", None, None, None), ("h", "Cobola Chilve", None, None, None, None, None),
    ]
    cols = "supplier_key string, nombre_proveedor string, razon_social_proveedor string, comuna_proveedor string, region_proveedor string, actividad_proveedor string, rut_proveedor string"
    df = spark.createDataFrame(rows, cols).withColumn("key", F.lit(1)).withColumn("class", F.lit(2))
    got = {(r["key_a"], r["key_b"]) for r in variants.link_variants(df, variants.SUPPLIERS).collect()}
    assert {("a", "b"), ("a", "d"), ("b", "d"), ("a", "h")} <= got
    assert not any("g" in p or "e" in p or "f" in p for p in got)
    assert variants.link_variants(df.limit(0), variants.SUPPLIERS).count() == 0


@pytest.mark.parametrize("hot", [2000, 1])
def test_links_with_unknown_attributes(spark, monkeypatch, hot):
    """One of two words mistyped, place and activity unknown on one side."""
    monkeypatch.setattr(variants, "HOT_PAIRS", hot)
    rows = [
        ("a", "Consultores Llavelsco Guapepu S.A.", None, "Talca", "R", "x", "1.234-5"), ("b", "Consultores Llavelsco Guapeu S.A.", None, None, "R", None, None),
        ("c", "Alimentos Velbún Velfella E.I.R.L.", None, "Curicó", "R", "y", None), ("d", "Alimentos Veblún Velfella E.I.R.L.", None, None, None, "y", None), ("e", "Consultores Llavelsco Guapeu S.A.", None, "Curicó", "S", "z", None),
    ]
    cols = "supplier_key string, nombre_proveedor string, razon_social_proveedor string, comuna_proveedor string, region_proveedor string, actividad_proveedor string, rut_proveedor string"
    got = {(r["key_a"], r["key_b"]) for r in variants.link_variants(spark.createDataFrame(rows, cols), variants.SUPPLIERS).collect()}
    assert got == {("a", "b"), ("c", "d")}


def test_split_blocks_lose_no_pair(spark):
    """One hot block: all pairs whose known attributes agree meet, however far it is split."""
    rng = random.Random(4)
    rows = [(7, i, [rng.choice([[], ["p"], ["q"]]), rng.choice([[], ["x"], ["y"], ["x", "y"]]), rng.choice([[], ["u"], ["v"], ["w"]])]) for i in range(60)]
    df = spark.createDataFrame(rows, "block long, class long, known array<array<string>>")
    values = [F.get("known", F.lit(i)) for i in range(3)]
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and all(not x or not y or set(x) & set(y) for x, y in zip(a[2], b[2]))}
    for most in (1, 20, 10_000):
        got, blocks = set(), {}
        for r in split_hot(df, values, most).collect():
            blocks.setdefault(r["block"], []).append(r)
        for rs in blocks.values():
            got |= {(a["class"], b["class"]) for a in rs for b in rs if a["class"] < b["class"] and not a["known_at"] & b["known_at"]}
        assert want <= got
    assert split_hot(df.limit(0), values, 1).count() == 0
    sided = {}
    for r in split_hot(df.withColumn("side", F.col("class") % 2), values, 1, "side").collect():
        sided.setdefault(r["block"], []).append(r)
    got = {(a["class"], b["class"]) for rs in sided.values() for a in rs for b in rs if a["side"] == 0 and b["side"] == 1 and not a["known_at"] & b["known_at"]}
    assert {p for w in want for p in (w, w[::-1]) if p[0] % 2 == 0 and p[1] % 2 == 1} <= got


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component"] for r in components(df).collect()} == {x: root(x) for x in parent}


def test_long_chain(spark):
    df = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in components(df).collect()} == {0}


# --- linkage


def brute_force_line(pro, con, z, u, steps=40):
    """Least loss of one line of up to two pairs on a grid."""
    s = pro / (pro + con)
    grid = np.linspace(0, 1, steps + 1)
    best = None
    for xs in np.array(np.meshgrid(*[grid] * len(pro))).reshape(len(pro), -1).T:
        if xs.sum() > 1 + 1e-9:
            continue
        loss = 0
        for i, x in enumerate(xs):
            zeta = grid
            one = pro[i] * (1 - x) ** 2 + con[i] * x**2 + linkage.TOGETHER * (np.maximum(0, x - zeta) ** 2 + np.maximum(0, zeta + s[i] - 1 - x) ** 2) + linkage.RHO / 2 * (zeta - z[i] + u[i]) ** 2
            loss += one.min()
        if best is None or loss < best[0]:
            best = (loss, xs)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_local_step_is_optimal(seed):
    r = np.random.default_rng(seed)
    pro, con, z, u = r.uniform(1, 9, 2), r.uniform(1, 9, 2), r.uniform(0, 1, 2), r.uniform(-0.2, 0.2, 2)
    x, _ = linkage.local_step(np.zeros(2, int), pro, con, z, u, sweeps=200)
    assert x.sum() <= 1 + 1e-6 and np.abs(x - brute_force_line(pro, con, z, u)[1]).max() < 0.06


def notice(i, n, text, q, day=0, code="41000001", fam="Oficina"):
    return (i, n, text, "", code, "Resma", fam, q, "Caja", day)


COLS = "id long, g string, t0 string, t1 string, code string, product string, family string, q double, unit string, day int"


def frame(spark, rows):
    rows = [(*r[:7], None if r[7] is None else float(r[7]), *r[8:]) for r in rows]
    df = spark.createDataFrame(rows, COLS).withColumn("models", F.lit("clash"))
    c = F.col
    return linkage.lines(df, "id", c("g"), (c("t0"), c("t1")), c("code"), c("product"), c("family"), c("q"), c("unit"), c("day"))


@pytest.mark.parametrize("hot", [20_000, 1])
def test_linkage(spark, monkeypatch, hot):
    monkeypatch.setattr(linkage, "HOT_PAIRS", hot)
    notices = [
        notice(1, "7-1-LE26", "Resma carta azul, de lino, medida 75x46 cm, marca Chadún modelo BM-9098, entrega en Liceo Dunpu Huebún", 399), notice(2, "7-1-LE26", "Silla negro, de goma, medida 12x13, modelo TT-1111, para Liceo Dunpu Huebún", 5, fam="Muebles", code="5"),
        notice(3, "8-1-LE26", "Resma carta azul, de lino, medida 70x40 cm, marca Chadún modelo BM-9099, entrega en Liceo Dunpu Huebún", 399), notice(4, "9-1-LE26", None, None, None, None, None), notice(5, "9-2-LE26", "x " * 20000, 1),
    ]
    orders = [
        notice(11, "7-5-SE26", "RESMA CARTA, AZUL, 75*46CM P/ LICEO DUNPU HUEB. MOD BM/9098", 399, 50), notice(12, "7-5-SE26", "Silla; goma / TT 1111 / p/ Liceo Dunpu Huebun", 5, 50, None, "Muebles"), notice(13, "3-5-SE26", "Resma carta roja 75x46", 399, 900), notice(14, "3-6-SE26", None, None, None, None, None), notice(15, None, "Resma carta azul BM9098", 399, 50),
    ]
    reviews = spark.createDataFrame([("7-5-SE26", "7-1-LE26", 0.4)], "o string, nt string, w double")
    n, o = frame(spark, notices), frame(spark, orders)
    got = {(r["p"], r["n"]): r["confidence"] for r in linkage.best_links(linkage.solve(linkage.candidates(o, n), reviews)).collect()}
    assert set(got) == {(11, 1), (12, 2)} and all(0.5 <= v <= 1 for v in got.values())
    assert linkage.candidates(o.limit(0), n).count() == 0 and linkage.candidates(o, n.limit(0)).count() == 0


def test_candidates_of_buyer_and_siblings(spark):
    """Part of the quantity, common words, no model, dimensions or colour: by the buyer, or by the order's other line."""
    common = "Resma carta de lino"
    notices = [notice(i, f"{100 + i}-1-LE26", common, 1000 + i) for i in range(60)] + [notice(70, "7-1-LE26", common, 80), notice(80, "8-1-LE26", common, 60), notice(81, "8-1-LE26", "Silla modelo TT-1111 goma", 5, fam="Muebles", code="5")]
    orders = [notice(170, "7-5-SE26", common, 40, 50), notice(180, "9-5-SE26", common, 30, 50), notice(181, "9-5-SE26", "Silla goma mod TT 1111", 5, 50, fam="Muebles", code="5")]
    n, o = frame(spark, notices), frame(spark, orders)
    got = {(r["p"], r["n"]) for r in linkage.candidates(o, n).collect()}
    assert got == {(170, 70), (180, 80), (181, 81)}


# --- mixing


def highest_quotients(weights, seats, caps):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        free = [k for k, w in weights.items() if w and w > 0 and got[k] < caps.get(k, seats)]
        if not free:
            break
        k = min(free, key=lambda k: (-weights[k] / (2 * got[k] + 1), str(k)))
        got[k] += 1
    return got


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=6), st.integers(0, 120), st.integers(0, 60))
def test_sainte_lague_equals_quotients(ws, seats, cap):
    weights = {f"s{i}": w for i, w in enumerate(ws)}
    caps = {"s0": cap}
    assert mixing.sainte_lague(weights, seats, caps) == highest_quotients(weights, seats, caps)


def test_tokens_of_pieces_are_tokens_of_the_whole(monkeypatch):
    text = "La entidad deberá  entregar\n\nel informe. " * 300
    whole = mixing.count_tokens(text)
    monkeypatch.setattr(mixing, "PIECE", 500)
    assert mixing.count_tokens(text) == whole and mixing.count_tokens(None) == 0 and mixing.count_tokens("") == 0


def test_mix(spark):
    r = random.Random(1)
    docs = [(i, "palabra " * r.randrange(1, 60), s) for i, s in enumerate(["big"] * 900 + ["BIG "] * 5 + ["small-one"] * 60 + ["extra"] * 30 + [None] * 3)] + [(5000, None, "big"), (5001, "", "big"), (7, "palabra", "big")]
    targets = [("big", 0.6, 1), ("small_one", 0.3, 3), ("missing", 0.1, 2), ("zero", 0.0, 2), ("none", None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    t = spark.createDataFrame(targets, "source_name string, target_share double, max_repeats int")
    mixture, shares = mixing.mix(d, t, block_tokens=100)
    got = {x["source_name"]: x for x in shares.collect()}
    assert abs(got["big"]["actual_share"] - 2 / 3) < 0.02 and abs(got["small_one"]["actual_share"] - 1 / 3) < 0.02
    assert got["missing"]["actual_share"] == 0 and got[None]["documents"] == 33 and got["small_one"]["most_copies"] <= 3
    rows = mixture.collect()
    assert max(Counter((x["doc_id"], x["source_name"], x["tokens"]) for x in rows).values()) == 1
    assert {x["copies"] for x in rows if x["source_name"] == "big"} == {1}
    again = {(x["doc_id"], x["copies"]) for x in mixing.mix(d.repartition(7), t, block_tokens=100)[0].collect()}
    assert again == {(x["doc_id"], x["copies"]) for x in rows}
    over = {x["source_name"]: x for x in mixing.mix(d, t, total_tokens=10**9, block_tokens=100)[1].collect()}
    assert over["small_one"]["most_copies"] == 3 and over["big"]["most_copies"] == 1
    assert mixing.mix(d.limit(0), t)[0].count() == 0 and mixing.mix(d, t.limit(0))[0].count() == 0
