"""Problem 1: round trips through wrong encodings, decoys, lost characters."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caudal.llm.mojibake import _decode, examine, garbled, repair, replaced_marks, restore_lost, suspect

WORDS = ["Contratación", "señalética", "público", "año", "Ñuñoa", "garantía", "técnica", "ÁREA", "pingüino", "según", "LICITACIÓN", "Nº 4", "«uso»", "50 €", "120 m²"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS), min_size=1, max_size=6), st.sampled_from(["latin-1", "cp1252", "cp850", "cp437", "mac_roman", "cp1251"]), st.booleans())
def test_utf8_read_as_single_bytes_round_trips(words, wrong, twice):
    text = " ".join(words)
    bad = _decode(text.encode("utf-8"), wrong)
    if twice and wrong in ("latin-1", "cp1252"):
        bad = _decode(bad.encode("utf-8"), wrong)
    n, lost, fixed = repair(bad)
    assert (n > 0) == (bad != text) and lost == 0
    assert fixed == text


@pytest.mark.parametrize("wrong", ["cp850", "mac_roman"])
def test_single_byte_confusion(wrong):
    text = "Contratación de cámara según garantía técnica y año. Habilitación y provisión"
    bad = text.encode("latin-1").decode(wrong)
    assert repair(bad) == (sum(a != b for a, b in zip(text, bad)), 0, text)


DECOYS = [
    "modelo CÂMARA LUX", "artículo 3º, letra ñ)", "diámetro Ø 12 mm", "código &oacute;ptimo &ntilde;", "¿Incluye flete? Sí", "consultas??? ver foro", "bajo 8 °C y humedad < 60%", "rango ±5 µm", "precio en € según anexo",
    "«uso clínico» exclusivamente", "marca SÃO BRÍLEM", "120 m² – segundo piso", "pingüino", "português: instalação e manutenção", "tubería de ½\" y codo de 90°", "Straße groß", "(¿vigente?)", "", "plain", "http://a.b/c?id=4", "l·l col·lecció", "L'Été “citado” ’tis",
]


@pytest.mark.parametrize("text", DECOYS)
def test_correct_text_is_left_alone(text):
    assert repair(text) == (0, 0, text)


def test_mixed_text_keeps_what_is_right():
    assert repair("Según garantÃ­a de São Brílem")[2] == "Según garantía de São Brílem"


@pytest.mark.parametrize(("text", "n"), [("Licitaci?n p?blica", 2), ("ser? evaluado", 1), ("?rea técnica", 1), ("Chab?n", 1), ("Llar?", 1), ("¿Qué? cosa", 0), ("a ? b", 1), ("x???", 0)])
def test_replaced_marks(text, n):
    assert len(replaced_marks(text)) == n


def test_garbled_and_restored(spark):
    long = "palabra " * 30000 + "garantÃ­a"
    rows = [("k1", "Contrataci�n", "limpio"), ("k2", None, ""), ("k3", "garantÃ­a", "garantía"), ("k3", "garantÃ­a", "x"), (None, "a�o", None), ("k4", long, "según")] + [("c", "contratación y año", "según")] * 20
    df = spark.createDataFrame(rows, "k string, a string, b string").withColumn("damaged", F.lit("clash"))
    cases = garbled(df, "k", ["a", "b"])
    got = sorted(((r["record_key"], r["field_name"], r["n_lost"]) for r in cases.collect()), key=str)
    assert got == sorted([("k1", "a", 1), ("k3", "a", 0), ("k3", "a", 0), (None, "a", 1), ("k4", "a", 0)], key=str)
    clean = df.select(F.explode(F.array("a", "b")).alias("text"))
    fixed = {(r["record_key"]): (r["restored"], r["complete"]) for r in restore_lost(cases, clean).collect()}
    assert fixed["k1"] == ("Contratación", True) and fixed[None] == ("año", True) and fixed["k4"][0] == long.replace("Ã­", "í")
    assert restore_lost(garbled(df.limit(0), "k", ["a"]), clean.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["Cual es el plazo?", "What time is it?", "SUR—NORTE", "A—B", "HOLA…ADIOS"])
def test_signs_that_may_be_right_are_only_doubtful(text):
    assert repair(text) == (0, 0, text)
    assert examine(text)[3]


def test_every_repaired_text_meets_the_prefilter():
    import re

    from caudal.llm.mojibake import sequences, singles

    pattern = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), suspect()))
    assert all(pattern.search(k) for k in [*sequences(), *singles(), "Servicio tÚcnico", "a�o", "a?o"])


def test_doubtful_signs_are_judged_by_the_corpus(spark):
    rows = [("1", "Servicio tÚcnico"), ("2", "Cual es el plazo?"), ("3", "polera piqu? azul"), ("4", "ESPA—A"), ("5", "SUR—NORTE"), ("6", "What time is it?"), ("7", "el plazo de polera piqué en ESPAÑA"), ("8", None), ("9", "")]
    got = {r["record_key"]: r["restored"] for r in garbled(spark.createDataFrame(rows, "k string, a string"), "k", ["a"]).collect()}
    assert got == {"1": "Servicio técnico", "3": "polera piqu? azul", "4": "ESPA?A"}
