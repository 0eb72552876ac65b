"""Problems 7 and 9 against brute force and labelled small pages."""

import time
import random

import numpy as np
import pytest

from caudal.llm import leakage
from caudal.llm.leakage import Index, find_leaks, fingerprints, shingles, words_of
from caudal.llm.spam_shapes import corpus_shapes, page_shapes, sentence_shape, shape, spam_pages

WORDS = "el proveedor entregará los bienes según bases técnicas dentro del plazo indicado en anexo tres sin costo adicional para la unidad".split()


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(400)) for _ in range(n))


def brute(docs, items, w=12):
    grams = {}
    for i, t in items:
        ws = words_of(t or "")
        for k in range(len(ws) - w + 1):
            grams.setdefault(tuple(ws[k : k + w]), set()).add(i)
    return {(d, i) for d, t in docs for ws in [words_of(t or "")] for k in range(len(ws) - w + 1) for i in grams.get(tuple(ws[k : k + w]), ())}


@pytest.mark.parametrize("block_words", [10**6, 60])
def test_leaks_equal_brute_force(spark, block_words, monkeypatch):
    monkeypatch.setattr(leakage, "CHUNK", 50)
    items = [(i, text(i, 40)) for i in range(6)] + [(7, "corto texto"), (8, None), (9, text(1, 40))]
    docs = [(100 + i, text(50 + i, 30) + " " + " ".join(items[i % 6][1].split()[5 : 5 + 9 + i]).upper().replace("E", "É") + ", " + text(90 + i, 30)) for i in range(12)]
    docs += [(1, None), (2, ""), (3, items[0][1]), (3, items[0][1]), (4, "a b c"), (None, items[0][1]), (5, text(5, 20000) + " " + items[2][1])]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    rows = find_leaks(d.selectExpr("*", "1 AS similarity", "2 AS item_id"), t, block_words=block_words).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["verbatim"]} == brute([x for x in docs if x[0] is not None], items)
    assert sum(r["doc_id"] == 3 and r["item_id"] == 0 for r in rows) == 2
    assert find_leaks(d.limit(0), t).count() == 0 and find_leaks(d, t.limit(0)).count() == 0


def test_blocks_find_all_within_radius():
    ix = Index([(i, text(i, 80)) for i in range(20)], 12, 3)
    rng = np.random.default_rng(3)
    p = ix.prints[rng.integers(0, len(ix.prints), 400)].copy()
    for i in range(len(p)):
        for b in rng.choice(64, i % 6, replace=False):
            p[i] ^= np.uint64(1) << np.uint64(b)
    want = {(a, b) for a in range(len(p)) for b in np.flatnonzero(np.bitwise_count(ix.prints ^ p[a]) <= 3).tolist()}
    assert set(zip(*(x.tolist() for x in ix.near(p)))) == want


def test_fingerprints_do_not_depend_on_chunks(monkeypatch):
    s = shingles(np.arange(1, 900, dtype=np.uint64) ** np.uint64(3))
    w = np.arange(len(s)) % 7 + 1
    whole = fingerprints(s, w, 11)
    monkeypatch.setattr(leakage, "CHUNK", 37)
    assert (fingerprints(s, w, 11) == whole).all() and len(whole) == len(s) - 10


SENTENCES = "La entidad licitante deberá entregar el informe mensual de avance dentro de 30 días. El contratista no podrá modificar los planos actualizados sin autorización de la jefatura. "
SPAM = [
    "resmas baratas, tóner original, resmas baratas online, comprar tóner original, resmas baratas precio, tóner original stock, resmas baratas 2026",
    "\n".join(f'<a href="http://x{i}.test/toner">resmas baratas oferta</a>' for i in range(9)), " ".join(f"https://www.x{i}.example/grua?id={i}" for i in range(20)),
    "#oferta #resmas #toner #barato #premium #stock #online #mejor", "\n".join(["Inicio > Aseo > Cloro", "Inicio > Salud > Guantes > Oferta", "Inicio > Deportes"] * 4),
    "¿Busca resmas baratas? Resmas baratas en Talca. Cotice resmas baratas hoy, resmas baratas siempre. Las mejores resmas baratas de Talca. Somos resmas baratas, vendemos resmas baratas. Resmas baratas, resmas baratas. ",
    "escritorio estacion premium\nmesa de trabajo\ncartucho de toner 24 horas\nmat de ejercicio\nsillon vinilo azul\npolera pique negra",
    SENTENCES + "\n" + " | ".join(["grúas horquilla oferta", "resmas baratas stock", "tóner original"] * 20),
]
PLAIN = [
    SENTENCES, SENTENCES.upper(), "", None, "Hola.", SENTENCES + "Referencias:\nwww.a.test/uno\nhttp://b.test/dos", "Ítems solicitados:\n" + "\n".join(f"{i}. Parka institucional negro: {i}8 unidades" for i in range(1, 15)),
    "La entidad licitante deberá entregar\nel informe mensual de avance dentro de\nlos 30 días que siguen a la firma del\ncontrato según lo que indica la pauta.", SENTENCES + " #oferta #resmas",
    "Please confirm whether the battery includes installation at Talca. Bidders may request clarification about item 4 before the closing date. " * 3, SENTENCES * 2000,
]


ORDINARY = {
    "poem": "Über allen Gipfeln\nIst Ruh,\nIn allen Wipfeln\nSpürest du\nKaum einen Hauch;\nDie Vögelein schweigen im Walde.",
    "lower-case poem": "caminante no hay camino\nse hace camino al andar\nal andar se hace el camino\ny al volver la vista atrás\nse ve la senda que nunca\nse ha de volver a pisar",
    "contents": "Contenido\n1. Antecedentes generales ........ 3\n2. Requisitos de participación ........ 5\n3. Presentación de ofertas ........ 8\n4. Evaluación ........ 12\n5. Adjudicación y contrato ........ 15\nAnexos ........ 20",
    "glossary": "Licitación: procedimiento administrativo\nAdjudicación: acto que acepta una oferta\nGarantía: caución del contrato\nBases: documentos aprobados\nOferente: quien presenta una oferta",
    "minutes": "Acta de la sesión\nAsistentes\nAntonio Pérez, alcalde\nMarta Soto, secretaria\nTabla\nLectura del acta anterior\nPresupuesto del año\nVarios\nCierre de la sesión",
}


@pytest.mark.parametrize("kind", ORDINARY)
def test_short_lines_of_ordinary_texts_are_no_tags(kind):
    assert page_shapes(ORDINARY[kind])[0] <= 0.5


def test_shapes():
    assert shape("Inicio > Aseo > Cloro") == "w3Cs3l0r0" and not sentence_shape(shape("Inicio > Aseo > Cloro"))
    assert sentence_shape(shape("La entidad deberá entregar el informe, los planos y el acta.")) and sentence_shape(shape("1. Guantes negros: 40 unidades"))
    assert not sentence_shape(shape("<a href='x.y'>resmas baratas</a>")) and not sentence_shape(shape("tóner; resmas; papel; cloro; guantes"))


def test_long_lines_take_linear_time():
    began = time.time()
    for t in ("a-" * 200_000, "<a " * 100_000, "1" * 300_000, "1. " + "2,3 " * 100_000, "x.y" * 100_000):
        page_shapes(t)
    assert time.time() - began < 20


def test_corpus_shapes(spark):
    got = {r["shape"]: r for r in corpus_shapes(spark.createDataFrame([(1, t) for t in SPAM + PLAIN], "doc_id long, text string")).collect()}
    assert all(r["sentence"] == sentence_shape(s) for s, r in got.items()) and any(not r["sentence"] for r in got.values())
    assert corpus_shapes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pages(spark):
    rows = [(i, t) for i, t in enumerate(SPAM + PLAIN)] + [(0, SPAM[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS p", "1 AS is_spam")
    got = spam_pages(df).collect()
    assert sorted(r["doc_id"] for r in got if r["is_spam"]) == [0] + list(range(len(SPAM)))
    assert len(got) == len(rows) and spam_pages(df.limit(0)).count() == 0


def test_share_is_over_whole_text():
    assert page_shapes(SENTENCES * 300 + SPAM[0])[1] < 0.05


def test_many_shapes_and_many_phrases(spark):
    tags = ["toner", "Toner negro", "RESMA CARTA OFICIO", "Silla Visita Cromada Azul", "mesa, pino, oferta", "Guante / Nitrilo", "CLORO | GEL | 5L | OFERTA", "grúa > horquilla > usada", "#aseo", "#Parka #Polar", "www.x.test/a", "Ver www.y.test/b Oferta", "LÁPIZ - GOMA - REGLA - TIJERA - PAPEL"]
    phrases = ["resmas baratas", "tóner original", "grúas horquilla", "sillas ergonómicas", "guantes nitrilo", "cloro gel"]
    stuffed = " ".join(f"La entidad ofrece {p} en la zona y también {p} con la mejor garantía. " * 4 for p in phrases)
    varied = "\n".join(tags) + "\n" + SENTENCES
    df = spark.createDataFrame([(1, varied), (2, stuffed), (3, SENTENCES * 3 + "\n" + "\n".join(tags[:4]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in spam_pages(df).collect()}
    assert {k for k, r in got.items() if r["is_spam"]} == {1, 2}
