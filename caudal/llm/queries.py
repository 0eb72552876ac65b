"""Queries of the problems tagged llm, and the SQL they are checked against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.llm import leakage, linkage, mixing, mojibake, spam_shapes, variants
from caudal.scale import read

#: Table: (key, fields that may be garbled).
GARBLED = {"normalized_licitaciones": ("codigo_externo", ["nombre", "descripcion"]), "normalized_suppliers": ("supplier_key", ["nombre_proveedor"])}


def _p1_cases(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [mojibake.garbled(read(spark, d, t), k, f).withColumn("record_table", F.lit(t)) for t, (k, f) in GARBLED.items()])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1_cases(spark, d).select("record_table", "record_key", "field_name").distinct()


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    """Damaged values with the original text where it can be had."""
    texts = [read(spark, d, t).select(F.explode(F.array(*f)).alias("text")).where("text IS NOT NULL") for t, (_, f) in GARBLED.items()]
    return mojibake.restore_lost(_p1_cases(spark, d), reduce(DataFrame.unionByName, texts))


def _latest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key, the latest updated; ties fall to the greatest values."""
    rest = [c for c in columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct("updated_at", *rest)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Notice line bought by each order line without a linked notice, with the confidence."""
    notice_line, order, order_line, link, tender = read(spark, d, "silver_notice_line", "silver_purchase_order", "silver_purchase_order_line", "silver_notice_purchase_order_link", "normalized_licitaciones")
    columns = ["notice_id", "onu_product_code", "generic_product_name", "category_level_1", "line_name", "line_description_raw", "unit_of_measure", "quantity_requested"]
    published = tender.groupBy(F.col("codigo_externo").alias("notice_id")).agg(F.min("fecha_publicacion").alias("published"))
    asked = _latest(notice_line, "notice_line_id", ["notice_line_id", *columns]).join(published, "notice_id", "left")
    columns = ["purchase_order_id", "linked_notice_id", "onu_product_code", "generic_product_name", "category_level_1", "buyer_item_spec_raw", "supplier_item_spec_raw", "unit_of_measure", "quantity_ordered"]
    created = order.groupBy("purchase_order_id").agg(F.min("order_created_at").alias("created"))
    bought = _latest(order_line, "purchase_order_line_id", ["purchase_order_line_id", *columns]).where("linked_notice_id IS NULL").join(created, "purchase_order_id", "left")
    c = F.col
    notices = linkage.materialize(linkage.lines(
        asked, "notice_line_id", c("notice_id"), (c("line_description_raw"), F.concat_ws(" ", "line_name", "generic_product_name")), c("onu_product_code"), c("generic_product_name"), c("category_level_1"),
        c("quantity_requested"), c("unit_of_measure"), F.unix_date(c("published").cast("date")),
    ))
    orders = linkage.materialize(linkage.lines(
        bought, "purchase_order_line_id", c("purchase_order_id"), (c("buyer_item_spec_raw"), c("supplier_item_spec_raw")), c("onu_product_code"), c("generic_product_name"), c("category_level_1"),
        c("quantity_ordered"), c("unit_of_measure"), F.unix_date(c("created").cast("date")),
    ))
    reviews = link.where("link_type = 'candidate_review'").select(c("purchase_order_id").alias("o"), c("notice_id").alias("nt"), F.coalesce(c("link_confidence").cast("double"), F.lit(0.3)).alias("w"))
    solved = linkage.solve(linkage.candidates(orders, notices), reviews)
    return linkage.best_links(solved).select(
        c("n").alias("notice_line_id"), c("p").alias("purchase_order_line_id"), c("nt").alias("notice_id"), c("o").alias("purchase_order_id"), F.round("confidence", 6).alias("link_confidence")
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_links(spark, d).select("notice_line_id", "purchase_order_line_id").distinct()


#: Table: what is compared of its records.
NAMED = {"normalized_suppliers": variants.SUPPLIERS, "normalized_buyers": variants.BUYERS}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [variants.link_variants(read(spark, d, t), a).select(F.lit(t).alias("record_table"), "key_a", "key_b") for t, a in NAMED.items()]
    return reduce(DataFrame.unionByName, parts)


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    """Entity of every key of suppliers and buying units, without expanding pairs."""
    parts = [variants.link_members(read(spark, d, t), a).select(F.lit(t).alias("record_table"), "key", "entity") for t, a in NAMED.items()]
    return reduce(DataFrame.unionByName, parts)


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with passages of evaluation items: windows that match, best similarity, whether word for word."""
    docs, items = read(spark, d, "documents", "eval_passages")
    return leakage.find_leaks(docs, items)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).where("verbatim").select("doc_id", "item_id").distinct()


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mixture with their number of copies."""
    return mixing.mix(*read(spark, d, "documents", "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source in the mixture."""
    return mixing.mix(*read(spark, d, "documents", "mix_targets"))[1]


def p9_shapes(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document is in non-sentence shapes, and in the commonest of them."""
    return spam_shapes.spam_pages(read(spark, d, "documents"))


def p9_corpus_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The shapes that the lines of all documents take, and whether they are those of sentences."""
    return spam_shapes.corpus_shapes(read(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_shapes(spark, d).where("is_spam").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p4_found, p4_links, p6_found, p6_members, p7_found, p7_leaks, p8_mixture, p8_shares, p9_found, p9_shapes, p9_corpus_shapes)}
_GRAMS = "SELECT DISTINCT id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM (SELECT {id} AS id, regexp_extract_all(strip_accents(lower({text})), '[a-z0-9]+') AS w FROM {table}) a) b"
ORACLE = {
    "p7_found": f"""WITH d AS ({_GRAMS.format(id='doc_id', text='text', table='documents')}), e AS ({_GRAMS.format(id='item_id', text='passage', table='eval_passages')})
        SELECT DISTINCT d.id AS doc_id, e.id AS item_id FROM d JOIN e ON d.g = e.g""",
}
