"""Exploratory query pack over the procurement entities: volumes, coverage, rankings, concentration, times, text, quality.

Each query is one SQL statement over entity relations. On Spark the relations are frames made by the
operators of this library (latest row a key by one aggregate, no window over raw rows); the oracle prefixes
the statement with its own definition of them. Entities of bids and awards have no table of their own in
the data: line items play them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.operators.latest import latest
from caudal.scale import read

#: Entity: (table, key, order of its rows by time); the latest row of a key counts.
LATEST = {
    "notice": ("normalized_licitaciones", "codigo_externo", ["updated_at", "row_hash_sha256"]), "line": ("silver_notice_line", "notice_line_id", ["updated_at", "row_hash_sha256"]),
    "poline": ("silver_purchase_order_line", "purchase_order_line_id", ["updated_at", "row_hash_sha256"]), "buyer": ("normalized_buyers", "buyer_key", ["updated_at"]), "supplier_dim": ("normalized_suppliers", "supplier_key", ["updated_at"]),
}
#: Entity: SQL over one table whose rows are entities themselves.
SIMPLE = {
    "po": ("silver_purchase_order", "*"), "link": ("silver_notice_purchase_order_link", "*"), "doc": ("documents", "*"),
    "bid": ("lineitem", "l_orderkey AS notice_id, l_partkey AS item_code, l_suppkey AS supplier_key, l_extendedprice AS amount, l_returnflag <> 'N' AS selected, l_shipdate AS offered_at"),
    "offer": ("lineitem", "l_partkey AS notice_id, CASE WHEN CAST(l_quantity AS INTEGER) % 8 <> 0 THEN CAST(CAST(l_quantity AS INTEGER) % 8 AS VARCHAR(9)) END AS item_code, l_linenumber AS line_no, l_suppkey AS supplier_key, l_extendedprice / l_quantity AS price, l_returnflag = 'A' AS selected, l_returnflag = 'A' AND l_linestatus = 'F' AS materialized"),
    "offerline": ("lineitem", "DISTINCT l_partkey AS notice_id, CAST(CAST(l_quantity AS INTEGER) % 8 AS VARCHAR(9)) AS item_code, l_linenumber AS line_no"),
    "product": ("part", "p_partkey AS notice_id, p_brand AS level_3, p_type AS level_2"),
}


def entity(spark: SparkSession, d: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of an entity with ``columns`` (all where None); no other column is read."""
    if name in LATEST:
        table, key, order = LATEST[name]
        return latest(read(spark, d, table), [key], [F.col(c) for c in order], columns)
    table, exprs = SIMPLE[name]
    df = spark.sql(f"SELECT {exprs} FROM {{t}}", t=read(spark, d, table))
    return df.select(*columns) if columns else df


def _first(table: str, key: str, *order: str) -> str:
    by = ", ".join(f"{o} DESC NULLS LAST" for o in order)
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {by}) AS rn_ FROM {table}) q_ WHERE rn_ = 1)"


ORACLE_ENTITIES = {n: _first(t, k, *o) for n, (t, k, o) in LATEST.items()} | {n: f"(SELECT {e} FROM {t})" for n, (t, e) in SIMPLE.items()}


class Spark:
    """Spellings that differ between the engines."""

    words = staticmethod(lambda c: f"LATERAL VIEW explode(split(lower({c}), '[^a-z0-9]+')) w_ AS token")
    token = "token"
    distinct_words = staticmethod(lambda c: f"array_distinct(split(lower({c}), '[^a-z0-9]+'))")
    size = staticmethod(lambda a: f"size({a})")
    common = staticmethod(lambda a, b: f"size(array_intersect({a}, {b}))")
    days = staticmethod(lambda a, b: f"datediff(CAST({a} AS DATE), CAST({b} AS DATE))")
    names = staticmethod(lambda c: f"array_join(sort_array(collect_set({c})), '|')")
    like = staticmethod(lambda c, p: f"regexp_like({c}, '{p}')")


class Duck:
    words = staticmethod(lambda c: f", unnest(regexp_split_to_array(lower({c}), '[^a-z0-9]+')) AS w_(token)")
    token = "w_.token"
    distinct_words = staticmethod(lambda c: f"list_distinct(regexp_split_to_array(lower({c}), '[^a-z0-9]+'))")
    size = staticmethod(lambda a: f"len({a})")
    common = staticmethod(lambda a, b: f"len(list_intersect({a}, {b}))")
    days = staticmethod(lambda a, b: f"date_diff('day', CAST({b} AS DATE), CAST({a} AS DATE))")
    names = staticmethod(lambda c: f"array_to_string(list_sort(list_distinct(list({c}))), '|')")
    like = staticmethod(lambda c, p: f"regexp_matches({c}, '{p}')")


MONTH = "CAST(date_trunc('month', {}) AS DATE)".format
UNIT = "split_part({}, '-', 1)".format
DBL = "CAST({} AS DOUBLE)".format
NOTICE_ORDERS = "SELECT linked_notice_id AS notice_id, purchase_order_id FROM po WHERE linked_notice_id IS NOT NULL UNION SELECT notice_id, purchase_order_id FROM link WHERE link_type = 'explicit_code_match' AND notice_id IS NOT NULL"


def _ratio(a: str, b: str, digits: int = 4) -> str:
    return f"round({DBL(a)} / nullif({DBL(b)}, 0), {digits})"


def _percentiles(x: str, names: dict[str, float]) -> str:
    return ", ".join(f"round(percentile_cont({p}) WITHIN GROUP (ORDER BY {DBL(x)}), 4) AS {n}" for n, p in names.items())


QUERY_PACK: dict[str, Callable[[type], str]] = {
    # volumes
    "b1_rows_per_entity": lambda D: " UNION ALL ".join(f"SELECT '{t}' AS entity, count(*) AS n FROM {t}" for t in ("notice", "line", "po", "poline", "buyer", "supplier_dim", "link")),
    "b2_monthly_volume": lambda D: f"""
        SELECT coalesce(n.month, o.month) AS month, coalesce(n.notices, 0) AS notices, n.estimated AS estimated, coalesce(o.orders, 0) AS orders, o.ordered AS ordered
        FROM (SELECT {MONTH('fecha_publicacion')} AS month, count(*) AS notices, round(sum({DBL('monto_estimado')}), 2) AS estimated FROM notice WHERE fecha_publicacion IS NOT NULL GROUP BY 1) n
        FULL JOIN (SELECT {MONTH('order_created_at')} AS month, count(*) AS orders, round(sum({DBL('total_amount')}), 2) AS ordered FROM po WHERE order_created_at IS NOT NULL GROUP BY 1) o ON n.month = o.month""",
    "b4_status_distribution": lambda D: "SELECT 'notice' AS entity, estado AS status, count(*) AS n FROM notice GROUP BY estado UNION ALL SELECT 'order' AS entity, purchase_order_status_name AS status, count(*) AS n FROM po GROUP BY purchase_order_status_name",
    # coverage
    "c4_link_coverage": lambda D: """
        SELECT count(*) AS orders, count(*) FILTER (WHERE p.linked_notice_id IS NOT NULL) AS direct, count(b.purchase_order_id) AS bridged, count(*) FILTER (WHERE p.linked_notice_id IS NOT NULL AND b.purchase_order_id IS NOT NULL) AS both_ways
        FROM po p LEFT JOIN (SELECT DISTINCT purchase_order_id FROM link) b ON b.purchase_order_id = p.purchase_order_id""",
    "c5_orders_per_notice": lambda D: f"""
        SELECT u.notice_id, count(DISTINCT u.purchase_order_id) AS orders, round(sum({DBL('p.total_amount')}), 2) AS amount
        FROM (SELECT linked_notice_id AS notice_id, purchase_order_id FROM po WHERE linked_notice_id IS NOT NULL UNION ALL SELECT notice_id, purchase_order_id FROM link) u
        JOIN po p ON p.purchase_order_id = u.purchase_order_id GROUP BY u.notice_id""",
    "c5_orders_per_notice_once": lambda D: f"""
        SELECT u.notice_id, count(*) AS orders, round(sum({DBL('p.total_amount')}), 2) AS amount FROM ({NOTICE_ORDERS}) u JOIN po p ON p.purchase_order_id = u.purchase_order_id GROUP BY u.notice_id""",
    # buyers
    "d1_top_buyers_by_notices": lambda D: "SELECT codigo_unidad AS buyer, count(*) AS notices FROM notice GROUP BY codigo_unidad ORDER BY notices DESC, buyer LIMIT 50",
    "d2_top_buyers_by_amount": lambda D: f"SELECT {UNIT('purchase_order_id')} AS buyer, count(*) AS orders, round(sum({DBL('total_amount')}), 2) AS amount FROM po GROUP BY 1 ORDER BY amount DESC NULLS LAST, buyer LIMIT 50",
    "d3_region_sector": lambda D: f"""
        SELECT b.region_unidad_compra AS region, b.sector, count(*) AS orders, count(DISTINCT b.buyer_key) AS buyers, round(sum({DBL('p.total_amount')}), 2) AS amount
        FROM po p JOIN buyer b ON b.buyer_key = {UNIT('p.purchase_order_id')} GROUP BY b.region_unidad_compra, b.sector""",
    # suppliers
    "e1_top_suppliers_by_bids": lambda D: "SELECT supplier_key, count(*) AS bids, count(DISTINCT notice_id) AS notices FROM bid GROUP BY supplier_key ORDER BY bids DESC, supplier_key LIMIT 50",
    "e2_top_suppliers_by_amount": lambda D: f"""
        SELECT p.supplier_key, s.nombre_proveedor AS name, p.orders, p.amount
        FROM (SELECT supplier_key, count(*) AS orders, round(sum({DBL('total_amount')}), 2) AS amount FROM po WHERE supplier_key IS NOT NULL GROUP BY supplier_key ORDER BY amount DESC, supplier_key LIMIT 50) p
        LEFT JOIN supplier_dim s ON s.supplier_key = p.supplier_key""",
    "e3_main_category": lambda D: f"""
        SELECT supplier_key, category, amount FROM (
            SELECT supplier_key, category, amount, row_number() OVER (PARTITION BY supplier_key ORDER BY amount DESC NULLS LAST, n DESC, category) AS r FROM (
                SELECT p.supplier_key, l.category_level_3 AS category, round(sum({DBL('l.line_net_total')}), 2) AS amount, count(*) AS n
                FROM po p JOIN poline l ON l.purchase_order_id = p.purchase_order_id WHERE p.supplier_key IS NOT NULL GROUP BY p.supplier_key, l.category_level_3) g) t WHERE r = 1""",
    "e4_main_buyer": lambda D: f"""
        SELECT supplier_key, buyer, amount FROM (
            SELECT supplier_key, buyer, amount, row_number() OVER (PARTITION BY supplier_key ORDER BY amount DESC NULLS LAST, n DESC, buyer) AS r FROM (
                SELECT supplier_key, {UNIT('purchase_order_id')} AS buyer, round(sum({DBL('total_amount')}), 2) AS amount, count(*) AS n FROM po WHERE supplier_key IS NOT NULL GROUP BY 1, 2) g) t WHERE r = 1""",
    # categories
    "f1_categories_by_notices": lambda D: "SELECT category_level_3 AS category, count(DISTINCT notice_id) AS notices FROM line GROUP BY 1 ORDER BY notices DESC, category LIMIT 50",
    "f2_categories_by_amount": lambda D: f"SELECT category_level_3 AS category, round(sum({DBL('line_net_total')}), 2) AS amount FROM poline GROUP BY 1 ORDER BY amount DESC NULLS LAST, category LIMIT 50",
    "f5_suppliers_per_category": lambda D: "SELECT l.category_level_3 AS category, count(DISTINCT p.supplier_key) AS suppliers FROM po p JOIN poline l ON l.purchase_order_id = p.purchase_order_id GROUP BY 1",
    # competition
    "g1_bidders": lambda D: """
        SELECT (SELECT round(avg(CAST(n AS DOUBLE)), 4) FROM (SELECT count(DISTINCT supplier_key) AS n FROM bid GROUP BY notice_id) a) AS per_notice,
          (SELECT round(avg(CAST(n AS DOUBLE)), 4) FROM (SELECT count(DISTINCT supplier_key) AS n FROM bid GROUP BY notice_id, item_code) b) AS per_line""",
    # times
    **{
        f"h{i}_{name}": (lambda a, b, rel: lambda D: f"SELECT count(*) AS n, round(avg({DBL(D.days(a, b))}), 4) AS mean_days, {_percentiles(D.days(a, b), {'p50': 0.5, 'p90': 0.9})} FROM {rel} WHERE {a} IS NOT NULL AND {b} IS NOT NULL")(a, b, rel)
        for i, name, a, b, rel in ((1, "days_to_close", "fecha_cierre", "fecha_publicacion", "notice"), (2, "days_to_award", "fecha_adjudicacion", "fecha_cierre", "notice"), (3, "days_to_acceptance", "order_accepted_at", "order_created_at", "po"))
    },
    # links
    "i1_linked_orders": lambda D: f"SELECT count(*) AS orders, count(*) FILTER (WHERE is_linked_to_notice_flag) AS linked, {_ratio('count(*) FILTER (WHERE is_linked_to_notice_flag)', 'count(*)')} AS share FROM po",
    "i2_notices_with_orders": lambda D: f"SELECT a.n AS notices, b.n AS with_order, {_ratio('b.n', 'a.n')} AS share FROM (SELECT count(*) AS n FROM notice) a CROSS JOIN (SELECT count(DISTINCT u.notice_id) AS n FROM ({NOTICE_ORDERS}) u JOIN notice x ON x.codigo_externo = u.notice_id) b",
    "i7_awarded_without_order": lambda D: f"SELECT n.codigo_externo FROM notice n WHERE n.fecha_adjudicacion IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({NOTICE_ORDERS}) u WHERE u.notice_id = n.codigo_externo)",
    # text
    "j2_uniqueness": lambda D: " UNION ALL ".join(
        f"SELECT '{n}' AS field, count({c}) AS n, count(DISTINCT {c}) AS n_distinct, {_ratio(f'count(DISTINCT {c})', f'count({c})')} AS uniqueness FROM {t}"
        for n, c, t in (("notice_description", "descripcion", "notice"), ("line_description", "line_description_raw", "line"), ("order_spec", "buyer_item_spec_raw", "poline"))
    ),
    # quality
    "k1_null_ratios": lambda D: " UNION ALL ".join(
        f"SELECT '{t}.{c}' AS field, round(avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END), 6) AS null_ratio FROM {t}"
        for t, c in (("notice", "codigo_unidad"), ("notice", "fecha_cierre"), ("line", "onu_product_code"), ("po", "supplier_key"), ("po", "linked_notice_id"), ("poline", "onu_product_code"), ("supplier_dim", "rut_proveedor"))
    ),
    "k3_orphans": lambda D: " UNION ALL ".join(
        f"SELECT '{n}' AS relation, count(*) AS orphans FROM {c} c LEFT JOIN {p} p ON p.{pk} = c.{ck} WHERE c.{ck} IS NOT NULL AND p.{pk} IS NULL"
        for n, c, ck, p, pk in (("line-notice", "line", "notice_id", "notice", "codigo_externo"), ("order line-order", "poline", "purchase_order_id", "po", "purchase_order_id"), ("order-supplier", "po", "supplier_key", "supplier_dim", "supplier_key"), ("link-order", "link", "purchase_order_id", "po", "purchase_order_id"))
    ),
    "k7_orders_without_parties": lambda D: f"SELECT p.purchase_order_id, p.supplier_key IS NULL AS no_supplier, b.buyer_key IS NULL AS no_buyer FROM po p LEFT JOIN buyer b ON b.buyer_key = {UNIT('p.purchase_order_id')} WHERE p.supplier_key IS NULL OR b.buyer_key IS NULL",
    "x3_shared_vocabulary": lambda D: f"SELECT token FROM (SELECT {D.token} AS token FROM notice {D.words('nombre')} INTERSECT SELECT {D.token} AS token FROM poline {D.words('buyer_item_spec_raw')}) s WHERE length(token) >= 3",
}

TABLES = ["normalized_licitaciones", "normalized_suppliers", "normalized_buyers", "silver_notice_line", "silver_purchase_order", "silver_purchase_order_line", "orders"]


def _used(sql: str, names: dict | list) -> list[str]:
    return [n for n in names if re.search(rf"(?:FROM|JOIN)\s+{n}\b", sql)]


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a statement over the entity relations and tables that it names, each with the columns whose names it holds."""
    words = set(re.findall(r"\w+", sql))

    def columns(name: str) -> list[str] | None:
        if name not in LATEST:
            return None
        table, key, _ = LATEST[name]
        return [c for c in read(spark, sf_dir, table).columns if c in words or c == key]

    frames = {n: entity(spark, sf_dir, n, columns(n)) for n in _used(sql, ORACLE_ENTITIES)} | {n: read(spark, sf_dir, n) for n in _used(sql, TABLES)}
    text = sql.replace("{", "{{").replace("}", "}}")
    for n in frames:
        text = re.sub(rf"((?:FROM|JOIN)\s+){n}\b", rf"\1{{{n}}}", text)
    return spark.sql(text, **frames)


def oracle(sql: str) -> str:
    used = _used(sql, ORACLE_ENTITIES)
    head = ", ".join(f"{n} AS {ORACLE_ENTITIES[n]}" for n in used)
    sql = sql.strip()
    return f"WITH {head}, {sql[5:]}" if head and sql.startswith("WITH ") else f"WITH {head} {sql}" if head else sql


def _query(make: Callable[[type], str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark, sf_dir, make(Spark))


QUERIES = {name: _query(make) for name, make in QUERY_PACK.items()}
ORACLE = {name: oracle(make(Duck)) for name, make in QUERY_PACK.items()}
