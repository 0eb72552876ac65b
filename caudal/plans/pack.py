"""Exploratory reads as data frames, each with SQL written apart from it: growth, funnel, conversion, competition, times, text, keys.

Amounts are summed as decimals and given as doubles. Lists that the reads cut to a number of rows are ordered down to
a unique column. Bids, their lines and their outcomes have no table in the data: line items (``offer``) play them;
"offers" of a supplier are the notices its orders name. Codes that are missing bear a name (``SIN_…``), as in the lists.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caudal.plans.eda import entity, oracle
from caudal.scale import read

Read = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Read] = {}
ORACLE: dict[str, str] = {}
c, count, uniq = F.col, F.count, F.count_distinct


def stated(sql: str) -> Callable[[Read], Read]:
    """Register a read under its name, with its SQL over the entity relations."""

    def keep(f: Read) -> Read:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle(sql)
        return f

    return keep


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def share(a: Column, b: Column, scale: float = 100.0) -> Column:
    """``a`` in hundredths of ``b``, null where ``b`` is 0."""
    return F.round(F.try_divide(scale * a, b), 4)


def money(name: str) -> Column:
    return F.sum(name).cast("double")


def month(name: str) -> Column:
    return F.trunc(name, "month")


def days(late: str, early: str) -> Column:
    return F.datediff(c(late).cast("date"), c(early).cast("date"))


def where_n(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def buyer_code() -> Column:
    return F.coalesce(F.split_part("purchase_order_id", F.lit("-"), F.lit(1)), F.lit("SIN_BUYER"))


def supplier_code() -> Column:
    return F.coalesce("supplier_key", F.lit("SIN_SUPPLIER"))


def bought_category() -> Column:
    return F.coalesce("category_code", "category_level_3", "category_level_1", F.lit("SIN_CATEGORIA"))


def asked_category() -> Column:
    return F.coalesce("category_level_3", "category_level_2", "category_level_1", F.lit("SIN_CATEGORIA"))


_BOUGHT = ["category_code", "category_level_3", "category_level_1"]
_ASKED = ["category_level_3", "category_level_2", "category_level_1"]
# The same in SQL.
_B = "coalesce(split_part({}purchase_order_id, '-', 1), 'SIN_BUYER')".format
_S = "coalesce({}supplier_key, 'SIN_SUPPLIER')".format
_BC = "coalesce({0}category_code, {0}category_level_3, {0}category_level_1, 'SIN_CATEGORIA')".format
_AC = "coalesce({0}category_level_3, {0}category_level_2, {0}category_level_1, 'SIN_CATEGORIA')".format
_P = "round(CASE WHEN {1} <> 0 THEN 100.0 * CAST({0} AS DOUBLE) / {1} END, 4)".format
_D = "date_diff('day', CAST({1} AS DATE), CAST({0} AS DATE))".format


def linked(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Notices and orders, by the order's own notice and by the link table; a pair known both ways comes twice."""
    po = entity(s, d, "po", ["purchase_order_id", "linked_notice_id", *columns])
    direct = po.where("linked_notice_id IS NOT NULL").withColumnRenamed("linked_notice_id", "notice_id")
    bridged = entity(s, d, "link", ["notice_id", "purchase_order_id"]).join(po.drop("linked_notice_id"), "purchase_order_id")
    return direct.unionByName(bridged)


# --- volumes


@stated("""SELECT month, n AS po_count, n - lag(n) OVER (ORDER BY month) AS po_count_delta, CAST(s AS DOUBLE) AS po_total_amount, CAST(s - lag(s) OVER (ORDER BY month) AS DOUBLE) AS po_amount_delta
    FROM (SELECT CAST(date_trunc('month', order_created_at) AS DATE) AS month, count(*) AS n, sum(total_amount) AS s FROM po WHERE order_created_at IS NOT NULL GROUP BY 1) q""")
def b3_monthly_growth(s: SparkSession, d: str) -> DataFrame:
    """Orders and amounts a month, and their change from the month before."""
    m = entity(s, d, "po", ["order_created_at", "total_amount"]).where("order_created_at IS NOT NULL").groupBy(month("order_created_at").alias("month")).agg(count("*").alias("po_count"), F.sum("total_amount").alias("total"))
    w = Window.orderBy("month")  # one row a month
    return m.select("month", "po_count", (c("po_count") - F.lag("po_count").over(w)).alias("po_count_delta"), c("total").cast("double").alias("po_total_amount"), (c("total") - F.lag("total").over(w)).cast("double").alias("po_amount_delta"))


@stated("""SELECT CASE WHEN s LIKE '%cancel%' OR s LIKE '%anulad%' OR s LIKE '%rechaz%' THEN 'cancelled' WHEN s LIKE '%acept%' OR s LIKE '%cerrad%' OR s LIKE '%finaliz%' OR s LIKE '%complet%' THEN 'closed' ELSE 'active_or_other' END AS lifecycle_state, count(*) AS orders
    FROM (SELECT lower(coalesce(purchase_order_status_name, '')) AS s FROM po) q GROUP BY 1""")
def b5_lifecycle_states(s: SparkSession, d: str) -> DataFrame:
    """Orders cancelled, closed and other, by what their status name holds."""
    name = F.lower(F.coalesce("purchase_order_status_name", F.lit("")))
    state = F.when(name.rlike("cancel|anulad|rechaz"), "cancelled").when(name.rlike("acept|cerrad|finaliz|complet"), "closed").otherwise("active_or_other")
    return entity(s, d, "po", ["purchase_order_status_name"]).groupBy(state.alias("lifecycle_state")).agg(count("*").alias("orders"))


@stated("""SELECT 'notice' AS entity, max(CAST(fecha_publicacion AS DATE)) AS max_business_date, max(CAST(updated_at AS DATE)) AS max_load_date FROM notice
    UNION ALL SELECT 'award', max(CAST(fecha_adjudicacion AS DATE)), max(CAST(updated_at AS DATE)) FROM notice WHERE fecha_adjudicacion IS NOT NULL
    UNION ALL SELECT 'order', max(CAST(order_created_at AS DATE)), max(CAST(updated_at AS DATE)) FROM po UNION ALL SELECT 'order_line', NULL, max(CAST(updated_at AS DATE)) FROM poline""")
def b6_freshness(s: SparkSession, d: str) -> DataFrame:
    """Newest business date and newest load of each entity; order lines have no date of their own."""
    n, po, l = entity(s, d, "notice", ["fecha_publicacion", "fecha_adjudicacion", "updated_at"]), entity(s, d, "po", ["order_created_at", "updated_at"]), entity(s, d, "poline", ["updated_at"])
    parts = [("notice", n, c("fecha_publicacion")), ("award", n.where("fecha_adjudicacion IS NOT NULL"), c("fecha_adjudicacion")), ("order", po, c("order_created_at")), ("order_line", l, F.lit(None))]
    return union([df.agg(F.max(at.cast("date")).alias("max_business_date"), F.max(c("updated_at").cast("date")).alias("max_load_date")).withColumn("entity", F.lit(k)) for k, df, at in parts])


# --- funnel


@stated(f"""WITH po_n AS (SELECT linked_notice_id AS k FROM po UNION SELECT notice_id FROM link), m AS (
      SELECT n.codigo_externo IN (SELECT notice_id FROM line) AS l, coalesce(n.numero_oferentes, 0) > 0 AS b, n.fecha_adjudicacion IS NOT NULL AS a, p.k IS NOT NULL AS p FROM notice n LEFT JOIN po_n p ON p.k = n.codigo_externo)
    SELECT count(*) AS notices, count(*) FILTER (WHERE l) AS with_line, {_P('count(*) FILTER (WHERE l)', 'count(*)')} AS pct_line, count(*) FILTER (WHERE b) AS with_bid, {_P('count(*) FILTER (WHERE b)', 'count(*)')} AS pct_bid,
      count(*) FILTER (WHERE a) AS with_award, {_P('count(*) FILTER (WHERE a)', 'count(*)')} AS pct_award, count(*) FILTER (WHERE p) AS with_po, {_P('count(*) FILTER (WHERE p)', 'count(*)')} AS pct_po FROM m""")
def c1_funnel(s: SparkSession, d: str) -> DataFrame:
    """Notices with lines, bidders, an award and orders (by either way of linking)."""
    n = entity(s, d, "notice", ["codigo_externo", "numero_oferentes", "fecha_adjudicacion"]).withColumnRenamed("codigo_externo", "notice_id")
    lines, orders = entity(s, d, "line", ["notice_id"]).distinct().withColumn("l", F.lit(True)), linked_notices(s, d).withColumn("p", F.lit(True))
    held = n.join(lines, "notice_id", "left").join(orders, "notice_id", "left")
    tests = {"line": c("l"), "bid": c("numero_oferentes") > 0, "award": c("fecha_adjudicacion").isNotNull(), "po": c("p")}
    total = held.agg(count("*").alias("notices"), *[where_n(t).alias(f"with_{k}") for k, t in tests.items()])
    return total.select("*", *[share(c(f"with_{k}"), c("notices")).alias(f"pct_{k}") for k in tests])


def linked_notices(s: SparkSession, d: str) -> DataFrame:
    direct, bridged = entity(s, d, "po", ["linked_notice_id"]).select(c("linked_notice_id").alias("notice_id")), entity(s, d, "link", ["notice_id"])
    return direct.unionByName(bridged).where("notice_id IS NOT NULL").distinct()


@stated("""SELECT round(avg(coalesce(l.n, 0)), 4) AS avg_lines_per_notice, round(avg(coalesce(n.numero_oferentes, 0)), 4) AS avg_bids_per_notice, round(avg(coalesce(p.n, 0)), 4) AS avg_suppliers_per_notice FROM notice n
    LEFT JOIN (SELECT notice_id, count(*) AS n FROM line GROUP BY 1) l ON l.notice_id = n.codigo_externo LEFT JOIN (SELECT linked_notice_id AS k, count(DISTINCT supplier_key) AS n FROM po GROUP BY 1) p ON p.k = n.codigo_externo""")
def c2_per_notice(s: SparkSession, d: str) -> DataFrame:
    """Mean number of lines, bidders and ordering suppliers of a notice; notices without any count as 0."""
    lines = entity(s, d, "line", ["notice_id"]).groupBy("notice_id").agg(count("*").alias("lines"))
    suppliers = entity(s, d, "po", ["linked_notice_id", "supplier_key"]).groupBy(c("linked_notice_id").alias("notice_id")).agg(uniq("supplier_key").alias("suppliers"))
    n = entity(s, d, "notice", ["codigo_externo", "numero_oferentes"]).withColumnRenamed("codigo_externo", "notice_id").join(lines, "notice_id", "left").join(suppliers, "notice_id", "left")
    return n.agg(*[F.round(F.avg(F.coalesce(x, F.lit(0))), 4).alias(f"avg_{k}_per_notice") for k, x in (("lines", "lines"), ("bids", "numero_oferentes"), ("suppliers", "suppliers"))])


@stated(f"""SELECT CAST(date_trunc('month', fecha_publicacion) AS DATE) AS month, count(*) AS notices, count(fecha_adjudicacion) AS awarded_notices, {_P('count(fecha_adjudicacion)', 'count(*)')} AS pct_notice_to_award, count(*) FILTER (WHERE o) AS notices_with_po, {_P('count(*) FILTER (WHERE o)', 'count(*)')} AS pct_notice_to_po
    FROM (SELECT *, EXISTS (SELECT 1 FROM po WHERE po.linked_notice_id = notice.codigo_externo) OR EXISTS (SELECT 1 FROM link WHERE link.notice_id = notice.codigo_externo) AS o FROM notice WHERE fecha_publicacion IS NOT NULL) q GROUP BY 1""")
def c3_monthly_conversion(s: SparkSession, d: str) -> DataFrame:
    """Notices a month of publication, those awarded and those with orders."""
    n = entity(s, d, "notice", ["codigo_externo", "fecha_publicacion", "fecha_adjudicacion"]).where("fecha_publicacion IS NOT NULL").withColumnRenamed("codigo_externo", "notice_id")
    held = n.join(linked_notices(s, d).withColumn("p", F.lit(1)), "notice_id", "left").groupBy(month("fecha_publicacion").alias("month")).agg(count("*").alias("notices"), count("fecha_adjudicacion").alias("awarded_notices"), count("p").alias("notices_with_po"))
    return held.select("*", share(c("awarded_notices"), c("notices")).alias("pct_notice_to_award"), share(c("notices_with_po"), c("notices")).alias("pct_notice_to_po"))


# --- buyers


@stated(f"""SELECT k AS buyer_unit_code, coalesce(b.unidad_compra, 'SIN_NOMBRE_UNIDAD') AS buyer_unit_name, po_total, po_direct_award, {_P('po_direct_award', 'po_total')} AS pct_direct_award FROM (
      SELECT {_B('')} AS k, count(*) AS po_total, count(*) FILTER (WHERE is_direct_award_flag) AS po_direct_award FROM po GROUP BY 1) q LEFT JOIN buyer b ON b.buyer_key = q.k WHERE po_total >= 20""")
def d4_direct_award_share(s: SparkSession, d: str) -> DataFrame:
    """Direct awards of buying units with 20 orders and more; names are joined after the sums."""
    units = entity(s, d, "po", ["purchase_order_id", "is_direct_award_flag"]).groupBy(buyer_code().alias("buyer_unit_code")).agg(count("*").alias("po_total"), where_n(c("is_direct_award_flag")).alias("po_direct_award")).where("po_total >= 20")
    names = entity(s, d, "buyer", ["buyer_key", "unidad_compra"]).withColumnRenamed("buyer_key", "buyer_unit_code")
    return units.join(names, "buyer_unit_code", "left").select("buyer_unit_code", F.coalesce("unidad_compra", F.lit("SIN_NOMBRE_UNIDAD")).alias("buyer_unit_name"), "po_total", "po_direct_award", share(c("po_direct_award"), c("po_total")).alias("pct_direct_award"))


def concentration(rows: DataFrame, by: list[str], member: str) -> DataFrame:
    """Members and sum of squared shares of the counts of ``member``, of each group: two aggregates, no window."""
    n = rows.groupBy(*by, member).agg(count("*").alias("n"))
    return n.groupBy(*by).agg(count("*").alias("supplier_count"), F.sum("n").alias("total"), F.sum(c("n") * c("n")).alias("squares")).select(*by, "supplier_count", "total", F.round(c("squares") / (c("total") * c("total")), 4).alias("hhi"))


@stated(f"""SELECT buyer_unit_code, count(*) AS supplier_count, round(sum(CAST(n AS DOUBLE) * n) / (sum(n) * sum(n)), 4) AS hhi FROM (SELECT {_B('')} AS buyer_unit_code, {_S('')} AS supplier_key, count(*) AS n FROM po GROUP BY 1, 2) q
    GROUP BY 1 ORDER BY hhi DESC, supplier_count, buyer_unit_code LIMIT 100""")
def d5_buyer_concentration(s: SparkSession, d: str) -> DataFrame:
    """The hundred units that order from the fewest suppliers, by their orders."""
    rows = entity(s, d, "po", ["purchase_order_id", "supplier_key"]).select(buyer_code().alias("buyer_unit_code"), supplier_code().alias("supplier_key"))
    return concentration(rows, ["buyer_unit_code"], "supplier_key").drop("total").orderBy(c("hhi").desc(), "supplier_count", "buyer_unit_code").limit(100)


def conversion(s: SparkSession, d: str, least: int) -> DataFrame:
    """Notices of each unit, and those that an order names, where the unit has ``least`` notices."""
    ordered = entity(s, d, "po", ["linked_notice_id"]).select(c("linked_notice_id").alias("codigo_externo")).distinct().withColumn("p", F.lit(1))
    n = entity(s, d, "notice", ["codigo_externo", "codigo_unidad"]).join(ordered, "codigo_externo", "left")
    return n.groupBy(c("codigo_unidad").alias("buyer_unit_code")).agg(count("*").alias("notices"), count("p").alias("notices_with_po")).where(c("notices") >= least).withColumn("conversion_pct", share(c("notices_with_po"), c("notices")))


_CONVERSION = f"""SELECT n.u AS buyer_unit_code, n.n AS notices, coalesce(p.n, 0) AS notices_with_po, {_P('coalesce(p.n, 0)', 'n.n')} AS conversion_pct FROM (SELECT codigo_unidad AS u, count(DISTINCT codigo_externo) AS n FROM notice GROUP BY 1) n
    LEFT JOIN (SELECT x.codigo_unidad AS u, count(DISTINCT x.codigo_externo) AS n FROM notice x JOIN po o ON o.linked_notice_id = x.codigo_externo GROUP BY 1) p ON p.u IS NOT DISTINCT FROM n.u WHERE n.n >= """


@stated(_CONVERSION + "20")
def d6_buyer_conversion(s: SparkSession, d: str) -> DataFrame:
    return conversion(s, d, 20)


@stated(_CONVERSION + "5")
def d6_buyer_conversion_of_five(s: SparkSession, d: str) -> DataFrame:
    """As d6, from five notices on."""
    return conversion(s, d, 5)


# --- suppliers


def participation(s: SparkSession, d: str, named: dict[str, Column]) -> DataFrame:
    """Distinct notices of each supplier, all and by flags of its offers: one row a supplier and notice first."""
    flags = [F.max(F.coalesce(x, F.lit(False))).alias(k) for k, x in named.items()]
    one = entity(s, d, "offer", ["notice_id", "supplier_key", "selected", "materialized"]).groupBy("supplier_key", "notice_id").agg(*flags)
    return one.groupBy("supplier_key").agg(count("*").alias("notices_participated"), *[F.count_if(k).alias(k) for k in named])


@stated(f"""SELECT supplier_key, count(DISTINCT notice_id) AS notices_participated, count(DISTINCT CASE WHEN selected THEN notice_id END) AS notices_selected, {_P('count(DISTINCT CASE WHEN selected THEN notice_id END)', 'count(DISTINCT notice_id)')} AS offer_to_award_pct
    FROM offer GROUP BY 1 HAVING count(DISTINCT notice_id) >= 10 ORDER BY offer_to_award_pct DESC, notices_participated DESC, supplier_key LIMIT 100""")
def e5_offer_to_award(s: SparkSession, d: str) -> DataFrame:
    """The hundred suppliers whose offers win most often, from ten notices on."""
    p = participation(s, d, {"notices_selected": c("selected")}).where("notices_participated >= 10").withColumn("offer_to_award_pct", share(c("notices_selected"), c("notices_participated")))
    return p.orderBy(c("offer_to_award_pct").desc(), c("notices_participated").desc(), "supplier_key").limit(100)


@stated(f"""SELECT supplier_key, count(DISTINCT notice_id) FILTER (WHERE selected) AS awarded_notices, count(DISTINCT notice_id) FILTER (WHERE materialized) AS awarded_materialized,
      {_P('count(DISTINCT notice_id) FILTER (WHERE materialized)', 'count(DISTINCT notice_id) FILTER (WHERE selected)')} AS award_to_po_pct FROM offer GROUP BY 1 HAVING count(DISTINCT notice_id) FILTER (WHERE selected) >= 5
    ORDER BY award_to_po_pct DESC, awarded_notices DESC, supplier_key LIMIT 100""")
def e6_award_to_order(s: SparkSession, d: str) -> DataFrame:
    """The hundred suppliers whose awards become orders most often, from five awards on."""
    p = participation(s, d, {"awarded_notices": c("selected"), "awarded_materialized": c("materialized")}).where("awarded_notices >= 5").drop("notices_participated")
    return p.withColumn("award_to_po_pct", share(c("awarded_materialized"), c("awarded_notices"))).orderBy(c("award_to_po_pct").desc(), c("awarded_notices").desc(), "supplier_key").limit(100)


# --- categories


@stated(f"""SELECT {_BC('')} AS category, count(*) AS po_line_count, count(DISTINCT purchase_order_id) AS po_count FROM poline GROUP BY 1 ORDER BY po_line_count DESC, category LIMIT 50""")
def f3_categories_by_lines(s: SparkSession, d: str) -> DataFrame:
    """The fifty categories with most order lines."""
    l = entity(s, d, "poline", ["purchase_order_id", *_BOUGHT]).groupBy(bought_category().alias("category"))
    return l.agg(count("*").alias("po_line_count"), uniq("purchase_order_id").alias("po_count")).orderBy(c("po_line_count").desc(), "category").limit(50)


def competition(s: SparkSession, d: str) -> DataFrame:
    """Suppliers of each category and notice that offered for a line of it, known by item code or line number.

    The alternative is two equal joins instead of one join by "or"; each is of distinct offers, and the distinct
    count takes no supplier twice.
    """
    lines = entity(s, d, "offerline").join(entity(s, d, "product"), "notice_id", "left").select("notice_id", "item_code", "line_no", F.coalesce("level_3", "level_2", F.lit("SIN_CATEGORIA")).alias("category"))
    offers = entity(s, d, "offer", ["notice_id", "item_code", "line_no", "supplier_key"])
    parts = [lines.select("category", "notice_id", k).distinct().join(offers.select("notice_id", k, "supplier_key").distinct(), ["notice_id", k], "left").select("category", "notice_id", "supplier_key") for k in ("item_code", "line_no")]
    return union(parts).groupBy("category", "notice_id").agg(uniq("supplier_key").alias("suppliers"))


_COMPETITION = """(SELECT coalesce(p.level_3, p.level_2, 'SIN_CATEGORIA') AS category, l.notice_id, count(DISTINCT b.supplier_key) AS n FROM offerline l LEFT JOIN product p ON p.notice_id = l.notice_id
    LEFT JOIN offer b ON b.notice_id = l.notice_id AND (b.item_code = l.item_code OR b.line_no = l.line_no) GROUP BY 1, 2)"""


@stated(f"SELECT category, round(avg(n), 4) AS avg_suppliers_per_notice, median(n) AS median_suppliers_per_notice FROM {_COMPETITION} q GROUP BY 1 ORDER BY avg_suppliers_per_notice DESC, category LIMIT 50")
def f4_most_competitive(s: SparkSession, d: str) -> DataFrame:
    """The fifty categories with most suppliers a notice."""
    g = competition(s, d).groupBy("category").agg(F.round(F.avg("suppliers"), 4).alias("avg_suppliers_per_notice"), F.median("suppliers").alias("median_suppliers_per_notice"))
    return g.orderBy(c("avg_suppliers_per_notice").desc(), "category").limit(50)


def bought(s: SparkSession, d: str, *order: str, line: tuple[str, ...] = ()) -> DataFrame:
    """Order lines with their category and the columns ``order`` of their orders."""
    l = entity(s, d, "poline", ["purchase_order_id", *_BOUGHT, *line]).withColumn("category", bought_category()).drop(*_BOUGHT)
    return l.join(entity(s, d, "po", ["purchase_order_id", *order]), "purchase_order_id")


@stated(f"""SELECT {_BC('l.')} AS category, count(*) AS total_lines, sum(CASE WHEN p.is_direct_award_flag THEN 1 ELSE 0 END) AS direct_award_lines, {_P('sum(CASE WHEN p.is_direct_award_flag THEN 1 ELSE 0 END)', 'count(*)')} AS pct_direct_award
    FROM poline l JOIN po p ON p.purchase_order_id = l.purchase_order_id GROUP BY 1 HAVING count(*) >= 30""")
def f6_direct_award_per_category(s: SparkSession, d: str) -> DataFrame:
    """Order lines of direct awards in categories of thirty lines and more."""
    g = bought(s, d, "is_direct_award_flag").groupBy("category").agg(count("*").alias("total_lines"), where_n(c("is_direct_award_flag")).alias("direct_award_lines")).where("total_lines >= 30")
    return g.withColumn("pct_direct_award", share(c("direct_award_lines"), c("total_lines")))


def frequent(s: SparkSession, d: str, by: str, value: Column) -> DataFrame:
    g = bought(s, d, "supplier_key", line=("line_net_total",)).groupBy(value.alias(by), "category").agg(count("*").alias("line_count"), money("line_net_total").alias("net_amount"))
    return g.orderBy(c("line_count").desc(), by, "category").limit(200)


_FREQUENT = f"SELECT {{0}} AS {{1}}, {_BC('l.')} AS category, count(*) AS line_count, CAST(sum(l.line_net_total) AS DOUBLE) AS net_amount FROM po o JOIN poline l ON l.purchase_order_id = o.purchase_order_id GROUP BY 1, 2 ORDER BY line_count DESC, 1, 2 LIMIT 200"


@stated(_FREQUENT.format(_B("o."), "buyer_unit_code"))
def f7_categories_per_buyer(s: SparkSession, d: str) -> DataFrame:
    """The two hundred most frequent pairs of a unit and a category."""
    return frequent(s, d, "buyer_unit_code", buyer_code())


@stated(_FREQUENT.format(_S("o."), "supplier_key"))
def f8_categories_per_supplier(s: SparkSession, d: str) -> DataFrame:
    """The two hundred most frequent pairs of a supplier and a category."""
    return frequent(s, d, "supplier_key", supplier_code())


# --- competition


@stated(f"SELECT {_BC('l.')} AS category, count(DISTINCT p.supplier_key) AS unique_suppliers FROM po p JOIN poline l USING (purchase_order_id) GROUP BY 1")
def g2_unique_suppliers(s: SparkSession, d: str) -> DataFrame:
    """Suppliers of each category."""
    return bought(s, d, "supplier_key").groupBy("category").agg(uniq("supplier_key").alias("unique_suppliers"))


def category_concentration(s: SparkSession, d: str, least: int) -> DataFrame:
    rows = bought(s, d, "supplier_key").select(buyer_code().alias("buyer_unit_code"), "category", supplier_code().alias("supplier_key"))
    return concentration(rows, ["buyer_unit_code", "category"], "supplier_key").where(c("total") >= least).drop("total").orderBy(c("hhi").desc(), "buyer_unit_code", "category").limit(200)


_CATEGORY_HHI = f"""WITH n AS (SELECT {_B('o.')} AS buyer_unit_code, {_BC('l.')} AS category, {_S('o.')} AS k, count(*) AS n FROM po o JOIN poline l ON l.purchase_order_id = o.purchase_order_id GROUP BY 1, 2, 3),
    s AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY buyer_unit_code, category) AS share FROM n)
    SELECT buyer_unit_code, category, count(*) AS supplier_count, round(sum(share * share), 4) AS hhi FROM s GROUP BY 1, 2 HAVING sum(n) >= {{}} ORDER BY hhi DESC, 1, 2 LIMIT 200"""


@stated(_CATEGORY_HHI.format(20))
def g3_buyer_category_concentration(s: SparkSession, d: str) -> DataFrame:
    """Two hundred pairs of a unit and a category with the fewest suppliers, from twenty lines on."""
    return category_concentration(s, d, 20)


@stated(_CATEGORY_HHI.format(3))
def g3_buyer_category_concentration_of_three(s: SparkSession, d: str) -> DataFrame:
    """As g3, from three lines on."""
    return category_concentration(s, d, 3)


@stated("""SELECT notice_id, coalesce(item_code, 'SIN_ITEM') AS item_code, count(price) AS offer_count, min(price) AS min_price, max(price) AS max_price, round(avg(CAST(price AS DOUBLE)), 4) AS avg_price,
      round(stddev_pop(CAST(price AS DOUBLE)), 4) AS std_price, round(CASE WHEN avg(price) > 0 THEN stddev_pop(CAST(price AS DOUBLE)) / avg(CAST(price AS DOUBLE)) END, 4) AS cv_price
    FROM offer WHERE price IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY cv_price DESC NULLS LAST, 1, 2 LIMIT 200""")
def g4_price_dispersion(s: SparkSession, d: str) -> DataFrame:
    """Two hundred notice lines whose offered unit prices differ most, from three offers on."""
    o = entity(s, d, "offer", ["notice_id", "item_code", "price"]).where("price IS NOT NULL").withColumn("price", c("price").cast("double")).groupBy("notice_id", F.coalesce("item_code", F.lit("SIN_ITEM")).alias("item_code"))
    g = o.agg(count("*").alias("offer_count"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.avg("price").alias("avg_price"), F.stddev_pop("price").alias("std_price")).where("offer_count >= 3")
    g = g.withColumn("cv_price", F.when(c("avg_price") > 0, c("std_price") / c("avg_price")))
    return g.select("notice_id", "item_code", "offer_count", "min_price", "max_price", *[F.round(k, 4).alias(k) for k in ("avg_price", "std_price", "cv_price")]).orderBy(c("cv_price").desc_nulls_last(), "notice_id", "item_code").limit(200)


@stated(f"SELECT category, a AS avg_suppliers_per_notice, CASE WHEN a >= 5 THEN 'alta_competencia' WHEN a >= 2 THEN 'media_competencia' ELSE 'baja_competencia' END AS competition_segment FROM (SELECT category, round(avg(n), 2) AS a FROM {_COMPETITION} x GROUP BY 1) q")
def g5_competition_segments(s: SparkSession, d: str) -> DataFrame:
    """Categories of high, middling and low competition, by suppliers a notice."""
    g = competition(s, d).groupBy("category").agg(F.round(F.avg("suppliers"), 2).alias("avg_suppliers_per_notice"))
    a = c("avg_suppliers_per_notice")
    return g.withColumn("competition_segment", F.when(a >= 5, "alta_competencia").when(a >= 2, "media_competencia").otherwise("baja_competencia"))


# --- times


def acceptance(s: SparkSession, d: str, least: int) -> DataFrame:
    po = entity(s, d, "po", ["purchase_order_id", "order_created_at", "order_accepted_at"]).where("order_created_at IS NOT NULL")
    return po.groupBy(buyer_code().alias("buyer_unit_code")).agg(F.round(F.avg(days("order_accepted_at", "order_created_at")), 4).alias("avg_days_creation_to_acceptance"), count("*").alias("po_count")).where(c("po_count") >= least)


_ACCEPTANCE = f"SELECT {_B('')} AS buyer_unit_code, round(avg({_D('order_accepted_at', 'order_created_at')}), 4) AS avg_days_creation_to_acceptance, count(*) AS po_count FROM po WHERE order_created_at IS NOT NULL GROUP BY 1 HAVING count(*) >= "


@stated(_ACCEPTANCE + "20")
def h4_times_per_buyer(s: SparkSession, d: str) -> DataFrame:
    """Mean days to acceptance of the orders of units with twenty orders and more."""
    return acceptance(s, d, 20)


@stated(_ACCEPTANCE + "3")
def h4_times_per_buyer_of_three(s: SparkSession, d: str) -> DataFrame:
    """As h4, from three orders on."""
    return acceptance(s, d, 3)


@stated(f"""SELECT {_BC('l.')} AS category, round(avg({_D('p.order_accepted_at', 'p.order_created_at')}), 4) AS avg_days_creation_to_acceptance, count(*) AS po_line_count FROM poline l JOIN po p ON p.purchase_order_id = l.purchase_order_id
    WHERE p.order_accepted_at IS NOT NULL AND p.order_created_at IS NOT NULL GROUP BY 1 HAVING count(*) >= 30""")
def h5_times_per_category(s: SparkSession, d: str) -> DataFrame:
    """Mean days to acceptance over the order lines of categories with thirty lines and more."""
    l = bought(s, d, "order_created_at", "order_accepted_at").withColumn("n", days("order_accepted_at", "order_created_at")).where("n IS NOT NULL")
    return l.groupBy("category").agg(F.round(F.avg("n"), 4).alias("avg_days_creation_to_acceptance"), count("*").alias("po_line_count")).where("po_line_count >= 30")


@stated(f"SELECT codigo_externo AS notice_id, nombre AS notice_title, fecha_publicacion AS publication_date, fecha_cierre AS close_date, {_D('fecha_cierre', 'fecha_publicacion')} AS days_publication_to_close FROM notice WHERE {_D('fecha_cierre', 'fecha_publicacion')} <= 2")
def h6_short_deadlines(s: SparkSession, d: str) -> DataFrame:
    """Notices that close within two days of publication, or before it."""
    n = entity(s, d, "notice", ["codigo_externo", "nombre", "fecha_publicacion", "fecha_cierre"]).withColumn("days_publication_to_close", days("fecha_cierre", "fecha_publicacion")).where("days_publication_to_close <= 2")
    return n.withColumnsRenamed({"codigo_externo": "notice_id", "nombre": "notice_title", "fecha_publicacion": "publication_date", "fecha_cierre": "close_date"})


@stated(f"""SELECT purchase_order_id, purchase_order_name, order_created_at, order_accepted_at, {_D('order_accepted_at', 'order_created_at')} AS days_creation_to_acceptance, CAST(total_amount AS DOUBLE) AS total_amount, supplier_key
    FROM po WHERE {_D('order_accepted_at', 'order_created_at')} >= {{}}""".format(30))
def h7_late_acceptances(s: SparkSession, d: str) -> DataFrame:
    """Orders accepted thirty days after their creation or later."""
    return late(s, d, 30)


@stated(f"""SELECT purchase_order_id, purchase_order_name, order_created_at, order_accepted_at, {_D('order_accepted_at', 'order_created_at')} AS days_creation_to_acceptance, CAST(total_amount AS DOUBLE) AS total_amount, supplier_key
    FROM po WHERE {_D('order_accepted_at', 'order_created_at')} >= {{}}""".format(5))
def h7_acceptances_after_five_days(s: SparkSession, d: str) -> DataFrame:
    """As h7, from five days on."""
    return late(s, d, 5)


def late(s: SparkSession, d: str, least: int) -> DataFrame:
    po = entity(s, d, "po", ["purchase_order_id", "purchase_order_name", "order_created_at", "order_accepted_at", "total_amount", "supplier_key"])
    return po.withColumn("days_creation_to_acceptance", days("order_accepted_at", "order_created_at")).where(c("days_creation_to_acceptance") >= least).withColumn("total_amount", c("total_amount").cast("double"))


@stated("SELECT " + ", ".join(f"quantile_cont({_D('order_accepted_at', 'order_created_at')}, {q / 100}) AS p{q}" for q in (10, 25, 50, 75, 90)) + " FROM po")
def h8_percentiles(s: SparkSession, d: str) -> DataFrame:
    """Percentiles of the days from creation to acceptance of orders."""
    n = entity(s, d, "po", ["order_created_at", "order_accepted_at"]).select(days("order_accepted_at", "order_created_at").alias("n"))
    p = n.agg(F.percentile("n", F.array(*[F.lit(q / 100) for q in (10, 25, 50, 75, 90)])).alias("p"))
    return p.select(*[F.get("p", F.lit(i)).alias(f"p{q}") for i, q in enumerate((10, 25, 50, 75, 90))])


# --- notices and orders


@stated("""SELECT notice_id, count(DISTINCT purchase_order_id) AS po_count, CAST(sum(total_amount) AS DOUBLE) AS po_total_amount, round(avg(CAST(total_amount AS DOUBLE)), 4) AS po_avg_amount FROM (
      SELECT p.linked_notice_id AS notice_id, p.purchase_order_id, p.total_amount FROM po p WHERE p.linked_notice_id IS NOT NULL UNION ALL SELECT l.notice_id, p.purchase_order_id, p.total_amount FROM link l, po p WHERE p.purchase_order_id = l.purchase_order_id) q GROUP BY 1""")
def i3_orders_per_linked_notice(s: SparkSession, d: str) -> DataFrame:
    """Orders of each notice, their sum and mean; an order known both ways counts twice in the amounts."""
    return linked(s, d, "total_amount").groupBy("notice_id").agg(uniq("purchase_order_id").alias("po_count"), money("total_amount").alias("po_total_amount"), F.round(F.avg(c("total_amount").cast("double")), 4).alias("po_avg_amount"))


@stated(_CONVERSION + "20 ORDER BY conversion_pct DESC, notices DESC, buyer_unit_code")
def i4_buyer_conversion(s: SparkSession, d: str) -> DataFrame:
    """Units of twenty notices and more by the part of their notices that became orders."""
    return conversion(s, d, 20).orderBy(c("conversion_pct").desc(), c("notices").desc(), "buyer_unit_code")


@stated(f"""SELECT supplier_key, count(DISTINCT notice_id) AS notices_participated, count(DISTINCT CASE WHEN materialized THEN notice_id END) AS notices_materialized, {_P('count(DISTINCT CASE WHEN materialized THEN notice_id END)', 'count(DISTINCT notice_id)')} AS conversion_pct
    FROM offer GROUP BY 1 HAVING count(DISTINCT notice_id) >= 10""")
def i5_supplier_conversion(s: SparkSession, d: str) -> DataFrame:
    """Suppliers of ten notices and more by the part of them that became orders."""
    return participation(s, d, {"notices_materialized": c("materialized")}).where("notices_participated >= 10").withColumn("conversion_pct", share(c("notices_materialized"), c("notices_participated")))


@stated(f"""SELECT a.category, count(*) AS notices, count(b.notice_id) AS notices_with_po, {_P('count(b.notice_id)', 'count(*)')} AS conversion_pct FROM (SELECT DISTINCT notice_id, {_AC('')} AS category FROM line) a
    LEFT JOIN (SELECT DISTINCT linked_notice_id AS notice_id, {_BC('')} AS category FROM poline WHERE linked_notice_id IS NOT NULL) b ON b.notice_id = a.notice_id AND b.category = a.category WHERE a.notice_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 20""")
def i6_category_conversion(s: SparkSession, d: str) -> DataFrame:
    """Notices of each category, and those with an order line of it, from twenty notices on."""
    asked = entity(s, d, "line", ["notice_id", *_ASKED]).where("notice_id IS NOT NULL").select("notice_id", asked_category().alias("category")).distinct()
    got = entity(s, d, "poline", ["linked_notice_id", *_BOUGHT]).where("linked_notice_id IS NOT NULL").select(c("linked_notice_id").alias("notice_id"), bought_category().alias("category")).distinct().withColumn("p", F.lit(1))
    return asked.join(got, ["notice_id", "category"], "left").groupBy("category").agg(count("*").alias("notices"), count("p").alias("notices_with_po")).where("notices >= 20").withColumn("conversion_pct", share(c("notices_with_po"), c("notices")))


@stated("""SELECT purchase_order_id, purchase_order_name, order_created_at, CAST(total_amount AS DOUBLE) AS total_amount, purchase_order_status_name, supplier_key FROM po
    WHERE linked_notice_id IS NULL OR linked_notice_id NOT IN (SELECT codigo_externo FROM notice WHERE codigo_externo IS NOT NULL)""")
def i8_orders_without_notice(s: SparkSession, d: str) -> DataFrame:
    """Orders that name no notice, or one that is not known."""
    known = entity(s, d, "notice", ["codigo_externo"]).select(c("codigo_externo").alias("linked_notice_id"))
    po = entity(s, d, "po", ["purchase_order_id", "purchase_order_name", "order_created_at", "total_amount", "purchase_order_status_name", "supplier_key", "linked_notice_id"])
    return po.join(known, "linked_notice_id", "left_anti").drop("linked_notice_id").withColumn("total_amount", c("total_amount").cast("double"))


# --- text

TEXTS = [("notice", "nombre"), ("notice", "descripcion"), ("line", "line_name"), ("line", "line_description_raw"), ("poline", "buyer_item_spec_raw"), ("poline", "supplier_item_spec_raw")]


def text_profile(s: SparkSession, d: str) -> DataFrame:
    """Counts and lengths of the text columns: one pass a table."""
    parts = []
    for table in dict.fromkeys(t for t, _ in TEXTS):
        columns = [x for t, x in TEXTS if t == table]
        cells = F.explode(F.array(*[F.struct(F.lit(f"{table}.{x}").alias("col"), c(x).alias("txt")) for x in columns]))
        parts.append(entity(s, d, table, columns).select(cells.alias("e")).select("e.*"))
    filled = F.trim("txt") != ""
    g = union(parts).withColumn("filled", F.when(filled, c("txt"))).groupBy("col").agg(
        count("*").alias("rows_total"), where_n(c("filled").isNull()).alias("rows_null_or_empty"), F.avg(F.length("filled")).alias("avg_len"), F.percentile(F.length("filled"), F.lit(0.5)).alias("p50_len"), uniq("filled").alias("unique_texts"),
    )
    return g.withColumn("null_pct", share(c("rows_null_or_empty"), c("rows_total")))


_TEXTS = " UNION ALL ".join(f"SELECT '{t}.{x}' AS col, {x} AS txt FROM {t}" for t, x in TEXTS)
_PROFILED = f"""(SELECT col, count(*) AS rows_total, count(*) FILTER (WHERE txt IS NULL OR trim(txt, ' ') = '') AS rows_null_or_empty, avg(length(txt)) FILTER (WHERE trim(txt, ' ') <> '') AS avg_len,
    quantile_cont(length(txt), 0.5) FILTER (WHERE trim(txt, ' ') <> '') AS p50_len, count(DISTINCT txt) FILTER (WHERE trim(txt, ' ') <> '') AS unique_texts FROM ({_TEXTS}) t GROUP BY col)"""


@stated(f"SELECT col, rows_total, rows_null_or_empty, {_P('rows_null_or_empty', 'rows_total')} AS null_pct, round(avg_len, 4) AS avg_len, p50_len FROM {_PROFILED} q")
def j1_text_lengths(s: SparkSession, d: str) -> DataFrame:
    """Rows without text and lengths of the others, of each text column."""
    return text_profile(s, d).select("col", "rows_total", "rows_null_or_empty", "null_pct", F.round("avg_len", 4).alias("avg_len"), "p50_len")


@stated(f"""SELECT col, round(avg_len, 4) AS avg_len, {_P('rows_null_or_empty', 'rows_total')} AS null_pct, unique_texts, round(u, 4) AS uniqueness_ratio,
      round(greatest(0.0, 100.0 - 100.0 * CAST(rows_null_or_empty AS DOUBLE) / rows_total) + CAST(0.2 AS DOUBLE) * least(coalesce(avg_len, 0), 200.0) + CAST(0.4 AS DOUBLE) * least(100.0 * u, 100.0), 2) AS nlp_readiness_score
    FROM (SELECT *, CASE WHEN rows_total > rows_null_or_empty THEN CAST(unique_texts AS DOUBLE) / (rows_total - rows_null_or_empty) ELSE 0 END AS u FROM {_PROFILED} p) q""")
def j8_readiness(s: SparkSession, d: str) -> DataFrame:
    """Readiness of each text column: filled, long (to 200 characters) and unlike, weighed 100, 40 and 40."""
    filled = c("rows_total") - c("rows_null_or_empty")
    p = text_profile(s, d).withColumn("u", F.coalesce(F.try_divide(c("unique_texts").cast("double"), filled), F.lit(0.0)))
    score = F.greatest(F.lit(0.0), 100 - 100.0 * c("rows_null_or_empty") / c("rows_total")) + 0.2 * F.least(F.coalesce("avg_len", F.lit(0.0)), F.lit(200.0)) + 0.4 * F.least(100 * c("u"), F.lit(100.0))
    return p.select("col", F.round("avg_len", 4).alias("avg_len"), "null_pct", "unique_texts", F.round("u", 4).alias("uniqueness_ratio"), F.round(score, 2).alias("nlp_readiness_score"))


def tokens(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Runs of letters a-z and digits, in lower case, of three characters and more; one row each."""
    return df.select(*keep, F.explode(F.regexp_extract_all(text, F.lit("([a-zA-Z0-9]{3,})"), 1)).alias("t")).select(*keep, F.lower("t").alias("token"))


_TOKENS = "SELECT {0}, lower(unnest(regexp_extract_all({1}, '[a-zA-Z0-9]{{3,}}'))) AS token FROM {2}".format
SOURCES = [("notice_desc", "notice", "descripcion"), ("line_desc", "line", "line_description_clean"), ("buyer_spec", "poline", "buyer_item_spec_clean"), ("supplier_spec", "poline", "supplier_item_spec_raw")]
_SOURCES = " UNION ALL ".join(_TOKENS(f"'{k}' AS source", x, t) for k, t, x in SOURCES)


def source_tokens(s: SparkSession, d: str) -> DataFrame:
    return union([tokens(entity(s, d, t, [x]).withColumn("source", F.lit(k)), x, "source") for k, t, x in SOURCES])


@stated(f"SELECT source, token, count(*) AS freq FROM ({_SOURCES}) q GROUP BY 1, 2 ORDER BY source, freq DESC, token LIMIT 200")
def j3_top_tokens(s: SparkSession, d: str) -> DataFrame:
    """Two hundred rows of tokens by source and frequency."""
    return source_tokens(s, d).groupBy("source", "token").agg(count("*").alias("freq")).orderBy("source", c("freq").desc(), "token").limit(200)


@stated(f"SELECT source, token, freq FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY freq DESC, token) AS r FROM (SELECT source, token, count(*) AS freq FROM ({_SOURCES}) q GROUP BY 1, 2) g) x WHERE r <= 50")
def j3_top_tokens_of_each_source(s: SparkSession, d: str) -> DataFrame:
    """The fifty commonest tokens of every source."""
    g = source_tokens(s, d).groupBy("source", "token").agg(count("*").alias("freq"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(c("freq").desc(), "token"))).where("r <= 50").drop("r")


@stated(f"SELECT category, token, count(*) AS freq FROM ({_TOKENS(_AC('') + ' AS category', 'line_description_clean', 'line')}) q GROUP BY 1, 2 ORDER BY category, freq DESC, token LIMIT 300")
def j4_top_tokens_by_category(s: SparkSession, d: str) -> DataFrame:
    """Three hundred rows of tokens of notice lines by category and frequency."""
    l = entity(s, d, "line", ["line_description_clean", *_ASKED]).withColumn("category", asked_category())
    return tokens(l, "line_description_clean", "category").groupBy("category", "token").agg(count("*").alias("freq")).orderBy("category", c("freq").desc(), "token").limit(300)


@stated(f"SELECT buyer_unit_code, token, count(*) AS freq FROM ({_TOKENS(_B('o.') + ' AS buyer_unit_code', 'l.buyer_item_spec_raw', 'po o JOIN poline l ON l.purchase_order_id = o.purchase_order_id')}) q GROUP BY 1, 2 HAVING count(*) >= 5 ORDER BY freq DESC, 1, 2 LIMIT 300")
def j5_top_tokens_by_buyer(s: SparkSession, d: str) -> DataFrame:
    """The three hundred commonest tokens of a unit's order lines, from five times on."""
    l = entity(s, d, "poline", ["purchase_order_id", "buyer_item_spec_raw"]).join(entity(s, d, "po", ["purchase_order_id"]), "purchase_order_id").withColumn("buyer_unit_code", buyer_code())
    g = tokens(l, "buyer_item_spec_raw", "buyer_unit_code").groupBy("buyer_unit_code", "token").agg(count("*").alias("freq")).where("freq >= 5")
    return g.orderBy(c("freq").desc(), "buyer_unit_code", "token").limit(300)


def vocabulary(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: F.length(t) >= 3))


_VOCABULARY = "list_distinct([x for x in regexp_split_to_array(lower({}), '\\s+') if length(x) >= 3])".format


@stated(f"""SELECT p.purchase_order_id, p.linked_notice_id AS notice_id, len(n.v) AS notice_vocab, len(coalesce(l.v, [])) AS po_vocab, len(list_intersect(n.v, coalesce(l.v, []))) AS overlap_terms FROM po p
    JOIN (SELECT codigo_externo, {_VOCABULARY("coalesce(descripcion, '')")} AS v FROM notice) n ON n.codigo_externo = p.linked_notice_id LEFT JOIN (SELECT purchase_order_id, {_VOCABULARY("string_agg(coalesce(buyer_item_spec_clean, ''), ' ')")} AS v FROM poline GROUP BY 1) l
    ON l.purchase_order_id = p.purchase_order_id ORDER BY overlap_terms DESC, notice_vocab DESC, p.purchase_order_id LIMIT 200""")
def j6_lexical_overlap(s: SparkSession, d: str) -> DataFrame:
    """Words shared by an order's lines and its notice: the two hundred orders that share most."""
    n = entity(s, d, "notice", ["codigo_externo", "descripcion"]).select(c("codigo_externo").alias("notice_id"), vocabulary(F.coalesce("descripcion", F.lit(""))).alias("nset"))
    words = entity(s, d, "poline", ["purchase_order_id", "buyer_item_spec_clean"]).select("purchase_order_id", F.explode(vocabulary(c("buyer_item_spec_clean"))).alias("w")).groupBy("purchase_order_id").agg(F.collect_set("w").alias("pset"))
    po = entity(s, d, "po", ["purchase_order_id", "linked_notice_id"]).withColumnRenamed("linked_notice_id", "notice_id").join(n, "notice_id").join(words, "purchase_order_id", "left").withColumn("pset", F.coalesce("pset", F.array().cast("array<string>")))
    po = po.select("purchase_order_id", "notice_id", F.size("nset").alias("notice_vocab"), F.size("pset").alias("po_vocab"), F.size(F.array_intersect("nset", "pset")).alias("overlap_terms"))
    return po.orderBy(c("overlap_terms").desc(), c("notice_vocab").desc(), "purchase_order_id").limit(200)


@stated(f"SELECT source AS col, count(*) AS token_total, count(DISTINCT token) AS token_unique, round(CAST(count(DISTINCT token) AS DOUBLE) / count(*), 4) AS semantic_density_ratio FROM ({_SOURCES}) q GROUP BY 1")
def j7_text_density(s: SparkSession, d: str) -> DataFrame:
    """Distinct tokens of all tokens of each text column."""
    g = source_tokens(s, d).groupBy(c("source").alias("col")).agg(count("*").alias("token_total"), uniq("token").alias("token_unique"))
    return g.withColumn("semantic_density_ratio", F.round(c("token_unique") / c("token_total"), 4))


# --- quality


@stated("""SELECT 'notice line (notice_id, item_code)' AS entity, count(*) AS duplicate_groups FROM (SELECT 1 FROM line GROUP BY notice_id, item_code HAVING count(*) > 1) q
    UNION ALL SELECT 'order line (purchase_order_id, line_item_id)', count(*) FROM (SELECT 1 FROM poline GROUP BY purchase_order_id, line_item_id HAVING count(*) > 1) q
    UNION ALL SELECT 'delivered notice line (notice_id, item_code)', count(*) FROM (SELECT 1 FROM silver_notice_line GROUP BY notice_id, item_code HAVING count(*) > 1) q""")
def k2_repeated_keys(s: SparkSession, d: str) -> DataFrame:
    """Business keys that more than one row bears, among current and among delivered rows."""
    frames = {
        "notice line (notice_id, item_code)": (entity(s, d, "line", ["notice_id", "item_code"]), ["notice_id", "item_code"]), "order line (purchase_order_id, line_item_id)": (entity(s, d, "poline", ["purchase_order_id", "line_item_id"]), ["purchase_order_id", "line_item_id"]),
        "delivered notice line (notice_id, item_code)": (read(s, d, "silver_notice_line"), ["notice_id", "item_code"]),
    }
    return union([df.groupBy(*k).agg(count("*").alias("n")).where("n > 1").agg(count("*").alias("duplicate_groups")).withColumn("entity", F.lit(e)) for e, (df, k) in frames.items()])


@stated("""SELECT b.buyer_key, count(DISTINCT n.codigo_externo) AS notices, count(DISTINCT o.purchase_order_id) AS po FROM buyer b LEFT JOIN notice n ON n.codigo_unidad = b.codigo_unidad_compra
    LEFT JOIN po o ON split_part(o.purchase_order_id, '-', 1) = b.buyer_key GROUP BY 1 HAVING count(DISTINCT n.codigo_externo) = 0 OR count(DISTINCT o.purchase_order_id) = 0""")
def k4_idle_buyers(s: SparkSession, d: str) -> DataFrame:
    """Units without a notice or without an order; notices and orders are counted before they meet the units."""
    n = entity(s, d, "notice", ["codigo_unidad"]).groupBy(c("codigo_unidad").alias("codigo_unidad_compra")).agg(count("*").alias("notices"))
    o = entity(s, d, "po", ["purchase_order_id"]).groupBy(F.split_part("purchase_order_id", F.lit("-"), F.lit(1)).alias("buyer_key")).agg(uniq("purchase_order_id").alias("po"))
    b = entity(s, d, "buyer", ["buyer_key", "codigo_unidad_compra"]).join(n, "codigo_unidad_compra", "left").join(o, "buyer_key", "left")
    return b.select("buyer_key", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("notices", "po")]).where("notices = 0 OR po = 0")


@stated("""SELECT k.supplier_key, count(DISTINCT o.linked_notice_id) AS offers, count(DISTINCT o.purchase_order_id) AS po FROM supplier_dim k LEFT JOIN po o ON o.supplier_key = k.supplier_key
    GROUP BY 1 HAVING count(DISTINCT o.linked_notice_id) = 0 OR count(DISTINCT o.purchase_order_id) = 0""")
def k5_idle_suppliers(s: SparkSession, d: str) -> DataFrame:
    """Suppliers without an order, or without one that names a notice."""
    o = entity(s, d, "po", ["supplier_key", "purchase_order_id", "linked_notice_id"]).groupBy("supplier_key").agg(uniq("linked_notice_id").alias("offers"), uniq("purchase_order_id").alias("po"))
    k = entity(s, d, "supplier_dim", ["supplier_key"]).join(o, "supplier_key", "left")
    return k.select("supplier_key", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("offers", "po")]).where("offers = 0 OR po = 0")


@stated("""SELECT 'notice_without_lines' AS issue, (SELECT count(*) FROM notice WHERE codigo_externo NOT IN (SELECT notice_id FROM line WHERE notice_id IS NOT NULL)) AS n
    UNION ALL SELECT 'line_without_category', count(*) FROM line WHERE coalesce(category_level_1, category_level_2, category_level_3) IS NULL
    UNION ALL SELECT 'snapshot_notice_without_lines', count(DISTINCT upper(trim(external_notice_code))) FROM mercado_publico_notice_snapshot WHERE upper(trim(external_notice_code)) NOT IN (SELECT notice_id FROM line WHERE notice_id IS NOT NULL)""")
def k6_notices_without_lines(s: SparkSession, d: str) -> DataFrame:
    """Notices without lines, of tenders and of snapshots, and lines without any category."""
    line = entity(s, d, "line", ["notice_id", *_ASKED])
    held = line.select("notice_id").where("notice_id IS NOT NULL").distinct()
    seen = read(s, d, "mercado_publico_notice_snapshot").select(F.upper(F.trim("external_notice_code")).alias("notice_id")).distinct().where("notice_id IS NOT NULL")
    parts = {"notice_without_lines": entity(s, d, "notice", ["codigo_externo"]).where("codigo_externo IS NOT NULL").select(c("codigo_externo").alias("notice_id")).join(held, "notice_id", "left_anti"), "line_without_category": line.where(F.coalesce(*_ASKED).isNull()), "snapshot_notice_without_lines": seen.join(held, "notice_id", "left_anti")}
    return union([df.agg(count("*").alias("n")).withColumn("issue", F.lit(k)) for k, df in parts.items()])


AMOUNTS = [("silver_purchase_order", "total_amount"), ("silver_purchase_order_line", "line_net_total"), ("normalized_licitaciones", "monto_estimado"), ("mercado_publico_notice_snapshot", "estimated_amount")]


@stated(" UNION ALL ".join(f"SELECT '{t}.{x}_negative' AS issue, count(*) AS n FROM {t} WHERE {x} < 0" for t, x in AMOUNTS))
def k8_odd_amounts(s: SparkSession, d: str) -> DataFrame:
    """Negative amounts of delivered rows; the filter reaches the scan."""
    return union([read(s, d, t).where(c(x) < 0).agg(count("*").alias("n")).withColumn("issue", F.lit(f"{t}.{x}_negative")) for t, x in AMOUNTS])


@stated("""SELECT 'notice_publication_after_close' AS issue, count(*) AS n FROM notice WHERE fecha_publicacion > fecha_cierre UNION ALL SELECT 'notice_close_after_award', count(*) FROM notice WHERE fecha_cierre > fecha_adjudicacion
    UNION ALL SELECT 'po_accept_before_create', count(*) FROM po WHERE order_accepted_at < order_created_at""")
def k9_inconsistent_dates(s: SparkSession, d: str) -> DataFrame:
    """Dates in an impossible order."""
    n, po = entity(s, d, "notice", ["fecha_publicacion", "fecha_cierre", "fecha_adjudicacion"]), entity(s, d, "po", ["order_created_at", "order_accepted_at"])
    tests = {"notice_publication_after_close": n.where("fecha_publicacion > fecha_cierre"), "notice_close_after_award": n.where("fecha_cierre > fecha_adjudicacion"), "po_accept_before_create": po.where("order_accepted_at < order_created_at")}
    return union([df.agg(count("*").alias("n")).withColumn("issue", F.lit(k)) for k, df in tests.items()])


def fragmentation(s: SparkSession, d: str, least: int) -> DataFrame:
    """Spellings of one supplier code's names, in lower case and with single blanks."""
    name = F.regexp_replace(F.lower(F.trim(F.coalesce("nombre_proveedor", F.lit("")))), r"\s+", " ")
    one = read(s, d, "normalized_suppliers").where("codigo_proveedor IS NOT NULL").select("codigo_proveedor", name.alias("n")).distinct()
    g = one.groupBy("codigo_proveedor").agg(F.array_join(F.sort_array(F.collect_list("n")), "|").alias("sample_names"), count("*").alias("distinct_name_variants")).where(c("distinct_name_variants") >= least)
    return g.orderBy(c("distinct_name_variants").desc(), "codigo_proveedor").limit(200)


_FRAGMENTATION = """SELECT codigo_proveedor, count(*) AS distinct_name_variants, string_agg(n, '|' ORDER BY n) AS sample_names FROM (SELECT DISTINCT codigo_proveedor, regexp_replace(lower(trim(coalesce(nombre_proveedor, ''), ' ')), '\\s+', ' ', 'g') AS n
    FROM normalized_suppliers WHERE codigo_proveedor IS NOT NULL) q GROUP BY 1 HAVING count(*) >= {} ORDER BY 2 DESC, 1 LIMIT 200"""


@stated(_FRAGMENTATION.format(3))
def k10_name_fragmentation(s: SparkSession, d: str) -> DataFrame:
    """Supplier codes with three spellings and more."""
    return fragmentation(s, d, 3)


@stated(_FRAGMENTATION.format(2))
def k10_name_fragmentation_of_two(s: SparkSession, d: str) -> DataFrame:
    """As k10, from two spellings on."""
    return fragmentation(s, d, 2)
