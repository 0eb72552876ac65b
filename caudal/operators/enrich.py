"""Set-based enrichment: measures of children joined back to their parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def offer_measures(amount: Column, supplier: Column, selected: Column) -> list[Column]:
    """Counts, exact median, range and dispersion of the offers of a group."""
    avg = F.avg(amount)
    return [
        F.count("*").alias("bid_count"), F.count_distinct(supplier).alias("supplier_count"), F.count_if(selected).alias("selected_bid_count"),
        F.min(amount).alias("min_offer"), F.max(amount).alias("max_offer"), avg.alias("avg_offer"), F.percentile(amount, 0.5).alias("median_offer"),
        F.when(avg != 0, (F.max(amount) - F.min(amount)) / avg).alias("price_dispersion"),
    ]


def enrich(parents: DataFrame, children: DataFrame, keys: list[str], measures: list[Column], counts: list[str]) -> DataFrame:
    """``parents`` with the measures of their children; counts of childless parents are 0, the rest null.

    The children are grouped before the join, so the join is one to one and a parent with a third of all
    children shuffles one partial row a map task.
    """
    grouped = children.groupBy(*keys).agg(*measures)
    out = parents.join(grouped, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})


def reconcile_links(orders: DataFrame, notices: DataFrame, links: DataFrame, order_id: str, notice_ref: str, notice_id: str) -> DataFrame:
    """Links missing from ``links`` (notice_id, purchase_order_id): orders that name an existing notice."""
    named = orders.where(F.col(notice_ref).isNotNull()).select(F.col(notice_ref).alias("notice_id"), F.col(order_id).alias("purchase_order_id"))
    known = named.join(notices.select(F.col(notice_id).alias("notice_id")), "notice_id", "left_semi").distinct()
    return known.join(links.select("notice_id", "purchase_order_id"), ["notice_id", "purchase_order_id"], "left_anti")


def concentration(df: DataFrame, keys: list[str], party: str, amount: Column) -> DataFrame:
    """Herfindahl index of each group: sum of squared shares of its parties, with party count and total.

    Parties are summed first; squares are of those sums over the group's total, so no window over raw rows.
    """
    parties = df.groupBy(*keys, party).agg(F.sum(amount).alias("a"))
    total, square = F.sum("a").cast("double"), F.sum(F.pow(F.col("a").cast("double"), F.lit(2)))
    return parties.groupBy(*keys).agg(F.count("*").alias("parties"), total.alias("total"), F.try_divide(square, total * total).alias("hhi"))
