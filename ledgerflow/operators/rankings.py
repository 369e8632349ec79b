"""Top-k rankings over multi-table joins.

Both rankings aggregate the large fact side *before* joining it to the
dimension side (eager aggregation). The result equals aggregating after
the join, because the dimension rows only label the per-key totals, but
the shuffles carry one row per key instead of one per fact row, and the
partial (map-side) aggregate collapses a hot key inside each task before
anything is exchanged. The join to the pre-aggregated side reuses its hash
partitioning, and the final regroup by (key, labels) needs no new
exchange because the data is already clustered by key.

Small dimension tables are broadcast by Spark only when their measured
size is under ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at
run time); otherwise the joins stay sort-merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.money import money_value, round_total
from ledgerflow.operators.topk import asc, desc, top_k


def top_items(
    item: DataFrame,
    bridge: DataFrame,
    category: DataFrame,
    unit: DataFrame,
    activity: DataFrame,
    *,
    item_key: str,
    item_title: str,
    item_rate: str,
    bridge_item_key: str,
    bridge_category_key: str,
    category_key: str,
    category_name: str,
    unit_key: str,
    unit_item_key: str,
    activity_unit_key: str,
    activity_id: str,
    item_link: str | None = None,
    k: int = 10,
    title_as: str = "film_title",
    category_as: str = "category",
    count_as: str = "rental_count",
    rate_as: str = "rental_rate",
) -> DataFrame:
    """Items with the most activity rows, one row per (item, category name).

    Join tree: item - bridge - category, and item - unit - activity (all
    inner). ``item_link`` is the item column joined to ``bridge_item_key``
    (default ``item_key``). ``count_as`` counts non-null ``activity_id``. An item in two
    categories gives two rows, each with the item's full count; items
    without activity do not appear. Order: count desc, then item key,
    category, title, rate ascending; the item key is not projected.
    """
    per_unit = (
        activity.where(F.col(activity_unit_key).isNotNull())
        .groupBy(F.col(activity_unit_key).alias("_unit"))
        .agg(F.count(F.col(activity_id)).alias("_n"))
    )
    per_item = (
        unit.select(F.col(unit_key).alias("_unit"), F.col(unit_item_key).alias("_item"))
        .join(per_unit, "_unit")
        .groupBy("_item")
        .agg(F.sum("_n").alias("_n"))
    )
    # The item first meets its per-item counts (both keyed by the item key, so
    # only the item side is exchanged), which also drops inactive items; the
    # category labels are looked up afterwards. With small bridge / category
    # tables those lookups are broadcast joins that keep the item-key
    # partitioning, so the final regroup needs no further exchange.
    i, b, c = item.alias("i"), bridge.alias("b"), category.alias("c")
    active = i.join(per_item, F.col(f"i.{item_key}") == F.col("_item"))
    counted = (
        active.join(b, F.col(f"i.{item_link or item_key}") == F.col(f"b.{bridge_item_key}"))
        .join(c, F.col(f"b.{bridge_category_key}") == F.col(f"c.{category_key}"))
        .select(
            F.col("_item"),
            F.col(f"i.{item_title}").alias(title_as),
            F.col(f"c.{category_name}").alias(category_as),
            F.col(f"i.{item_rate}").alias(rate_as),
            F.col("_n"),
        )
        .groupBy("_item", title_as, category_as, rate_as)
        .agg(F.sum("_n").alias(count_as))
    )
    order = [desc(count_as), asc("_item"), asc(category_as), asc(title_as), asc(rate_as)]
    return top_k(counted, order, k).select(title_as, category_as, count_as, rate_as)


def top_customers(
    customer: DataFrame,
    payment: DataFrame,
    *,
    customer_key: str,
    first_name: str,
    last_name: str,
    payment_customer_key: str,
    amount: str,
    payment_id: str,
    email: str | None = None,
    k: int = 10,
    name_as: str = "customer_name",
    email_as: str = "email",
    total_as: str = "total_spent",
    count_as: str = "rental_count",
) -> DataFrame:
    """Customers with the largest rounded money total.

    ``name_as`` is ``first || ' ' || last`` (NULL if either part is NULL);
    ``count_as`` counts non-null payment ids. Customers without payments do
    not appear. Order: total desc (NULL first), then customer key and name
    ascending; the key is not projected.
    """
    amount_type = payment.schema[amount].dataType
    per_customer = (
        payment.where(F.col(payment_customer_key).isNotNull())
        .groupBy(F.col(payment_customer_key).alias("_cust"))
        .agg(
            F.sum(money_value(amount, amount_type)).alias("_sum"),
            F.count(F.col(payment_id)).alias("_n"),
        )
    )
    c = customer.alias("c")
    labels = [F.col(f"c.{customer_key}").alias("_key"), F.col(f"c.{first_name}").alias("_first"),
              F.col(f"c.{last_name}").alias("_last")]
    if email is not None:
        labels.append(F.col(f"c.{email}").alias(email_as))
    joined = c.join(per_customer, F.col(f"c.{customer_key}") == F.col("_cust")).select(*labels, "_sum", "_n")
    group_cols = ["_key", "_first", "_last"] + ([email_as] if email is not None else [])
    totals = (
        joined.groupBy(*group_cols)
        .agg(round_total(F.sum("_sum")).alias(total_as), F.sum("_n").alias(count_as))
        .withColumn(name_as, F.concat(F.col("_first"), F.lit(" "), F.col("_last")))
    )
    order = [desc(total_as), asc("_key"), asc("_first"), asc("_last")]
    out = [name_as] + ([email_as] if email is not None else []) + [total_as, count_as]
    return top_k(totals, order, k).select(*out)
