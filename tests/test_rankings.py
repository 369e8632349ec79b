"""Top-k rankings on the transactional model's own tables (fixtures F1-F7)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

from ledgerflow.operators import top_customers, top_items
from ledgerflow.plans import plan_text

L, S = T.LongType(), T.StringType()
MONEY = T.DecimalType(4, 2)


def _df(spark, rows, fields):
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, t, True) for n, t in fields]))


def _film_tables(spark, films, film_category, categories, inventory, rentals):
    return (
        _df(spark, films, [("film_id", L), ("title", S), ("rental_rate", MONEY)]),
        _df(spark, film_category, [("film_id", L), ("category_id", L)]),
        _df(spark, categories, [("category_id", L), ("name", S)]),
        _df(spark, inventory, [("inventory_id", L), ("film_id", L)]),
        _df(spark, rentals, [("rental_id", L), ("inventory_id", L)]),
    )


def _top_films(tables, k=10):
    film, film_category, category, inventory, rental = tables
    return top_items(
        film, film_category, category, inventory, rental,
        item_key="film_id", item_title="title", item_rate="rental_rate",
        bridge_item_key="film_id", bridge_category_key="category_id",
        category_key="category_id", category_name="name",
        unit_key="inventory_id", unit_item_key="film_id",
        activity_unit_key="inventory_id", activity_id="rental_id",
        k=k,
    )


def test_multi_category_inactive_and_equal_titles(spark):
    rate = Decimal("4.99")
    tables = _film_tables(
        spark,
        films=[(1, "ONE", rate), (2, "IDLE", rate), (3, "X", rate), (4, "X", rate)],
        film_category=[(1, 10), (1, 20), (2, 10), (3, 10), (4, 10)],
        categories=[(10, "A"), (20, "B")],
        inventory=[(100, 1), (200, 2), (300, 3), (400, 4)],
        rentals=[(1, 100), (2, 100), (3, 100), (4, 300), (5, 400)],
    )
    rows = [tuple(r) for r in _top_films(tables).collect()]
    # one row per category, each with the full count; F2: film 2 absent;
    # equal titles stay separate rows.
    assert rows == [("ONE", "A", 3, rate), ("ONE", "B", 3, rate), ("X", "A", 1, rate), ("X", "A", 1, rate)]


def test_tie_at_cut_keeps_lowest_ids(spark):
    # 11 films with one rental each, k = 10 -> the ten lowest ids.
    ids = list(range(20, 9, -1))
    tables = _film_tables(
        spark,
        films=[(i, f"T{i:02d}", Decimal("0.99")) for i in ids],
        film_category=[(i, 1) for i in ids],
        categories=[(1, "C")],
        inventory=[(i * 10, i) for i in ids],
        rentals=[(i, i * 10) for i in ids],
    )
    titles = [r["film_title"] for r in _top_films(tables).collect()]
    assert titles == [f"T{i:02d}" for i in range(10, 20)]


def test_null_rental_id_not_counted(spark):
    tables = _film_tables(
        spark,
        films=[(1, "ONE", Decimal("1.00"))],
        film_category=[(1, 1)],
        categories=[(1, "C")],
        inventory=[(5, 1)],
        rentals=[(None, 5), (7, 5)],
    )
    assert [r["rental_count"] for r in _top_films(tables).collect()] == [1]


def _customer_tables(spark, customers, payments, amount_type=T.DecimalType(5, 2)):
    customer = _df(spark, customers, [("customer_id", L), ("first_name", S), ("last_name", S), ("email", S)])
    payment = _df(spark, payments, [("payment_id", L), ("customer_id", L), ("amount", amount_type)])
    return customer, payment


def _top_spenders(customer, payment, k=10):
    return top_customers(
        customer, payment,
        customer_key="customer_id", first_name="first_name", last_name="last_name", email="email",
        payment_customer_key="customer_id", amount="amount", payment_id="payment_id", k=k,
    )


def test_null_name_null_money_and_no_payments(spark):
    customer, payment = _customer_tables(
        spark,
        customers=[
            (1, None, "SEAL", "a@x"),      # F5: NULL first name
            (2, "ALL", "NULL", "b@x"),     # F6: all amounts NULL
            (3, "NINE", "NINETYNINE", "c@x"),
            (4, "NO", "PAYMENTS", "d@x"),  # no payments
        ],
        payments=[(1, 1, Decimal("5.00")), (2, 2, None), (3, 2, None), (4, 3, Decimal("9.99"))],
    )
    rows = [tuple(r) for r in _top_spenders(customer, payment).collect()]
    assert rows == [
        ("ALL NULL", "b@x", None, 2),                  # NULL total sorts first, ids still counted
        ("NINE NINETYNINE", "c@x", Decimal("9.99"), 1),
        (None, "a@x", Decimal("5.00"), 1),
    ]


def test_rounding_half_away_from_zero(spark):
    # decimal(9,3) amounts summed at their own scale, rounded after.
    customer, payment = _customer_tables(
        spark,
        customers=[(1, "P", "OS", None), (2, "N", "EG", None)],
        payments=[(1, 1, Decimal("1.005")), (2, 2, Decimal("-1.005"))],
        amount_type=T.DecimalType(9, 3),
    )
    totals = {r["customer_name"]: r["total_spent"] for r in _top_spenders(customer, payment).collect()}
    assert totals == {"P OS": Decimal("1.01"), "N EG": Decimal("-1.01")}


def test_rankings_plan_as_top_k(spark):
    # Plan check: both rankings are a per-task top-k, not a full sort.
    customer, payment = _customer_tables(spark, [(1, "A", "B", None)], [(1, 1, Decimal("1.00"))])
    assert "TakeOrderedAndProject" in plan_text(_top_spenders(customer, payment))
    tables = _film_tables(spark, [(1, "F", Decimal("1.00"))], [(1, 1)], [(1, "C")], [(1, 1)], [(1, 1)])
    assert "TakeOrderedAndProject" in plan_text(_top_films(tables))


def test_fact_side_aggregated_before_join(spark):
    # The payment side is aggregated (partial + final) before it meets customer.
    customer, payment = _customer_tables(spark, [(1, "A", "B", None)], [(1, 1, Decimal("1.00"))])
    text = plan_text(_top_spenders(customer, payment), "extended")
    physical = text.split("== Physical Plan ==")[1]
    assert physical.count("partial_sum") >= 1
