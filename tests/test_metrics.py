import pytest

from millrace.operators import metrics as m


def model(spark, **extra):
    orders = spark.createDataFrame([(1, 10, 100.0), (2, 10, 50.0), (3, None, 7.0)], "id int, cust int, total double")
    items = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 4.0)], "order_id int, qty double")
    customers = spark.createDataFrame([(10, "DE")], "id int, country string")
    ent = lambda n, *f: m.Entity(n, n, tuple(m.Field(x) for x in f))
    metrics = [
        m.Metric("revenue", "measure", "total", "orders", "SUM"),
        m.Metric("big", "measure", "total", "orders", "SUM", filter="total > 1000"),
        m.Metric("sold", "measure", "qty", "items", "SUM"),
        m.Metric("country", "dimension", "country", "customers"),
        m.Metric("per_item", "calculated", "[revenue] / [sold]"),
        m.Metric("broken", "calculated", "[revenue] / [big]"),
        m.Metric("loop_a", "calculated", "[loop_b] + 1"),
        m.Metric("loop_b", "calculated", "[loop_a] + 1"),
    ]
    return m.Model(
        {"orders": orders, "items": items, "customers": customers},
        (ent("orders", "id", "cust", "total"), ent("items", "order_id", "qty"), ent("customers", "id", "country")),
        (m.Relationship("orders", "cust", "customers", "id"), m.Relationship("items", "order_id", "orders", "id")),
        tuple(metrics),
    )


def test_facts_do_not_multiply(spark):
    row = m.query_metrics(model(spark), ["revenue", "sold", "per_item"]).first()
    assert (row["revenue"], row["sold"]) == (157.0, 9.0)
    assert abs(row["per_item"] - 157 / 9) < 1e-9


def test_unmatched_rows_keep_a_null_group(spark):
    rows = {r["country"]: (r["revenue"], r["sold"]) for r in m.query_metrics(model(spark), ["revenue", "sold"], ["country"]).collect()}
    assert rows == {"DE": (150.0, 9.0), None: (7.0, None)}


def test_division_by_nothing_is_null(spark):
    assert m.query_metrics(model(spark), ["broken"]).first()["broken"] is None


def test_circular_metrics_fail(spark):
    with pytest.raises(ValueError, match="circle"):
        m.query_metrics(model(spark), ["loop_a"])


def test_unreachable_dimension_fails(spark):
    base = model(spark)
    cut = m.Model(base.tables, base.entities, base.relationships[1:], base.metrics)
    with pytest.raises(ValueError, match="not reachable"):
        m.query_metrics(cut, ["revenue"], ["country"])


def test_view_walks_all_entities(spark):
    view = m.model_view(model(spark))
    assert "customers_country" in view.columns and "items_qty" in view.columns
    assert view.count() == 4
