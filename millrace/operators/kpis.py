"""Ready-made metric models for sales, marketing and finance tables.

Each builder takes the frames in the role names it documents and returns a Model; run its
metrics with ``query_metrics``. Metric names and their expressions are fixed values of the contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.operators.metrics import Entity, Field, Metric, Model, Relationship


def _entity(name: str, df: DataFrame) -> Entity:
    return Entity(name, name, tuple(Field(c) for c in df.columns))


def _model(tables, relationships, metrics) -> Model:
    return Model(tables, tuple(_entity(n, df) for n, df in tables.items()), tuple(relationships), tuple(metrics))


def sales_model(customers: DataFrame, products: DataFrame, orders: DataFrame, items: DataFrame) -> Model:
    """customers(customer_id, country), products(product_id, category, cost),
    orders(order_id, customer_id, order_date, total_amount), items(order_id, product_id, quantity)."""
    return _model(
        {"Orders": orders, "Customers": customers, "Products": products, "Order_Items": items},
        [
            Relationship("Orders", "customer_id", "Customers", "customer_id"),
            Relationship("Order_Items", "order_id", "Orders", "order_id"),
            Relationship("Order_Items", "product_id", "Products", "product_id"),
        ],
        [
            Metric("Total Revenue", "measure", "total_amount", "Orders", "SUM"),
            Metric("Order Count", "measure", "order_id", "Orders", "COUNT"),
            Metric("Average Order Value", "measure", "total_amount", "Orders", "AVG"),
            Metric("Item Revenue", "measure", "line_amount", "Order_Items", "SUM"),
            Metric("Product Cost", "measure", "quantity * Products.cost", "Order_Items", "SUM"),
            Metric("Product Category", "dimension", "category", "Products"),
            Metric("Order Date", "dimension", "order_date", "Orders"),
            Metric("Customer Location", "dimension", "country", "Customers"),
            Metric("Profit", "calculated", "[Total Revenue] - [Product Cost]"),
        ],
    )


def marketing_model(campaigns: DataFrame, ads: DataFrame, conversions: DataFrame) -> Model:
    """campaigns(campaign_id, campaign_name), ads(ad_id, campaign_id, cost),
    conversions(conversion_id, campaign_id, conversion_value, conversion_date)."""
    return _model(
        {"Campaigns": campaigns, "Ads": ads, "Conversions": conversions},
        [
            Relationship("Ads", "campaign_id", "Campaigns", "campaign_id"),
            Relationship("Conversions", "campaign_id", "Campaigns", "campaign_id"),
        ],
        [
            Metric("Total Ad Spend", "measure", "cost", "Ads", "SUM"),
            Metric("Conversion Count", "measure", "conversion_id", "Conversions", "COUNT"),
            Metric("Conversion Value", "measure", "conversion_value", "Conversions", "SUM"),
            Metric("Campaign Name", "dimension", "campaign_name", "Campaigns"),
            Metric("Conversion Date", "dimension", "conversion_date", "Conversions"),
            Metric("ROI", "calculated", "([Conversion Value] - [Total Ad Spend]) / [Total Ad Spend]"),
            Metric("Cost per Conversion", "calculated", "[Total Ad Spend] / [Conversion Count]"),
        ],
    )


def finance_model(accounts: DataFrame, transactions: DataFrame, budgets: DataFrame) -> Model:
    """accounts(account_id, account_type), transactions(transaction_id, account_id, amount, type,
    transaction_date), budgets(account_id, budget)."""
    return _model(
        {"Accounts": accounts, "Transactions": transactions, "Budgets": budgets},
        [
            Relationship("Transactions", "account_id", "Accounts", "account_id"),
            Relationship("Budgets", "account_id", "Accounts", "account_id"),
        ],
        [
            Metric("Total Income", "measure", "amount", "Transactions", "SUM", filter="type = 'income'"),
            Metric("Total Expenses", "measure", "amount", "Transactions", "SUM", filter="type = 'expense'"),
            Metric("Transaction Count", "measure", "transaction_id", "Transactions", "COUNT"),
            Metric("Budget", "measure", "budget", "Budgets", "SUM"),
            Metric("Account Type", "dimension", "account_type", "Accounts"),
            Metric("Transaction Date", "dimension", "transaction_date", "Transactions"),
            Metric("Net Income", "calculated", "[Total Income] - [Total Expenses]"),
            Metric("Budget Variance", "calculated", "[Budget] - [Total Expenses]"),
        ],
    )
