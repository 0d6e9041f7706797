"""Group A: scans, writes and extracts over the given tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from millrace.queries.registry import Tables, query
from millrace.session import ensure_checkpoint_dir
from millrace.sources import readers, writers


def _scratch(t: Tables, name: str) -> str:
    """A fresh target path in the shared scratch folder of the session."""
    return os.path.join(ensure_checkpoint_dir(t.spark), f"millrace-{name}-{uuid.uuid4().hex}")


@query(
    "a1_read_csv",
    """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""",
)
def a1_read_csv(t):
    path = _scratch(t, "csv")
    writers.export(t.customer, path, "csv")
    return readers.read_csv(t.spark, path, schema=t.customer.schema)


@query(
    "a2_read_json_flat",
    """SELECT vec_id, label, len(embedding) AS dims, label AS "meta.label",
       length(CAST(label AS VARCHAR)) AS "meta.label_chars" FROM embeddings""",
)
def a2_read_json_flat(t):
    path = _scratch(t, "json")
    nested = t.embeddings.select(
        "vec_id",
        "label",
        F.size("embedding").alias("dims"),
        F.struct(F.col("label"), F.length(F.col("label").cast("string")).alias("label_chars")).alias("meta"),
    )
    writers.export(nested, path, "json")
    return readers.read_json_flat(t.spark, path, schema=nested.schema, multi_line=False)


@query("a3_scan_parquet", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_discount > 0.05")
def a3_scan_parquet(t):
    scan = readers.read_table(t.spark, t.folder, "lineitem")
    return scan.where(F.col("l_discount") > 0.05).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "a5_collection_schema",
    """SELECT json_key AS field, count(*) AS documents
       FROM (SELECT unnest(json_keys(props)) AS json_key FROM events) k GROUP BY json_key""",
)
def a5_collection_schema(t):
    return readers.document_fields(t.events, "props")


@query("a5_merged_schema")
def a5_merged_schema(t):
    return readers.collection_schema(t.events, "props")


@query(
    "a6_write_table",
    "SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus",
)
def a6_write_table(t):
    path = _scratch(t, "table")
    writers.write_table(t.orders, path, "overwrite", partition_by=["o_orderstatus"])
    back = t.spark.read.parquet(path)
    return back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("a7_export_json", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def a7_export_json(t):
    path = _scratch(t, "export")
    writers.export(t.supplier, path, "json")
    return t.spark.read.schema(t.supplier.schema).json(path)


@query("a8_export_parquet", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def a8_export_parquet(t):
    path = _scratch(t, "parquet")
    writers.export(t.part, path, "parquet")
    return t.spark.read.parquet(path)


@query(
    "a9_extract_tables",
    """(SELECT 'orders' AS source, o_orderkey AS id FROM orders ORDER BY o_orderkey LIMIT 1000)
       UNION ALL
       (SELECT 'customer' AS source, c_custkey AS id FROM customer ORDER BY c_custkey LIMIT 1000)""",
)
def a9_extract_tables(t):
    path = _scratch(t, "extract")
    written = writers.extract_tables(
        t.some("orders", "customer"), 1000, path, order_by={"orders": ["o_orderkey"], "customer": ["c_custkey"]}
    )
    orders = t.spark.read.parquet(written["orders"]).select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"))
    customers = t.spark.read.parquet(written["customer"]).select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"))
    return orders.unionByName(customers)


@query(
    "a10_transfer",
    """SELECT event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY event_type""",
)
def a10_transfer(t):
    source, target = _scratch(t, "source") + ".csv", _scratch(t, "target")
    writers.export(t.events, source, "csv")
    writers.transfer(t.spark, {source: target})
    return t.spark.read.parquet(target).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    "a11_preview",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
def a11_preview(t):
    ranked = t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return writers.preview(ranked, 100)
