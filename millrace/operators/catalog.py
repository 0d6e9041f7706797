"""Analysis of the column catalogue: categories, duplicates, joins, keys and schema health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.frames import col
from millrace.sources.catalog import Keys, foreign_key_frame, primary_key_frame

# Name and type patterns per semantic category, first match wins.
CATEGORY_RULES = (
    ("identifier", r"(^|_)(id|pk)($|_)|key$|_pk$", r"int"),
    ("email", r"e?mail", r""),
    ("phone", r"phone|(^|_)tel($|_)|mobile|(^|_)fax($|_)", r""),
    ("datetime", r"date|(^|_)time|timestamp|created|updated|modified|_at$", r""),
    ("monetary", r"price|cost|amount|salary|revenue|total|(^|_)fee|(^|_)rate($|_)", r""),
    ("name", r"name", r""),
    ("address", r"address|street|city|state$|country|(^|_)zip|postal", r""),
    ("url", r"(^|_)url|link|website|href", r""),
    ("text", r"description|comment|(^|_)note|(^|_)bio($|_)|text|body|content", r""),
    ("categorical", r"status|state|type|category|flag|^is_|^has_", r""),
    ("count", r"count|quantity|qty|(^|_)num($|_)|number", r""),
    ("boolean", r"", r"bool"),
    ("numeric", r"", r"int|float|double|decimal|numeric|real"),
    ("text", r"", r"char|text|string"),
)
SNAKE_CASE = r"^[a-z][a-z0-9_]*$"


def category_of(name: Column, dtype: Column) -> Column:
    """Semantic category of a column from its name and type."""
    name, dtype = F.lower(name), F.lower(dtype)
    chain = None
    for category, in_name, in_type in CATEGORY_RULES:
        test = F.lit(True)
        if in_name:
            test = test & name.rlike(in_name)
        if in_type:
            test = test & dtype.rlike(in_type)
        chain = F.when(test, category) if chain is None else chain.when(test, category)
    return chain.otherwise("other")


def classify_columns(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("category", category_of(F.col("column"), F.col("type")))


def category_counts(catalog: DataFrame) -> DataFrame:
    """Columns per category; with row counts in the catalogue also the values they hold."""
    aggs = [F.count(F.lit(1)).alias("columns")]
    if "row_count" in catalog.columns:
        aggs.append(F.sum("row_count").alias("cells"))
    return classify_columns(catalog).groupBy("category").agg(*aggs)


def duplicate_columns(catalog: DataFrame) -> DataFrame:
    """Column names used by more than one table and whether their types agree."""
    aggs = [
        F.count_distinct("table").alias("tables"),
        F.array_join(F.array_sort(F.collect_set("table")), ", ").alias("used_by"),
        (F.count_distinct("type") == 1).alias("type_match"),
    ]
    if "row_count" in catalog.columns:
        aggs.append(F.sum("row_count").alias("cells"))
    return catalog.groupBy(F.lower(F.trim("column")).alias("name")).agg(*aggs).where("tables > 1")


def _bigrams(name: Column) -> Column:
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(2)))
    )


def similar_columns(catalog: DataFrame, low: float = 0.7) -> DataFrame:
    """Pairs of different column names whose character-bigram Jaccard is above ``low``.

    Candidates come from an inverted index on shared bigrams, not from all pairs.
    """
    names = catalog.select(F.lower(F.trim("column")).alias("name")).distinct().withColumn("grams", _bigrams(F.col("name")))
    index = names.select("name", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    left = index.select(F.col("name").alias("name_a"), F.col("size").alias("size_a"), "gram")
    right = index.select(F.col("name").alias("name_b"), F.col("size").alias("size_b"), "gram")
    shared = (
        left.join(right, "gram")
        .where("name_a < name_b")
        .groupBy("name_a", "name_b", "size_a", "size_b")
        .agg(F.count(F.lit(1)).alias("both"))
    )
    score = F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))
    return shared.select("name_a", "name_b", F.round(score, 4).alias("similarity")).where(
        (F.col("similarity") > low) & (F.col("similarity") < 1)
    )


def potential_joins(catalog: DataFrame, fks: DataFrame) -> DataFrame:
    """Table pairs sharing a column name and type that no declared key relates."""
    a = catalog.select(F.col("table").alias("table_a"), F.lower("column").alias("column"), "type")
    b = catalog.select(F.col("table").alias("table_b"), F.lower("column").alias("column"), "type")
    pairs = a.join(b, ["column", "type"]).where("table_a < table_b")
    related = fks.select(
        F.least("table", "ref_table").alias("ra"), F.greatest("table", "ref_table").alias("rb")
    ).distinct()
    return pairs.join(
        F.broadcast(related), (F.col("table_a") == F.col("ra")) & (F.col("table_b") == F.col("rb")), "left_anti"
    ).select("table_a", "table_b", "column", "type")


def verify_primary_keys(tables: dict[str, DataFrame], keys: Keys) -> DataFrame:
    """Each declared primary key with its row count, distinct count and whether it holds."""
    out = None
    for table, cols in keys.primary.items():
        key = F.struct(*[col(c) for c in cols])
        # two-level count: distinct keys first, so no task sees more than its share
        counted = tables[table].groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
        part = counted.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.count(F.lit(1)).alias("distinct_count"),
        ).select(F.lit(table).alias("table"), F.lit(", ".join(cols)).alias("key"), "row_count", "distinct_count")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("holds", F.col("row_count") == F.col("distinct_count"))


def relationships(tables: dict[str, DataFrame], keys: Keys) -> DataFrame:
    """Declared foreign keys with their row and orphan counts."""
    out = None
    for k in keys.foreign:
        # map-side counts per key value, so a hot value is one row in the join
        child = tables[k.table].groupBy(col(k.column).alias("k")).agg(F.count(F.lit(1)).alias("n")).where("k IS NOT NULL")
        parent = tables[k.ref_table].select(col(k.ref_column).alias("k")).distinct().withColumn("hit", F.lit(True))
        part = (
            child.join(parent, "k", "left")
            .agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n"))), F.lit(0)).alias("orphans"),
            )
            .select(
                F.lit(k.table).alias("table"), F.lit(k.column).alias("column"),
                F.lit(k.ref_table).alias("ref_table"), F.lit(k.ref_column).alias("ref_column"), "rows", "orphans",
            )
        )
        out = part if out is None else out.unionByName(part)
    return out


def schema_metrics(catalog: DataFrame, keys: Keys, row_counts: DataFrame | None = None) -> DataFrame:
    """Table and column counts, average width, keys, relationship ratio, nesting ratio."""
    n_pk = sum(len(c) for c in keys.primary.values())
    n_fk = len(keys.foreign)
    nested = F.col("type").rlike("^(array|map|struct|variant)")
    out = catalog.agg(
        F.count_distinct("table").alias("tables"),
        F.count(F.lit(1)).alias("columns"),
        F.count_if(nested).alias("nested"),
    )
    out = out.select(
        "tables",
        "columns",
        F.round(F.try_divide("columns", "tables"), 2).alias("avg_columns"),
        F.lit(n_pk).alias("primary_keys"),
        F.lit(n_fk).alias("foreign_keys"),
        F.round(F.try_divide(F.lit(n_fk), F.col("tables")), 2).alias("relationship_ratio"),
        F.round(F.try_divide("nested", "columns"), 2).alias("nesting_ratio"),
    )
    if row_counts is not None:
        total = row_counts.agg(F.sum("row_count").alias("n")).scalar()
        out = out.withColumn("rows", total)
    return out


def health_factors(catalog: DataFrame, valid_keys: DataFrame, fks: DataFrame) -> DataFrame:
    """(table, factor, penalty): every finding that lowers schema health.

    ``valid_keys`` holds the tables whose key was declared or verified on the data.
    """
    tables = catalog.groupBy("table").agg(
        F.count(F.lit(1)).alias("width"), F.count_if(F.col("type").rlike("^(array|map|struct|variant)")).alias("nested")
    )
    no_key = tables.join(F.broadcast(valid_keys.select("table").distinct()), "table", "left_anti")
    findings = [
        no_key.select("table", F.lit("no primary key").alias("factor"), F.lit(10).alias("penalty")),
        tables.where("width > 20").select("table", F.lit("more than 20 columns").alias("factor"), F.lit(5).alias("penalty")),
        tables.where("nested > 3").select("table", F.lit("more than 3 nested fields").alias("factor"), F.lit(5).alias("penalty")),
        fks.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
            F.lit("*").alias("table"), F.lit("no foreign keys").alias("factor"), F.lit(15).alias("penalty")
        ),
        tables.where(~F.col("table").rlike(SNAKE_CASE)).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
            F.lit("*").alias("table"), F.lit("names not in snake_case").alias("factor"), F.lit(5).alias("penalty")
        ),
    ]
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out


def schema_health(catalog: DataFrame, valid_keys: DataFrame, fks: DataFrame) -> DataFrame:
    """Score 0-100 and the number of findings."""
    return health_factors(catalog, valid_keys, fks).agg(
        F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.coalesce(F.sum("penalty"), F.lit(0)))).cast("int").alias("score"),
        F.count(F.lit(1)).alias("findings"),
    )


def schema_recommendations(catalog: DataFrame, valid_keys: DataFrame, fks: DataFrame) -> DataFrame:
    """Advice rows: cluster on foreign keys, add missing keys, rename to snake_case."""
    tables = catalog.select("table").distinct()
    no_key = tables.join(F.broadcast(valid_keys.select("table").distinct()), "table", "left_anti")
    snake = F.ltrim(F.lower(F.regexp_replace("table", "([A-Z])", "_$1")), F.lit("_"))
    parts = [
        fks.select(F.lit("clustering").alias("kind"), "table", F.concat(F.lit("bucket by "), "column").alias("advice")),
        no_key.select(F.lit("integrity").alias("kind"), "table", F.lit("add a primary key").alias("advice")),
        tables.where(~F.col("table").rlike(SNAKE_CASE)).select(
            F.lit("naming").alias("kind"), "table", F.concat(F.lit("rename to "), snake).alias("advice")
        ),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def data_dictionary(catalog: DataFrame, keys: Keys) -> DataFrame:
    """Every column with its key roles and the column it refers to."""
    spark = catalog.sparkSession
    pk = primary_key_frame(spark, keys).withColumn("is_pk", F.lit(True))
    fk = foreign_key_frame(spark, keys).select(
        "table", "column", F.concat_ws(".", "ref_table", "ref_column").alias("refers_to")
    )
    return (
        catalog.join(F.broadcast(pk), ["table", "column"], "left")
        .join(F.broadcast(fk), ["table", "column"], "left")
        .withColumn("is_pk", F.coalesce("is_pk", F.lit(False)))
        .withColumn("is_fk", F.col("refers_to").isNotNull())
    )
