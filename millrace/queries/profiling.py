"""Group D: profiles, catalogue analysis, key and dependency discovery."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from millrace.operators import catalog as cat
from millrace.operators import keys as kd
from millrace.operators import lattice as la
from millrace.operators import profile as pf
from millrace.plans.frames import col
from millrace.queries.registry import TABLE_NAMES, query
from millrace.sources.catalog import ForeignKey, Keys, catalog_frame, foreign_key_frame

# Column types of the given tables, for the SQL twins only.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
COLUMNS = {t: [tuple(c.split(" ")) for c in s.split(", ")] for t, s in SCHEMAS.items()}
NUMBERS = ("int", "bigint", "double")

KEYS = Keys(
    primary={
        "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",),
        "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",),
        "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",), "labels": ("doc_id",),
        "conversations": ("conv_id", "turn"),
    },
    foreign=(
        ForeignKey("nation", "n_regionkey", "region", "r_regionkey"),
        ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
        ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"),
        ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
        ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ForeignKey("lineitem", "l_partkey", "part", "p_partkey"),
        ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ForeignKey("labels", "doc_id", "documents", "doc_id"),
    ),
)


def profile_sql(table: str, source: str | None = None) -> str:
    source = source or table
    parts = []
    for i, (c, kind) in enumerate(COLUMNS[table]):
        avg = f"round(avg(CAST({c} AS DOUBLE)), 4)" if kind in NUMBERS else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"""SELECT '{table}' AS "table", '{c}' AS "column", '{kind}' AS type, {i} AS ordinal, count(*) AS row_count,
            count(*) - count({c}) AS null_count, floor(10000.0 * (count(*) - count({c})) / count(*) + 0.5) / 100 AS null_pct,
            count(DISTINCT {c}) AS distinct_count, floor(10000.0 * count(DISTINCT {c}) / count(*) + 0.5) / 100 AS distinct_pct,
            count(*) > 0 AND count(DISTINCT {c}) = count(*) AS is_unique, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max,
            {avg} AS avg, greatest(0.0, 100.0 - least(floor(10000.0 * (count(*) - count({c})) / count(*) + 0.5) / 100, 50.0)) AS quality FROM {source}"""
        )
    return " UNION ALL ".join(parts)


# NULLs injected alike on both sides: the given tables hold none.
HOLES = {"l_quantity": ("l_orderkey", 3, 2), "l_tax": ("l_partkey", 5, 1), "l_returnflag": ("l_suppkey", 4, 1)}


def holed(t):
    """lineitem with missing quantities (2/3), taxes (1/5) and return flags (1/4)."""
    return t.lineitem.select(
        *[
            F.when(F.col(HOLES[c][0]) % HOLES[c][1] >= HOLES[c][2], F.col(c)).alias(c) if c in HOLES else F.col(c)
            for c in t.lineitem.columns
        ]
    )


HOLED = "(SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN {k} % {m} >= {r} THEN {c} END AS {c}" for c, (k, m, r) in HOLES.items()
) + ") FROM lineitem)"
PROFILE_COLUMNS = "type, row_count, null_count, null_pct, distinct_count, distinct_pct, is_unique, min, max, avg, quality"
HOLED_PROFILE = f"({profile_sql('lineitem', HOLED)})"


@query("d1_row_counts", " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS row_count FROM {n}" for n in TABLE_NAMES))
def d1_row_counts(t):
    return pf.table_row_counts(t.every)


@query("d2_column_profile", profile_sql("lineitem"))
def d2_column_profile(t):
    return pf.profile(t.lineitem, "lineitem", stored=True)


@query("d2_profile_with_gaps", HOLED_PROFILE)
def d2_profile_with_gaps(t):
    return pf.profile(holed(t), "lineitem")


@query("d2_profile_approx")
def d2_profile_approx(t):
    return pf.profile(t.lineitem, "lineitem", approx=True)


@query("d3_min_max", f'SELECT "column", min, max FROM ({profile_sql("orders")})')
def d3_min_max(t):
    return pf.profile(t.orders, "orders").select("column", "min", "max")


@query("d4_means", f'SELECT "column", avg FROM ({profile_sql("part")}) WHERE avg IS NOT NULL')
def d4_means(t):
    return pf.profile(t.part, "part").where("avg IS NOT NULL").select("column", "avg")


def _counts_sql(table):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}"
        for c, _ in COLUMNS[table]
    )


@query(
    "d5_sample_values",
    f"""SELECT "column", value, rank FROM (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) AS rank
        FROM ({_counts_sql('customer')}) c) r WHERE rank <= 5""",
)
def d5_sample_values(t):
    return pf.sample_values(t.customer, 5, stored=True)


def _top_sql(table, k):
    return f"""SELECT "column", value, n, rank FROM (SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank
        FROM ({_counts_sql(table)}) c) r WHERE rank <= {k}"""


@query("d6_top_values", _top_sql("orders", 5))
def d6_top_values(t):
    return pf.top_values(t.orders, 5, stored=True)


BOTH = f"({profile_sql('lineitem', HOLED)} UNION ALL {profile_sql('orders')} UNION ALL {profile_sql('customer')})"


def _profiles(t):
    return (
        pf.profile(holed(t), "lineitem")
        .unionByName(pf.profile(t.orders, "orders"))
        .unionByName(pf.profile(t.customer, "customer"))
    )


@query("d7_quality_scores", f'SELECT "table", max(row_count) AS row_count, round(avg(quality), 1) AS score FROM {BOTH} GROUP BY "table"')
def d7_quality_scores(t):
    return pf.quality_scores(_profiles(t))


def _literal_catalog(tables=TABLE_NAMES) -> str:
    rows = ", ".join(f"('{t}', '{c}', '{k}', {i})" for t in tables for i, (c, k) in enumerate(COLUMNS[t]))
    counts = " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS row_count FROM {t}" for t in tables)
    return f"""(SELECT c."table", c."column", c.type, c.ordinal, n.row_count FROM (VALUES {rows}) c("table", "column", type, ordinal)
        JOIN ({counts}) n ON n.tbl = c."table")"""


def counted_catalog(t):
    """Catalogue of all tables with the row count of each."""
    return catalog_frame(t.spark, t.every).join(F.broadcast(pf.table_row_counts(t.every)), "table")


def category_sql(name: str = '"column"', dtype: str = "type") -> str:
    whens = []
    for category, in_name, in_type in cat.CATEGORY_RULES:
        tests = []
        if in_name:
            tests.append(f"regexp_matches(lower({name}), '{in_name}')")
        if in_type:
            tests.append(f"regexp_matches(lower({dtype}), '{in_type}')")
        whens.append(f"WHEN {' AND '.join(tests)} THEN '{category}'")
    return f"CASE {' '.join(whens)} ELSE 'other' END"


@query("d8_column_categories", f'SELECT "table", "column", {category_sql()} AS category, row_count FROM {_literal_catalog()}')
def d8_column_categories(t):
    return cat.classify_columns(counted_catalog(t)).select("table", "column", "category", "row_count")


@query(
    "d9_quality_issues",
    f"""SELECT "table", "column", CASE WHEN null_pct > 50 THEN 'High' ELSE 'Medium' END AS severity, 'missing values' AS issue, null_pct AS measure
        FROM {BOTH} WHERE null_pct > 20 UNION ALL
        SELECT "table", "column", 'Low', 'single value', CAST(distinct_count AS DOUBLE) FROM {BOTH} WHERE distinct_count = 1 AND row_count > 1""",
)
def d9_quality_issues(t):
    return pf.quality_issues(_profiles(t))


@query(
    "d10_quality_summary",
    f"""WITH s AS (SELECT "table", max(row_count) AS row_count, count(*) AS columns, round(avg(quality), 1) AS score FROM {BOTH} GROUP BY "table")
        SELECT count(*) AS tables, CAST(sum(row_count) AS BIGINT) AS rows, CAST(sum(columns) AS BIGINT) AS columns, round(avg(score), 1) AS avg_score,
        count(*) FILTER (WHERE score >= 80) AS good, count(*) FILTER (WHERE score >= 50 AND score < 80) AS fair, count(*) FILTER (WHERE score < 50) AS poor FROM s""",
)
def d10_quality_summary(t):
    return pf.quality_summary(_profiles(t))


@query(
    "d11_category_counts",
    f"SELECT category, count(*) AS columns, CAST(sum(row_count) AS BIGINT) AS cells FROM (SELECT {category_sql()} AS category, row_count FROM {_literal_catalog()}) x GROUP BY category",
)
def d11_category_counts(t):
    return cat.category_counts(counted_catalog(t))


@query(
    "d12_column_report",
    f"""WITH p AS (SELECT *, {category_sql()} AS category FROM ({profile_sql('part')}) x),
        w AS (SELECT *, category IN ('categorical', 'boolean', 'name', 'text') AND NOT is_unique AS wanted FROM p),
        r AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY ordinal) AS rn FROM w),
        f AS (SELECT "column" AS c, string_agg(value || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY rank) AS txt FROM ({_top_sql('part', 3)}) t GROUP BY "column")
        SELECT "table", "column", type, category, row_count, null_pct, distinct_count, is_unique, quality,
          CASE WHEN wanted AND rn <= 5 THEN txt END AS frequent FROM r LEFT JOIN f ON f.c = r."column" """,
)
def d12_column_report(t):
    return pf.column_report(t.part, "part")


@query(
    "d13_duplicate_columns",
    f"""SELECT lower(trim("column")) AS name, count(DISTINCT "table") AS tables, string_agg(DISTINCT "table", ', ' ORDER BY "table") AS used_by,
        count(DISTINCT type) = 1 AS type_match, CAST(sum(row_count) AS BIGINT) AS cells FROM {_literal_catalog()} GROUP BY lower(trim("column")) HAVING count(DISTINCT "table") > 1""",
)
def d13_duplicate_columns(t):
    return cat.duplicate_columns(counted_catalog(t))


@query(
    "d14_similar_columns",
    f"""WITH n AS (SELECT lower("column") AS name, max(row_count) AS row_count FROM {_literal_catalog()} GROUP BY 1),
        g AS (SELECT DISTINCT name, row_count, substring(name, CAST(i AS INT), 2) AS gram FROM n, LATERAL (SELECT unnest(generate_series(1, greatest(length(name) - 1, 1))) AS i) s),
        s AS (SELECT name, count(*) AS size FROM g GROUP BY name),
        b AS (SELECT x.name AS name_a, y.name AS name_b, max(x.row_count) + max(y.row_count) AS cells, count(*) AS both_n FROM g x JOIN g y ON x.gram = y.gram AND x.name < y.name GROUP BY x.name, y.name)
        SELECT name_a, name_b, similarity, cells FROM (SELECT name_a, name_b, cells, round(both_n / (sa.size + sb.size - both_n), 4) AS similarity
          FROM b JOIN s sa ON sa.name = name_a JOIN s sb ON sb.name = name_b) z WHERE similarity > 0.7 AND similarity < 1""",
)
def d14_similar_columns(t):
    catalog = counted_catalog(t)
    cells = catalog.groupBy(F.lower("column").alias("name")).agg(F.max("row_count").alias("row_count"))
    a = cells.select(F.col("name").alias("name_a"), F.col("row_count").alias("rows_a"))
    b = cells.select(F.col("name").alias("name_b"), F.col("row_count").alias("rows_b"))
    pairs = cat.similar_columns(catalog).join(F.broadcast(a), "name_a").join(F.broadcast(b), "name_b")
    return pairs.select("name_a", "name_b", "similarity", (F.col("rows_a") + F.col("rows_b")).alias("cells"))


FK_VALUES = "(VALUES " + ", ".join(f"('{k.table}', '{k.column}', '{k.ref_table}', '{k.ref_column}')" for k in KEYS.foreign) + ") f(tbl, col, ref_tbl, ref_col)"


@query(
    "d15_potential_joins",
    f"""SELECT a."table" AS table_a, b."table" AS table_b, a."column", a.type, a.row_count AS rows_a, b.row_count AS rows_b
        FROM {_literal_catalog()} a JOIN {_literal_catalog()} b ON a."column" = b."column" AND a.type = b.type AND a."table" < b."table"
        WHERE NOT EXISTS (SELECT 1 FROM {FK_VALUES} WHERE least(tbl, ref_tbl) = a."table" AND greatest(tbl, ref_tbl) = b."table")""",
)
def d15_potential_joins(t):
    pairs = cat.potential_joins(catalog_frame(t.spark, t.every), foreign_key_frame(t.spark, KEYS))
    rows = pf.table_row_counts(t.every)
    a = rows.select(F.col("table").alias("table_a"), F.col("row_count").alias("rows_a"))
    b = rows.select(F.col("table").alias("table_b"), F.col("row_count").alias("rows_b"))
    return pairs.join(F.broadcast(a), "table_a").join(F.broadcast(b), "table_b")


@query(
    "d16_relationships",
    " UNION ALL ".join(
        f"""SELECT '{k.table}' AS "table", '{k.column}' AS "column", '{k.ref_table}' AS ref_table, '{k.ref_column}' AS ref_column, count({k.column}) AS rows,
        count(*) FILTER (WHERE {k.column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {k.ref_table} p WHERE p.{k.ref_column} = c.{k.column})) AS orphans FROM {k.table} c"""
        for k in KEYS.foreign
    ),
)
def d16_relationships(t):
    return cat.relationships(t.every, KEYS)


def _key_sql(table, width=2):
    cols = [c for c, _ in COLUMNS[table]]
    singles = [f"SELECT '{c}' AS key, 1 AS width, count(*) AS row_count FROM {table} HAVING count(DISTINCT {c}) = count(*)" for c in cols]
    pairs = [
        f"""SELECT '{a}, {b}', 2, count(*) FROM {table} HAVING (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM {table}) d) = count(*)
        AND count(DISTINCT {a}) < count(*) AND count(DISTINCT {b}) < count(*)"""
        for a, b in combinations(cols, 2)
    ]
    return " UNION ALL ".join(singles + pairs)


@query("d17_candidate_keys", _key_sql("orders"))
def d17_candidate_keys(t):
    return kd.candidate_keys(t.orders)


@query("d17_composite_keys", _key_sql("conversations"))
def d17_composite_keys(t):
    return kd.candidate_keys(t.conversations)


DEP_COLS = ["o_custkey", "o_orderstatus", "c_nationkey", "c_mktsegment", "n_name", "n_regionkey"]
DEP_SQL = "(SELECT o_custkey, o_orderstatus, c_nationkey, c_mktsegment, n_name, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


@query(
    "d17_functional_deps",
    f"WITH d AS {DEP_SQL} " + " UNION ALL ".join(
        f"SELECT '{a}' AS determinant, '{b}' AS dependent, count(DISTINCT {a}) AS determinant_values FROM d HAVING count(DISTINCT {a}) = (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM d) x)"
        for a in DEP_COLS for b in DEP_COLS if a != b
    ),
)
def d17_functional_deps(t):
    wide = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return kd.functional_deps(wide.select(*DEP_COLS))


PAIRS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_custkey", "orders", "o_custkey"),
    ("part", "p_partkey", "lineitem", "l_partkey"),
    ("documents", "doc_id", "labels", "doc_id"),
]


@query(
    "d18_inclusion_deps",
    " UNION ALL ".join(
        f"""SELECT '{c}.{cc}' AS child, '{p}.{pc}' AS parent, count(DISTINCT {cc}) AS child_values,
        count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM {p} r WHERE r.{pc} = x.{cc}) THEN {cc} END) AS contained,
        round(count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM {p} r WHERE r.{pc} = x.{cc}) THEN {cc} END) * 1.0 / count(DISTINCT {cc}), 6) AS containment FROM {c} x"""
        for c, cc, p, pc in PAIRS
    ),
)
def d18_inclusion_deps(t):
    return kd.inclusion_deps(t.every, PAIRS)


# Families of the inclusion search, for the SQL twin only.
FAMILIES = {"int": "integer", "bigint": "integer", "double": "float", "string": "text", "timestamp_ntz": "timestamp"}
LEAST = 0.5


@query(
    "d18_all_inclusions",
    f"""WITH v AS ({" UNION ALL ".join(
        f"SELECT DISTINCT '{t}.{c}' AS c, '{FAMILIES[kind]}' AS f, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL"
        for t, cols in COLUMNS.items() for c, kind in cols if kind in FAMILIES
    )}), n AS (SELECT c, count(*) AS n FROM v GROUP BY c),
    p AS (SELECT a.c AS child, b.c AS parent, count(*) AS contained FROM v a JOIN v b ON a.f = b.f AND a.v = b.v AND a.c <> b.c GROUP BY a.c, b.c)
    SELECT child, parent, n AS child_values, contained, round(contained * 1.0 / n, 6) AS containment FROM p JOIN n ON n.c = p.child WHERE contained >= {LEAST} * n""",
)
def d18_all_inclusions(t):
    return la.inclusions(t.every, LEAST)


WIDE = ("customer", "part", "orders", "events")


def lattice_ctes(table: str, width: int) -> str:
    """Column sets with their distinct counts (s) and the table's rows (r)."""
    names = [c for c, _ in COLUMNS[table]]
    sets = [g for w in range(1, width + 1) for g in combinations(names, w)]
    each = " UNION ALL ".join(f"SELECT {list(g)} AS x, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(g)} FROM {table}) q) AS n" for g in sets)
    return f"s AS ({each}), r AS (SELECT count(*) AS total FROM {table})"


def minimal_keys_sql(table: str) -> str:
    return f"""SELECT * FROM (WITH {lattice_ctes(table, 2)}, k AS (SELECT x FROM s, r WHERE n = total)
        SELECT '{table}' AS "table", array_to_string(x, ', ') AS key, CAST(len(x) AS INT) AS width, total AS row_count FROM k, r
        WHERE NOT EXISTS (SELECT 1 FROM k o WHERE len(o.x) < len(k.x) AND list_has_all(k.x, o.x))) q_{table}"""


def dependencies_sql(table: str) -> str:
    return f"""SELECT * FROM (WITH {lattice_ctes(table, 3)},
        f AS (SELECT l.x, l.n, list_filter(b.x, lambda c: NOT list_contains(l.x, c))[1] AS a FROM s l JOIN s b ON len(b.x) = len(l.x) + 1 AND list_has_all(b.x, l.x) AND b.n = l.n, r WHERE l.n < total)
        SELECT '{table}' AS "table", array_to_string(x, ', ') AS determinant, a AS dependent, CAST(len(x) AS INT) AS width, n AS determinant_values FROM f
        WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.a = f.a AND len(g.x) < len(f.x) AND list_has_all(f.x, g.x))) q_{table}"""


def each_table(t, run):
    out = None
    for name in WIDE:
        part = run(getattr(t, name), 2).select(F.lit(name).alias("table"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("d17_minimal_keys", " UNION ALL ".join(minimal_keys_sql(x) for x in WIDE))
def d17_minimal_keys(t):
    return each_table(t, la.minimal_keys)


@query("d17_dependencies", " UNION ALL ".join(dependencies_sql(x) for x in WIDE))
def d17_dependencies(t):
    return each_table(t, la.dependencies)


@query(
    "d19_multivalued_columns",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS values,
        round(count(*) FILTER (WHERE j) * 1.0 / count({c}), 4) AS json_share,
        round(count(*) FILTER (WHERE NOT j AND regexp_full_match(trim({c}), '[^,;|]+([,;|][^,;|]+)+')) * 1.0 / count({c}), 4) AS list_share
        FROM (SELECT {c}, (trim({c}) LIKE '{{%}}' OR trim({c}) LIKE '[%]') AND json_valid(trim({c})) AS j FROM {table}) x"""
        for table, c in (("events", "event_type"), ("events", "props"), ("documents", "text"), ("documents", "lang"), ("documents", "source"))
    ),
)
def d19_multivalued_columns(t):
    return kd.multivalued_columns(t.events).unionByName(kd.multivalued_columns(t.documents))


@query(
    "d20_schema_metrics",
    f"""SELECT count(DISTINCT "table") AS tables, count(*) AS columns, round(count(*) * 1.0 / count(DISTINCT "table"), 2) AS avg_columns,
        {sum(len(c) for c in KEYS.primary.values())} AS primary_keys, {len(KEYS.foreign)} AS foreign_keys,
        round({len(KEYS.foreign)} * 1.0 / count(DISTINCT "table"), 2) AS relationship_ratio,
        round(count(*) FILTER (WHERE type LIKE 'array%') * 1.0 / count(*), 2) AS nesting_ratio,
        CAST((SELECT sum(n) FROM (SELECT DISTINCT "table", row_count AS n FROM {_literal_catalog()}) r) AS BIGINT) AS rows FROM {_literal_catalog()}""",
)
def d20_schema_metrics(t):
    return cat.schema_metrics(catalog_frame(t.spark, t.every), KEYS, pf.table_row_counts(t.every))


def _valid_keys(t):
    return cat.verify_primary_keys(t.every, KEYS).where("holds")


def _holds_sql():
    return " UNION ALL ".join(
        f"""SELECT '{t}' AS tbl, '{", ".join(c)}' AS key, count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT {", ".join(c)} FROM {t}) d) AS distinct_count FROM {t}"""
        for t, c in KEYS.primary.items()
    )


@query("d21_verified_keys", f'SELECT tbl AS "table", key, row_count, distinct_count, row_count = distinct_count AS holds FROM ({_holds_sql()}) k')
def d21_verified_keys(t):
    return cat.verify_primary_keys(t.every, KEYS)


@query(
    "d21_schema_health",
    f"""SELECT CAST(greatest(0, 100 - 10 * count(*)) AS INT) AS score, count(*) AS findings
        FROM (SELECT DISTINCT "table" AS n FROM {_literal_catalog()}) x WHERE n NOT IN (SELECT tbl FROM ({_holds_sql()}) k WHERE row_count = distinct_count)""",
)
def d21_schema_health(t):
    return cat.schema_health(catalog_frame(t.spark, t.every), _valid_keys(t), foreign_key_frame(t.spark, KEYS))


@query(
    "d22_schema_recommendations",
    f"""SELECT 'clustering' AS kind, tbl AS "table", 'bucket by ' || col AS advice FROM {FK_VALUES}
        UNION ALL SELECT 'integrity', n, 'add a primary key' FROM (SELECT DISTINCT "table" AS n FROM {_literal_catalog()}) x
        WHERE n NOT IN (SELECT tbl FROM ({_holds_sql()}) k WHERE row_count = distinct_count)""",
)
def d22_schema_recommendations(t):
    return cat.schema_recommendations(catalog_frame(t.spark, t.every), _valid_keys(t), foreign_key_frame(t.spark, KEYS))


PK_VALUES = "(VALUES " + ", ".join(f"('{t}', '{c}')" for t, cols in KEYS.primary.items() for c in cols) + ") p(tbl, col)"


@query(
    "d23_data_dictionary",
    f"""SELECT c."table", c."column", c.type, c.ordinal, c.row_count, p.col IS NOT NULL AS is_pk, f.ref_tbl || '.' || f.ref_col AS refers_to, f.col IS NOT NULL AS is_fk
        FROM {_literal_catalog()} c LEFT JOIN {PK_VALUES} ON p.tbl = c."table" AND p.col = c."column"
        LEFT JOIN {FK_VALUES} ON f.tbl = c."table" AND f.col = c."column" """,
)
def d23_data_dictionary(t):
    return cat.data_dictionary(counted_catalog(t), KEYS)
