"""Queries on profiles, schemas, sources and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from countercheck.operators import files, profile, schema_diff
from countercheck.queries import derived as D
from countercheck.sinks import storage
from countercheck.sources.flatten import flatten
from countercheck.sources.load import Source, load

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
STATS = ("min", "max", "mean", "median", "stddev")


def _profile(df):
    rows = profile.profile(df)
    return rows.select(
        "column", "distinct_count", "null_count", "null_percent", *[F.round(c, 4).alias(c) for c in STATS]
    )


def profile_orders(spark, folder):
    return _profile(D.target_orders(spark, folder))


def profile_lineitem(spark, folder):
    return _profile(D.table(spark, folder, "lineitem"))


def _profile_sql(table: str, columns: dict[str, str], head: str = "") -> str:
    """``columns``: how each column becomes a number."""
    numbers = {
        "number": "CAST({c} AS DOUBLE)",
        "text": "CASE WHEN regexp_matches({c}, '" + NUMBER + "') THEN TRY_CAST(trim({c}) AS DOUBLE) END",
        "none": "CAST(NULL AS DOUBLE)",
    }
    blocks = []
    for c, kind in columns.items():
        x = numbers[kind].format(c=c)
        blocks.append(
            f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_count,
  count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*) * 100.0, 4) AS null_percent,
  round(min({x}), 4) AS min, round(max({x}), 4) AS max, round(avg({x}), 4) AS mean,
  round(median({x}), 4) AS median, round(stddev_samp({x}), 4) AS stddev FROM {table}"""
        )
    return head + " UNION ALL ".join(blocks)


def profile_top(spark, folder):
    """The three most frequent values of every column of part."""
    rows = profile.top_values(D.table(spark, folder, "part"), top_n=3)
    return rows.withColumn("place", F.col("place").cast("bigint"))


def _top_sql() -> str:
    blocks = [
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS frequency,
  row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS place
FROM part WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY place <= 3"""
        for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    ]
    return " UNION ALL ".join(f"({b})" for b in blocks)


def profile_semantic(spark, folder):
    """Customers with contact columns: meanings of every kind."""
    df = D.table(spark, folder, "customer").select(
        "*",
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None))
        .otherwise(F.concat(F.regexp_replace("c_name", "#", "."), F.lit("@example.com")))
        .alias("email"),
        F.concat(F.lit("+1 ("), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.lit(") 555-0100")).alias("phone"),
        (F.col("c_acctbal") > 0).alias("solvent"),
        F.lit("2024-01-01").cast("date").alias("since"),
        F.lit(None).cast("string").alias("fax"),
    )
    return profile.profile(df).select("column", "distinct_count", "semantic_type")


SEMANTIC_SQL = r"""WITH c AS (
  SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE replace(c_name, '#', '.') || '@example.com' END AS email,
         '+1 (' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || ') 555-0100' AS phone FROM customer
), n AS (SELECT count(*) AS total FROM c)
SELECT 'c_custkey' AS "column", count(DISTINCT c_custkey) AS distinct_count,
       CASE WHEN count(DISTINCT c_custkey) > 0.95 * count(*) THEN 'NUMERIC_ID' ELSE 'NUMERIC' END AS semantic_type FROM c
UNION ALL SELECT 'c_name', count(DISTINCT c_name),
       CASE WHEN count(DISTINCT c_name) > 0.95 * count(*) THEN 'IDENTIFIER' ELSE 'FREE_TEXT' END FROM c
UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey),
       CASE WHEN count(DISTINCT c_nationkey) > 0.95 * count(*) THEN 'NUMERIC_ID' ELSE 'NUMERIC' END FROM c
UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal),
       CASE WHEN count(DISTINCT c_acctbal) > 0.95 * count(*) THEN 'NUMERIC_ID' ELSE 'NUMERIC' END FROM c
UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment),
       CASE WHEN count(DISTINCT c_mktsegment) > 0.95 * count(*) THEN 'IDENTIFIER' ELSE 'FREE_TEXT' END FROM c
UNION ALL SELECT 'email', count(DISTINCT email),
       CASE WHEN avg(CASE WHEN regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN 1 WHEN email IS NULL THEN NULL ELSE 0 END) >= 0.8
            THEN 'EMAIL' ELSE 'FREE_TEXT' END FROM c
UNION ALL SELECT 'phone', count(DISTINCT phone),
       CASE WHEN avg(CASE WHEN regexp_matches(phone, '^\+?[\d\-().\s]{7,20}$') THEN 1 ELSE 0 END) >= 0.8
            THEN 'PHONE' ELSE 'FREE_TEXT' END FROM c
UNION ALL SELECT 'solvent', count(DISTINCT c_acctbal > 0), 'BOOLEAN' FROM c
UNION ALL SELECT 'since', least(count(*), 1), 'DATE' FROM c
UNION ALL SELECT 'fax', count(NULL), 'UNKNOWN' FROM c"""


def _catalogs(spark, folder):
    mine = {"customer": D.table(spark, folder, "customer"), "part": D.table(spark, folder, "part")}
    theirs = {"CUSTOMER": D.other_customer(spark, folder), "part": mine["part"]}
    return (
        D.observed_catalog(spark, mine, {"customer": "c_custkey", "part": "p_partkey"}),
        D.observed_catalog(spark, theirs, {"CUSTOMER": "c_custkey", "part": "p_name"}),
    )


def schema_status(spark, folder):
    diff = schema_diff.schema_diff(*_catalogs(spark, folder))
    return diff.select(
        "table_name", "column", "source_position", "target_position",
        "source_type", "target_type", "status", "source_length", "target_length",
    )


def schema_attributes(spark, folder):
    diff = schema_diff.schema_diff(*_catalogs(spark, folder))
    return diff.select("table_name", "column", "length_match", "source_key", "target_key", "key_match", "default_match")


def schema_summary(spark, folder):
    return schema_diff.schema_summary(schema_diff.schema_diff(*_catalogs(spark, folder)))


# The structure is fixed; lengths and keys are measured on the whole tables.
SCHEMA_SQL = f"""WITH {D.OTHER_CUSTOMER_SQL}, s(table_name, "column", p, ty, len, pk) AS (
  SELECT 'customer', 'c_custkey', 0, 'INTEGER', NULL, count(DISTINCT c_custkey) = count(*) FROM customer
  UNION ALL SELECT 'customer', 'c_name', 1, 'STRING', max(length(c_name)), false FROM customer
  UNION ALL SELECT 'customer', 'c_nationkey', 2, 'INTEGER', NULL, false
  UNION ALL SELECT 'customer', 'c_acctbal', 3, 'FLOAT', NULL, false
  UNION ALL SELECT 'customer', 'c_mktsegment', 4, 'STRING', max(length(c_mktsegment)), false FROM customer
  UNION ALL SELECT 'part', 'p_partkey', 0, 'INTEGER', NULL, count(DISTINCT p_partkey) = count(*) FROM part
  UNION ALL SELECT 'part', 'p_name', 1, 'STRING', max(length(p_name)), false FROM part
  UNION ALL SELECT 'part', 'p_brand', 2, 'STRING', max(length(p_brand)), false FROM part
  UNION ALL SELECT 'part', 'p_type', 3, 'STRING', max(length(p_type)), false FROM part
  UNION ALL SELECT 'part', 'p_size', 4, 'INTEGER', NULL, false
  UNION ALL SELECT 'part', 'p_retailprice', 5, 'FLOAT', NULL, false
), t(table_name, "column", p, ty, len, pk) AS (
  SELECT 'customer', 'c_custkey', 0, 'INTEGER', NULL, count(DISTINCT c_custkey) = count(*) FROM other_customer
  UNION ALL SELECT 'customer', 'c_acctbal', 1, 'FLOAT', NULL, false
  UNION ALL SELECT 'customer', 'c_name', 2, 'STRING', max(length(c_name)), false FROM other_customer
  UNION ALL SELECT 'customer', 'c_nationkey', 3, 'STRING', max(length(c_nationkey)), false FROM other_customer
  UNION ALL SELECT 'customer', 'segment', 4, 'STRING', max(length(segment)), false FROM other_customer
  UNION ALL SELECT table_name, "column", p, ty, len, false FROM s WHERE table_name = 'part' AND "column" <> 'p_name'
  UNION ALL SELECT 'part', 'p_name', 1, 'STRING', max(length(p_name)), count(DISTINCT p_name) = count(*) FROM part
), diff AS (
  SELECT coalesce(s.table_name, t.table_name) AS table_name, coalesce(s."column", t."column") AS "column",
         CAST(s.p AS INTEGER) AS source_position, CAST(t.p AS INTEGER) AS target_position,
         s.ty AS source_type, t.ty AS target_type,
         CASE WHEN t."column" IS NULL THEN 'MISSING_IN_TARGET' WHEN s."column" IS NULL THEN 'EXTRA_IN_TARGET'
              WHEN s.ty <> t.ty THEN 'TYPE_MISMATCH' WHEN s.p <> t.p THEN 'POSITION_MISMATCH'
              ELSE 'MATCH' END AS status,
         CAST(s.len AS BIGINT) AS source_length, CAST(t.len AS BIGINT) AS target_length,
         s.pk AS source_key, t.pk AS target_key,
         CASE WHEN s."column" IS NOT NULL AND t."column" IS NOT NULL THEN s.len IS NOT DISTINCT FROM t.len END AS length_match,
         CASE WHEN s."column" IS NOT NULL AND t."column" IS NOT NULL THEN s.pk = t.pk END AS key_match,
         s."column" = t."column" AS default_match  -- files have no defaults, so all agree
  FROM s FULL OUTER JOIN t ON s.table_name = t.table_name AND s."column" = t."column"
)"""


def check_plan(spark, folder):
    """Checks suggested by what the tables show: keys, and columns never NULL."""
    tables = {
        "customer": D.gappy_customer(spark, folder),
        "orders": D.target_orders(spark, folder),
        "documents": D.table(spark, folder, "documents"),
    }
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "documents": "text"}
    catalog = D.observed_catalog(spark, tables, keys)
    plan = schema_diff.plan_checks(spark, catalog, ["Orders", "customer", "ORDERS", "documents", "gone"])
    lists = ("check_columns", "key_columns", "null_check_columns")
    return plan.select(
        "table_name", "module", *[F.array_join(c, ",").alias(c) for c in lists], "error"
    )


def _check_plan_sql() -> str:
    tables = {
        "customer": ("gappy", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "c_custkey"),
        "orders": ("target", ["o_orderkey", *D.ORDER_COLUMNS], "o_orderkey"),
        "documents": ("documents", ["doc_id", "text", "lang", "source", "n_chars"], "text"),
    }
    blocks = [
        f"""SELECT '{name}' AS table_name, {i} AS p, '{c}' AS c, count(*) > count({c}) AS nullable,
  {f"count(DISTINCT {c}) = count(*)" if c == key else "false"} AS pk FROM {view}"""
        for name, (view, columns, key) in tables.items()
        for i, c in enumerate(columns)
    ]
    listed = {
        "check_columns": "true",
        "key_columns": "module = 'DUPLICATE' AND pk",
        "null_check_columns": "module = 'NULLABILITY' AND NOT nullable",
    }
    lists = ", ".join(
        f"coalesce(string_agg(c, ',' ORDER BY p) FILTER (WHERE {cond}), '') AS {name}"
        for name, cond in listed.items()
    )
    return f"""WITH {D.TARGET_ORDERS_SQL}, {D.GAPPY_CUSTOMER_SQL}, cat AS ({' UNION ALL '.join(blocks)})
SELECT table_name, module, {lists}, CAST(NULL AS VARCHAR) AS error
FROM cat, (SELECT unnest(['SCHEMA', 'RECORD_COUNT', 'DUPLICATE', 'NULLABILITY']) AS module) m
GROUP BY table_name, module
UNION ALL SELECT 'gone', NULL, '', '', '', 'No catalog metadata for this table.'"""


def source_nested_flatten(spark, folder):
    events = D.table(spark, folder, "events")
    parsed = events.select("event_id", F.from_json("props", "k bigint").alias("props"))
    return flatten(parsed)


def source_parquet(spark, folder):
    """Two columns, named in another case; only they are read."""
    path = f"{folder}/lineitem.parquet"
    return load(spark, Source(path=path, columns=["L_ORDERKEY", "l_Quantity"]))


#: Rows of a CSV or XML file that is written here. One task reads such a file from start to end.
FILE_ROWS = 100_000


def _in_files(df):
    """A writer whose tasks and files are of bounded size, however the rows of ``df`` lie."""
    return df.hint("rebalance").write.option("maxRecordsPerFile", FILE_ROWS)


def _through(kind: str, options: dict, columns: dict[str, str], table: str, write):
    """Write a table in another format to the shared folder and load it."""

    def query(spark, folder):
        path = storage.new_folder(spark, kind)
        write(D.table(spark, folder, table).select(*columns), path)
        df = load(spark, Source(format=kind, path=path, options=options))
        return df.select([F.col(c).cast(t).alias(c) for c, t in columns.items()])

    return query


CUSTOMER = {
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int",
    "c_acctbal": "double", "c_mktsegment": "string",
}
EVENT = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}


def file_checksums(spark, folder):
    """Every given file against itself: the folder as source and as target."""
    sides = [files.checksums(files.list_files(spark, folder, "*.parquet")) for _ in range(2)]
    return files.compare_files(*sides)


QUERIES = {
    "profile": (
        profile_orders,
        _profile_sql(
            "target",
            {
                "o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text",
                "o_totalprice": "number", "o_orderdate": "none", "o_orderpriority": "text",
            },
            f"WITH {D.TARGET_ORDERS_SQL} ",
        ),
    ),
    "profile_lineitem": (
        profile_lineitem,
        _profile_sql(
            "lineitem",
            {
                **dict.fromkeys(
                    ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                     "l_extendedprice", "l_discount", "l_tax"),
                    "number",
                ),
                "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "none",
            },
        ),
    ),
    "profile_top": (profile_top, _top_sql()),
    "profile_semantic": (profile_semantic, SEMANTIC_SQL),
    "schema_diff": (
        schema_status,
        f"""{SCHEMA_SQL} SELECT table_name, "column", source_position, target_position, source_type,
  target_type, status, source_length, target_length FROM diff""",
    ),
    "schema_attributes": (
        schema_attributes,
        f'{SCHEMA_SQL} SELECT table_name, "column", length_match, source_key, target_key, key_match, default_match FROM diff',
    ),
    "schema_summary": (
        schema_summary,
        f"""{SCHEMA_SQL}, f AS (
  SELECT count(*) AS columns_compared,
         count(*) FILTER (WHERE status IN ('MISSING_IN_TARGET', 'EXTRA_IN_TARGET', 'TYPE_MISMATCH')) AS mismatches,
         count(*) FILTER (WHERE NOT length_match OR NOT key_match) AS attribute_mismatches FROM diff
) SELECT *, CASE WHEN mismatches + attribute_mismatches = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM f""",
    ),
    "check_plan": (check_plan, _check_plan_sql()),
    "source_nested_flatten": (
        source_nested_flatten,
        "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS \"props.k\" FROM events",
    ),
    "source_parquet": (source_parquet, "SELECT l_orderkey, l_quantity FROM lineitem"),
    "source_csv": (
        _through(
            "csv", {"delimiter": "|"}, CUSTOMER, "customer",
            lambda df, path: _in_files(df).csv(path, header=True, sep="|"),
        ),
        f"SELECT {', '.join(CUSTOMER)} FROM customer",
    ),
    "source_json": (
        _through("json", {}, EVENT, "events", lambda df, path: df.write.json(path)),
        f"SELECT {', '.join(EVENT)} FROM events",
    ),
    "source_xml": (
        _through(
            "xml", {"rowTag": "customer"}, CUSTOMER, "customer",
            lambda df, path: _in_files(df).option("rowTag", "customer").xml(path),
        ),
        f"SELECT {', '.join(CUSTOMER)} FROM customer",
    ),
    "file_checksums": (file_checksums, None),
}
