"""Input tables and the "dirty" views: the given tables with deterministic defects planted in them.

Every view keeps all rows and whole texts of its table. The same text runs in Spark and in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

VIEWS = {
    # the whole table plus planted copies of every tenth row; nulls, numeric text, boolean text, mixed date formats;
    # key (o_orderkey, copy)
    "orders_dirty": """
SELECT o.o_orderkey, o.copy, o.o_custkey, o.o_orderstatus, o.o_orderdate,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_totalprice END AS o_totalprice,
       CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE o.o_orderpriority END AS o_orderpriority,
       CASE WHEN o.o_orderkey % 13 = 0 THEN 'n/a'
            ELSE concat('$', CAST(CAST(floor(o.o_totalprice) AS BIGINT) AS VARCHAR(20))) END AS price_text,
       CASE WHEN o.o_orderkey % 4 < 2 THEN 'Yes' WHEN o.o_orderkey % 4 = 2 THEN 'no' ELSE 'N' END AS flag_text,
       CASE WHEN o.o_orderkey % 17 = 0 THEN 'unknown'
            WHEN o.o_orderkey % 3 = 0 THEN concat(substr(CAST(o.o_orderdate AS VARCHAR(40)), 9, 2), '/',
                 substr(CAST(o.o_orderdate AS VARCHAR(40)), 6, 2), '/', substr(CAST(o.o_orderdate AS VARCHAR(40)), 1, 4))
            ELSE substr(CAST(o.o_orderdate AS VARCHAR(40)), 1, 10) END AS date_text
FROM (SELECT *, 0 AS copy FROM orders UNION ALL SELECT *, 1 AS copy FROM orders WHERE o_orderkey % 10 = 0) o""",
    # runs of nulls in an ordered series; key event_id
    "events_gaps": """
SELECT event_id, ts, user_id, event_type,
       CASE WHEN event_id % 9 IN (0, 1, 2) THEN NULL ELSE value END AS value,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_type END AS event_type_n
FROM events""",
    # invalid and missing coordinates; key c_custkey
    "customer_geo": """
SELECT c_custkey, c_name, c_mktsegment, c_acctbal,
       CASE WHEN c_custkey % 17 = 0 THEN NULL
            WHEN c_custkey % 23 = 0 THEN 95.0E0
            ELSE 25.0E0 + (c_custkey * 37 % 2400) / 100.0E0 END AS latitude,
       CASE WHEN c_custkey % 29 = 0 THEN -190.0E0
            ELSE -125.0E0 + (c_custkey * 53 % 5900) / 100.0E0 END AS longitude
FROM customer""",
    # valid coordinates for suppliers, the other side of the spatial join; key s_suppkey
    "supplier_geo": """
SELECT s_suppkey, s_name,
       25.0E0 + (s_suppkey * 91 % 2400) / 100.0E0 AS s_lat,
       -125.0E0 + (s_suppkey * 157 % 5900) / 100.0E0 AS s_lon
FROM supplier""",
    # white space, URL, e-mail, phone, HTML, curly quotes around the whole text; key doc_id
    "text_dirty": """
SELECT doc_id, lang,
       concat(CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE '' END, text,
              CASE WHEN doc_id % 3 = 0 THEN ' see http://example.org/a?b=1 ' ELSE ' ' END,
              CASE WHEN doc_id % 5 = 0 THEN 'mail a.b@example.com' ELSE '' END,
              CASE WHEN doc_id % 7 = 0 THEN ' 555-123-4567' ELSE '' END,
              CASE WHEN doc_id % 11 = 0 THEN ' <b>bold</b>' ELSE '' END,
              CASE WHEN doc_id % 13 = 0 THEN ' it’s “so”  so so don''t' ELSE '' END) AS text
FROM documents""",
    # misspelt names; key p_partkey
    "part_typos": """
SELECT p_partkey, p_brand, p_name,
       CASE WHEN p_partkey % 3 = 0 THEN upper(p_name)
            WHEN p_partkey % 3 = 1 THEN concat(p_name, 's')
            ELSE p_name END AS p_name_typo
FROM part""",
    # a numeric table with nulls for the imputers and model-like operators; key l_orderkey, l_linenumber, l_partkey
    "lineitem_gaps": """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
       CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
       CASE WHEN l_orderkey % 20 = 0 THEN NULL ELSE l_discount END AS l_discount, l_tax, l_returnflag
FROM lineitem""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in VIEWS:
        return view(spark, sf_dir, name)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tables_in(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    frames = {}
    for t in _tables_in(sql):
        sql = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", sql)
        frames[t] = table(spark, sf_dir, t)
    return spark.sql(sql, **frames)


def ora(views: str, body: str) -> str:
    """DuckDB text: named dirty views as leading CTEs, then the body (which may bring its own WITH)."""
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views.split() if v in VIEWS)
    body = body.strip()
    if not head:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
