"""Queries for sources and sinks (2.1) and for recommendation, automation, batch and lineage (2.15)."""

from __future__ import annotations

import datetime as dt
import io
import os
import zipfile
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c, rnd, scratch_path
from cleanlake.operators import dedup as D
from cleanlake.operators import encode as E
from cleanlake.operators import missing as M
from cleanlake.operators import outliers as O
from cleanlake.operators import types as Y
from cleanlake.plans import lineage as L
from cleanlake.plans import prepare as PR
from cleanlake.plans import recommend as RC
from cleanlake.queries.fixtures import TABLES, ora, table
from cleanlake.queries.q_profile import _nocopy, od_rules, rounded
from cleanlake.queries.registry import query
from cleanlake.queries.sqltext import OD_NUM, R, prof, union
from cleanlake.sources import scan as SC
from cleanlake.sources import sink as SK

CU = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
cu = lambda s, d: table(s, d, "customer")
CSCHEMA = "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string"
wide = lambda df: df.select("c_custkey", "c_name", c("c_nationkey").cast("long").alias("c_nationkey"), "c_acctbal", "c_mktsegment")

# ---------------------------------------------------------------- sources and sinks


def _csv(s, d, sep=","):
    p = scratch_path(s, "csv")
    SK.sink_csv(cu(s, d), p, sep=sep)
    return wide(SC.scan_delimited(s, p, sep))


query("scan_delimited", CU)(_csv)


def _broken(s, d):
    p = scratch_path(s, "csv-lines")
    SK.sink_csv(table(s, d, "documents").select("doc_id", "text", "lang", "n_chars"), p)
    return SC.scan_delimited(s, p, schema="doc_id long, text string, lang string, n_chars long")


# texts with line breaks, quotes and separators survive the round trip
query("scan_delimited_line_breaks", "SELECT doc_id, nullif(text, '') AS text, nullif(lang, '') AS lang, n_chars FROM documents")(_broken)


def _tsv(s, d):
    p = scratch_path(s, "tsv")
    SK.sink_csv(cu(s, d), p, sep="\t")
    return wide(SC.scan_delimited(s, p, "\t", CSCHEMA))


query("scan_delimited_tab", CU)(_tsv)
query("scan_json", "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS \"props.k\" FROM events")(
    lambda s, d: SC.json_column(table(s, d, "events").select("event_id", "event_type", "props"), "props", "k long"))


def _json(s, d):
    p = scratch_path(s, "json")
    cu(s, d).select("c_custkey", F.struct("c_name", F.struct("c_nationkey", "c_acctbal").alias("more")).alias("info"), "c_mktsegment").write.json(p)
    t = SC.scan_json(s, p)
    return t.select("c_custkey", c("info.c_name").alias("c_name"), c("info.more.c_nationkey").alias("c_nationkey"), c("info.more.c_acctbal").alias("c_acctbal"), "c_mktsegment")


query("scan_json_nested", CU)(_json)
query("scan_parquet", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")(lambda s, d: SC.scan_parquet(s, f"{d}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderpriority"))


def _xml(s, d):
    p = scratch_path(s, "xml")
    cu(s, d).write.format("xml").option("rowTag", "customer").option("rootTag", "customers").save(p)
    return wide(SC.scan_xml(s, p, "customer"))


query("scan_xml", CU)(_xml)


def _write_archives(df: DataFrame, path: str) -> None:
    """One zip archive per partition, written by its task, with a CSV member per batch of rows."""
    path = path.removeprefix("file://")
    os.makedirs(path, exist_ok=True)

    def pack(batches):
        import uuid
        parts = [half.to_csv(index=False) for pdf in batches for half in (pdf.iloc[::2], pdf.iloc[1::2]) if len(half)]
        if parts:
            with zipfile.ZipFile(f"{path}/{uuid.uuid4().hex}.zip", "w", zipfile.ZIP_DEFLATED) as z:
                for i, part in enumerate(parts):
                    z.writestr(f"data{i}.csv", part)
        yield from ()

    df.mapInPandas(pack, df.schema).write.format("noop").mode("overwrite").save()


def _zip(s, d):
    p = scratch_path(s, "zip")
    _write_archives(cu(s, d).repartition(4, "c_custkey"), p)
    return SC.scan_zip_csv(s, p, CSCHEMA)


query("scan_zip_csv", CU)(_zip)


def _uri(s, d):
    p = scratch_path(s, "objects")
    SK.sink_csv(cu(s, d), p + "/customer.csv")
    cu(s, d).write.json(p + "/customer.json")
    cu(s, d).write.parquet(p + "/customer.parquet")
    root = p if "://" in p else "file://" + p
    parts = [wide(SC.scan_uri(s, f"{root}/customer.{x}")).withColumn("format", F.lit(x)) for x in ("csv", "json", "parquet")]
    return reduce(DataFrame.unionByName, parts)


query("scan_uri", " UNION ALL ".join(f"SELECT *, '{x}' AS format FROM ({CU})" for x in ("csv", "json", "parquet")))(_uri)


def _many(s, d):
    p = scratch_path(s, "many")
    names = ["customer", "orders", "part", "supplier"]
    for n in names:
        SK.sink_csv(table(s, d, n), f"{p}/{n}")
    return SC.many_totals(SC.scan_many(s, {n: f"{p}/{n}" for n in names}))


WIDTH = {"customer": 5, "orders": 6, "part": 6, "supplier": 4}
query("scan_many", union(WIDTH, lambda n: f"SELECT '{n}' AS \"table\", count(*) AS rows, CAST({WIDTH[n]} AS BIGINT) AS columns FROM {n}"))(_many)


def _orc(s, d):
    p = scratch_path(s, "orc")
    cu(s, d).write.orc(p)
    return wide(SC.scan_orc(s, p))


query("scan_orc", CU)(_orc)


def _guess(s, d):
    p = scratch_path(s, "guess")
    SK.sink_csv(cu(s, d), p, sep="|")
    return wide(SC.scan_text_guess(s, p))


query("scan_text_guess", CU)(_guess)


def _sinkcsv(s, d):
    p = scratch_path(s, "sink")
    SK.sink_csv(cu(s, d).select("c_custkey", "c_acctbal"), p, index_by=["c_acctbal", "c_custkey"])
    return SC.scan_delimited(s, p, schema="index long, c_custkey long, c_acctbal double")


query("sink_csv", "SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS index, c_custkey, c_acctbal FROM customer")(_sinkcsv)


def _sinkjson(s, d):
    p = scratch_path(s, "sink")
    SK.sink_json(table(s, d, "orders_dirty").select("o_orderkey", "copy", "o_totalprice", "o_orderpriority"), p)
    return SC.scan_json(s, p, schema="o_orderkey long, copy long, o_totalprice double, o_orderpriority string")


query("sink_json", ora("orders_dirty", "SELECT o_orderkey, CAST(copy AS BIGINT) AS copy, o_totalprice, o_orderpriority FROM orders_dirty"))(_sinkjson)


def _sinkparquet(s, d):
    p = scratch_path(s, "sink")
    SK.sink_parquet(table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), p, ["o_orderstatus"])
    return SC.scan_parquet(s, p)


query("sink_parquet", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")(_sinkparquet)


def _subset(s, d):
    o = table(s, d, "orders")
    cols = ["o_orderkey", "o_totalprice"]
    key = ["o_totalprice", "o_orderkey"]
    parts = [SK.subset(o, cols).withColumn("rows", F.lit("all")), SK.subset(o, cols, "first", 10, key).withColumn("rows", F.lit("first")),
             SK.subset(o, cols, "last", 10, key).withColumn("rows", F.lit("last")), SK.subset(o, cols, "range", order_by=key, span=(100, 120)).withColumn("rows", F.lit("range"))]
    return reduce(DataFrame.unionByName, parts)


OS = "SELECT o_orderkey, o_totalprice, '{0}' AS rows FROM orders"
query("sink_subset", OS.format("all") + " UNION ALL SELECT * FROM (" + OS.format("first") + " ORDER BY o_totalprice, o_orderkey LIMIT 10) UNION ALL SELECT * FROM (" + OS.format("last") + " ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10) UNION ALL SELECT * FROM (" + OS.format("range") + " ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 100)")(_subset)
query("sink_subset_random", "SELECT o_orderkey FROM orders ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), o_orderkey LIMIT 100")(lambda s, d: SK.subset(table(s, d, "orders"), ["o_orderkey"], "random", 100, ["o_orderkey"]))


def events_log(s, d):
    return table(s, d, "events").select("ts", F.col("event_type").alias("action"), F.col("props").alias("details"), F.concat(F.lit("user_"), F.col("user_id")).alias("table"))


query("sink_package")(lambda s, d: SK.sink_package(_nocopy(s, d), scratch_path(s, "package"), events_log(s, d)))


def _sinkbatch(s, d):
    tables = {"orders": _nocopy(s, d), "events": table(s, d, "events_gaps").drop("ts"), "geo": table(s, d, "customer_geo")}
    done, result = PR.batch(tables, ["remove_duplicates", "fill_numeric", "fill_mode"], 4, scratch_path(s, "batch"))
    return result


SB = {"orders": (9, "SELECT * EXCLUDE (copy) FROM orders_dirty"), "events": (5, "SELECT * EXCLUDE (ts) FROM events_gaps"), "geo": (6, "SELECT * FROM customer_geo")}
query("sink_batch", ora("orders_dirty events_gaps customer_geo", union(SB, lambda n: f"""SELECT '{n}' AS "table", 'completed' AS status, (SELECT count(*) FROM ({SB[n][1]})) AS rows_before, CAST({SB[n][0]} AS BIGINT) AS columns_before, count(*) AS rows_after,
  CAST({SB[n][0]} AS BIGINT) AS columns_after, 3 AS operations, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT * FROM ({SB[n][1]}))""")))(_sinkbatch)
T0 = dt.datetime(2024, 1, 1)


def uploads(s, d):
    names = ["customer", "orders", "part", "supplier", "lineitem", "events"]
    return reduce(DataFrame.unionByName, [L.upload_record(n, "Parquet" if i % 2 else "CSV", table(s, d, n), T0 + dt.timedelta(days=i)) for i, n in enumerate(names)])


UW = {"customer": 5, "orders": 6, "part": 6, "supplier": 4, "lineitem": 11, "events": 6}
UP = union(enumerate(UW), lambda p: f"SELECT '{p[1]}' AS source, '{'Parquet' if p[0] % 2 else 'CSV'}' AS source_type, count(*) AS rows, CAST({UW[p[1]]} AS BIGINT) AS columns, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {p[0]} DAY AS upload_date, 'Success' AS status FROM {p[1]}")
query("upload_totals", f"SELECT count(*) AS uploads, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(columns) AS BIGINT) AS columns, 7.5E0 * sum(columns) AS minutes_saved FROM ({UP})")(lambda s, d: L.upload_totals(uploads(s, d)))
query("upload_log_search", f"SELECT source, source_type, rows, columns, strftime(upload_date, '%Y-%m-%d') AS day, status FROM ({UP}) WHERE source_type = 'Parquet'")(
    lambda s, d: L.upload_search(uploads(s, d), "PARQUET").select("source", "source_type", "rows", "columns", F.date_format("upload_date", "yyyy-MM-dd").alias("day"), "status"))

# ---------------------------------------------------------------- recommendation
FIX = {"drop_column": 10, "knn_impute": 30, "winsorize": 20, "flag_outliers": 15, "convert_to_numeric": 10, "remove_duplicates": 5, "auto_scale": 25}
MISSA = "CASE WHEN 100.0 * nulls / n > 80 THEN 'drop_column' WHEN 100.0 * nulls / n > 50 THEN 'knn_impute' WHEN role <> 'numeric' THEN 'impute_most_frequent' WHEN abs(skew) > 1 THEN 'impute_median' ELSE 'impute_mean' END"
RULES = f"""SELECT 'missing_values' AS type, col AS "column", CASE WHEN 100.0 * nulls / n > 50 THEN 'high' ELSE 'medium' END AS severity, {R('100.0 * nulls / n')} AS value, {MISSA} AS action, true AS auto_fixable, CAST(CASE WHEN 100.0 * nulls / n > 80 THEN 10 WHEN 100.0 * nulls / n > 50 THEN 30 ELSE 15 END AS INT) AS minutes FROM prof WHERE nulls > 0
  UNION ALL SELECT 'outliers', col, CASE WHEN 100.0 * outl / (n - nulls) > 10 THEN 'high' ELSE 'medium' END, {R('100.0 * outl / (n - nulls)')}, CASE WHEN 100.0 * outl / (n - nulls) > 10 THEN 'winsorize' ELSE 'flag_outliers' END, true, CAST(CASE WHEN 100.0 * outl / (n - nulls) > 10 THEN 20 ELSE 15 END AS INT) FROM prof WHERE role = 'numeric' AND 100.0 * outl / (n - nulls) > 5
  UNION ALL SELECT 'data_types', col, 'medium', {R('100.0 * clean_ok / (n - nulls)')}, 'convert_to_numeric', true, 10 FROM prof WHERE role = 'text' AND clean_ok > 0.8 * (n - nulls)
  UNION ALL SELECT 'duplicates', 'all', CASE WHEN 100.0 * d / n > 10 THEN 'high' ELSE 'medium' END, {R('100.0 * d / n')}, 'remove_duplicates', true, 5 FROM tot WHERE d > 0
  UNION ALL SELECT 'scaling', 'numeric_features', 'medium', {R('max(std) / min(std)')}, 'auto_scale', true, 25 FROM prof WHERE std > 0 HAVING count(*) > 1 AND max(std) / min(std) > 10
  UNION ALL SELECT 'encoding', col, 'low', {R('uniq')}, CASE WHEN uniq <= 10 THEN 'onehot_encode' ELSE 'label_encode' END, true, 15 FROM prof WHERE role = 'text' AND uniq > 1"""
query("recommend_all", od_rules(RULES))(lambda s, d: rounded(RC.recommend_all(_nocopy(s, d))))
query("automation_summary", od_rules(f"SELECT count(*) AS total, count(*) FILTER (WHERE auto_fixable) AS auto_fixable, count(*) FILTER (WHERE severity = 'high') AS high_severity, CAST(sum(minutes) AS BIGINT) AS minutes_saved, {R('100.0 * count(*) FILTER (WHERE auto_fixable) / count(*)')} AS coverage_pct FROM ({RULES})"))(
    lambda s, d: rounded(RC.summary(RC.recommend_all(_nocopy(s, d)))))
WSX = r"[\s\x0B\x{0085}\p{Z}]"
TXTI = lambda x: f"""SELECT 'text_cleaning' AS analysis, '{x}' AS "column", 'medium' AS severity, 'clean' AS action, CAST(NULL AS DOUBLE) AS value FROM od HAVING max(regexp_matches({x}, '{WSX}{{2,}}')) OR max(regexp_matches({x}, '[^\\p{{L}}\\p{{N}}_\\s\\x0B\\x{{0085}}\\p{{Z}}]')) OR (max(regexp_matches({x}, '\\p{{Ll}}') AND NOT regexp_matches({x}, '\\p{{Lu}}')) AND max(regexp_matches({x}, '\\p{{Lu}}') AND NOT regexp_matches({x}, '\\p{{Ll}}')))"""
ISSUES = f"""SELECT 'data_types' AS analysis, col AS "column", 'medium' AS severity, 'to_numeric' AS action, {R('100.0 * num_ok / n')} AS value FROM prof WHERE role = 'text' AND num_ok > 0.7 * n
  UNION ALL SELECT 'data_types', col, 'medium', 'to_datetime', {R('100.0 * date_ok / n')} FROM prof WHERE role = 'text' AND date_ok > 0.5 * n
  UNION ALL SELECT 'missing_values', col, CASE WHEN 100.0 * nulls / n > 30 THEN 'high' WHEN 100.0 * nulls / n > 10 THEN 'medium' ELSE 'low' END, CASE WHEN role = 'numeric' THEN 'median' ELSE 'mode' END, {R('100.0 * nulls / n')} FROM prof WHERE nulls > 0
  UNION ALL SELECT 'outliers', col, CASE WHEN 100.0 * outl / n > 10 THEN 'high' WHEN 100.0 * outl / n > 5 THEN 'medium' ELSE 'low' END, CASE WHEN 100.0 * outl / n < 5 THEN 'cap' ELSE 'remove' END, {R('100.0 * outl / n')} FROM prof WHERE outl > 0
  UNION ALL SELECT 'categorical', col, 'high', CASE WHEN uniq <= 10 THEN 'onehot' ELSE 'label' END, {R('uniq')} FROM prof WHERE role = 'text' AND uniq > 1 AND 1.0 * uniq / n < 0.5
  UNION ALL SELECT 'duplicates', 'all', CASE WHEN d > 0.1 * n THEN 'high' ELSE 'medium' END, 'remove', {R('100.0 * d / n')} FROM tot WHERE d > 0
  UNION ALL SELECT 'scaling', col, 'medium', 'scale', {R('mx - mn')} FROM prof WHERE role = 'numeric' AND (SELECT max(mx - mn) / min(mx - mn) FROM prof WHERE mx > mn) > 100
  UNION ALL {' UNION ALL '.join(TXTI(x) for x in ('o_orderstatus', 'o_orderpriority', 'price_text', 'flag_text', 'date_text'))}"""
query("recommend_column_issues", od_rules(ISSUES))(lambda s, d: rounded(RC.column_issues(_nocopy(s, d))))
query("treatment_order", od_rules(f"SELECT analysis, count(*) AS columns, CAST(list_position(['data_types', 'duplicates', 'missing_values', 'outliers', 'text_cleaning', 'categorical', 'scaling'], analysis) AS INT) AS priority FROM ({ISSUES}) GROUP BY analysis"))(
    lambda s, d: RC.treatment_order(RC.column_issues(_nocopy(s, d))))
query("overview_fix_list", od_rules("""SELECT 'encode' AS issue, count(*) AS count, 'medium' AS priority FROM prof WHERE role = 'text' HAVING count(*) > 0 UNION ALL SELECT 'outliers', CAST(sum(outl) AS BIGINT), 'medium' FROM prof HAVING sum(outl) > 0
  UNION ALL SELECT 'missing', CAST(sum(nulls) AS BIGINT), 'high' FROM prof HAVING sum(nulls) > 0 UNION ALL SELECT 'duplicates', d, 'medium' FROM dup WHERE d > 0"""))(lambda s, d: RC.fix_list(_nocopy(s, d)))


def _applied(s, d):
    df = _nocopy(s, d).select("o_orderkey", "o_totalprice", "o_orderpriority", "price_text", "o_orderstatus")
    for action, col in [("remove_duplicates", "all"), ("impute_mean", "o_totalprice"), ("impute_most_frequent", "o_orderpriority"), ("convert_to_numeric", "price_text"), ("onehot_encode", "o_orderstatus")]:
        df = RC.apply_recommendation(df, action, col)
    return rounded(df)


APPLY = """WITH t AS (SELECT DISTINCT o_orderkey, o_totalprice, o_orderpriority, price_text, o_orderstatus FROM orders_dirty)"""
query("apply_recommendation", ora("orders_dirty", f"""{APPLY} SELECT o_orderkey, {R('coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM t))')} AS o_totalprice, coalesce(o_orderpriority, (SELECT o_orderpriority FROM t WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority,
  {R("TRY_CAST(replace(price_text, '$', '') AS DOUBLE)")} AS price_text, {', '.join(f"CAST(o_orderstatus = '{v}' AS INT) AS o_orderstatus_{v}" for v in 'FOP')} FROM t"""))(_applied)
MODE_OF = lambda t, x: f"(SELECT {x} FROM {t} WHERE {x} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
# the price text has missing values only once it is a number, and the columns differ in scale only once there are indicators: these rules come from the profiles after those steps
query("apply_all", ora("orders_dirty", f"""WITH t AS (SELECT o_totalprice, o_orderpriority, TRY_CAST(replace(price_text, '$', '') AS DOUBLE) AS price FROM orders_dirty),
  f AS (SELECT DISTINCT coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM t)) AS total, coalesce(o_orderpriority, {MODE_OF('t', 'o_orderpriority')}) AS o_orderpriority, coalesce(price, (SELECT avg(price) FROM t)) AS price FROM t)
  SELECT {R('(total - (SELECT min(total) FROM f)) / (SELECT max(total) - min(total) FROM f)')} AS o_totalprice, {R('(price - (SELECT min(price) FROM f)) / (SELECT max(price) - min(price) FROM f)')} AS price_text,
  {', '.join(f"CAST(o_orderpriority = '{v}' AS INT) + 0.0E0 AS \"o_orderpriority_{v}\"" for v in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'))} FROM f"""))(
    lambda s, d: rounded(RC.apply_all(_nocopy(s, d).select("o_totalprice", "o_orderpriority", F.concat("price_text", F.lit("")).alias("price_text")))[0]))
FX = lambda x: f"greatest((SELECT quantile_cont({x}, 0.25) - 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) FROM t), least((SELECT quantile_cont({x}, 0.75) + 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) FROM t), {x}))"
query("auto_fix", ora("orders_dirty", f"""WITH f AS (SELECT o_orderkey, o_custkey, coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_dirty)) AS o_totalprice, coalesce(o_orderpriority, (SELECT o_orderpriority FROM orders_dirty WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM orders_dirty), t AS (SELECT DISTINCT * FROM f)
  SELECT {R(FX('o_orderkey'))} AS o_orderkey, {R(FX('o_custkey'))} AS o_custkey, {R(FX('o_totalprice'))} AS o_totalprice, o_orderpriority FROM t"""))(
    lambda s, d: rounded(RC.auto_fix(_nocopy(s, d).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"))))
query("explain_column", od_rules(f"""SELECT col AS "column", 'missing_values' AS issue, {R('100.0 * nulls / n')} AS value, CASE WHEN 100.0 * nulls / n > 50 THEN 'high' WHEN 100.0 * nulls / n > 20 THEN 'medium' ELSE 'low' END AS impact, {R('CASE WHEN 100.0 * nulls / n > 50 THEN 0.3 WHEN 100.0 * nulls / n > 20 THEN 0.7 ELSE 0.9 END')} AS confidence FROM prof WHERE nulls > 0
  UNION ALL SELECT col, 'outliers', {R('100.0 * outl / n')}, CASE WHEN 100.0 * outl / n > 10 THEN 'high' WHEN 100.0 * outl / n > 5 THEN 'medium' ELSE 'low' END, {R('CASE WHEN 100.0 * outl / n > 10 THEN 0.8 WHEN 100.0 * outl / n > 5 THEN 0.7 ELSE 0.9 END')} FROM prof WHERE outl > 0
  UNION ALL SELECT col, 'data_types', {R('100.0 * greatest(num_ok, date_ok) / (n - nulls)')}, CASE WHEN 100.0 * greatest(num_ok, date_ok) / (n - nulls) > 90 THEN 'high' ELSE 'medium' END, {R('1.0 * greatest(num_ok, date_ok) / (n - nulls)')} FROM prof WHERE role = 'text' AND 100.0 * greatest(num_ok, date_ok) / (n - nulls) > 50
  UNION ALL SELECT col, 'scaling', {R('mx - mn')}, CASE WHEN mx - mn > 1000 THEN 'high' WHEN mx - mn > 100 THEN 'medium' ELSE 'low' END, {R('0.8')} FROM prof WHERE mx > mn"""))(lambda s, d: rounded(RC.explain_column(_nocopy(s, d))))


def _prepare(s, d):
    df = table(s, d, "orders_dirty").select("o_orderkey", "copy", "o_orderdate", "o_totalprice", "o_orderpriority", "price_text", "flag_text")
    out, _ = PR.prepare(df, ["o_orderkey", "copy"], ["duplicates", "missing", "outliers", "text", "datetime", "encoding", "scaling"])
    return rounded(out.drop("o_orderdate"), 5)


PREP = "f AS (SELECT o_orderkey, copy, o_orderdate, coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_dirty)) AS x, coalesce(o_orderpriority, (SELECT o_orderpriority FROM orders_dirty WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority, price_text, flag_text FROM orders_dirty)"
query("auto_prepare", ora("orders_dirty", f"""WITH {PREP}, b AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM f), c AS (SELECT *, greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), x)) AS y FROM f, b), m AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM c), p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT lower(price_text) AS v FROM f))
  SELECT o_orderkey, copy, {R('(y - m) / s', 5)} AS o_totalprice, {', '.join(f"CAST(lower(o_orderpriority) = '{v}' AS INT) AS \"o_orderpriority_{v}\"" for v in ('1-urgent', '2-high', '3-medium', '4-not specified', '5-low'))}, code AS price_text, {', '.join(f"CAST(lower(flag_text) = '{v}' AS INT) AS flag_text_{v}" for v in ('n', 'no', 'yes'))},
  CAST(year(o_orderdate) AS INT) AS o_orderdate_year, CAST(month(o_orderdate) AS INT) AS o_orderdate_month, CAST(isodow(o_orderdate) - 1 AS INT) AS o_orderdate_weekday FROM c JOIN p ON v = lower(price_text), m"""))(_prepare)

# ---------------------------------------------------------------- batch
BT = {"orders": "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders_dirty", "events": "SELECT user_id, value, event_type_n FROM events_gaps", "geo": "SELECT c_mktsegment, latitude, longitude FROM customer_geo"}


def _tables(s, d):
    return {"orders": table(s, d, "orders_dirty").select("o_orderkey", "o_totalprice", "o_orderpriority"), "events": table(s, d, "events_gaps").select("user_id", "value", "event_type_n"),
            "geo": table(s, d, "customer_geo").select("c_mktsegment", "latitude", "longitude")}


BRUN = union(BT, lambda n: f"SELECT '{n}' AS \"table\", 'completed' AS status, (SELECT count(*) FROM ({BT[n]})) AS rows_before, CAST(3 AS BIGINT) AS columns_before, count(*) AS rows_after, CAST(3 AS BIGINT) AS columns_after, 2 AS operations, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT * FROM ({BT[n]})) t WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in BT[n].split(" FROM ")[0][7:].split(", ")))
query("batch_run", ora("orders_dirty events_gaps customer_geo", BRUN))(lambda s, d: PR.batch(_tables(s, d), ["remove_duplicates", "drop_missing"])[1])
query("batch_estimate", ora("orders_dirty events_gaps customer_geo", union(BT, lambda n: f"SELECT '{n}' AS \"table\", count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({BT[n]}))) AS duplicates, " + " + ".join(f"count(*) - count({x})" for x in BT[n].split(" FROM ")[0][7:].split(", ")) + " AS missing, 2 AS numeric_columns, 1 AS text_columns FROM (" + BT[n] + ")")))(
    lambda s, d: PR.batch_estimate(_tables(s, d)))
query("batch_summary", ora("orders_dirty events_gaps customer_geo", f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS successful, count(*) FILTER (WHERE status = 'failed') AS failed, {R('100.0')} AS success_rate FROM ({BRUN})"))(
    lambda s, d: rounded(PR.batch_summary(PR.batch(_tables(s, d), ["remove_duplicates", "drop_missing"])[1])))

# ---------------------------------------------------------------- log
query("log_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase') AND CAST(ts AS DATE) = DATE '2024-01-05'")(
    lambda s, d: L.log_filter(table(s, d, "events"), ["click", "purchase"], "2024-01-05", action="event_type").select("event_id", "event_type"))
query("log_search", "SELECT event_id, props FROM events WHERE lower(props) LIKE '%7%' OR lower(event_type) LIKE '%7%'")(lambda s, d: L.log_search(table(s, d, "events"), "7", ["props", "event_type"]).select("event_id", "props"))
query("log_action_counts", "SELECT event_type AS action, count(*) AS rows, event_type = (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_frequent FROM events GROUP BY 1")(lambda s, d: L.action_counts(events_log(s, d)))
query("log_hourly", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS rows FROM events GROUP BY 1")(lambda s, d: L.hourly(events_log(s, d)).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "rows"))
query("log_duration", "SELECT CAST(floor(epoch(max(ts) - min(ts))) AS BIGINT) AS seconds FROM events")(lambda s, d: L.duration(events_log(s, d)))
query("step_stats", f"""SELECT event_type AS action, count(*) AS actions, count(DISTINCT user_id) AS columns, CAST(NULL AS DOUBLE) AS completed_pct FROM events GROUP BY 1 UNION ALL SELECT 'all', count(*), count(DISTINCT user_id), {R("100.0 * count(DISTINCT event_type) FILTER (WHERE event_type IN ('click', 'view', 'purchase', 'refund')) / 4")} FROM events""")(
    lambda s, d: rounded(L.step_stats(events_log(s, d), column="table", steps=["click", "view", "purchase", "refund"])))
query("quality_report", od_rules(f"""SELECT 'overview' AS section, 'rows' AS item, {R('n')} AS value FROM tot UNION ALL SELECT 'overview', 'columns', {R('count(*)')} FROM prof UNION ALL SELECT 'overview', 'completeness', {R('100 - miss')} FROM tot UNION ALL SELECT 'uniqueness', 'duplicates', {R('d')} FROM tot UNION ALL SELECT 'uniqueness', 'unique', {R('n - d')} FROM tot
  UNION ALL SELECT 'missing', col, {R('nulls')} FROM prof WHERE nulls > 0 UNION ALL SELECT 'types', t, {R('count(*)')} FROM (SELECT CASE WHEN col IN ('o_orderkey', 'o_custkey') THEN 'bigint' WHEN col = 'o_totalprice' THEN 'double' WHEN role = 'datetime' THEN 'timestamp_ntz' ELSE 'string' END AS t FROM prof) GROUP BY t
  UNION ALL SELECT 'issues', 'over_30_pct_missing', {R('count(*) FILTER (WHERE 100.0 * nulls / n > 30)')} FROM prof UNION ALL SELECT 'issues', 'single_value', {R('count(*) FILTER (WHERE uniq <= 1)')} FROM prof UNION ALL SELECT 'issues', 'duplicate_rows', {R('CAST(d > 0 AS INT)')} FROM tot
  UNION ALL SELECT 'actions', event_type, {R('count(*)')} FROM events GROUP BY event_type"""))(lambda s, d: rounded(RC.quality_report(_nocopy(s, d), events_log(s, d))))
query("before_after_report", ora("orders_dirty", "SELECT count(*) AS rows_before, CAST(4 AS BIGINT) AS columns_before, (count(*) - count(o_totalprice)) + (count(*) - count(o_orderpriority)) AS missing_before, (SELECT count(*) FROM orders_dirty WHERE o_totalprice IS NOT NULL) AS rows_after, CAST(3 AS BIGINT) AS columns_after, CAST(0 AS BIGINT) AS missing_after FROM orders_dirty"))(
    lambda s, d: RC.before_after(table(s, d, "orders_dirty").select("o_orderkey", "copy", "o_totalprice", "o_orderpriority"), M.drop_rows(table(s, d, "orders_dirty").select("o_orderkey", "copy", "o_totalprice"), ["o_totalprice"])))
