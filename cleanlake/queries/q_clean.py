"""Queries for types (2.4), duplicates (2.5), missing values (2.6), outliers (2.7) and related declared operators (2.16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanlake.core import rnd
from cleanlake.operators import dedup as D
from cleanlake.operators import fuzzy as Z
from cleanlake.operators import missing as M
from cleanlake.operators import outliers as O
from cleanlake.operators import types as Y
from cleanlake.queries.fixtures import ora, table
from cleanlake.queries.q_profile import OD_NC, _nocopy, od_rules, rounded
from cleanlake.queries.registry import query
from cleanlake.queries.sqltext import OD_ALL, OD_NUM, R, clean, isnum, od_prof, prof, todate, tonum, union

DTYPE = {"numeric": "bigint"}
TYPE_OF = "CASE col WHEN 'o_orderkey' THEN 'bigint' WHEN 'o_custkey' THEN 'bigint' WHEN 'copy' THEN 'int' WHEN 'o_totalprice' THEN 'double' WHEN 'o_orderdate' THEN 'timestamp_ntz' ELSE 'string' END"


def od(s, d):
    return table(s, d, "orders_dirty")


# ---------------------------------------------------------------- types
query("detect_types_strict", od_rules("""SELECT col AS "column", CASE WHEN role <> 'text' THEN 'keep_current' WHEN num_ok = n - nulls THEN 'numeric' WHEN date_ok = n - nulls THEN 'datetime'
  WHEN 1.0 * uniq / n < 0.1 THEN 'categorical' ELSE 'text' END AS suggestion FROM prof"""))(lambda s, d: Y.detect_strict(_nocopy(s, d)))
SUGGEST = """CASE WHEN role IN ('numeric', 'datetime') THEN TYPE_OF WHEN 1.0 * date_ok / (n - nulls) > 0.8 THEN 'datetime' WHEN 1.0 * num_ok / (n - nulls) > 0.8 THEN 'integer'
  WHEN uniq <= 3 AND bool_ok = n - nulls THEN 'boolean' ELSE 'category' END""".replace("TYPE_OF", TYPE_OF)
CONF = """CASE WHEN role IN ('numeric', 'datetime') THEN 0.9 WHEN 1.0 * date_ok / (n - nulls) > 0.8 THEN 1.0 * date_ok / (n - nulls) WHEN 1.0 * num_ok / (n - nulls) > 0.8 THEN 1.0 * num_ok / (n - nulls)
  WHEN uniq <= 3 AND bool_ok = n - nulls THEN 0.9 ELSE 0.7 END"""
query("detect_types_scored", od_rules(f"""SELECT col AS "column", {TYPE_OF} AS current, {SUGGEST} AS suggestion, {R(CONF)} AS confidence FROM prof"""))(
    lambda s, d: rounded(Y.detect_scored(_nocopy(s, d))))
query("detect_types_steps", od_rules("""SELECT col AS "column", CASE WHEN role = 'text' AND date_ok = n - nulls THEN 'datetime' WHEN uniq = 2 AND role = 'text' AND bool_ok = n - nulls THEN 'boolean'
  WHEN uniq = 2 AND role = 'numeric' AND mn = 0 AND mx = 1 THEN 'boolean' WHEN role = 'numeric' OR (role = 'text' AND num_ok = n - nulls) THEN 'numerical' ELSE 'categorical' END AS suggestion FROM prof"""))(
    lambda s, d: Y.detect_steps(_nocopy(s, d)))
query("detect_types_semantic", od_prof("""SELECT col AS "column", CASE WHEN role = 'numeric' AND col <> 'o_totalprice' THEN CASE WHEN uniq = 2 THEN 'Boolean (Numeric)' WHEN 1.0 * uniq / (n - nulls) < 0.05 THEN 'Categorical (Numeric)' ELSE 'Integer' END
  WHEN role = 'numeric' THEN 'Float' WHEN role = 'datetime' THEN 'DateTime' WHEN 1.0 * date_ok / (n - nulls) > 0.7 THEN 'Potential DateTime' WHEN bool_ok = n - nulls THEN 'Boolean (Text)'
  WHEN 1.0 * uniq / (n - nulls) < 0.05 THEN 'Categorical' WHEN contains(col, '_id') THEN 'ID Column' ELSE 'Text' END AS semantic_type FROM prof"""))(
    lambda s, d: Y.detect_semantic(od(s, d)))
query("detect_numeric_text", od_rules(f"""SELECT col AS "column", {R('1.0 * clean_ok / (n - nulls)')} AS rate FROM prof WHERE role = 'text' AND clean_ok > 0.8 * (n - nulls)"""))(
    lambda s, d: rounded(Y.detect_numeric_text(_nocopy(s, d))))
query("recommend_types", od_rules(f"""SELECT col AS "column", 'numeric' AS target, num_ok AS convertible, {R('1.0 * num_ok / n')} AS share FROM prof WHERE role = 'text' AND num_ok > 0.7 * n
  UNION ALL SELECT col, 'datetime', date_ok, {R('1.0 * date_ok / n')} FROM prof WHERE role = 'text' AND date_ok > 0.5 * n"""))(lambda s, d: rounded(Y.recommend_types(_nocopy(s, d))))
CONSIST = "CASE WHEN role = 'text' THEN greatest(num_ok, date_ok) * 1.0 / n ELSE 0.95 END"
query("convertibility", od_rules(f"""SELECT col AS "column", CASE WHEN role = 'text' THEN {R('1.0 * num_ok / n')} END AS numeric_rate, CASE WHEN role = 'text' THEN {R('1.0 * date_ok / n')} END AS datetime_rate,
  CASE WHEN role = 'text' THEN {R('1.0 * bool_ok / n')} END AS boolean_rate, {R(CONSIST)} AS consistency, CASE WHEN {CONSIST} > 0.8 THEN 'Good' WHEN {CONSIST} > 0.5 THEN 'Review' ELSE 'Convert' END AS label FROM prof"""))(
    lambda s, d: rounded(Y.convertibility(_nocopy(s, d))))
query("to_numeric", ora("orders_dirty", f"SELECT o_orderkey, copy, {tonum('price_text')} AS price_text, {tonum(clean('price_text'))} AS amount FROM orders_dirty"))(
    lambda s, d: Y.to_numeric(od(s, d).withColumn("amount", F.regexp_replace("price_text", "[,$%]", "")), ["price_text", "amount"]).select("o_orderkey", "copy", "price_text", "amount"))
query("to_numeric_clean", ora("orders_dirty", f"SELECT o_orderkey, copy, {tonum(clean('price_text'))} AS price_text FROM orders_dirty"))(
    lambda s, d: Y.to_numeric_clean(od(s, d), ["price_text"]).select("o_orderkey", "copy", "price_text"))
query("to_datetime_auto", ora("orders_dirty", f"SELECT o_orderkey, copy, {todate('date_text')} AS date_text FROM orders_dirty"))(
    lambda s, d: Y.to_datetime_auto(od(s, d), ["date_text"]).select("o_orderkey", "copy", "date_text"))
query("to_datetime_format", ora("orders_dirty", "SELECT o_orderkey, copy, try_strptime(date_text, '%d/%m/%Y') AS date_text FROM orders_dirty"))(
    lambda s, d: Y.to_datetime_format(od(s, d), ["date_text"], "%d/%m/%Y").select("o_orderkey", "copy", "date_text"))
query("to_datetime_multi", ora("orders_dirty", f"SELECT o_orderkey, copy, {todate('date_text', ['%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y', '%Y-%m-%d %H:%M:%S', '%m/%d/%Y %H:%M:%S'])} AS date_text FROM orders_dirty"))(
    lambda s, d: Y.to_datetime_multi(od(s, d), ["date_text"]).select("o_orderkey", "copy", "date_text"))
query("to_boolean", ora("orders_dirty", "SELECT o_orderkey, copy, CASE WHEN lower(flag_text) IN ('true','1','yes','y') THEN true WHEN lower(flag_text) IN ('false','0','no','n') THEN false END AS flag_text FROM orders_dirty"))(
    lambda s, d: Y.to_boolean(od(s, d), ["flag_text"]).select("o_orderkey", "copy", "flag_text"))
query("to_category", "SELECT o_orderkey, o_orderpriority FROM orders")(lambda s, d: Y.to_category(table(s, d, "orders"), ["o_orderpriority"]).select("o_orderkey", "o_orderpriority"))
query("to_string", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")(lambda s, d: Y.to_string(table(s, d, "orders"), ["o_custkey"]).select("o_orderkey", "o_custkey"))
query("to_int", ora("orders_dirty", f"SELECT o_orderkey, copy, CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice, CAST({tonum('price_text')} AS BIGINT) AS price_text FROM orders_dirty"))(
    lambda s, d: Y.to_int(od(s, d), ["o_totalprice", "price_text"]).select("o_orderkey", "copy", "o_totalprice", "price_text"))
query("apply_type_recommendations", ora("orders_dirty", f"SELECT o_orderkey, copy, {todate('date_text')} AS date_text, CASE WHEN lower(flag_text) IN ('yes','y') THEN true WHEN lower(flag_text) IN ('no','n') THEN false END AS flag_text, price_text FROM orders_dirty"))(
    lambda s, d: Y.apply_recommended(od(s, d))[0].select("o_orderkey", "copy", "date_text", "flag_text", "price_text"))

# ---------------------------------------------------------------- duplicates
LK = ["l_orderkey", "l_linenumber"]
LORD = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
LCOLS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
RN = lambda part, order: f"row_number() OVER (PARTITION BY {part} ORDER BY {order})"
LSEL = lambda df: df.select(*LCOLS.split(", "))
LO = ", ".join(LORD)
query("dup_exact_stats", ora("orders_dirty", f"""SELECT CAST(sum(k) AS BIGINT) AS rows, CAST(sum(k - 1) AS BIGINT) AS duplicates, {R('100.0 * sum(k - 1) / sum(k)')} AS pct, count(*) FILTER (WHERE k > 1) AS groups
  FROM (SELECT count(*) AS k FROM orders_dirty GROUP BY {', '.join(OD_NC)})"""))(lambda s, d: rounded(D.exact_stats(_nocopy(s, d))))
query("dup_rows", f"SELECT {LCOLS} FROM (SELECT *, {RN('l_orderkey, l_linenumber', LO)} AS rn FROM lineitem) WHERE rn > 1")(lambda s, d: LSEL(D.repeated_rows(table(s, d, "lineitem"), LK, LORD)))
query("dup_rows_all", f"SELECT {LCOLS} FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k > 1")(lambda s, d: LSEL(D.repeated_rows_all(table(s, d, "lineitem"), LK, LORD)))
query("dedup_first", f"SELECT {LCOLS} FROM (SELECT *, {RN('l_orderkey, l_linenumber', LO)} AS rn FROM lineitem) WHERE rn = 1")(lambda s, d: LSEL(D.keep_first(table(s, d, "lineitem"), LK, LORD)))
LOD = ", ".join(x + " DESC" for x in LORD)
query("dedup_last", f"SELECT {LCOLS} FROM (SELECT *, {RN('l_orderkey, l_linenumber', LOD)} AS rn FROM lineitem) WHERE rn = 1")(lambda s, d: LSEL(D.keep_last(table(s, d, "lineitem"), LK, LORD)))
query("dedup_none", f"SELECT {LCOLS} FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")(lambda s, d: LSEL(D.keep_none(table(s, d, "lineitem"), LK)))
DR = ["o_orderstatus", "o_orderpriority", "price_text"]
query("distinct_rows", ora("orders_dirty", f"""SELECT 'table' AS "column", count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(DR)} FROM orders_dirty)) AS distinct_values, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(DR)} FROM orders_dirty)) < count(*) AS has_repeats FROM orders_dirty
  UNION ALL """ + union(DR, lambda x: f"SELECT '{x}', count(*), count(DISTINCT {x}) + max(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END), count(DISTINCT {x}) + max(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END) < count(*) FROM orders_dirty")))(
    lambda s, d: D.distinct_stats(od(s, d), DR))
NAMES = "names AS (SELECT DISTINCT p_name_typo AS v FROM part_typos)"
SCORE = lambda a, b: f"(1.0 - levenshtein({a}, {b}) / CAST(greatest(length({a}), length({b})) AS DOUBLE)) * 100"
query("dup_fuzzy_pairs", ora("part_typos", f"""WITH {NAMES} SELECT a.v AS "left", b.v AS "right", {R(SCORE('a.v', 'b.v'))} AS score FROM names a JOIN names b ON a.v < b.v WHERE levenshtein(a.v, b.v) * 100 <= 20 * greatest(length(a.v), length(b.v))"""))(
    lambda s, d: rounded(Z.pairs(table(s, d, "part_typos"), "p_name_typo", 80)))
query("dup_fuzzy_groups", ora("part_typos", f"""WITH RECURSIVE {NAMES}, e AS (SELECT a.v AS x, b.v AS y FROM names a JOIN names b ON a.v <> b.v WHERE levenshtein(a.v, b.v) * 100 <= 20 * greatest(length(a.v), length(b.v))),
  r AS (SELECT x AS node, x AS seen FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.seen = e.x), lab AS (SELECT node, min(seen) AS rep FROM r GROUP BY node)
  SELECT rep AS representative, node AS member, {R("CASE WHEN rep = node THEN 100.0 ELSE " + SCORE('rep', 'node') + " END")} AS score, count(*) AS rows FROM lab JOIN part_typos ON p_name_typo = node GROUP BY rep, node""").replace("WITH part_typos", "WITH RECURSIVE part_typos", 1).replace("RECURSIVE names", "names"))(
    lambda s, d: rounded(Z.groups(table(s, d, "part_typos"), "p_name_typo", 80)))


def _standardize(s, d):
    df = table(s, d, "part_typos")
    mapping = Z.groups(df, "p_name_typo", 90).where("representative <> member").select(F.col("member").alias("from"), F.col("representative").alias("to"))
    return Z.standardize(df, "p_name_typo", mapping).select("p_partkey", "p_name_typo")


query("dup_fuzzy_standardize", ora("part_typos", f"""WITH RECURSIVE {NAMES}, e AS (SELECT a.v AS x, b.v AS y FROM names a JOIN names b ON a.v <> b.v WHERE levenshtein(a.v, b.v) * 100 <= 10 * greatest(length(a.v), length(b.v))),
  r AS (SELECT x AS node, x AS seen FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.seen = e.x), lab AS (SELECT node, min(seen) AS rep FROM r GROUP BY node)
  SELECT p_partkey, coalesce(rep, p_name_typo) AS p_name_typo FROM part_typos LEFT JOIN lab ON node = p_name_typo""").replace("WITH part_typos", "WITH RECURSIVE part_typos", 1).replace("RECURSIVE names", "names"))(_standardize)
query("dup_similar_positions", ora("part_typos", f"""WITH v AS (SELECT DISTINCT lower(p_name_typo) AS v FROM part_typos), p AS (SELECT a.v AS l, b.v AS r, (SELECT count(*) FROM range(1, length(a.v) + 1) t(i) WHERE substr(a.v, i, 1) = substr(b.v, i, 1)) / CAST(length(a.v) AS DOUBLE) AS s
  FROM v a JOIN v b ON length(a.v) = length(b.v) AND a.v < b.v) SELECT l AS "left", r AS "right", {R('s')} AS similarity FROM p WHERE s > 0.8"""))(
    lambda s, d: rounded(D.similar_positions(table(s, d, "part_typos"), "p_name_typo", 0.8)))
query("dup_conditional", ora("orders_dirty", f"""SELECT o_orderstatus, CAST(sum(k) AS BIGINT) AS total, CAST(sum(k - 1) AS BIGINT) AS duplicates, {R('100.0 * sum(k - 1) / sum(k)')} AS pct FROM (SELECT o_orderstatus, count(*) AS k FROM orders_dirty GROUP BY o_orderstatus, o_custkey, o_orderpriority)
  GROUP BY o_orderstatus HAVING sum(k - 1) > 0"""))(lambda s, d: rounded(D.conditional_stats(od(s, d), "o_orderstatus", ["o_custkey", "o_orderpriority"])))
query("dedup_conditional", ora("orders_dirty", f"SELECT o_orderkey, copy, o_orderstatus, o_custkey FROM (SELECT *, {RN('o_orderstatus, o_custkey', 'o_orderkey, copy')} AS rn FROM orders_dirty) WHERE rn = 1"))(
    lambda s, d: D.keep_first_within(od(s, d), "o_orderstatus", ["o_custkey"], ["o_orderkey", "copy"]).select("o_orderkey", "copy", "o_orderstatus", "o_custkey"))
NEAR = ["p_brand", "p_type", "p_size", "p_name"]
NEAR_T = "WITH t AS (SELECT p_brand, p_type, p_size, p_name, min(p_partkey) AS k, count(*) AS n FROM part GROUP BY 1, 2, 3, 4)"
query("dup_near", f"""{NEAR_T},
  p AS (SELECT a.k AS l, b.k AS r, a.n * b.n AS m, CAST(a.p_brand <> b.p_brand AS INT) + CAST(a.p_type <> b.p_type AS INT) + CAST(a.p_size <> b.p_size AS INT) + CAST(a.p_name <> b.p_name AS INT) AS df FROM t a JOIN t b ON a.k < b.k)
  SELECT l AS left_key, r AS right_key, df AS differences, {R('(4 - df) * 100.0 / 4')} AS similarity, m AS row_pairs FROM p WHERE df BETWEEN 1 AND 2""")(
    lambda s, d: rounded(D.near(table(s, d, "part"), NEAR, "p_partkey", 2)))
query("dup_near_blocks", NEAR_T + " " + " UNION ALL ".join(f"""SELECT '{a},{b}' AS fixed, min(k) OVER w AS block, k AS member, n AS rows, count(*) OVER w AS block_members, CAST(sum(n) OVER w AS BIGINT) AS block_rows
  FROM t WINDOW w AS (PARTITION BY {a}, {b}) QUALIFY count(*) OVER w > 1""" for i, a in enumerate(NEAR) for b in NEAR[i + 1:]))(
    lambda s, d: D.near_blocks(table(s, d, "part"), NEAR, "p_partkey", 2))
query("dup_near_counts", f"""{NEAR_T},
  p AS (SELECT a.n * b.n AS m, CAST(a.p_brand <> b.p_brand AS INT) + CAST(a.p_type <> b.p_type AS INT) + CAST(a.p_size <> b.p_size AS INT) + CAST(a.p_name <> b.p_name AS INT) AS df FROM t a JOIN t b ON a.k < b.k)
  SELECT d AS differences, count(df) AS pairs, CAST(coalesce(sum(m), 0) AS BIGINT) AS row_pairs FROM (VALUES (1), (2)) v(d) LEFT JOIN p ON df = d GROUP BY d""")(
    lambda s, d: D.near_counts(table(s, d, "part"), NEAR, 2))
CS = ["o_orderstatus", "o_orderpriority", "o_custkey", "price_text"]
query("dup_column_stats", ora("orders_dirty", union(CS, lambda x: f"""SELECT '{x}' AS "column", count(*) AS total, count(DISTINCT {x}) AS "unique", count(*) - count(DISTINCT {x}) AS repeats, {R(f'100.0 * (count(*) - count(DISTINCT {x})) / count(*)')} AS pct,
  (SELECT CAST({x} AS VARCHAR) FROM orders_dirty WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY count(*) DESC, CAST({x} AS VARCHAR) LIMIT 1) AS most_frequent, (SELECT count(*) FROM orders_dirty WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY count(*) DESC LIMIT 1) AS frequency FROM orders_dirty""")))(
    lambda s, d: rounded(D.column_stats(od(s, d), CS)))
query("dedup_column", """WITH n AS (SELECT *, count(*) OVER (PARTITION BY p_name) AS k, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part), top AS (SELECT p_name FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
  SELECT 'most_frequent' AS keep, p_partkey, p_name FROM n WHERE rn = 1 AND (k = 1 OR p_name = (SELECT p_name FROM top)) UNION ALL SELECT 'first', p_partkey, p_name FROM n WHERE rn = 1""")(
    lambda s, d: D.dedup_column(table(s, d, "part"), "p_name", "most_frequent", ["p_partkey"]).select(F.lit("most_frequent").alias("keep"), "p_partkey", "p_name").unionByName(
        D.dedup_column(table(s, d, "part"), "p_name", "first", ["p_partkey"]).select(F.lit("first").alias("keep"), "p_partkey", "p_name")))

# ---------------------------------------------------------------- missing values
ODT = {"o_orderkey": "bigint", "copy": "int", "o_custkey": "bigint", "o_orderdate": "timestamp_ntz", "o_totalprice": "double"}
query("missing_report", ora("orders_dirty", union(OD_ALL, lambda x: f"""SELECT '{x}' AS "column", '{ODT.get(x, 'string')}' AS type, count(*) - count({x}) AS missing, {R(f'100.0 * (count(*) - count({x})) / count(*)')} AS pct, count({x}) AS known FROM orders_dirty""")
  + " UNION ALL SELECT 'table', '-', " + " + ".join(f"count(*) - count({x})" for x in OD_ALL) + ", " + R("100.0 * (" + " + ".join(f"count(*) - count({x})" for x in OD_ALL) + ") / (10 * count(*))") + ", count(*) FILTER (WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in OD_ALL) + ") FROM orders_dirty"))(
    lambda s, d: rounded(M.report(od(s, d))))
KEY = ["o_orderkey", "copy", "o_totalprice", "o_orderpriority"]
SEL = ", ".join(KEY)
query("missing_drop_rows", ora("orders_dirty", f"SELECT {SEL} FROM orders_dirty WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL"))(lambda s, d: M.drop_rows(od(s, d), ["o_totalprice", "o_orderpriority"]).select(*KEY))
query("missing_drop_columns", ora("orders_dirty", "SELECT o_orderkey, copy, o_custkey, o_orderstatus, o_orderdate, o_totalprice, price_text, flag_text, date_text FROM orders_dirty"))(lambda s, d: M.drop_columns(od(s, d), 0.1))
query("fill_mean", ora("orders_dirty", f"SELECT o_orderkey, copy, {R('coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM orders_dirty))')} AS o_totalprice FROM orders_dirty"))(
    lambda s, d: rounded(M.transform(od(s, d), M.fit_mean(od(s, d), ["o_totalprice"])).select("o_orderkey", "copy", "o_totalprice")))
query("fill_median", ora("orders_dirty", f"SELECT o_orderkey, copy, {R('coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_dirty))')} AS o_totalprice FROM orders_dirty"))(
    lambda s, d: rounded(M.transform(od(s, d), M.fit_median(od(s, d), ["o_totalprice"])).select("o_orderkey", "copy", "o_totalprice")))
MODEP = "(SELECT o_orderpriority FROM orders_dirty WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
query("fill_mode", ora("orders_dirty", f"SELECT o_orderkey, copy, coalesce(o_orderpriority, {MODEP}) AS o_orderpriority FROM orders_dirty"))(
    lambda s, d: M.transform(od(s, d), M.fit_mode(od(s, d), ["o_orderpriority"])).select("o_orderkey", "copy", "o_orderpriority"))
query("batch_fill_mode", ora("orders_dirty", f"SELECT o_orderkey, copy, coalesce(o_orderpriority, {MODEP}) AS o_orderpriority FROM orders_dirty"))(
    lambda s, d: M.transform(od(s, d), M.fit_mode(od(s, d), ["o_orderpriority", "o_orderstatus"])).select("o_orderkey", "copy", "o_orderpriority"))
query("fill_constant", ora("orders_dirty", "SELECT o_orderkey, copy, coalesce(o_totalprice, 0.0) AS o_totalprice, coalesce(o_orderpriority, 'Unknown') AS o_orderpriority FROM orders_dirty"))(
    lambda s, d: M.fill_constant(od(s, d), {"o_totalprice": 0.0, "o_orderpriority": "Unknown"}).select(*KEY))


def eg(s, d):
    return table(s, d, "events_gaps")


LASTV = lambda x, part="": f"last_value({x} IGNORE NULLS) OVER ({part} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
NEXTV = lambda x, part="": f"first_value({x} IGNORE NULLS) OVER ({part} ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
TS = ["ts", "event_id"]
query("fill_forward", ora("events_gaps", f"SELECT event_id, {LASTV('value')} AS value, {LASTV('event_type_n')} AS event_type_n FROM events_gaps"))(
    lambda s, d: M.fill_ordered(eg(s, d), ["value", "event_type_n"], TS).select("event_id", "value", "event_type_n"))
query("fill_forward_by_user", ora("events_gaps", f"SELECT event_id, {LASTV('value', 'PARTITION BY user_id')} AS value FROM events_gaps"))(
    lambda s, d: M.fill_ordered(eg(s, d), ["value"], TS, partition_by=["user_id"]).select("event_id", "value"))
query("fill_backward", ora("events_gaps", f"SELECT event_id, {NEXTV('value')} AS value FROM events_gaps"))(lambda s, d: M.fill_ordered(eg(s, d), ["value"], TS, direction="backward").select("event_id", "value"))
query("fill_ffill_bfill", ora("events_gaps", f"SELECT event_id, coalesce({LASTV('value')}, {NEXTV('value')}) AS value FROM events_gaps"))(lambda s, d: M.fill_ordered(eg(s, d), ["value"], TS, direction="both").select("event_id", "value"))
query("interpolate_linear", ora("events_gaps", f"""WITH i AS (SELECT event_id, ts, value, row_number() OVER (ORDER BY ts, event_id) AS i FROM events_gaps),
  k AS (SELECT *, CASE WHEN value IS NOT NULL THEN i END AS ki FROM i), f AS (SELECT *, {LASTV('value')} AS pv, {LASTV('ki')} AS pi, {NEXTV('value')} AS nv, {NEXTV('ki')} AS ni FROM k)
  SELECT event_id, {R('CASE WHEN value IS NOT NULL THEN value WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * (i - pi) / CAST(ni - pi AS DOUBLE) ELSE pv END')} AS value FROM f"""))(
    lambda s, d: rounded(M.interpolate(eg(s, d), "value", TS).select("event_id", "value")))
query("impute_knn", ora("customer_geo", f"""WITH pairs AS (SELECT r.c_custkey, d.latitude AS v, 3 / 2.0 * (power(CAST(r.c_acctbal AS DOUBLE) - CAST(d.c_acctbal AS DOUBLE), 2) + power(r.longitude - d.longitude, 2)) AS d2, d.c_custkey AS donor
    FROM customer_geo r JOIN customer_geo d ON r.latitude IS NULL AND d.latitude IS NOT NULL),
  best AS (SELECT c_custkey, avg(v) AS v FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d2, donor) <= 5) GROUP BY c_custkey)
  SELECT g.c_custkey, {R('coalesce(g.latitude, b.v)')} AS latitude, {R('g.longitude')} AS longitude FROM customer_geo g LEFT JOIN best b ON g.c_custkey = b.c_custkey"""))(
    lambda s, d: rounded(M.impute_knn(table(s, d, "customer_geo"), ["c_acctbal", "latitude", "longitude"], "c_custkey", 5).select("c_custkey", "latitude", "longitude")))


def _iterative(s, d):
    df = table(s, d, "lineitem_gaps")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(M.transform_iterative(df, M.fit_iterative(df, cols, 5)).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount"))


query("impute_iterative")(_iterative)
query("impute_auto", ora("customer_geo", f"SELECT c_custkey, c_name, c_mktsegment, {R('c_acctbal')} AS c_acctbal, {R('coalesce(latitude, (SELECT quantile_cont(latitude, 0.5) FROM customer_geo))')} AS latitude, {R('longitude')} AS longitude FROM customer_geo"))(
    lambda s, d: rounded(M.impute_auto(table(s, d, "customer_geo"), "c_custkey", ["c_custkey"])[0]))
query("impute_auto_simple", ora("orders_dirty", f"SELECT o_orderkey, copy, {R('coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_dirty))')} AS o_totalprice, coalesce(o_orderpriority, {MODEP}) AS o_orderpriority FROM orders_dirty"))(
    lambda s, d: rounded(M.impute_simple(od(s, d)).select(*KEY)))
query("recommend_imputation", od_prof(f"""SELECT col AS "column", CASE WHEN role = 'numeric' THEN CASE WHEN 100.0 * nulls / n > 50 THEN 'knn' WHEN abs(skewp) > 1 THEN 'median' ELSE 'mean' END WHEN 100.0 * nulls / n > 30 THEN 'unknown_category' ELSE 'mode' END AS method,
  CAST(CASE WHEN role = 'numeric' THEN CASE WHEN 100.0 * nulls / n > 50 THEN 8 WHEN abs(skewp) > 1 THEN 9 ELSE 8 END WHEN 100.0 * nulls / n > 30 THEN 7 ELSE 8 END AS INT) AS confidence, {R('100.0 * nulls / n')} AS missing_pct FROM prof WHERE nulls > 0"""))(
    lambda s, d: rounded(M.recommend_imputation(od(s, d))))
query("recommend_missing_priority", od_prof(f"""SELECT col AS "column", CASE WHEN 1.0 * nulls / n > 0.5 THEN 'drop_column' WHEN role = 'numeric' AND 1.0 * nulls / n < 0.1 THEN 'median_or_mean' WHEN role = 'numeric' THEN 'knn_or_iterative' WHEN role = 'text' THEN 'mode_or_unknown' ELSE 'ffill_bfill' END AS recommendation,
  CASE WHEN 1.0 * nulls / n > 0.5 THEN 'high' WHEN role = 'numeric' AND 1.0 * nulls / n < 0.1 THEN 'low' WHEN role = 'numeric' THEN 'medium' WHEN role = 'text' THEN 'low' ELSE 'medium' END AS priority, {R('1.0 * nulls / n')} AS share FROM prof WHERE nulls > 0"""))(
    lambda s, d: rounded(M.recommend_priority(od(s, d))))


def _co(s, d):
    df = od(s, d).select("o_totalprice", "o_orderpriority", F.when(F.col("o_totalprice") > 100, F.col("o_custkey")).alias("cust"))
    return rounded(M.cooccurrence(df, 0.1))


COT = "t AS (SELECT o_totalprice, o_orderpriority, CASE WHEN o_totalprice > 100 THEN o_custkey END AS cust FROM orders_dirty)"
COP = [(a, b) for a in ("o_totalprice", "o_orderpriority", "cust") for b in ("o_totalprice", "o_orderpriority", "cust") if a != b]
query("missing_cooccurrence", ora("orders_dirty", f"""WITH {COT} SELECT "column", other, {R('s')} AS share FROM ({union(COP, lambda p: f'''SELECT '{p[0]}' AS "column", '{p[1]}' AS other, 1.0 * count(*) FILTER (WHERE {p[1]} IS NULL) / count(*) AS s FROM t WHERE {p[0]} IS NULL''')}) WHERE s > 0.1"""))(_co)

# ---------------------------------------------------------------- outliers
IQR = "f AS (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM events_gaps)"
EG = lambda body: ora("events_gaps", f"WITH {IQR} {body}")
EVV = lambda df: rounded(df.select("event_id", "value"))
EOUT = "coalesce(value < lo OR value > hi, false)"
query("outlier_iqr", EG(f"SELECT event_id, {R('value')} AS value FROM events_gaps, f WHERE {EOUT}"))(lambda s, d: EVV(O.flagged(eg(s, d), "value", O.fit_iqr(eg(s, d), ["value"]))))
ZS = lambda sd, t: ora("events_gaps", f"SELECT event_id, {R('value')} AS value FROM events_gaps, (SELECT avg(value) AS m, {sd}(value) AS s FROM events_gaps) WHERE abs(value - m) / s > {t}")
query("outlier_zscore", ZS("stddev_pop", 2))(lambda s, d: EVV(O.flagged(eg(s, d), "value", O.fit_zscore(eg(s, d), ["value"], 2.0))))
query("outlier_zscore_sample", ZS("stddev_samp", 3))(lambda s, d: EVV(O.flagged(eg(s, d), "value", O.fit_zscore(eg(s, d), ["value"], 3.0, sample_std=True))))
query("outlier_iforest")(lambda s, d: rounded(O.flagged_forest(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber", "l_partkey"], 0.05).select("l_orderkey", "l_linenumber", "l_partkey", "anomaly_score", "is_outlier")))
query("outlier_remove", EG(f"SELECT event_id, {R('value')} AS value FROM events_gaps, f WHERE NOT {EOUT}"))(lambda s, d: EVV(O.remove(eg(s, d), O.fit_iqr(eg(s, d), ["value"]))))
query("outlier_cap", EG(f"SELECT event_id, {R('CASE WHEN value IS NOT NULL THEN greatest(lo, least(hi, value)) END')} AS value FROM events_gaps, f"))(lambda s, d: EVV(O.cap(eg(s, d), O.fit_iqr(eg(s, d), ["value"]))))
query("outlier_log", ora("events_gaps", f"SELECT event_id, {R('CASE WHEN value > -1 THEN ln(1 + value) END')} AS value FROM events_gaps"))(lambda s, d: EVV(O.log_transform(eg(s, d), ["value"])))
for _how, _v in (("median", "(SELECT quantile_cont(value, 0.5) FROM events_gaps)"), ("mean", "(SELECT avg(value) FROM events_gaps)"), ("null", "NULL")):
    query(f"outlier_to_{_how}", EG(f"SELECT event_id, {R(f'CASE WHEN {EOUT} THEN {_v} ELSE value END')} AS value FROM events_gaps, f"))(
        lambda s, d, h=_how: EVV(O.to_value(eg(s, d), O.fit_iqr(eg(s, d), ["value"]), h)))
GN = ["user_id", "value"]
SUMSQL = lambda body: ora("events_gaps", f"WITH {prof('events_gaps', GN, [], [])} {body}")
query("outlier_summary", SUMSQL(f"""SELECT col AS "column", outl AS outliers, {R('100.0 * outl / n')} AS pct, {R('q1 - 1.5 * (q3 - q1)')} AS lower, {R('q3 + 1.5 * (q3 - q1)')} AS upper FROM prof"""))(
    lambda s, d: rounded(O.summary(eg(s, d), O.fit_iqr(eg(s, d), GN))))
query("outlier_totals", SUMSQL(f"SELECT CAST(sum(outl) AS BIGINT) AS outliers, {R('100.0 * sum(outl) / sum(n)')} AS pct, CASE WHEN 100.0 * sum(outl) / sum(n) < 1 THEN 'low' WHEN 100.0 * sum(outl) / sum(n) < 5 THEN 'moderate' ELSE 'high' END AS label FROM prof"))(
    lambda s, d: rounded(O.totals(eg(s, d), O.fit_iqr(eg(s, d), GN))))
query("outlier_cap_all", ora("orders_dirty", f"WITH {prof('orders_dirty', OD_NUM, [], [])} SELECT o_orderkey, copy, " + ", ".join(
    R(f"CASE WHEN {x} IS NOT NULL THEN greatest((SELECT q1 - 1.5 * (q3 - q1) FROM prof WHERE col = '{x}'), least((SELECT q3 + 1.5 * (q3 - q1) FROM prof WHERE col = '{x}'), {x})) END") + f" AS {x}" for x in ("o_custkey", "o_totalprice")) + " FROM orders_dirty"))(
    lambda s, d: rounded(O.cap(od(s, d), O.fit_iqr(od(s, d), ["o_custkey", "o_totalprice"])).select("o_orderkey", "copy", "o_custkey", "o_totalprice")))


def _overlap(s, d):
    df = eg(s, d).withColumn("twice", F.col("value") * 2)
    return rounded(O.overlap(df, O.fit_iqr(df, ["value", "twice", "user_id"])))


OVT = "t AS (SELECT value, value * 2 AS twice, user_id FROM events_gaps)"
OVF = lambda x: f"({x} < (SELECT quantile_cont({x}, 0.25) - 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) FROM t) OR {x} > (SELECT quantile_cont({x}, 0.75) + 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) FROM t))"
OVP = [(a, b) for a in ("value", "twice", "user_id") for b in ("value", "twice", "user_id") if a != b]
query("outlier_overlap", ora("events_gaps", f"""WITH {OVT} SELECT a AS "column", b AS other, {R('s')} AS share FROM ({union(OVP, lambda p: f"SELECT '{p[0]}' AS a, '{p[1]}' AS b, 1.0 * count(*) FILTER (WHERE {OVF(p[1])}) / nullif(count(*), 0) AS s FROM t WHERE {OVF(p[0])}")}) WHERE s > 0.3"""))(_overlap)
query("recommend_outliers", ora("events_gaps", f"""WITH {prof('events_gaps', ['event_id', 'user_id', 'value'], [], [])} SELECT col AS "column", outl AS outliers, {R('100.0 * outl / (n - nulls)')} AS pct, CASE WHEN 100.0 * outl / (n - nulls) > 10 THEN 'winsorize' WHEN 100.0 * outl / (n - nulls) > 5 THEN 'flag' ELSE 'none' END AS action,
  CASE WHEN 100.0 * outl / n < 5 THEN 'Cap' ELSE 'Remove' END AS treatment, CASE WHEN 100.0 * outl / n > 10 THEN 'high' WHEN 100.0 * outl / n > 5 THEN 'medium' ELSE 'low' END AS severity FROM prof WHERE outl > 0"""))(
    lambda s, d: rounded(O.recommend(eg(s, d))))
query("outlier_methods_compare")(lambda s, d: rounded(O.compare_methods(table(s, d, "events"), "value", ["event_id"], 0.05)))
WQ = "(SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events_gaps)"
query("outlier_winsorize", ora("events_gaps", f"SELECT event_id, {R('CASE WHEN value IS NOT NULL THEN greatest(lo, least(hi, value)) END')} AS value FROM events_gaps, {WQ}"))(lambda s, d: EVV(O.cap(eg(s, d), O.fit_quantile(eg(s, d), ["value"]))))
query("outlier_flag", EG(f"SELECT event_id, {EOUT} AS value_outlier FROM events_gaps, f"))(lambda s, d: O.flag(eg(s, d), O.fit_iqr(eg(s, d), ["value"])).select("event_id", "value_outlier"))
query("batch_outliers", EG(f"SELECT event_id, {EOUT} AS value_outlier FROM events_gaps, f"))(lambda s, d: O.flag(eg(s, d), O.fit_iqr(eg(s, d), ["value"])).select("event_id", "value_outlier"))
query("outlier_threshold", ora("events_gaps", f"""WITH m AS (SELECT quantile_cont(value, 0.5) AS med FROM events_gaps), d AS (SELECT quantile_cont(abs(value - med), 0.5) AS mad FROM events_gaps, m)
  SELECT event_id, coalesce(value < 1 OR value > 200, false) AS manual, coalesce(abs(0.6745 * (value - med) / mad) > 3.5, false) AS modified_z FROM events_gaps, m, d"""))(
    lambda s, d: eg(s, d).select("event_id", O.is_outlier("value", O.user_bounds({"value": (1, 200)})).alias("manual"), O.is_outlier("value", O.fit_modified_z(eg(s, d), ["value"])).alias("modified_z")))
query("outlier_zscore_cap", ora("events_gaps", f"SELECT event_id, {R('CASE WHEN value IS NOT NULL THEN greatest(m - 2 * s, least(m + 2 * s, value)) END')} AS value FROM events_gaps, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events_gaps)"))(
    lambda s, d: EVV(O.cap(eg(s, d), O.fit_zscore(eg(s, d), ["value"], 2.0))))
