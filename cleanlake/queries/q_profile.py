"""Profiling queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from cleanlake.core import rnd
from cleanlake.operators import profile as P
from cleanlake.queries.fixtures import ora, table
from cleanlake.queries.registry import query
from cleanlake.queries.sqltext import OD_ALL, OD_DT, OD_NUM, OD_TEXT, R, od_prof, prof, union


def rounded(df, digits=4):
    return df.select(*[rnd(F.col(n), digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


OD_TYPES = {"o_orderkey": "bigint", "copy": "int", "o_custkey": "bigint", "o_orderstatus": "string", "o_orderdate": "timestamp_ntz",
            "o_totalprice": "double", "o_orderpriority": "string", "price_text": "string", "flag_text": "string", "date_text": "string"}
LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EV = ["user_id", "value"]
LIPROF = lambda body: "WITH " + prof("lineitem", LI, [], []) + " " + body
ODPAIRS = lambda cols: list(combinations(cols, 2))

query("profile_columns", ora("orders_dirty", union(OD_ALL, lambda x: f"""SELECT '{x}' AS "column", '{OD_TYPES[x]}' AS type, count({x}) AS non_null,
  count(*) - count({x}) AS nulls, {R(f'100.0 * (count(*) - count({x})) / count(*)')} AS null_pct, count(DISTINCT {x}) AS "unique",
  {R(f'100.0 * count(DISTINCT {x}) / count(*)')} AS unique_pct FROM orders_dirty""")))(
    lambda s, d: rounded(P.profile_columns(table(s, d, "orders_dirty"))))

query("profile_describe", LIPROF(f"""SELECT col AS "column", n - nulls AS count, {R('mean')} AS mean, {R('std')} AS std, {R('mn')} AS min,
  {R('q1')} AS q25, {R('q2')} AS q50, {R('q3')} AS q75, {R('mx')} AS max FROM prof"""))(
    lambda s, d: rounded(P.describe(table(s, d, "lineitem"), LI)))

LABEL = lambda x: f"CASE WHEN abs({x}) < 0.5 THEN 'symmetric' WHEN abs({x}) < 1 THEN 'moderate' WHEN {x} IS NOT NULL THEN 'high' END"

query("profile_shape", ora("orders_dirty", f"""WITH {prof('orders_dirty', OD_NUM, [], [])}
  SELECT col AS "column", {R('skew')} AS skew, {R('kurt')} AS kurt, {LABEL('skew')} AS label FROM prof
  UNION ALL SELECT 'average', {R('avg(skew)')}, {R('avg(kurt)')}, {LABEL('avg(skew)')} FROM prof
  UNION ALL SELECT 'average_abs', {R('avg(abs(skew))')}, NULL, {LABEL('avg(abs(skew))')} FROM prof"""))(lambda s, d: _shape(s, d))


def _shape(s, d):
    df = table(s, d, "orders_dirty")
    sm = P.shape_summary(df, OD_NUM)
    avg = sm.select(F.lit("average").alias("column"), F.col("avg_skew").alias("skew"), F.col("avg_kurt").alias("kurt"), "label")
    absolute = sm.select(F.lit("average_abs").alias("column"), F.col("avg_abs_skew").alias("skew"),
                         F.lit(None).cast("double").alias("kurt"), P.skew_label(F.col("avg_abs_skew")).alias("label"))
    return rounded(P.shape(df, OD_NUM).unionByName(avg).unionByName(absolute))


query("profile_shape_population", ora("orders_dirty", f"""WITH {prof('orders_dirty', OD_NUM, [], [])}
  SELECT col AS "column", {R('mean')} AS mean, {R('q2')} AS median, {R('std')} AS std, {R('skewp')} AS skew, {R('kurtp')} AS kurt,
  CASE WHEN skewp > 0 THEN 'right' WHEN skewp < 0 THEN 'left' ELSE 'symmetric' END AS skew_label,
  CASE WHEN kurtp > 0 THEN 'heavy' WHEN kurtp < 0 THEN 'light' ELSE 'normal' END AS tail_label FROM prof"""))(
    lambda s, d: rounded(P.shape_population(table(s, d, "orders_dirty"), OD_NUM)))

OD_NC = [x for x in OD_ALL if x != "copy"]
NOCOPY = "od AS (SELECT " + ", ".join(OD_NC) + " FROM orders_dirty)"
NULLSUM = lambda cols: " + ".join(f"(count(*) - count({x}))" for x in cols)


def _nocopy(s, d):
    return table(s, d, "orders_dirty").drop("copy")


def od_rules(body):
    """SQL over the profile of orders_dirty without its copy number, where copied rows are true duplicates."""
    p = prof("od", [x for x in OD_NUM if x != "copy"], OD_TEXT, OD_DT, OD_NC)
    return ora("orders_dirty", f"WITH {NOCOPY}, {p}, dup AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM od)) AS d FROM od), "
               f"tot AS (SELECT 100.0 * sum(nulls) / sum(n) AS miss, max(n) AS n, max(d) AS d FROM prof, dup) {body}")


query("quality_summary", od_rules(f"""SELECT max(prof.n) AS rows, count(*) AS columns, CAST(sum(nulls) AS BIGINT) AS missing_cells,
  {R('100.0 * sum(nulls) / sum(prof.n)')} AS missing_pct, (SELECT d FROM dup) AS duplicates,
  count(*) FILTER (WHERE role = 'numeric') AS numeric_columns, count(*) FILTER (WHERE role = 'text') AS text_columns,
  count(*) FILTER (WHERE role = 'datetime') AS datetime_columns FROM prof"""))(lambda s, d: rounded(P.quality_summary(_nocopy(s, d))))

query("completeness", od_rules(f"""SELECT {R('100 - miss')} AS completeness,
  (SELECT {R('100 - 100.0 * sum(nulls) / sum(n)')} FROM prof WHERE role = 'numeric') AS numeric_completeness,
  CASE WHEN 100 - miss > 95 THEN 'excellent' WHEN 100 - miss > 80 THEN 'good' ELSE 'attention' END AS label FROM tot"""))(
    lambda s, d: rounded(P.completeness(_nocopy(s, d))))

query("issue_table", od_rules(f"""SELECT col AS "column", 'missing' AS issue, nulls AS count, {R('100.0 * nulls / n')} AS pct,
  CASE WHEN 1.0 * nulls / n > 0.1 THEN 'High' ELSE 'Medium' END AS severity FROM prof WHERE nulls > 0
  UNION ALL SELECT col, 'high_duplication', n - uniq - CASE WHEN nulls > 0 THEN 1 ELSE 0 END, {R('100.0 * (n - uniq - CASE WHEN nulls > 0 THEN 1 ELSE 0 END) / n')}, 'Medium'
  FROM prof WHERE role <> 'numeric' AND n - uniq - CASE WHEN nulls > 0 THEN 1 ELSE 0 END > 0.1 * n
  UNION ALL SELECT col, 'outliers', outl, {R('100.0 * outl / n')}, CASE WHEN 1.0 * outl / n < 0.05 THEN 'Low' ELSE 'Medium' END FROM prof WHERE outl > 0"""))(
    lambda s, d: rounded(P.issue_table(_nocopy(s, d))))

query("issue_list", od_rules("""SELECT 'missing' AS issue, count(*) AS count, string_agg(col, ',' ORDER BY pos) AS columns FROM prof WHERE nulls > 0 HAVING count(*) > 0
  UNION ALL SELECT 'potential_date', count(*), string_agg(col, ',' ORDER BY pos) FROM prof WHERE role = 'text' AND n > nulls AND date_ok = n - nulls HAVING count(*) > 0
  UNION ALL SELECT 'high_cardinality', count(*), string_agg(col, ',' ORDER BY pos) FROM prof WHERE role = 'text' AND uniq > 0.7 * n HAVING count(*) > 0
  UNION ALL SELECT 'duplicates', d, '' FROM dup WHERE d > 0"""))(lambda s, d: P.issue_list(_nocopy(s, d)))

query("issue_ids", od_rules("""SELECT row_number() OVER (ORDER BY grp, pos) AS id, category, "column", severity FROM (
  SELECT 1 AS grp, pos, 'Missing Values' AS category, col AS "column", CASE WHEN 100.0 * nulls / n > 50 THEN 'high' WHEN 100.0 * nulls / n > 10 THEN 'medium' ELSE 'low' END AS severity FROM prof WHERE nulls > 0
  UNION ALL SELECT 2, 0, 'Duplicates', 'all', CASE WHEN d > 0.1 * n THEN 'high' ELSE 'medium' END FROM tot WHERE d > 0
  UNION ALL SELECT 3, pos, 'Data Types', col, 'medium' FROM prof WHERE role = 'text' AND clean_ok > 0.8 * (n - nulls))"""))(
    lambda s, d: P.issue_ids(_nocopy(s, d)))

query("insights", od_rules(f"""SELECT CASE WHEN miss > 20 THEN 'high' ELSE 'medium' END AS severity, 'missing' AS insight, 'all' AS "column", {R('miss')} AS value FROM tot WHERE miss > 5
  UNION ALL SELECT 'high', 'duplicates', 'all', {R('100.0 * d / n')} FROM tot WHERE 100.0 * d / n > 10
  UNION ALL SELECT 'medium', 'numeric_as_text', col, {R('100.0 * clean_ok / (n - nulls)')} FROM prof WHERE role = 'text' AND clean_ok > 0.8 * (n - nulls)
  UNION ALL SELECT 'low', 'high_cardinality', col, {R('100.0 * uniq / n')} FROM prof WHERE 1.0 * uniq / n > 0.95"""))(
    lambda s, d: rounded(P.insights(_nocopy(s, d))))

query("insights_overview", ora("events_gaps", f"""WITH {prof('events_gaps', ['event_id', 'user_id', 'value'], ['event_type', 'event_type_n'], ['ts'])},
  tot AS (SELECT 100.0 * sum(nulls) / sum(n) AS miss, max(n) AS n, (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events_gaps)) FROM events_gaps) AS d FROM prof)
  SELECT 'Medium' AS severity, 'large_table' AS insight, 'all' AS "column", {R('n')} AS value FROM tot WHERE n > 100000
  UNION ALL SELECT CASE WHEN miss > 10 THEN 'High' ELSE 'Medium' END, 'missing', 'all', {R('miss')} FROM tot WHERE miss > 5
  UNION ALL SELECT CASE WHEN 100.0 * d / n > 5 THEN 'Medium' ELSE 'Low' END, 'duplicates', 'all', {R('100.0 * d / n')} FROM tot WHERE d > 0
  UNION ALL SELECT 'Low', 'skewed', col, {R('skew')} FROM prof WHERE abs(skew) > 2
  UNION ALL SELECT 'Low', 'identifier', col, {R('uniq')} FROM prof WHERE 1.0 * uniq / n > 0.95 AND uniq > 10
  UNION ALL SELECT 'Low', 'categorical', col, {R('uniq')} FROM prof WHERE 1.0 * uniq / n < 0.01 AND uniq > 1"""))(
    lambda s, d: rounded(P.insights_overview(table(s, d, "events_gaps"))))

query("todo_activities", od_rules("""SELECT 'handle_missing' AS action, count(*) AS columns, CASE WHEN (SELECT miss FROM tot) > 10 THEN 'High' ELSE 'Medium' END AS severity FROM prof WHERE nulls > 0 HAVING count(*) > 0
  UNION ALL SELECT 'detect_outliers', count(*), 'Medium' FROM prof WHERE role = 'numeric' HAVING count(*) > 0
  UNION ALL SELECT 'optimize_types', count(*), 'Low' FROM prof"""))(lambda s, d: P.todo_activities(_nocopy(s, d)))

query("dtype_counts", ora("orders_dirty", "SELECT type, count(*) AS columns, CAST(sum(known) AS BIGINT) AS known_values FROM (" + union(OD_TYPES, lambda x: f"SELECT '{OD_TYPES[x]}' AS type, count({x}) AS known FROM orders_dirty") + ") GROUP BY type"))(
    lambda s, d: P.dtype_counts(table(s, d, "orders_dirty")))


def _engineered(s, d):
    df = table(s, d, "lineitem")
    return rounded(P.engineered_census(df.select("*", (F.col("l_tax") * 2).alias("l_tax_scaled"), F.sqrt("l_quantity").alias("l_quantity_sqrt"),
                                                 (F.col("l_tax") * F.col("l_discount")).alias("l_tax_x_l_discount"), F.log1p("l_tax").alias("l_tax_log"))))


query("engineered_census", f"""SELECT category, CAST(k AS BIGINT) AS columns, {R('100.0 * k / 15')} AS pct, k * (SELECT count(l_tax) FROM lineitem) AS known_values FROM (VALUES ('scaled', 1), ('mathematical', 2), ('interactions', 1)) t(category, k)""")(_engineered)

query("value_counts_topk", "SELECT p_name AS value, count(*) AS rows FROM part GROUP BY p_name ORDER BY rows DESC, value LIMIT 10")(
    lambda s, d: P.value_counts_topk(table(s, d, "part"), "p_name", 10))

query("histogram_bins", """WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
  e AS (SELECT CAST(range AS BIGINT) AS bin FROM range(30)),
  h AS (SELECT CAST(least(floor((value - lo) * 30 / (hi - lo)), 29) AS BIGINT) AS bin, count(*) AS rows FROM events, m GROUP BY 1)
  SELECT e.bin, """ + R("lo + e.bin * ((hi - lo) / 30)") + " AS low, " + R("lo + (e.bin + 1) * ((hi - lo) / 30)") + """ AS high, coalesce(h.rows, 0) AS rows
  FROM m, e LEFT JOIN h ON h.bin = e.bin""")(lambda s, d: rounded(P.histogram(table(s, d, "events"), "value", 30)))

query("box_stats", ora("orders_dirty", f"WITH {prof('orders_dirty', OD_NUM, [], [])} " + union(OD_NUM, lambda x: f"""SELECT '{x}' AS "column", {R('q1')} AS q1, {R('q2')} AS median,
  {R('q3')} AS q3, {R('q1 - 1.5 * (q3 - q1)')} AS lower_fence, {R('q3 + 1.5 * (q3 - q1)')} AS upper_fence,
  {R(f'(SELECT min({x}) FROM orders_dirty WHERE {x} >= q1 - 1.5 * (q3 - q1))')} AS whisker_low,
  {R(f'(SELECT max({x}) FROM orders_dirty WHERE {x} <= q3 + 1.5 * (q3 - q1))')} AS whisker_high, outl AS outliers FROM prof WHERE col = '{x}'""")))(
    lambda s, d: rounded(P.box_stats(table(s, d, "orders_dirty"), OD_NUM)))

query("qq_points")(lambda s, d: rounded(P.qq_points(table(s, d, "events"), "value", 100)))

query("missing_matrix", ora("orders_dirty", "WITH i AS (SELECT *, row_number() OVER (ORDER BY o_orderkey, copy) - 1 AS i, count(*) OVER () AS n FROM orders_dirty) " + union(
    ["o_totalprice", "o_orderpriority", "price_text"], lambda x: f"""SELECT i * 20 // n AS bucket, '{x}' AS "column", {R(f'avg(CASE WHEN {x} IS NULL THEN 1.0 ELSE 0.0 END)')} AS null_share FROM i GROUP BY 1""")))(
    lambda s, d: rounded(P.missing_matrix(table(s, d, "orders_dirty"), ["o_orderkey", "copy"], 20, ["o_totalprice", "o_orderpriority", "price_text"])))

MC = ["o_totalprice", "o_orderpriority", "flag_text"]
query("missing_corr", ora("orders_dirty", f"""SELECT 'o_totalprice' AS "left", 'o_orderpriority' AS "right",
  {R('corr(CASE WHEN o_totalprice IS NULL THEN 1.0 ELSE 0.0 END, CASE WHEN o_orderpriority IS NULL THEN 1.0 ELSE 0.0 END)')} AS corr FROM orders_dirty"""))(
    lambda s, d: rounded(P.missing_corr(table(s, d, "orders_dirty"), MC)))

query("missing_per_row_hist", ora("orders_dirty", "SELECT CAST(" + " + ".join(f"CASE WHEN {x} IS NULL THEN 1 ELSE 0 END" for x in OD_ALL) + " AS BIGINT) AS missing, count(*) AS rows FROM orders_dirty GROUP BY 1"))(
    lambda s, d: P.missing_per_row(table(s, d, "orders_dirty")))

query("corr_pearson", union(ODPAIRS(LI), lambda p: f"""SELECT '{p[0]}' AS "left", '{p[1]}' AS "right", {R(f'corr({p[0]}, {p[1]})')} AS corr FROM lineitem"""))(
    lambda s, d: rounded(P.corr_pearson(table(s, d, "lineitem"), LI)))

query("corr_spearman", "WITH " + ", ".join(f"r_{x} AS (SELECT {x} AS v, avg(rn) AS r FROM (SELECT {x}, row_number() OVER (ORDER BY {x}) AS rn FROM lineitem) GROUP BY {x})" for x in LI)
      + ", t AS (SELECT " + ", ".join(f"r_{x}.r AS {x}" for x in LI) + " FROM lineitem l " + " ".join(f"JOIN r_{x} ON r_{x}.v = l.{x}" for x in LI) + ") "
      + union(ODPAIRS(LI), lambda p: f"""SELECT '{p[0]}' AS "left", '{p[1]}' AS "right", {R(f'corr({p[0]}, {p[1]})')} AS corr FROM t"""))(
    lambda s, d: rounded(P.corr_spearman(table(s, d, "lineitem"), LI)))

KC = ["l_quantity", "l_discount", "l_tax"]


def _kendall(a, b):
    return f"""SELECT '{a}' AS "left", '{b}' AS "right", {R('(cc - dd) / sqrt((n0 - n1) * (n0 - n2))')} AS corr FROM (
  SELECT (SELECT sum(CAST(p.w AS DOUBLE) * q.w) FROM k_{a}_{b} p JOIN k_{a}_{b} q ON p.x < q.x AND p.y < q.y) AS cc,
  (SELECT sum(CAST(p.w AS DOUBLE) * q.w) FROM k_{a}_{b} p JOIN k_{a}_{b} q ON p.x < q.x AND p.y > q.y) AS dd,
  (SELECT sum(w) * (sum(w) - 1) / 2.0 FROM k_{a}_{b}) AS n0,
  (SELECT sum(w * (w - 1) / 2.0) FROM (SELECT sum(w) AS w FROM k_{a}_{b} GROUP BY x)) AS n1,
  (SELECT sum(w * (w - 1) / 2.0) FROM (SELECT sum(w) AS w FROM k_{a}_{b} GROUP BY y)) AS n2)"""


query("corr_kendall", "WITH " + ", ".join(f"k_{a}_{b} AS (SELECT {a} AS x, {b} AS y, count(*) AS w FROM lineitem GROUP BY 1, 2)" for a, b in ODPAIRS(KC)) + " "
      + union(ODPAIRS(KC), lambda p: _kendall(*p)))(lambda s, d: rounded(P.corr_kendall(table(s, d, "lineitem"), KC)))

CP = LI + ["tax_paid", "charge"]
query("corr_pairs", f"""WITH t AS (SELECT *, l_quantity * l_tax AS tax_paid, l_extendedprice * (1 - l_discount) AS charge FROM lineitem) SELECT "left", "right", {R('r')} AS corr, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.5 THEN 'moderate' ELSE 'weak' END AS label FROM (
  {union(ODPAIRS(CP), lambda p: f'''SELECT '{p[0]}' AS "left", '{p[1]}' AS "right", corr({p[0]}, {p[1]}) AS r FROM t''')}) WHERE abs(r) > 0.3""")(
    lambda s, d: rounded(P.corr_pairs(table(s, d, "lineitem").withColumn("tax_paid", F.col("l_quantity") * F.col("l_tax"))
                                      .withColumn("charge", F.col("l_extendedprice") * (1 - F.col("l_discount"))), CP, 0.3)))

query("vif")(lambda s, d: rounded(P.vif(table(s, d, "lineitem"), LI)))

query("group_share", f"SELECT o_orderstatus, count(*) AS rows, {R('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct FROM orders GROUP BY 1")(
    lambda s, d: rounded(P.group_share(table(s, d, "orders"), ["o_orderstatus"])))
query("group_share_multi", f"SELECT o_orderstatus, o_orderpriority, count(*) AS rows, {R('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct FROM orders GROUP BY 1, 2")(
    lambda s, d: rounded(P.group_share(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"])))
query("group_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS rows, grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")(
    lambda s, d: P.group_rollup(table(s, d, "orders"), "o_orderstatus", "o_orderpriority"))
query("group_by_date_part", """SELECT 'year' AS part, CAST(year(o_orderdate) AS VARCHAR) AS value, count(*) AS rows FROM orders GROUP BY 2
  UNION ALL SELECT 'month', strftime(o_orderdate, '%B'), count(*) FROM orders GROUP BY 2
  UNION ALL SELECT 'quarter', CAST(quarter(o_orderdate) AS VARCHAR), count(*) FROM orders GROUP BY 2
  UNION ALL SELECT 'weekday', strftime(o_orderdate, '%A'), count(*) FROM orders GROUP BY 2""")(
    lambda s, d: P.group_by_date_part(table(s, d, "orders"), "o_orderdate"))
query("group_conditions", """SELECT CASE WHEN l_quantity >= 40 THEN 'bulk' WHEN l_discount > 0.05 THEN 'discounted' ELSE 'Other' END AS condition, count(*) AS rows FROM lineitem GROUP BY 1""")(
    lambda s, d: P.group_conditions(table(s, d, "lineitem"), {"bulk": "l_quantity >= 40", "discounted": "l_discount > 0.05"}))

JB = "(n - nulls) / 6.0 * (skewp * skewp + kurtp * kurtp / 4.0)"
query("normality", LIPROF(f"""SELECT col AS "column", {R(JB, 3)} AS jarque_bera, {R(f'exp(-{JB} / 2)')} AS p_value, coalesce(exp(-{JB} / 2) > 0.05, false) AS is_normal FROM prof"""))(
    lambda s, d: P.normality(table(s, d, "lineitem"), LI).select("column", rnd("jarque_bera", 3).alias("jarque_bera"), rnd("p_value").alias("p_value"), "is_normal"))
SDP = "(std * sqrt((n - nulls - 1.0) / (n - nulls)))"
query("distribution_analysis", ora("orders_dirty", f"""WITH {prof('orders_dirty', OD_NUM, [], [])} SELECT col AS "column", {R('mean')} AS mean, {R('std')} AS std, {R('mx - mn')} AS range,
  {R('skew')} AS skew, {R('kurt')} AS kurt, coalesce(exp(-{JB} / 2) > 0.05, false) AS is_normal, greatest(mx - mean, mean - mn) / {SDP} > 3 AS has_outliers, zeros > 0 AS has_zeros, negs > 0 AS has_negatives FROM prof"""))(
    lambda s, d: rounded(P.distribution_analysis(table(s, d, "orders_dirty"), OD_NUM)))


def _compare(s, d):
    df = table(s, d, "lineitem")
    after = df.withColumn("l_tax_scaled", F.col("l_tax") * 10 + 1).withColumn("l_quantity_scaled", F.col("l_quantity") / 50)
    return rounded(P.compare_stats(df, after, {"l_tax": "l_tax_scaled", "l_quantity": "l_quantity_scaled"}))


query("compare_stats", union([("l_tax", "l_tax * 10 + 1"), ("l_quantity", "l_quantity / 50")], lambda p: f"""SELECT '{p[0]}' AS "column", '{p[0]}_scaled' AS new_column,
  count({p[0]}) AS count_before, {R(f'avg({p[0]})')} AS mean_before, {R(f'stddev_samp({p[0]})')} AS std_before, {R(f'min({p[0]})')} AS min_before, {R(f'max({p[0]})')} AS max_before,
  count({p[1]}) AS count_after, {R(f'avg({p[1]})')} AS mean_after, {R(f'stddev_samp({p[1]})')} AS std_after, {R(f'min({p[1]})')} AS min_after, {R(f'max({p[1]})')} AS max_after FROM lineitem"""))(_compare)
query("validate_numeric", LIPROF(f"""SELECT col AS "column", {R('mean')} AS mean, {R('std')} AS std, {R('skew')} AS skew, {R('kurt')} AS kurt, {R('mx - mn')} AS range, zeros, negs AS negatives,
  uniq AS "unique", nulls AS missing, {R('mn')} AS min, {R('mx')} AS max FROM prof"""))(lambda s, d: rounded(P.validate_numeric(table(s, d, "lineitem"), LI)))
query("most_variable", od_prof(f"""SELECT 'largest_variation' AS fact, arg_max(col, std / abs(nullif(mean, 0))) AS "column", {R('max(std / abs(nullif(mean, 0)))')} AS value FROM prof
  UNION ALL SELECT 'largest_value', arg_max(col, mx), {R('max(mx)')} FROM prof UNION ALL SELECT 'most_diverse', arg_max(col, uniq), {R('max(uniq)')} FROM prof WHERE role = 'text'"""))(
    lambda s, d: rounded(P.most_variable(table(s, d, "orders_dirty"))))

CHAR = "CASE WHEN nulls > 0 THEN 'gaps' WHEN abs(skew) < 0.5 THEN 'steady' ELSE 'dramatic' END"
MODE = lambda x: f"SELECT '{x}' AS subject, 'mode' AS fact, CAST(NULL AS DOUBLE) AS number, (SELECT {x} FROM od WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY count(*) DESC, {x} LIMIT 1) AS label"
query("story_facts", od_rules(" UNION ALL ".join(
    [f"SELECT col AS subject, '{k}' AS fact, {R(v)} AS number, {CHAR} AS label FROM prof WHERE role = 'numeric'" for k, v in [("min", "mn"), ("max", "mx"), ("mean", "mean"), ("std", "std")]]
    + [f"SELECT col, 'skew', {R('skew')}, CASE WHEN abs(skew) < 0.5 THEN 'balanced' WHEN skew > 1 THEN 'right' WHEN skew < -1 THEN 'left' WHEN skew IS NOT NULL THEN 'mild' END FROM prof WHERE role = 'numeric'",
       f"SELECT col, 'unique', {R('uniq')}, CASE WHEN uniq <= 5 THEN 'lead' WHEN uniq <= 20 THEN 'supporting' ELSE 'ensemble' END FROM prof WHERE role = 'text'",
       f"SELECT col, 'missing_pct', {R('100.0 * nulls / n')}, CASE WHEN 100.0 * nulls / n > 50 THEN 'critical' WHEN 100.0 * nulls / n > 20 THEN 'significant' ELSE 'minor' END FROM prof WHERE nulls > 0",
       f"SELECT 'table', 'completeness', {R('100 - miss')}, CASE WHEN miss < 5 THEN 'excellent' WHEN miss < 20 THEN 'good' ELSE 'attention' END FROM tot"]
    + [MODE(x) for x in OD_TEXT])))(lambda s, d: rounded(P.story_facts(_nocopy(s, d))))
query("trend_line", f"SELECT {R('regr_slope(l_extendedprice, l_quantity)')} AS slope, {R('regr_intercept(l_extendedprice, l_quantity)')} AS intercept, {R('corr(l_extendedprice, l_quantity)')} AS corr FROM lineitem")(
    lambda s, d: rounded(P.trend_line(table(s, d, "lineitem"), "l_quantity", "l_extendedprice")))
query("anomaly_count", od_rules("SELECT CAST((miss > 0)::INT + (d > 0)::INT + ((SELECT sum(outl) FROM prof) > 0)::INT AS BIGINT) AS anomalies FROM tot"))(
    lambda s, d: P.anomaly_count(_nocopy(s, d)))
