"""Queries for feature work (2.13), joins and grouping (2.14) and selections (2.2)."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import functions as F

from cleanlake.core import c, numeric_columns, rnd, roles, small_frame
from cleanlake.operators import features as FE
from cleanlake.operators import fuzzy as Z
from cleanlake.operators import geo as G
from cleanlake.operators import joins as J
from cleanlake.operators import ordered
from cleanlake.operators import outliers as O
from cleanlake.operators import selection as SE
from cleanlake.queries.fixtures import ora, table
from cleanlake.queries.q_profile import LI, rounded
from cleanlake.queries.registry import query
from cleanlake.queries.sqltext import OD_NUM, R, od_prof, prof, union

LK = ["l_orderkey", "l_linenumber", "l_partkey"]
KS = ", ".join(LK)
li = lambda s, d: table(s, d, "lineitem")
lg = lambda s, d: table(s, d, "lineitem_gaps")
LGALL = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lq(key, fn, exprs, digits=4, source="lineitem_gaps"):
    """Row-wise features of the gap table: fn(df) adds columns, exprs maps their names to SQL."""
    places = lambda n: min(digits, 4) if n.endswith("_std") or "_sq_" in n else digits
    body = f"SELECT {KS}, " + ", ".join(f'{R(e, places(n))} AS "{n}"' for n, e in exprs.items()) + f" FROM {source}"
    query(key, ora(source, body))(lambda s, d: fn(table(s, d, source)).select(*LK, *[rnd(c(n), places(n)).alias(n) for n in exprs]))


Z0 = lambda x: f"coalesce({x}, 0)"
PC = ["l_quantity", "l_discount", "l_tax"]
POLY = {"poly_bias": "1.0"}
for k in (2, 3):
    for combo in combinations_with_replacement(PC, k):
        POLY["poly_" + "_".join(f"{x}^{combo.count(x)}" if combo.count(x) > 1 else x for x in dict.fromkeys(combo))] = " * ".join(Z0(x) for x in combo)
lq("feat_polynomial", lambda df: FE.polynomial(df, PC, 3, bias=True), POLY)
lq("feat_powers", lambda df: FE.powers(df, ["l_quantity", "l_discount"], 3), {"l_quantity_pow2": "l_quantity * l_quantity", "l_quantity_pow3": "l_quantity * l_quantity * l_quantity", "l_discount_pow2": "l_discount * l_discount", "l_discount_pow3": "l_discount * l_discount * l_discount"}, 5)
lq("feat_interaction", lambda df: FE.interaction(df, "l_quantity", "l_discount"), {"l_quantity_multiply_l_discount": "l_quantity * l_discount", "l_quantity_add_l_discount": "l_quantity + l_discount", "l_quantity_subtract_l_discount": "l_quantity - l_discount",
   "l_quantity_divide_l_discount": "l_quantity / nullif(l_discount, 0)", "l_quantity_ratio_l_discount": "l_quantity / nullif(l_quantity + l_discount, 0)"}, 5)
lq("feat_pairwise", lambda df: FE.pairwise(df, LGALL), {f"{a}_{b}_interaction": f"{a} * {b}" for a, b in combinations(LGALL, 2)}, 5)
XP = "CASE WHEN {x} IS NOT NULL THEN greatest(-10.0, least(10.0, {x})) END".format(x="l_discount")
lq("feat_math", lambda df: FE.math_features(df, "l_discount"), {"l_discount_sqrt": "sqrt(abs(l_discount))", "l_discount_sq": "l_discount * l_discount", "l_discount_cube": "l_discount * l_discount * l_discount", "l_discount_log": "ln(abs(l_discount) + 1)", "l_discount_exp": f"exp({XP})",
   "l_discount_inv": "1.0 / nullif(l_discount, 0)", "l_discount_abs": "abs(l_discount)", "l_discount_sign": "sign(l_discount)", "l_discount_pow2": f"power(2.0, {XP})"}, 6)
RL = "list_filter([" + ", ".join(f"CAST({x} AS DOUBLE)" for x in LGALL) + "], lambda v: v IS NOT NULL)"
lq("feat_row_agg", lambda df: FE.row_aggregates(df, LGALL), {"agg_mean": f"list_avg({RL})", "agg_sum": f"list_sum({RL})", "agg_min": f"list_min({RL})", "agg_max": f"list_max({RL})", "agg_std": f"list_stddev_samp({RL})", "agg_range": f"list_max({RL}) - list_min({RL})"}, 6)
WB = lambda x, n, t: f"CASE WHEN {x} IS NOT NULL THEN " + " + ".join(f"CAST({x} > (SELECT min({x}) + (max({x}) - min({x})) * {i} / {n} FROM {t}) AS INT)" for i in range(1, n)) + " END"
QB = lambda x, n, t: f"CASE WHEN {x} IS NOT NULL THEN " + " + ".join(f"CAST({x} > (SELECT quantile_cont({x}, {i}.0 / {n}) FROM {t}) AS INT)" for i in range(1, n)) + " END"
lq("feat_bin_width", lambda df: FE.bins(df, FE.fit_bins_width(df, "l_extendedprice", 5)), {"l_extendedprice_binned": WB("l_extendedprice", 5, "lineitem_gaps")})
lq("feat_bin_freq", lambda df: FE.bins(df, FE.fit_bins_quantile(df, "l_extendedprice", 4)), {"l_extendedprice_binned": QB("l_extendedprice", 4, "lineitem_gaps")})
query("feat_bin_quantile", ora("lineitem_gaps", f"SELECT {KS}, concat('Q', 1 + {QB('l_extendedprice', 4, 'lineitem_gaps')}) AS q FROM lineitem_gaps WHERE l_extendedprice IS NOT NULL"))(
    lambda s, d: FE.bins(lg(s, d), FE.fit_bins_quantile(lg(s, d), "l_extendedprice", 4), "q", ["Q1", "Q2", "Q3", "Q4"]).where("q IS NOT NULL").select(*LK, "q"))
lq("feat_bin_custom", lambda df: FE.bins(df, FE.Bins("l_quantity", [5.0, 10.0, 25.0, 40.0])), {"l_quantity_binned": "CASE WHEN l_quantity >= 5 AND l_quantity <= 40 THEN CAST(l_quantity > 10 AS INT) + CAST(l_quantity > 25 AS INT) END"})
lq("feat_bin_indicators", lambda df: FE.bin_indicators(df, FE.Bins("l_quantity", [1.0, 10.0, 25.0, 50.0])), {"l_quantity_bin_0": "CAST(l_quantity >= 1 AND l_quantity <= 10 AS INT)", "l_quantity_bin_1": "CAST(l_quantity > 10 AND l_quantity <= 25 AS INT)", "l_quantity_bin_2": "CAST(l_quantity > 25 AND l_quantity <= 50 AS INT)"})


def emb(s, d, n=64):
    return table(s, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)])


EC = [f"e{i}" for i in range(64)]
query("feat_pca")(lambda s, d: rounded(FE.transform_pca(emb(s, d), FE.fit_pca(emb(s, d), EC, 5), keep=False)))
query("feat_pca_reduce")(lambda s, d: rounded(FE.pca_reduce(emb(s, d), EC, 10)))
query("feat_pca_loadings")(lambda s, d: rounded(FE.pca_loadings(s, FE.fit_pca(li(s, d), LI, None))))
FV = lambda x: f"""SELECT '{x}' AS "column", ((sum(n * power(m - g, 2))) / (count(*) - 1)) / (sum(v) / (sum(n) - count(*))) AS f FROM (SELECT label, count(*) AS n, avg({x}) AS m, var_pop({x}) * count(*) AS v FROM e GROUP BY label), (SELECT avg({x}) AS g FROM e)"""
ESQL = "e AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(64)) + " FROM embeddings)"
query("select_kbest_f", f"""WITH {ESQL} SELECT "column", {R('f', 5)} AS f_value FROM ({union(EC, FV)}) ORDER BY f DESC LIMIT 10""")(lambda s, d: rounded(FE.top_k(FE.anova_f(emb(s, d), EC, "label"), "f_value", 10), 5))
MI = lambda x: f"""SELECT '{x}' AS "column", sum(n / t * ln(n * t / (x * z))) AS mi FROM (SELECT CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER () AS t, sum(count(*)) OVER (PARTITION BY b) AS x, sum(count(*)) OVER (PARTITION BY l_returnflag) AS z FROM (SELECT l_returnflag, {QB(x, 10, 'lineitem')} AS b FROM lineitem) GROUP BY b, l_returnflag)"""
query("select_kbest_mi", f"""SELECT "column", {R('mi', 7)} AS mutual_information FROM ({union(LI, MI)}) ORDER BY mi DESC LIMIT 3""")(lambda s, d: rounded(FE.top_k(FE.mutual_information(li(s, d), LI, "l_returnflag"), "mutual_information", 3), 7))
query("select_variance", union(LI, lambda x: f"""SELECT '{x}' AS "column", {R(f'var_pop({x})', 3)} AS variance FROM lineitem HAVING var_pop({x}) > 0.001""").replace(") AS variance", ") AS variance"))(
    lambda s, d: rounded(FE.select_variance(li(s, d), LI, 0.001), 3))


def _selcorr(s, d):
    df = li(s, d).withColumn("charge", F.col("l_extendedprice") * (1 - F.col("l_discount"))).withColumn("tax_paid", F.col("l_extendedprice") * F.col("l_tax"))
    keep = FE.select_correlation(df, LI + ["charge", "tax_paid"], 0.8)
    return small_frame(s, [(i, x) for i, x in enumerate(keep)], "position int, column string")


query("select_correlation", """WITH t AS (SELECT *, l_extendedprice * (1 - l_discount) AS charge, l_extendedprice * l_tax AS tax_paid FROM lineitem), k AS (SELECT * FROM (VALUES (0, 'l_quantity'), (1, 'l_extendedprice'), (2, 'l_discount'), (3, 'l_tax'), (4, 'tax_paid')) v(position, "column"))
  SELECT position, "column" FROM k WHERE (SELECT corr(l_extendedprice, charge) FROM t) > 0.8 AND (SELECT abs(corr(l_extendedprice, tax_paid)) FROM t) < 0.8 AND (SELECT abs(corr(l_quantity, l_extendedprice)) FROM t) < 0.8""")(_selcorr)
names = lambda s, xs: small_frame(s, [(i, x) for i, x in enumerate(xs)], "position int, column string")
query("select_rf")(lambda s, d: names(s, FE.select_rf(li(s, d), LI, "l_returnflag", 0.05, 20)))
query("select_rfe")(lambda s, d: names(s, FE.select_rfe(li(s, d), LI, "l_returnflag", 2, 10)))
query("feat_importance_table")(lambda s, d: rounded(FE.importance_table(li(s, d), LI, "l_linestatus", 20)))


def _lasso(s, d):
    df = li(s, d).withColumn("y", F.col("l_quantity") * 3 - F.col("l_tax") * 50)
    return rounded(small_frame(s, FE.select_lasso(df, LI, "y", 0.1), "column string, coefficient double"))


query("select_lasso")(_lasso)
AUTO = {f"auto_poly_{a} {b}": f"{Z0(a)} * {Z0(b)}" for a, b in combinations(LGALL, 2)} | {f"auto_int_{a}_x_{b}": f"{a} * {b}" for a, b in combinations(LGALL, 2)} | {f"auto_sq_{x}": f"{x} * {x}" for x in LGALL}
R3 = "list_filter([CAST(l_quantity AS DOUBLE), CAST(l_extendedprice AS DOUBLE), CAST(l_discount AS DOUBLE)], lambda v: v IS NOT NULL)"
AUTO |= {"auto_agg_1_mean": f"list_avg({R3})", "auto_agg_1_std": f"list_stddev_samp({R3})"}
lq("feat_auto", lambda df: FE.auto(df, LGALL), AUTO, 6)
query("feat_auto_skewed", f"SELECT event_id, {R('sqrt(abs(value))')} AS auto_sqrt_value, {QB('value', 5, 'events')} AS auto_bin_value FROM events")(
    lambda s, d: FE.auto(table(s, d, "events"), ["value"]).select("event_id", rnd("auto_sqrt_value").alias("auto_sqrt_value"), "auto_bin_value"))
query("feat_auto_simple", f"SELECT event_id, {R('value * value')} AS value_squared, {WB('value', 5, 'events')} AS value_binned FROM events WHERE (SELECT stddev_samp(value) > 0 FROM events)".replace(WB("value", 5, "events"), f"CASE WHEN (SELECT stddev_samp(value - 30) > avg(value - 30) FROM events) THEN {WB('value', 5, 'events')} END"))(
    lambda s, d: FE.auto_simple(table(s, d, "events").select("event_id", "value", (F.col("value") - 30).alias("low")), ["value", "low"]).select("event_id", rnd("value_squared").alias("value_squared"), F.col("low_binned").alias("value_binned")))
lq("feat_auto_core", lambda df: FE.auto_core(df, LGALL), {f"{a}_{b}_interaction": f"{a} * {b}" for a, b in combinations(LGALL, 2)} | {f"{x}_binned": WB(x, 5, "lineitem_gaps") for x in ("l_quantity", "l_extendedprice")}, 4)
query("recommend_features", od_prof("""SELECT 'all' AS "column", 'interactions' AS recommendation, count(*) AS value FROM prof WHERE role = 'numeric' HAVING count(*) >= 2 UNION ALL SELECT col, 'binning', uniq FROM prof WHERE role = 'numeric' AND uniq > 50
  UNION ALL SELECT 'all', 'pca', count(*) FROM prof WHERE role = 'numeric' HAVING count(*) > 10"""))(lambda s, d: FE.recommend(table(s, d, "orders_dirty")))
query("select_features", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")(lambda s, d: SE.select_features(table(s, d, "orders"), ["o_orderkey", "o_totalprice"], "o_orderstatus"))

# ---------------------------------------------------------------- projection, filter, preview
query("select_by_role", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")(lambda s, d: SE.by_role(table(s, d, "orders"), "numeric"))
ORD = "ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey"
OL = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"]
query("preview_head", f"SELECT {KS}, l_extendedprice FROM lineitem {ORD} LIMIT 25")(lambda s, d: SE.head(li(s, d), 25, OL).select(*LK, "l_extendedprice"))
query("preview_tail", f"SELECT * FROM (SELECT {KS}, l_extendedprice FROM lineitem {ORD.replace(',', ' DESC,')} DESC LIMIT 25)")(lambda s, d: SE.tail(li(s, d), 25, OL).select(*LK, "l_extendedprice"))
query("preview_slice", f"SELECT {KS}, l_extendedprice FROM lineitem {ORD} LIMIT 40 OFFSET 1000")(lambda s, d: SE.rows_between(li(s, d), 1000, 1040, OL).select(*LK, "l_extendedprice"))
query("sample_n", f"SELECT {', '.join(LK)} FROM lineitem ORDER BY md5(concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in LK)}, '42')), {', '.join(LK)} LIMIT 500")(lambda s, d: SE.sample_n(li(s, d), 500, LK).select(*LK))
query("drop_columns", "SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM orders")(lambda s, d: table(s, d, "orders").drop("o_orderstatus", "o_totalprice"))
query("filter_not_null_pairs", ora("customer_geo", "SELECT c_custkey, latitude, longitude FROM customer_geo WHERE latitude IS NOT NULL AND longitude IS NOT NULL"))(lambda s, d: SE.not_null(table(s, d, "customer_geo"), ["latitude", "longitude"]).select("c_custkey", "latitude", "longitude"))


def _isin(s, d):
    ev = table(s, d, "events")
    odd = O.flagged(ev, "value", O.fit_iqr(ev, ["value"]))
    yes = SE.isin(ev, odd, ["event_id"]).select("event_id", F.lit("flagged").alias("kind"))
    return yes.unionByName(SE.isin(ev, odd, ["event_id"], negate=True).select("event_id", F.lit("normal").alias("kind")))


query("filter_isin_values", "WITH b AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS c FROM events) SELECT event_id, CASE WHEN value < a - 1.5 * (c - a) OR value > c + 1.5 * (c - a) THEN 'flagged' ELSE 'normal' END AS kind FROM events, b")(_isin)

# ---------------------------------------------------------------- joins
KEY_PAIRS = [("o_custkey", "l_orderkey", "key_pattern"), ("o_custkey", "l_partkey", "key_pattern"), ("o_custkey", "l_suppkey", "key_pattern"), ("o_orderkey", "l_orderkey", "key_pattern"),
             ("o_orderkey", "l_orderkey", "similar_name"), ("o_orderkey", "l_partkey", "key_pattern"), ("o_orderkey", "l_suppkey", "key_pattern")]
query("suggest_join_keys", union(enumerate(KEY_PAIRS), lambda p: f"SELECT {p[0] + 1} AS position, '{p[1][0]}' AS left_column, '{p[1][1]}' AS right_column, 0.9E0 AS similarity, '{p[1][2]}' AS reason, (SELECT count(*) FROM (SELECT {p[1][0]} FROM orders INTERSECT SELECT {p[1][1]} FROM lineitem)) AS shared_values"))(
    lambda s, d: rounded(J.suggest_keys_with_overlap(table(s, d, "orders"), li(s, d))))
for _h in ("inner", "left", "right", "outer"):
    query(f"join_{_h}", f"SELECT c_custkey, c_nationkey, s_suppkey, s_nationkey, {R('s_acctbal', 2)} AS s_acctbal FROM customer {_h if _h != 'outer' else 'FULL OUTER'} JOIN supplier ON c_nationkey = s_nationkey")(
        lambda s, d, h=_h: J.equi_join(table(s, d, "customer"), table(s, d, "supplier").withColumn("s_acctbal", rnd("s_acctbal", 2)), ["c_nationkey"], ["s_nationkey"], h).select("c_custkey", "c_nationkey", "s_suppkey", "s_nationkey", "s_acctbal"))


def _conflicts(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("amount"))
    l = li(s, d).select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("amount"))
    a = J.equi_join(o, l, ["k"], ["k"], "inner").select(F.lit("suffix").alias("how"), "k", "amount_left", "amount_right")
    b = J.equi_join(o, l, ["k"], ["k"], "inner", conflict="keep_right", salt=True).select(F.lit("keep_right").alias("how"), "k", F.lit(None).cast("double").alias("amount_left"), F.col("amount").alias("amount_right"))
    e = J.equi_join(o, l, ["k"], ["k"], "inner", conflict="keep_left").select(F.lit("keep_left").alias("how"), "k", F.col("amount").alias("amount_left"), F.lit(None).cast("double").alias("amount_right"))
    return a.unionByName(b).unionByName(e)


OJ = "FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
query("join_conflicts", f"SELECT 'suffix' AS how, o_orderkey AS k, o_totalprice AS amount_left, l_extendedprice AS amount_right {OJ} UNION ALL SELECT 'keep_right', o_orderkey, NULL, l_extendedprice {OJ} UNION ALL SELECT 'keep_left', o_orderkey, o_totalprice, NULL {OJ}")(_conflicts)
SCORE = "(1.0 - levenshtein(a.v, b.v) / CAST(greatest(length(a.v), length(b.v)) AS DOUBLE)) * 100"
query("join_fuzzy", ora("part_typos", f"""WITH a AS (SELECT DISTINCT p_name_typo AS v FROM part_typos), b AS (SELECT DISTINCT p_name AS v FROM part), m AS (SELECT a.v AS l, b.v AS r, {SCORE} AS s, row_number() OVER (PARTITION BY a.v ORDER BY levenshtein(a.v, b.v) / CAST(greatest(length(a.v), length(b.v)) AS DOUBLE), b.v) AS rn
  FROM a JOIN b ON levenshtein(a.v, b.v) * 100 <= 30 * greatest(length(a.v), length(b.v))) SELECT p_partkey, p_name_typo, r AS matched, {R('s')} AS score FROM part_typos JOIN m ON l = p_name_typo AND rn = 1"""))(
    lambda s, d: rounded(Z.fuzzy_join(table(s, d, "part_typos"), table(s, d, "part"), "p_name_typo", "p_name", 70).select("p_partkey", "p_name_typo", "matched", "score")))
query("join_range", f"SELECT c_custkey, s_suppkey, {R('abs(c_acctbal - s_acctbal)')} AS distance FROM customer JOIN supplier ON abs(c_acctbal - s_acctbal) <= 50")(
    lambda s, d: rounded(J.range_join(table(s, d, "customer"), table(s, d, "supplier"), "c_acctbal", "s_acctbal", 50).select("c_custkey", "s_suppkey", "distance")))
HV = "2 * 6371.0 * asin(sqrt(least(1.0, power(sin((radians(s_lat) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(s_lat)) * power(sin((radians(s_lon) - radians(longitude)) / 2), 2))))"
query("join_spatial", ora("customer_geo supplier_geo", f"SELECT * FROM (SELECT c_custkey, s_suppkey, {R(HV, 3)} AS distance_km FROM customer_geo JOIN supplier_geo ON latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180) WHERE distance_km <= 100"))(
    lambda s, d: rounded(J.spatial_join(G.fix_invalid(table(s, d, "customer_geo"), "latitude", "longitude", "remove"), table(s, d, "supplier_geo"), "latitude", "longitude", "s_lat", "s_lon", 100).select("c_custkey", "s_suppkey", "distance_km"), 3))
query("group_agg", ora("orders_dirty", "SELECT o_orderpriority, " + ", ".join(f"{e} AS {n}" for n, e in [("o_totalprice_count", "count(o_totalprice)")] + [(f"o_totalprice_{k}", R(f"{f}(o_totalprice)" if k != "median" else "quantile_cont(o_totalprice, 0.5)", 2)) for k, f in (("sum", "sum"), ("mean", "avg"), ("median", ""), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]) + " FROM orders_dirty WHERE o_orderpriority IS NOT NULL GROUP BY 1"))(
    lambda s, d: rounded(J.group_agg(table(s, d, "orders_dirty"), "o_orderpriority", ["o_totalprice"], ["count", "sum", "mean", "median", "std", "min", "max"]), 2))
