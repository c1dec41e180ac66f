"""Queries for encoding (2.11) and scaling (2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanlake.core import c, rnd
from cleanlake.operators import encode as E
from cleanlake.operators import scale as S
from cleanlake.queries.fixtures import ora, table
from cleanlake.queries.q_profile import JB, LI, od_rules, rounded, _nocopy
from cleanlake.queries.registry import query
from cleanlake.queries.sqltext import OD_NUM, OD_TEXT, R, od_prof, prof, union

PR = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
part = lambda s, d: table(s, d, "part")
od = lambda s, d: table(s, d, "orders_dirty")
SEG = "AUTOMOBILE BUILDING FURNITURE HOUSEHOLD MACHINERY".split()



query("encode_onehot", "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{v}' AS INT) AS o_orderstatus_{v}" for v in "FOP") + " FROM orders")(
    lambda s, d: E.onehot(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"]))
query("encode_onehot_na", ora("events_gaps", "SELECT event_id, event_type_n, " + ", ".join(f"CAST(coalesce(event_type_n = '{v}', false) AS INT) AS event_type_n_{v}" for v in "click error purchase signup view".split()) + ", CAST(event_type_n IS NULL AS INT) AS event_type_n_nan FROM events_gaps"))(
    lambda s, d: E.onehot(table(s, d, "events_gaps").select("event_id", "event_type_n"), ["event_type_n"], missing=True, keep=True))
LABEL = lambda t, col: f"(SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce({col}, 'missing') AS v FROM {t}))"
query("encode_label", ora("orders_dirty", f"SELECT o_orderkey, copy, code AS o_orderpriority_encoded FROM orders_dirty JOIN {LABEL('orders_dirty', 'o_orderpriority')} ON v = coalesce(o_orderpriority, 'missing')"))(
    lambda s, d: E.label(od(s, d), "o_orderpriority").select("o_orderkey", "copy", "o_orderpriority_encoded"))
for _key, _table, _id, _text in (("encode_label_names", "customer", "c_custkey", "c_name"), ("encode_label_urls", "pages", "page_id", "url")):
    # texts that begin alike: the numbering is cut by the bytes in which they differ
    query(_key, f"SELECT {_id}, code AS {_text}_encoded FROM {_table} JOIN {LABEL(_table, _text)} ON v = coalesce({_text}, 'missing')")(
        lambda s, d, t=_table, i=_id, x=_text: E.label(table(s, d, t), x).select(i, f"{x}_encoded"))
query("encode_label_high_cardinality", f"SELECT o_orderkey, code AS key_text_encoded FROM (SELECT o_orderkey, CAST(o_orderkey * 7919 % 100003 AS VARCHAR) AS key_text FROM orders) JOIN {LABEL('(SELECT CAST(o_orderkey * 7919 % 100003 AS VARCHAR) AS key_text FROM orders)', 'key_text')} ON v = key_text")(
    lambda s, d: E.label(table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 100003).cast("string").alias("key_text")), "key_text").select("o_orderkey", "key_text_encoded"))
query("encode_ordinal", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS o_orderstatus_ordinal FROM orders")(
    lambda s, d: E.ordinal(table(s, d, "orders"), "o_orderstatus", ["P", "O", "F"]).select("o_orderkey", "o_orderstatus_ordinal"))
CARD = "(SELECT o_orderkey, CAST(o_orderkey * 7919 % 100003 AS VARCHAR) AS key_text FROM orders)"
many = lambda s, d: table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 100003).cast("string").alias("key_text"))
# columns of as many values as rows: one-hot as a sparse vector, ordinal by the sorted position
query("encode_onehot_high_cardinality", f"SELECT o_orderkey, [code] AS places, (SELECT count(DISTINCT key_text) FROM {CARD}) AS size FROM {CARD} JOIN {LABEL(CARD, 'key_text')} ON v = key_text")(
    lambda s, d: E.onehot(many(s, d), ["key_text"]).select("o_orderkey", F.from_json(F.to_json(F.struct(F.col("key_text_onehot").alias("v"))), "v struct<size long, indices array<long>>").alias("j")).select("o_orderkey", F.col("j.v.indices").alias("places"), F.col("j.v.size").alias("size")))
query("encode_ordinal_high_cardinality", f"SELECT o_orderkey, CAST(code AS INT) AS key_text_ordinal FROM {CARD} JOIN {LABEL(CARD, 'key_text')} ON v = key_text")(
    lambda s, d: E.ordinal(many(s, d), "key_text").select("o_orderkey", "key_text_ordinal"))
query("encode_bulk_onehot", f"SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS o_orderstatus_F, CAST(o_orderstatus = 'O' AS INT) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INT) AS o_orderstatus_P, CAST(o_orderstatus IS NULL AS INT) AS o_orderstatus_nan, code AS place FROM orders JOIN {LABEL('(SELECT CAST(o_custkey AS VARCHAR) AS cust FROM orders)', 'cust')} ON v = CAST(o_custkey AS VARCHAR)")(
    lambda s, d: E.bulk(table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").cast("string").alias("cust")), "onehot").select("o_orderkey", "o_orderstatus_F", "o_orderstatus_O", "o_orderstatus_P", "o_orderstatus_nan", F.from_json(F.to_json(F.struct(F.col("cust_onehot").alias("v"))), "v struct<indices array<long>>")["v"]["indices"][0].alias("place")))
query("encode_binary", f"SELECT p_partkey, " + ", ".join(f"CAST(((code + 1) >> {4 - i}) & 1 AS INT) AS p_brand_{i}" for i in range(5)) + f" FROM part JOIN {LABEL('part', 'p_brand')} ON v = p_brand")(
    lambda s, d: E.binary(part(s, d).select("p_partkey", "p_brand"), "p_brand").drop("p_brand"))
TGT = lambda t, col, y: f"SELECT coalesce({col}, 'missing') AS v, (sum({y}) + 10 * (SELECT avg({y}) FROM {t})) / (count({y}) + 10) AS enc FROM {t} GROUP BY 1"
query("encode_target", ora("orders_dirty", f"SELECT o_orderkey, copy, {R('enc', 3)} AS encoded FROM orders_dirty JOIN ({TGT('orders_dirty', 'o_orderpriority', 'o_totalprice')}) ON v = coalesce(o_orderpriority, 'missing')"))(
    lambda s, d: E.target(od(s, d), "o_orderpriority", "o_totalprice", name="encoded").select("o_orderkey", "copy", rnd("encoded", 3).alias("encoded")))
query("encode_target_out_of_fold", f"""WITH g AS (SELECT p_brand, p_partkey % 5 AS f, count(*) AS n, CAST(sum(CAST(p_retailprice AS DECIMAL(28, 10))) AS DOUBLE) AS s FROM part GROUP BY 1, 2), t AS (SELECT p_brand, count(*) AS n, CAST(sum(CAST(p_retailprice AS DECIMAL(28, 10))) AS DOUBLE) AS s FROM part GROUP BY 1), a AS (SELECT CAST(sum(CAST(p_retailprice AS DECIMAL(28, 10))) AS DOUBLE) / count(p_retailprice) AS m FROM part)
  SELECT p_partkey, {R('(t.s - g.s + 10 * m) / (t.n - g.n + 10)', 3)} AS encoded FROM part p JOIN g ON g.p_brand = p.p_brand AND g.f = p_partkey % 5 JOIN t ON t.p_brand = p.p_brand, a""")(
    lambda s, d: E.target_out_of_fold(part(s, d), "p_brand", "p_retailprice", "p_partkey", name="encoded").select("p_partkey", rnd("encoded", 3).alias("encoded")))
query("encode_frequency", ora("orders_dirty", "SELECT o_orderkey, copy, CASE WHEN o_orderpriority IS NOT NULL THEN count(*) OVER (PARTITION BY o_orderpriority) END AS o_orderpriority_freq FROM orders_dirty"))(
    lambda s, d: E.frequency(od(s, d), "o_orderpriority").select("o_orderkey", "copy", "o_orderpriority_freq"))
BYTE = lambda col: f"list_transform(range(0, 16), lambda i: CAST(concat('0x', substr(md5({col}), i * 2 + 1, 2)) AS INT))"
HCODE = lambda col, n: f"list_reduce(list_prepend(0, {BYTE(col)}), lambda r, b: (r * 256 + b) % {n})"
query("encode_hash", "SELECT p_partkey, " + ", ".join(f"CAST(h = {i} AS INT) AS p_name_hash_{i}" for i in range(8)) + f" FROM (SELECT p_partkey, {HCODE('p_name', 8)} AS h FROM part)")(
    lambda s, d: E.hashed(part(s, d).select("p_partkey", "p_name"), "p_name", 8).drop("p_name"))
query("encode_map", ora("orders_dirty", "SELECT o_orderkey, copy, CASE o_orderpriority WHEN '1-URGENT' THEN 9.0E0 WHEN '2-HIGH' THEN 5.0E0 ELSE 0.0E0 END AS o_orderpriority_mapped FROM orders_dirty"))(
    lambda s, d: E.mapped(od(s, d), "o_orderpriority", {"1-URGENT": 9, "2-HIGH": 5}).select("o_orderkey", "copy", "o_orderpriority_mapped"))


def _stat(s, d):
    t = part(s, d)
    for h in ("mean", "median", "std", "min", "max"):
        t = E.stat(t, "p_brand", "p_retailprice", h, h)
    return rounded(t.select("p_partkey", "mean", "median", "std", "min", "max"))


query("encode_stat", f"SELECT p_partkey, {R('avg(p_retailprice) OVER w')} AS mean, {R('quantile_cont(p_retailprice, 0.5) OVER w')} AS median, {R('stddev_samp(p_retailprice) OVER w')} AS std, {R('min(p_retailprice) OVER w')} AS min, {R('max(p_retailprice) OVER w')} AS max FROM part WINDOW w AS (PARTITION BY p_brand)")(_stat)
RK = lambda expr: f"(SELECT p_brand AS b, (rank() OVER (ORDER BY {expr}) + (count(*) OVER (PARTITION BY {expr}) - 1) / 2.0) + 0.0E0 AS r FROM part GROUP BY p_brand)"
RKW = lambda expr: f"(SELECT b, rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0E0 AS r FROM (SELECT p_brand AS b, {expr} AS k FROM part GROUP BY p_brand))"
query("encode_rank", f"SELECT p_partkey, m.r AS mean_rank, f.r AS frequency_rank FROM part JOIN {RKW('avg(p_retailprice)')} m ON m.b = p_brand JOIN {RKW('-count(*)')} f ON f.b = p_brand")(
    lambda s, d: E.rank(E.rank(part(s, d), "p_brand", "mean", "p_retailprice", "mean_rank"), "p_brand", "frequency", name="frequency_rank").select("p_partkey", "mean_rank", "frequency_rank"))
query("encode_auto", f"SELECT p_partkey, code AS p_brand, " + "p_hash FROM part JOIN " + LABEL("part", "p_brand") + " ON v = p_brand JOIN (SELECT p_partkey AS k, p_size AS p_hash FROM part) ON k = p_partkey")(
    lambda s, d: E.auto(part(s, d).select("p_partkey", "p_brand", F.col("p_size").alias("p_hash"))))
query("encode_bulk", ora("orders_dirty", "SELECT o_orderkey, copy, " + ", ".join(f"CAST(coalesce(o_orderpriority = '{v}', false) AS INT) AS \"o_orderpriority_{v}\"" for v in PR) + ", CAST(o_orderpriority IS NULL AS INT) AS o_orderpriority_nan, " + ", ".join(f"CAST(h = {i} AS INT) AS price_text_hash_{i}" for i in range(8)) + f" FROM (SELECT *, {HCODE('price_text', 8)} AS h FROM orders_dirty)"))(
    lambda s, d: E.bulk(od(s, d).select("o_orderkey", "copy", "o_orderpriority", "price_text")).drop("o_orderpriority", "price_text"))
CA = ["o_orderstatus", "o_orderpriority", "flag_text"]
CNT = lambda x, o: f"(SELECT {{0}} FROM (SELECT {x} AS v, count(*) AS k FROM orders_dirty WHERE {x} IS NOT NULL GROUP BY 1 ORDER BY {o} LIMIT 1))"
query("cat_analysis", ora("orders_dirty", union(CA, lambda x: f"""SELECT '{x}' AS "column", count(DISTINCT {x}) AS "unique", count(*) - count({x}) AS missing, {CNT(x, 'k DESC, v').format('v')} AS most_frequent, {CNT(x, 'k DESC, v').format('k')} AS most_count,
  {CNT(x, 'k, v DESC').format('v')} AS least_frequent, {CNT(x, 'k, v DESC').format('k')} AS least_count, {R(f'1.0 * count(DISTINCT {x}) / count(*)', 6)} AS cardinality_ratio FROM orders_dirty""")))(lambda s, d: rounded(E.analysis(od(s, d), CA), 6))
query("recommend_encoding", od_prof("""SELECT col AS "column", uniq AS "unique", CASE WHEN uniq <= 2 THEN 'binary_or_label' WHEN uniq <= 10 THEN 'onehot' WHEN uniq <= 50 THEN 'target_or_ordinal' ELSE 'hashing' END AS method,
  CASE WHEN uniq <= 1 THEN NULL WHEN uniq <= 10 THEN 'onehot_encode' ELSE 'label_encode' END AS action FROM prof WHERE role = 'text'"""))(lambda s, d: E.recommend(od(s, d)))
query("encoding_priority", od_prof("""SELECT CAST(row_number() OVER (ORDER BY score DESC, col) AS INT) AS position, col AS "column", complexity, missing_data, uniq AS "unique", score FROM (SELECT col, uniq, CASE WHEN uniq <= 5 THEN 'low' WHEN uniq <= 20 THEN 'medium' ELSE 'high' END AS complexity,
  1.0 * nulls / n > 0.2 AS missing_data, CAST(CASE WHEN uniq <= 5 THEN 1 WHEN uniq <= 20 THEN 2 ELSE 3 END + CASE WHEN 1.0 * nulls / n > 0.2 THEN 1 ELSE 0 END AS INT) AS score FROM prof WHERE role = 'text')"""))(lambda s, d: E.priority(od(s, d)))
query("encode_loo", f"SELECT p_partkey, {R('(sum(p_retailprice) OVER (PARTITION BY p_name) - p_retailprice) / (count(*) OVER (PARTITION BY p_name) - 1)', 3)} AS loo FROM part")(
    lambda s, d: E.leave_one_out(part(s, d), "p_name", "p_retailprice", ["p_partkey"], "loo").select("p_partkey", rnd("loo", 3).alias("loo")))
query("encode_woe", f"""WITH t AS (SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id)), g AS (SELECT source, count(*) FILTER (WHERE quality = 1) AS e, count(*) FILTER (WHERE quality = 0) AS z FROM t GROUP BY 1), s AS (SELECT sum(e) AS te, sum(z) AS tz, count(*) AS k FROM g)
  SELECT doc_id, {R('ln(((e + 0.5) / (te + 0.5 * k)) / ((z + 0.5) / (tz + 0.5 * k)))')} AS woe FROM t JOIN g USING (source), s""")(
    lambda s, d: rounded(E.weight_of_evidence(table(s, d, "documents").join(table(s, d, "labels"), "doc_id"), "source", "quality", name="woe").select("doc_id", "woe")))

# ---------------------------------------------------------------- scaling
gaps = lambda s, d: table(s, d, "orders_dirty").select("o_orderkey", "copy", "o_totalprice", "o_custkey")
SC = ["o_totalprice", "o_custkey"]


def scaled(key, fit, sql, digits=5, **kw):
    query(key, ora("orders_dirty", f"SELECT o_orderkey, copy, " + ", ".join(f"{R(sql(x), digits)} AS {x}_scaled" for x in SC) + " FROM orders_dirty"))(
        lambda s, d: rounded(S.transform(gaps(s, d), fit(gaps(s, d), SC, **kw)).drop(*SC), digits))


A = lambda e: f"(SELECT {e} FROM orders_dirty)"
Q = lambda x, p: A(f"quantile_cont({x}, {p})")
scaled("scale_standard", S.fit_standard, lambda x: f"({x} - {A(f'avg({x})')}) / {A(f'stddev_pop({x})')}")
scaled("scale_robust", S.fit_robust, lambda x: f"({x} - {Q(x, 0.5)}) / ({Q(x, 0.75)} - {Q(x, 0.25)})")
scaled("scale_maxabs", S.fit_maxabs, lambda x: f"{x} / {A(f'max(abs({x}))')}")
scaled("scale_unit", S.fit_unit, lambda x: f"{x} / sqrt({A(f'sum(CAST({x} AS DOUBLE) * {x})')})", 8)
scaled("scale_quantile_range", S.fit_quantile_range, lambda x: f"({x} - {Q(x, 0.5)}) / ({Q(x, 0.9)} - {Q(x, 0.1)})", p=0.1)


def _minmax(s, d):
    out = None
    for lo, hi in ((0, 1), (-1, 1), (0, 100)):
        one = rounded(S.transform(gaps(s, d), S.fit_minmax(gaps(s, d), SC, lo, hi)).drop(*SC), 5).withColumn("span", F.lit(f"{lo}..{hi}"))
        out = one if out is None else out.unionByName(one)
    return out


query("scale_minmax", ora("orders_dirty", " UNION ALL ".join("SELECT o_orderkey, copy, " + ", ".join(R(f"1.0 * ({x} - {A(f'min({x})')}) / ({A(f'max({x})')} - {A(f'min({x})')}) * {hi - lo} + {lo}", 5) + f" AS {x}_scaled" for x in SC) + f", '{lo}..{hi}' AS span FROM orders_dirty" for lo, hi in ((0, 1), (-1, 1), (0, 100)))))(_minmax)
query("scale_yeojohnson")(lambda s, d: rounded(S.transform_power(table(s, d, "events"), S.fit_power(table(s, d, "events"), ["value"])).select("event_id", "value_scaled")))
query("scale_boxcox")(lambda s, d: rounded(S.transform_power(table(s, d, "events"), S.fit_power(table(s, d, "events"), ["value"], "boxcox")).select("event_id", "value_scaled")))
query("scale_power_fixed", f"SELECT event_id, {R('CASE WHEN value >= 0 THEN (power(value + 1, 0.3) - 1) / 0.3 ELSE -(power(1 - value, 1.7) - 1) / 1.7 END')} AS yj, {R('CASE WHEN value > 0 THEN (power(value, 0.3) - 1) / 0.3 END')} AS bc FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", rnd(S.yeojohnson(c("value"), 0.3)).alias("yj"), rnd(S.boxcox(c("value"), 0.3)).alias("bc")))
query("scale_quantile")(lambda s, d: rounded(S.transform_quantile(table(s, d, "events"), S.fit_quantile_map(table(s, d, "events"), ["value"], 200, "normal")).select("event_id", "value_scaled")))
query("scale_rank", f"SELECT l_orderkey, l_linenumber, l_partkey, {R('(rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0) / count(*) OVER ()', 6)} AS r FROM lineitem")(
    lambda s, d: S.rank(table(s, d, "lineitem"), "l_quantity", ["l_orderkey", "l_linenumber"], "r").select("l_orderkey", "l_linenumber", "l_partkey", rnd("r", 6).alias("r")))
LOGS = {"ln": "ln", "log10": "log10", "log2": "log2"}


def _log(s, d):
    t = table(s, d, "customer").select("c_custkey", "c_acctbal")
    for k in ("ln", "log10", "log2", "log1p"):
        t = S.log_scale(t, "c_acctbal", k, k)
    return rounded(t.drop("c_acctbal"))


SH = "(c_acctbal + (SELECT CASE WHEN min(c_acctbal) <= 0 THEN 1 - min(c_acctbal) ELSE 0 END FROM customer))"
query("scale_log", "SELECT c_custkey, " + ", ".join(f"{R(f'{f}({SH})')} AS {k}" for k, f in LOGS.items()) + f", {R('CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END')} AS log1p FROM customer")(_log)
WX = "CASE WHEN o_totalprice IS NOT NULL THEN greatest(lo, least(hi, o_totalprice)) END"
query("scale_winsor_standard", ora("orders_dirty", f"WITH b AS (SELECT quantile_cont(o_totalprice, 0.05) AS lo, quantile_cont(o_totalprice, 0.95) AS hi FROM orders_dirty), w AS (SELECT o_orderkey, copy, {WX} AS x FROM orders_dirty, b) SELECT o_orderkey, copy, {R('(x - (SELECT avg(x) FROM w)) / (SELECT stddev_pop(x) FROM w)')} AS z FROM w"))(
    lambda s, d: rounded(S.winsor_standard(gaps(s, d), "o_totalprice", 0.05, "z").select("o_orderkey", "copy", "z")))
query("scale_bulk", "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(R(f"1.0 * ({x} - (SELECT min({x}) FROM lineitem)) / (SELECT max({x}) - min({x}) FROM lineitem)", 5) + f" AS {x}_scaled" for x in LI) + " FROM lineitem")(
    lambda s, d: rounded(S.bulk(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *LI), "auto", LI).drop(*LI), 5))
SDP = "(std * sqrt((n - nulls - 1.0) / (n - nulls)))"
query("recommend_scaler", ora("events_gaps", f"""WITH {prof('events_gaps', ['user_id', 'value'], [], [])} SELECT col AS "column", CASE WHEN exp(-{JB} / 2) > 0.05 AND NOT greatest(mx - mean, mean - mn) / {SDP} > 3 THEN 'standard' WHEN greatest(mx - mean, mean - mn) / {SDP} > 3 OR abs(skew) > 1 THEN 'robust' WHEN mn >= 0 AND mx > mn THEN 'minmax' ELSE 'standard' END AS method FROM prof"""))(
    lambda s, d: S.recommend_table(table(s, d, "events_gaps"), ["user_id", "value"]))
query("recommend_scaler_iqr", ora("events_gaps", f"""WITH {prof('events_gaps', ['event_id', 'user_id', 'value'], [], [])}, m AS (SELECT *, abs(skewp) AS s, outl > 0.05 * (n - nulls) AS many FROM prof) SELECT col AS "column", CASE WHEN s > 2 THEN 'power' WHEN many THEN 'robust' WHEN s > 1 THEN 'quantile' ELSE 'standard' END AS method,
  CAST(CASE WHEN s > 2 THEN 9 WHEN many AND s > 1 THEN 8 WHEN many THEN 9 WHEN s > 1 THEN 7 ELSE 9 END AS INT) AS confidence, outl AS outliers, {R('skewp')} AS skew FROM m"""))(lambda s, d: rounded(S.recommend_by_outliers(table(s, d, "events_gaps"))))
query("scale_need", od_prof(f"""SELECT signal, {R('v')} AS value, f AS flagged FROM (SELECT 'columns_needing_scaling' AS signal, 1.0E0 * count(*) FILTER (WHERE mx - mn > 100 OR mx - mn < 0.01) AS v, count(*) FILTER (WHERE mx - mn > 100 OR mx - mn < 0.01) > 0 AS f FROM prof WHERE role = 'numeric'
  UNION ALL SELECT 'range_variation', stddev_pop(mx - mn) / avg(mx - mn), stddev_pop(mx - mn) / avg(mx - mn) > 1 FROM prof WHERE role = 'numeric' AND mx > mn UNION ALL SELECT 'skewed_columns', count(*) FILTER (WHERE abs(skew) > 1), count(*) FILTER (WHERE abs(skew) > 1) > 0 FROM prof
  UNION ALL SELECT 'std_ratio', max(std) / min(std), max(std) / min(std) > 10 FROM prof WHERE std > 0 UNION ALL SELECT 'range_ratio', max(mx - mn) / min(mx - mn), max(mx - mn) / min(mx - mn) > 100 FROM prof WHERE mx > mn)"""))(lambda s, d: rounded(S.need(od(s, d))))
