"""Quantiles, salted joins, near and fuzzy matching against brute force on small fixtures."""

import difflib
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cleanlake.operators import components, dedup, fuzzy, joins, profile, quantiles, skew

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("kind", ["spread", "ties", "constant"])
def test_bracketed_quantiles(spark, kind):
    rng = np.random.default_rng(3)
    x = {"spread": rng.normal(0, 1e4, 5000), "ties": rng.integers(0, 4, 5000).astype(float), "constant": np.full(500, 7.0)}[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = quantiles.exact_quantiles(df, ["x"], PROBS, small_cells=0, accuracy=200)["x"]
    assert got == pytest.approx(np.quantile(x, PROBS).tolist())
    assert quantiles.exact_quantiles(df, ["x"], PROBS)["x"] == pytest.approx(np.quantile(x, PROBS).tolist())


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantiles.exact_quantiles(df, ["x"], [0.5])["x"] == [None]
    assert quantiles.exact_quantiles(df, ["x"], [0.5], small_cells=0)["x"] == [None]


def test_grouped_quantiles_large_groups(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["hot", "b", "c"], 4000, p=[0.9, 0.09, 0.01]), "x": rng.normal(size=4000), "y": rng.integers(0, 9, 4000).astype(float)})
    got = quantiles.grouped_quantiles(spark.createDataFrame(pdf), ["g"], ["x", "y"], [0.25, 0.5], small_group=300, accuracy=500)
    got = {r["g"]: (r["x"], r["y"]) for r in got.collect()}
    for g, part in pdf.groupby("g"):
        assert got[g][0] == pytest.approx(part.x.quantile([0.25, 0.5]).tolist())
        assert got[g][1] == pytest.approx(part.y.quantile([0.25, 0.5]).tolist())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(spark, how):
    rnd = random.Random(2)
    left = spark.createDataFrame([(rnd.choice(["a", "a", "a", "b", "c", None]), i) for i in range(300)], "k string, i long")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3), (None, 4), ("z", 5)], "k string, v long")
    got = skew.skew_join(left, right, ["k"], how, hot_rows=20, salts=5)
    r = right.withColumnRenamed("k", "k2")
    want = left.join(r, left["k"].eqNullSafe(r["k2"]), how)
    cols = ["k", "i"] + (["v"] if how in ("inner", "left") else [])
    assert rows(got, *cols) == rows(want, *cols)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_spread_join_equals_plain_join(spark, how, null_safe):
    rnd = random.Random(4)
    left = spark.createDataFrame([(rnd.choice(["a", "a", "a", "b", "c", "only", None]), rnd.randrange(40)) for _ in range(200)], "k string, i int")
    right = spark.createDataFrame([(rnd.choice(["a", "a", "b", "other", None]), rnd.randrange(30)) for _ in range(90)], "q string, v int")
    got = skew.spread_join(left, right, [("k", "q")], how, null_safe=null_safe, side=7)
    want = left.join(right, left["k"].eqNullSafe(right["q"]) if null_safe else left["k"] == right["q"], how)
    assert got.columns == want.columns and rows(got, *got.columns) == rows(want, *want.columns)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_pairs_of_one_key_meet_in_many_tasks(spark, how):
    left, right = spark.range(1600).select(F.col("id").alias("a"), F.lit(1).alias("k")), spark.range(1500).select(F.col("id").alias("b"), F.lit(1).alias("q"))
    out = joins.equi_join(left, right, ["k"], ["q"], how)
    parts = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("a").alias("n")).collect()]
    assert sum(parts) == 1600 * 1500 and max(parts) < 0.6 * sum(parts)
    near = joins.range_join(left.withColumn("x", F.col("a") / 1600), right.withColumn("y", F.col("b") / 1500), "x", "y", 1.0)
    parts = [r["n"] for r in near.groupBy(F.spark_partition_id()).agg(F.count("a").alias("n")).collect()]
    assert sum(parts) == 1600 * 1500 and max(parts) < 0.6 * sum(parts)


def sent(plan):
    """Rows that the exchanges of a plan that has run wrote."""
    inner = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "ResultQueryStage": "plan"}.get(plan.nodeName())
    below = [getattr(plan, inner)()] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
    return own + sum(map(sent, below))


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_copies_grow_with_the_rows_not_with_their_pairs(spark, how):
    copies = []
    for n in (600, 1200):
        left, right = spark.range(n).select(F.col("id").alias("a"), (F.col("id") % 2).alias("k")), spark.range(n).select(F.col("id").alias("b"), (F.col("id") % 2).alias("q"))
        out = skew.spread_join(left, right, [("k", "q")], how, side=8).select("a", "b")
        assert len(out.collect()) == n * n // 2
        copies.append(sent(out._jdf.queryExecution().executedPlan()))
    assert copies[1] < 2.2 * copies[0] and copies[1] < 4 * math.sqrt(skew.GROUPS * spark.sparkContext.defaultParallelism) * 1200


def test_groups_of_pairs_have_their_limits():
    for groups in (32, 10_000):
        for sizes in [(2_000_000, 3), (3, 2_000_000), (5_400_000, 360_000), (1_200, 1_000), (1, 2_000_000)], [(216_000, 14_400)] * 25, [(9_000_000, 2_000_000)]:
            for (m, n), (a, b) in zip(sizes, skew._chunks(sizes, groups)):
                assert m * n <= a * b * skew.MOST_SIDE ** 2 and n <= b * skew.HELD_ROWS and m <= a * skew.SORTED_ROWS and a >= 1 and b >= 1
    assert sum(a * b for a, b in skew._chunks([(216_000, 14_400)] * 25, 192)) <= 2 * 192 and skew._chunks([(1_025, 1_024)], 4) == [(2, 1)]


def test_lookup_join_small_and_large(spark):
    left = spark.range(500).select((F.col("id") % 50).alias("k"), "id")
    table = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    small = skew.lookup_join(left, table, ["k"])
    large = skew.lookup_join(left, table, ["k"], max_rows=5)
    assert rows(small, "k", "id", "v") == rows(large, "k", "id", "v")
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_hot_group_of_copies(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = skew.group_stats_join(df, ["k"], {"first": F.min("id")}, where=F.col("__n") > 1, spread_by=["id"], hot_rows=100)
    assert got.count() == 700 and got.agg(F.max("first")).first()[0] == 0
    assert dedup.repeated_rows(df, ["k"], ["id"]).count() == 699
    assert dedup.keep_none(df, ["k"]).count() == 300
    assert dedup.keep_last(df, ["k"], ["id"]).where("k = 'hot'").first()["id"] == 699


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def words(n, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12))) for _ in range(n)]
    out = set(base)
    for w in base:
        w = list(w)
        for _ in range(rnd.randint(1, 4)):
            p = rnd.randrange(len(w) + 1)
            if rnd.random() < 0.5 or p == len(w):
                w.insert(p, rnd.choice("abcd"))
            elif rnd.random() < 0.5 and len(w) > 1:
                del w[p]
            else:
                w[p] = rnd.choice("abcd")
        out.add("".join(w))
    return sorted(out)


@pytest.mark.parametrize("threshold", [50, 60, 75, 80, 90, 100])
def test_fuzzy_pairs_miss_nothing(spark, threshold):
    v = words(60, threshold)
    df = spark.createDataFrame([(x,) for x in v], "s string")
    want = {(a, b) for a, b in itertools.combinations(v, 2) if lev(a, b) * 100 <= (100 - threshold) * max(len(a), len(b))}
    got = {(r["left"], r["right"]) for r in fuzzy.pairs(df, "s", threshold).collect()}
    assert got == want


@pytest.mark.parametrize("threshold", [70, 80, 92])
def test_fuzzy_long_texts_share_rare_grams(spark, threshold):
    rnd = random.Random(threshold)
    v = set()
    for _ in range(12):
        base = [rnd.choice("abcdeé漢 ") for _ in range(rnd.randint(20, 160))]
        for _ in range(4):
            w = list(base)
            for _ in range(rnd.randint(0, len(w) // 3)):
                w[rnd.randrange(len(w))] = rnd.choice("abcdefgh")
                if rnd.random() < 0.3:
                    del w[rnd.randrange(len(w))]
            v.add("".join(w))
    v = sorted(v)
    want = {(a, b) for a, b in itertools.combinations(v, 2) if lev(a, b) * 100 <= (100 - threshold) * max(len(a), len(b))}
    df = spark.createDataFrame([(x,) for x in v], "s string")
    assert want and {(r["left"], r["right"]) for r in fuzzy.pairs(df, "s", threshold).collect()} == want
    q = fuzzy._gram_size(threshold)
    freq = fuzzy._grams(df.toDF("v"), q).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    keys = fuzzy._prefixes(df.toDF("v"), freq, threshold, q).count()
    assert keys <= sum(q * fuzzy._edits(len(x), threshold) + 1 for x in v) <= sum(map(len, v)) + len(v)


def test_fuzzy_matches_two_tables(spark):
    a, b = words(40, 1), words(40, 2)
    got = {(r[0], r[1]) for r in fuzzy.matches(spark.createDataFrame([(x,) for x in a], "x string"), spark.createDataFrame([(x,) for x in b], "y string"), "x", "y", 70).select("left_value", "right_value").collect()}
    assert got == {(x, y) for x in a for y in b if lev(x, y) * 100 <= 30 * max(len(x), len(y))}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y")], "left string, right string")
    lab = {r["node"]: r["label"] for r in fuzzy.components(edges).collect()}
    assert {lab[f"n{i:03d}"] for i in range(41)} == {"n000"} and lab["y"] == "x"


@pytest.mark.parametrize("hub_rows", [4, 10_000])
def test_components_equal_union_find(spark, hub_rows):
    rnd = random.Random(hub_rows)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000, i) for i in range(1001, 1060)] + [(2000 + i, 3000) for i in range(60)] + [(5, 5), (7777, 7777), (None, 3), (9, None)]
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for x, y in edges:
        if x is not None and y is not None:
            x, y = sorted((find(x), find(y)))
            parent[y] = x
    got = components.components(spark.createDataFrame(edges, "left long, right long"), hub_rows).collect()
    assert {r["node"]: r["label"] for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert components.components(spark.createDataFrame([], "left long, right long")).count() == 0


def test_a_hub_meets_no_task(spark):
    star = spark.range(1, 60_000).select(F.lit(0).cast("long").alias("left"), F.col("id").alias("right"))
    got = components.components(star.unionByName(spark.range(60_001, 60_050).select(F.col("id").alias("left"), (F.col("id") - 1).alias("right"))))
    assert got.groupBy("label").count().orderBy("label").collect() == [(0, 60_000), (60_000, 50)]
    least = star.groupBy(F.col("left").alias("b")).agg(F.min("left").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = components._around(star.select(F.col("right").alias("a"), F.col("left").alias("b")), "b", least, 10_000)
    per_task = joined.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 59_999 and max(r["count"] for r in per_task) < 20_000


def test_similar_positions(spark):
    v = sorted({w.ljust(8, "x") for w in words(60, 9) if len(w) <= 8})
    got = {(r["left"], r["right"]) for r in dedup.similar_positions(spark.createDataFrame([(x,) for x in v], "s string"), "s", 0.6).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(v, 2) if len(a) == len(b) and sum(x == y for x, y in zip(a, b)) / len(a) > 0.6}


@pytest.mark.parametrize("k", [1, 2, 3])
def test_near_duplicates(spark, k):
    rnd = random.Random(k)
    data = [(i, *[rnd.choice([1, 2, None]) for _ in range(4)]) for i in range(40)]
    got = {(r["left_key"], r["right_key"]): (r["differences"], r["row_pairs"]) for r in dedup.near(spark.createDataFrame(data, "id long, a int, b int, c int, d int"), ["a", "b", "c", "d"], "id", k).collect()}
    groups = {}
    for r in data:
        groups.setdefault(r[1:], []).append(r[0])
    want = {}
    for (x, xs), (y, ys) in itertools.combinations(groups.items(), 2):
        d = sum(p != q for p, q in zip(x, y))
        if 1 <= d <= k:
            want[tuple(sorted((min(xs), min(ys))))] = (d, len(xs) * len(ys))
    assert got == want
    df = spark.createDataFrame(data, "id long, a int, b int, c int, d int")
    counts = {r["differences"]: (r["pairs"], r["row_pairs"]) for r in dedup.near_counts(df, ["a", "b", "c", "d"], k).collect()}
    assert counts == {n: (len(x := [v for v in want.values() if v[0] == n]), sum(v[1] for v in x)) for n in range(1, k + 1)}
    rows = dedup.near_blocks(df, ["a", "b", "c", "d"], "id", k).collect()
    blocks = {}
    for r in rows:
        blocks.setdefault((r["fixed"], r["block"]), []).append(r)
    assert {tuple(sorted((x["member"], y["member"]))) for b in blocks.values() for x, y in itertools.combinations(b, 2)} == set(want)
    assert all(len(b) == b[0]["block_members"] > 1 and sum(r["rows"] for r in b) == b[0]["block_rows"] and min(r["member"] for r in b) == b[0]["block"] for b in blocks.values())
    assert len(rows) <= len(list(itertools.combinations("abcd", k))) * len(groups)


def test_range_join(spark):
    rnd = random.Random(4)
    a = [(i, rnd.choice([rnd.uniform(-20, 20), 5.0])) for i in range(80)]
    b = [(i, rnd.uniform(-20, 20)) for i in range(60)]
    got = joins.range_join(spark.createDataFrame(a, "i long, x double"), spark.createDataFrame(b, "j long, y double"), "x", "y", 1.5)
    assert {(r["i"], r["j"]) for r in got.collect()} == {(i, j) for i, x in a for j, y in b if abs(x - y) <= 1.5}
    exact = joins.range_join(spark.createDataFrame(a, "i long, x double"), spark.createDataFrame(a, "j long, y double"), "x", "y", 0)
    assert {(r["i"], r["j"]) for r in exact.collect()} == {(i, j) for i, x in a for j, y in a if x == y}


def km(p, q):
    a, b, x, y = map(math.radians, (*p, *q))
    return 2 * 6371 * math.asin(min(1.0, math.sqrt(math.sin((x - a) / 2) ** 2 + math.cos(a) * math.cos(x) * math.sin((y - b) / 2) ** 2)))


@pytest.mark.parametrize("dist", [0.5, 150.0, 3000.0, 15000.0])
def test_spatial_join_with_poles_and_date_line(spark, dist):
    rnd = random.Random(7)
    pts = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(60)] + [(90.0, 0.0), (89.9, 170.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0), (0.001, 179.999), (45.0, -179.99), (45.0, 179.99), (89.5, -10.0)]
    near = pts + [(min(90, a + 0.003), b) for a, b in pts[:20]]
    l = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "i long, la double, lo double")
    r = spark.createDataFrame([(i, *p) for i, p in enumerate(near)], "j long, ra double, ro double")
    got = sorted((x["i"], x["j"]) for x in joins.spatial_join(l, r, "la", "lo", "ra", "ro", dist).collect())
    assert got == sorted((i, j) for i, p in enumerate(pts) for j, q in enumerate(near) if km(p, q) <= dist)


def test_kendall_with_ties(spark):
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 15, 150), rng.normal(size=150).round(1)
    c = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(150) for j in range(i))
    tx = sum(x[i] == x[j] for i in range(150) for j in range(i))
    ty = sum(y[i] == y[j] for i in range(150) for j in range(i))
    n0 = 150 * 149 / 2
    got = profile.kendall_tau_b(spark.createDataFrame(pd.DataFrame({"x": x.astype(float), "y": y})), "x", "y").first()["corr"]
    assert got == pytest.approx(c / math.sqrt((n0 - tx) * (n0 - ty)))


def test_spearman_with_nulls(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(rng.integers(0, 9, (120, 3)).astype(float), columns=list("abc")).mask(rng.random((120, 3)) < 0.2)
    df = spark.createDataFrame(pdf)
    got = {(r["left"], r["right"]): r["corr"] for r in profile.corr_spearman(df, list("abc")).collect()}
    for a, b in itertools.combinations("abc", 2):
        both = pdf[[a, b]].dropna()
        assert got[(a, b)] == pytest.approx(both[a].rank().corr(both[b].rank()))


def test_suggest_keys(spark):
    a, b = spark.createDataFrame([(1, "x")], "customer_id int, name string"), spark.createDataFrame([(1, "x")], "cust_id int, full_name string")
    got = {(r["left_column"], r["right_column"], r["reason"]) for r in joins.suggest_keys(a, b).collect()}
    assert ("customer_id", "cust_id", "key_pattern") in got
    assert (("customer_id", "cust_id", "similar_name") in got) == (difflib.SequenceMatcher(None, "customer_id", "cust_id").ratio() > 0.7)


def test_dup_near_names_every_pair(spark, tmp_path):
    from cleanlake.queries import all_queries
    parts = [(1, "A", "T", 1, "x"), (2, "A", "T", 1, "x"), (3, "A", "T", 2, "x"), (4, "A", "U", 2, "x"), (5, "B", "V", 9, "y"), (6, "A", "U", 3, "z")]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r["left_key"], r["right_key"]): (r["differences"], r["similarity"], r["row_pairs"]) for r in all_queries()["dup_near"](spark, str(tmp_path)).collect()}
    assert got == {(1, 3): (1, 75.0, 2), (1, 4): (2, 50.0, 2), (3, 4): (1, 75.0, 1), (4, 6): (2, 50.0, 1)}
