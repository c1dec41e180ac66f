"""Property tests for operators that SQL cannot express."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cleanlake.core import c
from cleanlake.operators import knn, encode, features, missing, outliers, profile, scale


def gaps(n=120, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(10, 3, n)
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": 2 * a + rng.normal(0, .1, n), "c": rng.random(n)})
    pdf.loc[::7, "a"] = np.nan
    pdf.loc[3::11, "b"] = np.nan
    return pdf


def frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.select(*[F.when(~F.isnan(x), c(x)).alias(x) if t == "double" else c(x) for x, t in df.dtypes])


def knn_reference(pdf, cols, k):
    x = pdf[cols].to_numpy()
    out = x.copy()
    for r, col in zip(*np.nonzero(np.isnan(x))):
        d = []
        for i in range(len(x)):
            both = ~np.isnan(x[r]) & ~np.isnan(x[i])
            if not np.isnan(x[i, col]) and both.any():
                d.append((((x[r, both] - x[i, both]) ** 2).sum() * len(cols) / both.sum(), i, x[i, col]))
        d.sort()
        out[r, col] = np.mean([v for *_, v in d[:k]])
    return out


@pytest.mark.parametrize("cell,most", [(16, 64), (2, 64), (16, 1)])
def test_knn_is_exact(spark, cell, most, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 25)
    pdf = gaps()
    got = missing.impute_knn(frame(spark, pdf), ["a", "b", "c"], "id", 4, cell=cell, max_patterns=most).toPandas().sort_values("id")
    assert np.allclose(got[["a", "b", "c"]].to_numpy(), knn_reference(pdf, ["a", "b", "c"], 4), atol=1e-6)


def test_knn_with_copies_outliers_and_ties(spark):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({"id": rng.permutation(n), "a": rng.integers(0, 4, n).astype(float), "b": rng.lognormal(0, 2, n).round(1), "c": rng.random(n) * 100, "d": np.where(np.arange(n) % 3, 7.0, 1e6)})
    pdf.loc[:130, ["a", "b", "c", "d"]] = [1.0, 2.0, 3.0, 4.0]              # a third of the rows alike
    for x, m in zip("abcd", (5, 7, 11, 13)):
        pdf.loc[rng.random(n) < 1 / m, x] = np.nan
    pdf.loc[3, ["a", "b", "c", "d"]] = np.nan
    pdf = pdf.sort_values("id").reset_index(drop=True)
    want = knn_reference(pdf, list("abcd"), 3)
    want = np.where(np.isnan(want), np.nanmean(pdf[list("abcd")].to_numpy(), axis=0), want)
    got = missing.impute_knn(frame(spark, pdf).repartition(5), list("abcd"), "id", 3, cell=4).toPandas().sort_values("id")
    assert np.allclose(got[list("abcd")].to_numpy(), want, atol=1e-6)


def test_knn_of_little(spark):
    schema = "id string, x double, y double, __knn0 string"
    rows = [("a", 1.0, None, "s"), ("b", None, 2.0, "s"), ("c", None, None, None), ("c", None, None, None)]
    got = missing.impute_knn(spark.createDataFrame(rows, schema), ["x", "y"], "id").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", 1.0, 2.0, "s"), ("b", 1.0, 2.0, "s"), ("c", 1.0, 2.0, None), ("c", 1.0, 2.0, None)]
    none = spark.createDataFrame([("a", None, 1.0, ""), ("b", None, None, "")], schema)
    assert [r.x for r in missing.impute_knn(none, ["x", "y"], "id").collect()] == [None, None]
    assert missing.impute_knn(none.limit(0), ["x", "y"], "id").count() == 0


def test_knn_searches_few_cells(spark):
    """The first round of a large even table touches a small share of all pairs."""
    df = spark.range(20000).select("id", F.when(F.col("id") % 50 > 0, F.rand(1)).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"))
    best, target, _ = knn.nearest(df, ["a", "b", "c"], "id", 5)
    assert target == [0] and best.count() == 400 * 5
    grids, _, _ = knn._indexes({"111": 19600, "011": 400}, [0], [np.linspace(0, 1, 1023)] * 3, 16)
    assert len(grids) == 1 and len(grids[0].cuts) == 2 and 800 < np.prod([len(e) + 1 for _, e in grids[0].cuts]) < 1600


def test_iterative_recovers_a_line(spark):
    pdf = gaps(400)
    df = frame(spark, pdf)
    got = missing.transform_iterative(df, missing.fit_iterative(df, ["a", "b", "c"], 10)).toPandas().sort_values("id").reset_index(drop=True)
    assert not got.isna().any().any()
    known = pdf.b.notna()
    assert np.allclose(got.b[known], pdf.b[known])
    only = pdf.b.isna() & pdf.a.notna()
    assert np.abs(got.b[only] - 2 * pdf.a[only]).max() < 0.6


def test_fill_without_values(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, None)], "id long, x double, s string")
    assert missing.transform(df, missing.fit_median(df, ["x"])).where("x IS NULL").count() == 2
    assert missing.transform(df, missing.fit_mode(df, ["s"])).where("s = 'Unknown'").count() == 2


def test_forest_ranks_planted_outliers_first(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": np.arange(600), "x": rng.normal(size=600), "y": rng.normal(size=600)})
    pdf.loc[:4, ["x", "y"]] = [[12, 12], [-12, 12], [12, -12], [-12, -12], [15, 0]]
    df = spark.createDataFrame(pdf)
    t = outliers.flag_forest(df, outliers.fit_forest(df, ["x", "y"], ["id"], 0.05, trees=40, sample=128)).toPandas()
    assert set(t.nlargest(5, "anomaly_score").id) == {0, 1, 2, 3, 4}
    assert abs(t.is_outlier.sum() - 30) <= 2


def test_bounds_keep_nulls(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(1000.0,), (None,)], "x double")
    b = outliers.fit_iqr(df, ["x"])
    assert outliers.cap(df, b).where("x IS NULL").count() == 1 and outliers.cap(df, b).agg(F.max("x")).first()[0] == b.limits["x"][1]
    assert outliers.remove(df, b).count() == 21
    flat = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert outliers.fit_zscore(flat, ["x"]).limits["x"] is None and outliers.fit_modified_z(flat, ["x"]).limits["x"] is None


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    fit = features.fit_pca(spark.createDataFrame(pd.DataFrame(x, columns=list("abcde"))), list("abcde"), 5)
    w = np.array(fit.components)
    assert np.allclose(w @ w.T, np.eye(5), atol=1e-8) and sum(fit.explained) == pytest.approx(1)
    val = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert np.allclose(fit.explained, val / val.sum())
    assert len(features.fit_pca(spark.createDataFrame(pd.DataFrame(x, columns=list("abcde"))), list("abcde"), 0.6).components) == np.searchsorted(np.cumsum(val / val.sum()), 0.6) + 1


def test_vif(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(5, 1, size=(200, 3))
    x[:, 2] = x[:, 0] + rng.normal(0, .1, 200)
    got = {r["column"]: r["vif"] for r in profile.vif(spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))), list("abc")).collect()}
    for i, n in enumerate("abc"):
        others = np.delete(x, i, 1)
        beta = np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        assert got[n] == pytest.approx((x[:, i] ** 2).sum() / ((x[:, i] - others @ beta) ** 2).sum(), rel=1e-6)


@pytest.mark.parametrize("kind", ["yeojohnson", "boxcox"])
def test_power_lambda_is_a_maximum(spark, kind):
    rng = np.random.default_rng(5)
    x = np.exp(rng.normal(size=2000))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    fit = scale.fit_power(df, ["x"], kind)
    lam = fit.lambdas["x"]
    lik = scale._likelihoods(df, ["x"], kind, fit.shifts, {"x": [lam - .05, lam, lam + .05]})["x"]
    assert lik[1] == max(lik)
    if kind == "boxcox":
        assert abs(lam) < 0.1
    z = scale.transform_power(df, fit).agg(F.avg("x_scaled"), F.stddev_pop("x_scaled")).first()
    assert z[0] == pytest.approx(0, abs=1e-8) and z[1] == pytest.approx(1)


def test_quantile_map(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.exponential(size=1500)}))
    u = scale.transform_quantile(df, scale.fit_quantile_map(df, ["x"], 100)).toPandas().x_scaled
    assert u.min() == 0 and u.max() == 1 and abs(u.mean() - 0.5) < 0.01
    z = scale.transform_quantile(df, scale.fit_quantile_map(df, ["x"], 100, "normal")).toPandas().x_scaled
    assert abs(z.mean()) < 0.05 and 0.9 < z.std() < 1.2


def test_linear_scaling_can_be_undone(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, None)], "x double, k double")
    for fit in (scale.fit_standard(df, ["x", "k"]), scale.fit_minmax(df, ["x", "k"], -1, 1), scale.fit_robust(df, ["x", "k"])):
        t = scale.transform(df, fit).toPandas()
        shift, div, factor, offset = fit.params["x"]
        assert np.allclose((t.x_scaled - offset) / factor * div + shift, t.x)
        assert t.k_scaled.isna().sum() == 1


def test_qq_points(spark):
    t = profile.qq_points(spark.createDataFrame(pd.DataFrame({"x": np.random.default_rng(7).normal(3, 2, 2000)})), "x", 99).toPandas()
    slope, icept = np.polyfit(t.theoretical[5:-5], t.ordered[5:-5], 1)
    assert slope == pytest.approx(2, abs=.15) and icept == pytest.approx(3, abs=.15)


def test_encoding_edges(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (2, "a", 0.0), (3, None, 1.0), (4, "b", 0.0)], "id long, s string, y double")
    assert {r["id"]: r["s_encoded"] for r in encode.label(df, "s").collect()} == {1: 1, 2: 0, 3: 2, 4: 1}
    hot = encode.onehot(df, ["s"], missing=True).toPandas()
    assert list(hot.columns) == ["id", "y", "s_a", "s_b", "s_nan"] and hot[["s_a", "s_b", "s_nan"]].sum(axis=1).eq(1).all()
    loo = {r["id"]: r["s_loo"] for r in encode.leave_one_out(df, "s", "y").collect()}
    assert loo[1] == 0.0 and loo[4] == 1.0 and loo[2] == 0.5
    with pytest.raises(Exception):
        encode.ordinal(df, "s", ["a"]).collect()
    assert encode.ordinal(df, "s", ["a"], unknown="null").where("s_ordinal IS NULL").count() == 3
    many = spark.range(50).select("id", F.when(F.col("id") > 0, F.format_string("%02d", "id")).alias("s"))
    assert encode.fit_categories(many, ["s"], cap=10) is None
    vec = {r["id"]: r["s_onehot"] for r in encode.onehot(many, ["s"], missing=True, wide=10).collect()}
    assert all(v.size == 50 and v.indices.tolist() == [i - 1 if i else 49] for i, v in vec.items())
    bare = {r["id"]: r["s_onehot"] for r in encode.onehot(many, ["s"], wide=10).collect()}
    assert bare[0].size == 49 and not len(bare[0].indices) and bare[49].indices.tolist() == [48]
    long = encode.onehot_long(many, ["s"], ["id"]).collect()
    assert len(long) == 49 and {r["column"] for r in long} == {"s"}
    sizes = {r["id"]: r["s_ordinal"] for r in encode.ordinal(many, "s").collect()}
    assert sizes == {0: None, **{i: i - 1 for i in range(1, 50)}}


def test_model_selection_finds_the_signal(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(500, 4)), columns=list("abcd"))
    pdf["y"] = (pdf.a > 0).astype(int)
    pdf["z"] = 3 * pdf.b + rng.normal(0, .01, 500)
    df = spark.createDataFrame(pdf)
    assert features.forest_importance(df, list("abcd"), "y", 10)[0][0] == "a"
    assert features.select_rfe(df, list("abcd"), "y", 1, 5) == ["a"]
    assert [x for x, _ in features.select_lasso(df, list("abcd"), "z", 0.1)] == ["b"]
    assert features.top_k(features.mutual_information(df, list("abcd"), "z"), "mutual_information", 1).first()["column"] == "b"


def test_profile_edge_tables(spark):
    empty = spark.createDataFrame([], "x double, s string")
    assert profile.issue_table(empty).count() == 0 and profile.insights(empty).count() == 0
    flat = spark.createDataFrame([(1.0, None), (1.0, None), (1.0, None)], "x double, s string")
    d = profile.describe(flat).first()
    assert (d["std"], d["q25"], d["max"]) == (0.0, 1.0, 1.0)
    assert profile.shape(flat).first()["skew"] is None
    assert profile.corr_pearson(flat.select("x", (F.col("x") * 2).alias("z"))).first()["corr"] is None
    assert profile.histogram(flat, "x", 5).agg(F.sum("rows")).first()[0] == 3


def test_power_brackets_widen_and_need_values(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(3.0, 0.3, 4000)
    pdf = pd.DataFrame({"high": (8 * x + 1) ** (1 / 8) - 1, "same": 2.0})
    df = spark.createDataFrame(pdf).withColumn("none", F.lit(None).cast("double"))
    fit = scale.fit_power(df, ["high", "same", "none"])
    best = max(np.arange(2, 14, 0.05), key=lambda l: -len(x) / 2 * np.log(np.var(((pdf.high + 1) ** l - 1) / l)) + (l - 1) * np.log1p(pdf.high).sum())
    assert abs(fit.lambdas["high"] - best) < 0.1 and fit.lambdas["high"] > 6 and fit.lambdas["same"] == 1.0 and fit.lambdas["none"] is None
    got = scale.transform_power(df, fit).toPandas()
    assert got.none_scaled.isna().all() and abs(got.high_scaled.std() - 1) < 0.01
    low = spark.createDataFrame(pd.DataFrame({"v": np.maximum(1 - 8 * rng.normal(0.09, 0.008, 4000), 0.02) ** (-1 / 8)}))
    assert scale.fit_power(low, ["v"], "boxcox").lambdas["v"] < -5


def test_forest_scores_rows_once(spark, monkeypatch):
    calls, real = [], outliers.score_forest
    monkeypatch.setattr(outliers, "score_forest", lambda *a, **k: calls.append(1) or real(*a, **k))
    df = spark.range(300).select("id", F.rand(3).alias("x"), F.when(F.col("id") < 6, 9.0).otherwise(F.rand(4)).alias("y"))
    t = outliers.flagged_forest(df, ["x", "y"], ["id"], 0.02, trees=30, sample=64)
    assert len(calls) == 1 and "ArrowEvalPython" not in t._jdf.queryExecution().executedPlan().toString()
    assert {r["id"] for r in t.where("is_outlier").collect()} == set(range(6))


def ranks(v):
    return pd.Series(v).rank().to_numpy()


@pytest.mark.parametrize("gaps", [False, True])
def test_spearman_in_one_pass(spark, gaps):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"a": rng.integers(0, 6, 300).astype(float), "b": rng.normal(size=300), "c": rng.integers(0, 3, 300).astype(float), "d": np.arange(300.0), "e": 1.0})
    pdf["b"] += pdf.a
    if gaps:
        pdf.loc[::7, "a"] = np.nan
        pdf.loc[5::9, "c"] = np.nan
    got = {(r["left"], r["right"]): r["corr"] for r in profile.corr_spearman(frame(spark, pdf)).collect()}
    assert len(got) == 10
    for (x, y), v in got.items():
        both = pdf[[x, y]].dropna()
        want = np.corrcoef(ranks(both[x]), ranks(both[y]))[0, 1] if "e" not in (x, y) else None
        assert (v is None) == (want is None) and (v is None or abs(v - want) < 1e-9)


def test_hundred_columns(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(500, 100)) + 1e6
    base[:, 1] = base[:, 0] * 2
    base[::9, 5] = np.nan
    base[:, 7] = 4.0
    pdf = pd.DataFrame(base, columns=[f"c{i}" for i in range(100)])
    df = frame(spark, pdf)
    got = {(r["left"], r["right"]): r["corr"] for r in profile.corr_pearson(df).collect()}
    want = pdf.corr()
    assert len(got) == 4950 and abs(got["c0", "c1"] - 1) < 1e-9
    assert all((v is None) if "c7" in k else abs(v - want.loc[k[0], k[1]]) < 1e-7 for k, v in got.items())
    few = profile._pair_corr(df, {x: profile.dbl(x) for x in ["c0", "c5", "c9"]}, most=0).collect()
    assert all(abs(r["corr"] - want.loc[r["left"], r["right"]]) < 1e-7 for r in few)
    n, sums, products = profile.gram(df, list(pdf.columns), {x: 1e6 for x in pdf.columns})
    rows = pdf.dropna().to_numpy() - 1e6
    assert n == len(rows) and np.allclose(sums, rows.sum(axis=0)) and np.allclose(products, rows.T @ rows)
    flags = profile.missing_corr(df).collect()
    assert flags == []


def test_inverse_normal_of_arrays():
    import statistics

    from cleanlake.functions.normal import inverse_normal
    p = np.concatenate([np.linspace(1e-6, 1 - 1e-6, 4001), [1e-300, 1e-30, 1e-12, 0.075, 0.925, 1 - 1e-12]])
    assert np.allclose(inverse_normal(p), [statistics.NormalDist().inv_cdf(x) for x in p], rtol=1e-12, atol=1e-14)
    assert np.isnan(inverse_normal(np.array([0.0, 1.0, np.nan, -1.0]))).all() and inverse_normal(np.array([0.5]))[0] == 0


def test_selection_passes_do_not_repeat(spark, monkeypatch):
    from cleanlake.operators import features
    df = spark.createDataFrame([(float(i % 7), float(i % 5), float(i), "yn"[i % 7 > 3]) for i in range(200)], "a double, b double, x double, y string")
    calls = []
    plain, indexer = features.exact_quantiles, features.StringIndexer
    monkeypatch.setattr(features, "exact_quantiles", lambda *a, **k: calls.append("quantiles") or plain(*a, **k))
    monkeypatch.setattr(features, "StringIndexer", lambda **k: calls.append("classes") or indexer(**k))
    mi = {r["column"]: r["mutual_information"] for r in features.mutual_information(df, ["a", "b", "x"], "y").collect()}
    assert max(mi, key=mi.get) == "a" and calls == ["quantiles"]
    assert features.select_rfe(df, ["a", "b", "x"], "y", 1, 5) == ["a"] and calls == ["quantiles", "classes"]
