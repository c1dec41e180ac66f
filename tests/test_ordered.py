import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cleanlake.operators import ordered


def series(n=400, ties=0.4, groups=3, seed=1):
    rng = np.random.default_rng(seed)
    t = np.where(rng.random(n) < ties, 50, rng.integers(0, 100, n))     # one value of t holds a large part
    pdf = pd.DataFrame({"t": t.astype(float), "id": np.arange(n), "g": rng.choice(["a", "b", None][:groups], n, p=[0.8, 0.1, 0.1][:groups]),
                        "v": np.where(rng.random(n) < 0.5, np.nan, rng.random(n).round(4))})
    return pdf.sample(frac=1, random_state=seed).reset_index(drop=True)


def frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))).withColumn("g", F.when(F.col("g") != "NaN", F.col("g")))


def result(df, col):
    return {r["id"]: r[col] for r in df.collect()}


def same(got, want):
    for k, w in want.items():
        g = got[k]
        if w is None or (isinstance(w, float) and np.isnan(w)):
            assert g is None, (k, g, w)
        else:
            assert g == pytest.approx(w), (k, g, w)


@pytest.mark.parametrize("segments", [2, 7, 40])
def test_index_and_running_sum(spark, segments):
    pdf = series()
    df = frame(spark, pdf)
    p = pdf.sort_values(["t", "id"]).reset_index(drop=True)
    same(result(ordered.with_index(df, ["t", "id"], "i", segments=segments), "i"), dict(zip(p.id, p.index)))
    p["c"] = p.id.cumsum()
    same(result(ordered.running_sum(df, {"c": "id"}, ["t", "id"], segments=segments), "c"), dict(zip(p.id, p.c)))
    same(result(ordered.running_sum(df, {"c": "id"}, ["t", "id"], segments=segments, inclusive=False), "c"), dict(zip(p.id, p.c - p.id)))


def test_heavy_tie_is_split(spark):
    pdf = series(2000, ties=0.9)
    seg = ordered.segment(frame(spark, pdf), ["t", "id"], segments=10)
    sizes = [r["count"] for r in seg.groupBy(ordered.SEG).count().collect()]
    assert max(sizes) < 600 and len(sizes) >= 8


@pytest.mark.parametrize("direction", ["forward", "backward", "both"])
@pytest.mark.parametrize("part", [None, ["g"]])
def test_fill(spark, direction, part):
    pdf = series()
    p = pdf.sort_values(["t", "id"])
    src = p.groupby(p.g.fillna("-"))["v"] if part else p["v"]
    f, b = src.ffill(), src.bfill()
    if direction == "both":
        f = f.fillna(b)
    want = dict(zip(p.id, b if direction == "backward" else f))
    same(result(ordered.fill(frame(spark, pdf), ["v"], ["t", "id"], direction=direction, partition_by=part, segments=9), "v"), want)


def test_interpolate(spark):
    pdf = series()
    p = pdf.sort_values(["t", "id"])
    same(result(ordered.interpolate(frame(spark, pdf), "v", ["t", "id"], segments=9), "v"), dict(zip(p.id, p.v.interpolate())))


def test_rolling_crosses_blocks(spark):
    pdf = series().assign(v=lambda d: d.v.fillna(0.25))
    p = pdf.sort_values(["t", "id"])
    got = ordered.rolling_mean(frame(spark, pdf), "v", 6, ["t", "id"], segments=5, block=11)
    same(result(got, "rolling_mean"), dict(zip(p.id, p.v.rolling(6).mean())))


def test_value_ranks(spark):
    pdf = series()
    ranks = {r["t"]: r["avg_rank"] for r in ordered.value_ranks(frame(spark, pdf), "t").collect()}
    want = pdf.t.rank()
    for t, w in zip(pdf.t, want):
        assert ranks[t] == pytest.approx(w)


def test_timestamp_and_text_order(spark):
    df = spark.range(200).select("id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0, id % 40)").alias("ts"), F.concat(F.lit("key"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("s"))
    for order in (["ts", "id"], ["s"]):
        want = {r["id"]: i for i, r in enumerate(df.orderBy(*order).collect())}
        same(result(ordered.with_index(df, order, "i", segments=6), "i"), want)


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "t double, id long, v double")
    assert ordered.fill(df, ["v"], ["t", "id"]).collect() == []
    one = spark.createDataFrame([(1.0, 1, None)], "t double, id long, v double")
    assert ordered.interpolate(one, "v", ["t", "id"]).first()["v"] is None


def test_text_with_shared_prefixes_gives_even_segments(spark, sf):
    """Names that begin alike are cut by the bytes in which they differ, and the cut follows the order."""
    df = spark.read.parquet(f"{sf}/customer.parquet").select("c_name")
    seg = ordered.segment(df, ["c_name"], segments=8)
    sizes = [r[0] for r in seg.groupBy(ordered.SEG).count().select("count").collect()]
    assert len(sizes) >= 6 and max(sizes) <= 2 * df.count() / len(sizes)
    rows = sorted((r["c_name"], r[ordered.SEG]) for r in seg.collect())
    assert [x for _, x in rows] == sorted(x for _, x in rows)


def test_text_segments_follow_the_order_of_bytes(spark):
    rows = [(x, i) for i, x in enumerate(["prefix-" + y for y in ("", "a", "a\0", "a\0b", "ab", "é", "z" * 300, "z" * 300 + "1")] * 40 + [None] * 9 + ["prefix"] * 50)]
    seg = ordered.segment(spark.createDataFrame(rows, "s string, i int"), ["s", "i"], segments=16).collect()
    got = sorted(((r["s"] is not None, (r["s"] or "").encode(), r["i"]), r[ordered.SEG]) for r in seg)
    assert [x for _, x in got] == sorted(x for _, x in got)


def test_long_common_prefixes_are_cut_evenly(spark):
    head = "https://example.org/a/very/long/path/that/all/of/them/share/" * 5
    df = spark.range(6000).select(F.concat(F.lit(head), F.lpad(F.hash("id").cast("string"), 12, "0")).alias("s"))
    sizes = [r["count"] for r in ordered.segment(df, ["s"], segments=12).groupBy(ordered.SEG).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * min(sizes)
    got = ordered.with_index(df, ["s"], "i", segments=12).orderBy("i").collect()
    assert [r["s"] for r in got] == sorted(r["s"] for r in got) and [r["i"] for r in got] == list(range(6000))


def test_heavy_texts_are_cut_by_the_next_column(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "same").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("é"), F.col("id").cast("string"))).alias("s"), "id")
    sizes = [r["count"] for r in ordered.segment(df, ["s", "id"], segments=10).groupBy(ordered.SEG).count().collect()]
    assert max(sizes) < 1000
    got = [(r["s"], r["id"]) for r in ordered.with_index(df, ["s", "id"], "i", segments=10).orderBy("i").collect()]
    assert got == sorted(got, key=lambda t: (t[0] is not None, (t[0] or "").encode(), t[1]))
