"""Exact linear-interpolation quantiles that never gather an unbounded column in one task.

Small inputs use the built-in `percentile`. Larger ones are bracketed with the mergeable
`percentile_approx` sketch; only values inside the narrow bracket are counted exactly, by value,
and the wanted order statistics are read from the running counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cleanlake.core import c, dbl
from cleanlake.operators.skew import skew_join

SMALL_CELLS = 4_000_000
ACCURACY = 100_000


def _interpolate(pos: float, lo: float, hi: float) -> float:
    frac = pos - math.floor(pos)
    return lo + (hi - lo) * frac if frac else lo


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], *, small_cells: int = SMALL_CELLS,
                    accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Quantiles per column, nulls skipped; None for a column without values."""
    if not columns or not probs:
        return {col: [] for col in columns}
    df = df.select(*[dbl(col).alias(col) for col in columns])
    if df.count() * len(columns) <= small_cells:
        row = df.agg(*[F.percentile(c(col), F.array(*map(F.lit, probs))).alias(col) for col in columns]).first()
        return {col: list(row[col]) if row[col] is not None else [None] * len(probs) for col in columns}
    return _bracketed(df, columns, probs, accuracy)


def _bracketed(df: DataFrame, columns: list[str], probs: list[float], accuracy: int) -> dict[str, list[float | None]]:
    extremes = df.agg(*[F.struct(F.count(c(col)).alias("n"), F.min(c(col)).alias("lo"), F.max(c(col)).alias("hi"))
                        .alias(col) for col in columns]).first()
    wanted = {}
    for ci, col in enumerate(columns):
        if extremes[col]["n"]:
            for pi, p in enumerate(probs):
                wanted[(ci, pi)] = (extremes[col]["n"] - 1) * p
    brackets: dict[tuple[int, int], tuple[float, float, int]] = {}
    open_, eps = set(wanted), 4.0 / accuracy
    while open_:
        pts = {k: (max(0.0, probs[k[1]] - eps), min(1.0, probs[k[1]] + eps)) for k in open_}
        cols = sorted({k[0] for k in open_})
        grid = {ci: sorted({x for k in open_ if k[0] == ci for x in pts[k]}) for ci in cols}
        approx = df.agg(*[F.percentile_approx(c(columns[ci]), F.array(*map(F.lit, grid[ci])), accuracy)
                          .alias(str(ci)) for ci in cols]).first()
        cand = {}
        for k in open_:
            ci = k[0]
            lo_p, hi_p = pts[k]
            lo = extremes[columns[ci]]["lo"] if lo_p == 0.0 else approx[str(ci)][grid[ci].index(lo_p)]
            hi = extremes[columns[ci]]["hi"] if hi_p == 1.0 else approx[str(ci)][grid[ci].index(hi_p)]
            cand[k] = (lo, hi)
        aggs = []
        for k, (lo, hi) in cand.items():
            x = c(columns[k[0]])
            aggs += [F.count(F.when(x < lo, 1)).alias(f"b{k[0]}_{k[1]}"), F.count(F.when(x <= hi, 1)).alias(f"u{k[0]}_{k[1]}")]
        cnt = df.agg(*aggs).first()
        for k, (lo, hi) in cand.items():
            below, upto = cnt[f"b{k[0]}_{k[1]}"], cnt[f"u{k[0]}_{k[1]}"]
            if below <= math.floor(wanted[k]) and math.ceil(wanted[k]) < upto:
                brackets[k] = (lo, hi, below)
        open_ -= set(brackets)
        eps = min(1.0, eps * 8)
    out: dict[str, list[float | None]] = {col: [None] * len(probs) for col in columns}
    keys = sorted(brackets)
    if not keys:
        return out
    cells = F.array(*[F.struct(F.lit(i).alias("id"), F.when(c(columns[k[0]]).between(brackets[k][0], brackets[k][1]),
                                                            c(columns[k[0]])).alias("v")) for i, k in enumerate(keys)])
    inside = (df.select(F.inline(F.filter(cells, lambda s: s["v"].isNotNull())))
              .groupBy("id", "v").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("id").orderBy("v")
    run = inside.withColumn("cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    below = F.element_at(F.array(*[F.lit(float(brackets[k][2])) for k in keys]), F.col("id") + 1)
    pos = F.element_at(F.array(*[F.lit(float(wanted[k])) for k in keys]), F.col("id") + 1)
    end, start = below + F.col("cum"), below + F.col("cum") - F.col("n")
    hits = run.select("id", "v", ((start <= F.floor(pos)) & (F.floor(pos) < end)).alias("is_lo"),
                      ((start <= F.ceil(pos)) & (F.ceil(pos) < end)).alias("is_hi")).where("is_lo OR is_hi").collect()
    lo = {r["id"]: r["v"] for r in hits if r["is_lo"]}
    hi = {r["id"]: r["v"] for r in hits if r["is_hi"]}
    for i, k in enumerate(keys):
        out[columns[k[0]]][k[1]] = _interpolate(wanted[k], lo[i], hi[i])
    return out


def grouped_quantiles(df: DataFrame, keys: list[str], columns: list[str], probs: list[float], *,
                      small_group: int = SMALL_CELLS, accuracy: int = ACCURACY) -> DataFrame:
    """Quantiles per group: keys plus one array<double> column per input column.

    Groups of a proven small size are aggregated directly; for larger groups only the values between two
    sketched bounds (about 8/accuracy of the group) are ordered.
    """
    base = df.select(*[c(k) for k in keys], *[dbl(col).alias("__q_" + col) for col in columns])
    value = {col: "__q_" + col for col in columns}
    plist = F.array(*map(F.lit, probs))
    direct = lambda d: d.groupBy(*[c(k) for k in keys]).agg(
        *[F.percentile(c(value[col]), plist).alias(col) for col in columns])
    counts = base.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    biggest = counts.agg(F.max("__n")).first()[0] or 0
    if biggest * len(columns) <= small_group:
        return direct(base)
    limit = small_group // len(columns)
    small = direct(skew_join(base, counts.where(F.col("__n") <= limit), keys, "left_semi", counts=counts))
    big = skew_join(base, counts.where(F.col("__n") > limit).select(*[c(k) for k in keys]), keys, "left_semi", counts=counts)
    long = big.select(*[c(k) for k in keys], F.inline(F.array(*[
        F.struct(F.lit(i).alias("__c"), c(value[col]).alias("__v")) for i, col in enumerate(columns)]))).where("__v IS NOT NULL")
    g = keys + ["__c"]
    eps = 8.0 / accuracy
    pts = [x for p in probs for x in (max(0.0, p - eps), min(1.0, p + eps))]
    br = long.groupBy(*[c(k) for k in g]).agg(
        F.count(F.lit(1)).alias("__m"), F.percentile_approx("__v", F.array(*map(F.lit, pts)), accuracy).alias("__b"),
        F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    rows = []
    for j, p in enumerate(probs):
        lo = F.col("__min") if p - eps <= 0 else F.col("__b")[2 * j]
        hi = F.col("__max") if p + eps >= 1 else F.col("__b")[2 * j + 1]
        rows.append(F.struct(F.lit(j).alias("j"), lo.alias("lo"), hi.alias("hi"), ((F.col("__m") - 1) * F.lit(p)).alias("pos")))
    br = br.select(*[c(k) for k in g], F.col("__m").alias("__n"), F.array(*rows).alias("__br"))
    joined = skew_join(long, br.drop("__n"), g, counts=br)
    part = joined.select(*[c(k) for k in g], "__v", F.inline("__br")).where(F.col("__v") <= F.col("hi"))
    tally = (part.withColumn("__in", F.when(F.col("__v") >= F.col("lo"), F.col("__v")))
             .groupBy(*[c(k) for k in g], "j", "pos", "__in").agg(F.count(F.lit(1)).alias("m")))
    w = Window.partitionBy(*[c(k) for k in g], "j").orderBy(F.col("__in").asc_nulls_first())
    run = tally.withColumn("end", F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("start", F.col("end") - F.col("m"))
    hit = lambda rank: F.max(F.when((F.col("start") <= rank) & (rank < F.col("end")), F.col("__in")))
    got = run.groupBy(*[c(k) for k in g], "j").agg(hit(F.floor("pos")).alias("lo"), hit(F.ceil("pos")).alias("hi"),
                                                 F.max("pos").alias("pos"))
    got = got.withColumn("q", F.when(F.col("lo").isNull() | F.col("hi").isNull(),
                                     F.raise_error(F.lit("quantile outside its bracket; raise accuracy")).cast("double"))
                         .otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor("pos"))))
    per = got.groupBy(*[c(k) for k in keys]).agg(*[
        F.when(F.count(F.when(F.col("__c") == i, 1)) > 0,
               F.transform(F.sort_array(F.collect_list(F.when(F.col("__c") == i, F.struct("j", "q")))), lambda s: s["q"]))
        .alias(col) for i, col in enumerate(columns)])
    return small.unionByName(per)
