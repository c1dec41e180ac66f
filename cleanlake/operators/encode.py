"""Categorical encoding. Fits are short category lists or look-up tables that stay distributed, whatever the number of values."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c, dbl, small_frame, text_columns, written
from cleanlake.operators.profile import profile
from cleanlake.operators.quantiles import grouped_quantiles
from cleanlake.operators.skew import group_stats_join, lookup_join
from cleanlake.operators.types import Categories, fit_categories

MISSING = "missing"


def _value(column: str) -> Column:
    """Text of the value; missing values share one explicit label."""
    return F.coalesce(c(column).cast("string"), F.lit(MISSING))


# ---------------------------------------------------------------- one-hot

WIDE = 1000       # up to so many values become columns of their own; more become one sparse vector


def onehot(df: DataFrame, columns: list[str], cats: Categories | None = None, *, missing: bool = False, keep: bool = False, wide: int = WIDE) -> DataFrame:
    """0/1 column per value, sorted; `missing` adds an indicator for nulls, `keep` keeps the source.

    A column of more than `wide` values becomes one sparse vector `<column>_onehot` instead, with the sorted values' codes as places (see
    `fit_label`; nulls have the last place with `missing`, else an empty vector).
    """
    found = {x: cats.values[x] if cats else (few.values[x] if (few := fit_categories(df, [x], wide)) else None) for x in columns}
    out = df.select(*[c(x) for x in df.columns if x not in columns or keep or found[x] is None],
                    *[e for x in columns if found[x] is not None for e in
                      [F.coalesce((c(x).cast("string") == v).cast("int"), F.lit(0)).alias(f"{x}_{v}") for v in found[x]] + ([c(x).isNull().cast("int").alias(f"{x}_nan")] if missing else [])])
    for x in columns:
        if found[x] is None:
            out = onehot_vector(out, x, missing=missing)
            out = out if keep else out.drop(x)
    return out


def fit_values(df: DataFrame, column: str) -> DataFrame:
    """value, code: the sorted distinct known values, numbered from 0."""
    from cleanlake.operators.ordered import with_index
    return with_index(df.where(c(column).isNotNull()).select(c(column).cast("string").alias("value")).distinct(), ["value"], "code")


def onehot_vector(df: DataFrame, column: str, fit: DataFrame | None = None, *, missing: bool = False, name: str | None = None) -> DataFrame:
    """One sparse vector with a 1 at the value's code. Unknown values and, without `missing`, nulls have no 1."""
    fit = fit if fit is not None else written(fit_values(df, column), "onehot-values")
    n = fit.count()
    known = c(column).isNotNull()
    t = lookup_join(df.withColumn("__value", c(column).cast("string")), fit.select(F.col("value").alias("__value"), F.col("code").alias("__code")), ["__value"], "left")
    # The last place stands for null, the one after it for nothing, which the encoder leaves out.
    t = t.withColumn("__code", F.coalesce(F.col("__code"), F.when(~known & F.lit(missing), n).otherwise(n + int(missing))).cast("double"))
    return _places(t, n + int(missing), name or column + "_onehot").drop("__value", "__code")


def _places(df: DataFrame, size: int, name: str) -> DataFrame:
    top = df.sparkSession.createDataFrame([(float(size),)], "__code double")
    encoder = OneHotEncoder(inputCol="__code", outputCol=name, dropLast=True).fit(top)
    return encoder.transform(df)


def onehot_long(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """key, column, value: one row per known cell, the long form of one-hot columns of any number."""
    cells = F.array(*[F.struct(F.lit(x).alias("column"), c(x).cast("string").alias("value")) for x in columns])
    return df.select(*[c(k) for k in key], F.inline(cells)).where("value is not null")


# ---------------------------------------------------------------- look-up tables

def fit_label(df: DataFrame, column: str) -> DataFrame:
    """value, code: sorted distinct values numbered from 0; missing is a label of its own.

    The numbering runs over distinct values only, along distributed segments.
    """
    from cleanlake.operators.ordered import with_index
    values = df.select(_value(column).alias("value")).distinct()
    return with_index(values, ["value"], "code")


def _apply(df: DataFrame, column: str, table: DataFrame, new: dict[str, str]) -> DataFrame:
    """Join `table` (value, ...) on the value and add its columns under new names."""
    t = table.select(F.col("value").alias("__value"), *[c(k).alias("__t_" + v) for k, v in new.items()])
    out = lookup_join(df.withColumn("__value", _value(column)), t, ["__value"], "left")
    return out.select(*[c(x) for x in df.columns if x not in new.values()], *[c("__t_" + v).alias(v) for v in new.values()])


def label(df: DataFrame, column: str, fit: DataFrame | None = None, name: str | None = None) -> DataFrame:
    return _apply(df, column, fit if fit is not None else fit_label(df, column), {"code": name or column + "_encoded"})


def ordinal(df: DataFrame, column: str, order: list[str] | None = None, unknown: str = "error", name: str | None = None) -> DataFrame:
    """Position in the given order (or the sorted values). unknown: error or null."""
    new = name or column + "_ordinal"
    fit = fit_values(df, column) if order is None else small_frame(df.sparkSession, [(v, i) for i, v in enumerate(order)], "value string, code long")
    t = fit.select(F.col("value").alias("__value"), F.col("code").cast("int").alias("__code"))
    out = lookup_join(df.withColumn("__value", c(column).cast("string")), t, ["__value"], "left")
    strange = F.col("__code").isNull() & c(column).isNotNull()
    if unknown == "error":
        code = F.when(strange, F.raise_error(F.concat(F.lit(f"unknown category in {column}: "), F.col("__value"))).cast("int")).otherwise(F.col("__code"))
    else:
        code = F.col("__code")
    return out.select(*[c(x) for x in df.columns if x != new], code.alias(new))


def binary(df: DataFrame, column: str, fit: DataFrame | None = None) -> DataFrame:
    """Bits of the 1-based sorted position, most significant first."""
    fit = fit if fit is not None else fit_label(df, column)
    n = fit.count()
    bits = max(1, int(n).bit_length())
    t = _apply(df, column, fit, {"code": "__code"})
    return t.select(*[c(x) for x in df.columns], *[F.expr(f"cast(shiftright(__code + 1, {bits - 1 - i}) & 1 as int)").alias(f"{column}_{i}") for i in range(bits)])


def fit_target(df: DataFrame, column: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """value, encoded: (sum + m * prior) / (count + m)."""
    prior = df.agg(F.avg(dbl(target))).first()[0] or 0.0
    g = df.where(dbl(target).isNotNull()).groupBy(_value(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.sum(dbl(target)).alias("s"))
    return g.select("value", ((F.col("s") + smoothing * prior) / (F.col("n") + smoothing)).alias("encoded"), F.lit(prior).alias("prior"))


def target(df: DataFrame, column: str, target_col: str, fit: DataFrame | None = None, smoothing: float = 10.0, name: str | None = None) -> DataFrame:
    new = name or column + "_target_encoded"
    fit = fit if fit is not None else fit_target(df, column, target_col, smoothing)
    prior = fit.agg(F.max("prior")).first()[0]
    return _apply(df, column, fit, {"encoded": new}).withColumn(new, F.coalesce(c(new), F.lit(prior)))


def _exact_sum(x: Column) -> Column:
    """Sum of a double column that does not depend on the order of the rows: the decimal part to ten places exactly, and what is left of it."""
    part = x.try_cast("decimal(28,10)")
    return F.coalesce(F.sum(part).cast("double"), F.lit(0.0)) + F.coalesce(F.sum(x - F.coalesce(part.cast("double"), F.lit(0.0))), F.lit(0.0))


def target_out_of_fold(df: DataFrame, column: str, target_col: str, key: str, folds: int = 5, smoothing: float = 10.0, name: str | None = None) -> DataFrame:
    """Target encoding in which a row never sees its own fold (folds by key modulo). Sums are exact, so that runs agree to the last digit."""
    new = name or column + "_target_encoded"
    y = dbl(target_col)
    total = df.agg(_exact_sum(y).alias("s"), F.count(y).alias("n")).first()
    prior = total["s"] / total["n"] if total["n"] else 0.0
    fold = F.pmod(c(key), F.lit(folds)).cast("int")
    value = _value(column)
    per = df.groupBy(value.alias("value"), fold.alias("fold")).agg(F.count(y).alias("n"), _exact_sum(y).alias("s"))
    whole = per.groupBy("value").agg(F.sum("n").alias("tn"), _exact_sum(F.col("s")).alias("ts"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "s")))).alias("by"))
    t = whole.select(F.col("value").alias("__value"), "tn", "ts", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("__fold"), "by")
    own = F.try_element_at("by", F.col("__fold"))
    n, s = F.col("tn") - F.coalesce(own["n"], F.lit(0)), F.col("ts") - F.coalesce(own["s"], F.lit(0.0))
    t = t.select("__value", "__fold", ((s + smoothing * prior) / (n + smoothing)).alias("__enc"))
    out = lookup_join(df.withColumn("__value", value).withColumn("__fold", fold), t, ["__value", "__fold"], "left")
    return out.select(*[c(x) for x in df.columns], F.coalesce("__enc", F.lit(prior)).alias(new))


def fit_frequency(df: DataFrame, column: str) -> DataFrame:
    return df.where(c(column).isNotNull()).groupBy(c(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def frequency(df: DataFrame, column: str, fit: DataFrame | None = None) -> DataFrame:
    return _apply(df, column, fit if fit is not None else fit_frequency(df, column), {"n": column + "_freq"})


def hashed(df: DataFrame, column: str, n: int = 8) -> DataFrame:
    """n indicator columns; the hot one is md5(value) modulo n, folded byte by byte."""
    byte = lambda i: F.conv(F.substring(F.md5(_value(column)), i * 2 + 1, 2), 16, 10).cast("int")
    code = F.lit(0)
    for i in range(16):
        code = F.pmod(code * 256 + byte(i), F.lit(n))
    t = df.withColumn("__code", code)
    return t.select(*[c(x) for x in df.columns], *[(F.col("__code") == i).cast("int").alias(f"{column}_hash_{i}") for i in range(n)])


def mapped(df: DataFrame, column: str, mapping: dict[str, float], name: str | None = None) -> DataFrame:
    """User value -> number; missing and unknown values are 0."""
    t = small_frame(df.sparkSession, [(k, float(v)) for k, v in mapping.items()], "value string, v double")
    new = name or column + "_mapped"
    return _apply(df, column, t, {"v": new}).withColumn(new, F.coalesce(c(new), F.lit(0.0)))


def fit_stat(df: DataFrame, column: str, number: str, how: str) -> DataFrame:
    base = df.where(c(column).isNotNull())
    if how == "median":
        return grouped_quantiles(base.select(c(column).cast("string").alias("value"), c(number)), ["value"], [number], [0.5]).select("value", c(number)[0].alias("v"))
    agg = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[how]
    return base.groupBy(c(column).cast("string").alias("value")).agg(agg(dbl(number)).alias("v"))


def stat(df: DataFrame, column: str, number: str, how: str, name: str | None = None) -> DataFrame:
    return _apply(df, column, fit_stat(df, column, number, how), {"v": name or f"{column}_{how}_{number}"})


def rank(df: DataFrame, column: str, by: str, number: str | None = None, name: str | None = None) -> DataFrame:
    """Average rank of the value by group mean / median ascending, or by frequency descending."""
    from cleanlake.operators.ordered import value_ranks
    if by == "frequency":
        t = fit_frequency(df, column).select("value", (-F.col("n")).alias("v"))
    else:
        t = fit_stat(df, column, number, by)
    r = value_ranks(t, "v").select("v", "avg_rank")
    return _apply(df, column, lookup_join(t, r, ["v"], "left"), {"avg_rank": name or f"{column}_{by}_rank"})


def leave_one_out(df: DataFrame, column: str, target_col: str, spread_by: list[str] | None = None, name: str | None = None) -> DataFrame:
    """(sum - y) / (n - 1) within the value; a value seen once takes the overall mean."""
    prior = df.agg(F.avg(dbl(target_col))).first()[0]
    t = group_stats_join(df, [column], {"__s": F.sum(dbl(target_col)), "__c": F.count(dbl(target_col))}, spread_by=spread_by)
    y = F.coalesce(dbl(target_col), F.lit(0.0))
    k = F.col("__c") - F.when(dbl(target_col).isNotNull(), 1).otherwise(0)
    enc = F.when(k > 0, (F.col("__s") - y) / k).otherwise(F.lit(prior))
    return t.select(*[c(x) for x in df.columns], enc.alias(name or column + "_loo"))


def weight_of_evidence(df: DataFrame, column: str, target_col: str, smoothing: float = 0.5, name: str | None = None) -> DataFrame:
    """ln(share of events / share of non-events) per value of a 0/1 target, counts smoothed."""
    y = dbl(target_col)
    g = df.groupBy(_value(column).alias("value")).agg(F.count(F.when(y == 1, 1)).alias("e"), F.count(F.when(y == 0, 1)).alias("z"))
    tot = g.agg(F.sum("e"), F.sum("z"), F.count(F.lit(1))).first()
    e = (F.col("e") + smoothing) / F.lit(tot[0] + smoothing * tot[2])
    z = (F.col("z") + smoothing) / F.lit(tot[1] + smoothing * tot[2])
    return _apply(df, column, g.select("value", F.ln(e / z).alias("v")), {"v": name or column + "_woe"})


# ---------------------------------------------------------------- dispatch and analysis

def _cardinality(df: DataFrame, columns: list[str]) -> dict[str, int]:
    return df.agg(*[F.count_distinct(c(x)).alias(x) for x in columns]).first().asDict() if columns else {}


def _small_cardinality(df: DataFrame, columns: list[str], certain: int = 200) -> dict[str, int]:
    """Distinct counts that only have to be exact when small: a sketch first, exact counts for the small columns."""
    if not columns:
        return {}
    rough = df.agg(*[F.approx_count_distinct(c(x)).alias(x) for x in columns]).first().asDict()
    return rough | _cardinality(df, [x for x in columns if rough[x] <= certain])


def auto(df: DataFrame, columns: list[str] | None = None, limit: int = 10) -> DataFrame:
    """At most `limit` values one-hot, else label in place."""
    cols = columns or text_columns(df)
    card = _small_cardinality(df, cols)
    out = df
    for x in cols:
        out = onehot(out, [x]) if card[x] <= limit else label(out, x, name="__new").drop(x).withColumnRenamed("__new", x)
    return out


def bulk(df: DataFrame, strategy: str = "smart", columns: list[str] | None = None, target_col: str | None = None) -> DataFrame:
    """strategy: smart, onehot (columns up to 20 values, one sparse vector above), label, target. Sources are kept, every column is encoded."""
    cols = columns or text_columns(df)
    card = _small_cardinality(df, cols)
    out = df
    for x in cols:
        if strategy == "target":
            out = target(out, x, target_col)
        elif strategy == "label":
            out = label(out, x, name=x + "_label_encoded")
        elif strategy == "onehot":
            out = onehot(out, [x], missing=True, keep=True, wide=20)
        elif card[x] <= 2:
            out = label(out, x)
        elif card[x] <= 10:
            out = onehot(out, [x], missing=True, keep=True)
        elif card[x] <= 50:
            out = label(out, x, name=x + "_label_encoded")
        else:
            out = hashed(out, x, 8)
    return out


def analysis(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: unique, missing, most and least frequent value (ties: smallest / largest), ratio."""
    cols = columns or text_columns(df)
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), c(x).cast("string").alias("value")) for x in cols])))
    counts = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("value").isNotNull()
    top = F.min(F.when(known, F.struct((-F.col("n")).alias("n"), "value")))
    low = F.max(F.when(known, F.struct((-F.col("n")).alias("n"), "value")))
    t = counts.groupBy("column").agg(F.count("value").alias("unique"), F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("missing"), F.sum("n").alias("rows"), top.alias("t"), low.alias("l"))
    return t.select("column", "unique", "missing", F.col("t.value").alias("most_frequent"), (-F.col("t.n")).alias("most_count"), F.col("l.value").alias("least_frequent"),
                    (-F.col("l.n")).alias("least_count"), (F.col("unique") / F.col("rows")).alias("cardinality_ratio"))


def recommend(df: DataFrame, max_onehot: int = 10) -> DataFrame:
    rows = []
    for x, k in _cardinality(df, text_columns(df)).items():
        method = "binary_or_label" if k <= 2 else "onehot" if k <= max_onehot else "target_or_ordinal" if k <= 50 else "hashing"
        rows.append((x, k, method, None if k <= 1 else "onehot_encode" if k <= 10 else "label_encode"))
    return small_frame(df.sparkSession, rows, "column string, unique long, method string, action string")


def priority(df: DataFrame) -> DataFrame:
    cols = text_columns(df)
    card = _cardinality(df, cols)
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c(x)).alias(x) for x in cols]).first()
    rows = []
    for x in cols:
        gaps = (row["__n"] - row[x]) / row["__n"] > 0.2
        level = 1 if card[x] <= 5 else 2 if card[x] <= 20 else 3
        rows.append((x, ["low", "medium", "high"][level - 1], gaps, card[x], level + int(gaps)))
    rows.sort(key=lambda r: (-r[4], r[0]))
    return small_frame(df.sparkSession, [(i + 1, *r) for i, r in enumerate(rows)], "position int, column string, complexity string, missing_data boolean, unique long, score int")
