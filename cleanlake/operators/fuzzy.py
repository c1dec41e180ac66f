"""Fuzzy matching of text values: score = 100 * (1 - levenshtein / longer length).

Candidates come from counting arguments, not from all pairs, and nothing above the threshold can be missed:

* d edits destroy at most q * d of a value's q-grams. With the q-grams of every value in one order, rarest first, two values within d edits share one
  among the first q * d + 1 of each, at most d places apart. These are the equi-join keys: their number grows with the length, not with its square.
* Where a value is too short to have that many q-grams, slices serve: if it is within d edits of a longer one and is cut into d + 1 slices, one slice
  occurs unchanged in the other near its own place. Lengths, and so the keys, are bounded there.

The joins are salted, and candidates are verified.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c, written
from cleanlake.operators.components import components
from cleanlake.operators.skew import lookup_join, skew_join

_START = "cast(i * l div (d + 1) as int)"
_LEN = "cast((i + 1) * l div (d + 1) - i * l div (d + 1) as int)"


def _short_keys(v: DataFrame, threshold: int) -> DataFrame:
    """Slices of a value in its role as the shorter side, for every length the longer side may have."""
    t = v.select("v", F.length("v").alias("l")).where("l > 0")
    t = t.withColumn("lp", F.explode(F.expr(f"sequence(l, cast((l * 100) div {threshold} as int))")))
    t = t.withColumn("d", F.expr(f"cast(({100 - threshold} * lp) div 100 as int)"))
    t = t.withColumn("i", F.explode(F.expr("sequence(0, d)")))
    return t.select("v", "l", "lp", "i", F.expr(f"substring(v, {_START} + 1, {_LEN})").alias("slice"))


def _long_keys(v: DataFrame, threshold: int) -> DataFrame:
    """Substrings of a value in its role as the longer side, at the offsets a slice can have moved to."""
    t = v.select(F.col("v").alias("w"), F.length("v").alias("lp")).where("lp > 0")
    t = t.withColumn("d", F.expr(f"cast(({100 - threshold} * lp) div 100 as int)"))
    t = t.withColumn("l", F.explode(F.expr(f"sequence(cast(({threshold} * lp + 99) div 100 as int), lp)")))
    t = t.withColumn("i", F.explode(F.expr("sequence(0, d)")))
    low, high = "greatest(-i, lp - l - (d - i))", "least(i, lp - l + (d - i))"
    t = t.withColumn("s", F.explode(F.expr(f"if({low} <= {high}, sequence({low}, {high}), cast(array() as array<int>))")))
    t = t.where(f"{_START} + s >= 0 AND {_START} + s + {_LEN} <= lp")
    return t.select("w", "l", "lp", "i", F.expr(f"substring(w, {_START} + s + 1, {_LEN})").alias("slice")).distinct()


def _score(a: str, b: str):
    longer = F.greatest(F.length(a), F.length(b))
    return (F.lit(1.0) - F.levenshtein(F.col(a), F.col(b)) / longer) * 100


def _gram_size(threshold: int) -> int:
    """Largest q, up to 4, at which long values have enough q-grams to spare: q * d stays below 0.86 of the length."""
    return max((q for q in range(1, 5) if q * (100 - threshold) <= 0.86 * threshold), default=0)


def _edits(length: int, threshold: int) -> int:
    """Edits that a value of this length may be away from a partner, at most."""
    return (100 - threshold) * (length * 100 // threshold) // 100


def _short_lengths(threshold: int, q: int) -> list[int]:
    """Lengths at which a value does not have q * d + 1 q-grams."""
    return [n for n in range(1, 2_000) if n - q + 1 < q * _edits(n, threshold) + 1]


def _prefixes(values: DataFrame, freq: DataFrame, threshold: int, q: int) -> DataFrame:
    """v, l, gram, places: the q * d + 1 rarest q-grams of every value (rows of one q-gram together)."""
    grams = _grams(values, q)
    ranked = lookup_join(grams, freq, ["gram"], "inner")
    listed = ranked.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("n", "gram", "place"))).alias("grams")).withColumn("l", F.length("v"))
    keep = F.expr(f"{q} * cast(({100 - threshold} * cast(l * 100 div {threshold} as int)) div 100 as int) + 1")
    return listed.select("v", "l", F.inline(F.slice("grams", F.lit(1), keep))).select("v", "l", "gram", "place")


def _grams(values: DataFrame, q: int) -> DataFrame:
    chars = values.select("v", F.split("v", "").alias("c")).withColumn("c", F.filter("c", lambda x: x != ""))
    at = F.expr(f"transform(sequence(0, size(c) - {q}), i -> concat({', '.join(f'get(c, i + {k})' for k in range(q))}))")
    return chars.where(F.size("c") >= q).select("v", F.posexplode(at).alias("place", "gram"))


def _by_grams(left: DataFrame, right: DataFrame, threshold: int, q: int, keep: str) -> DataFrame:
    """Candidates v, w of two tables of values that all have enough q-grams."""
    freq = written(_grams(left.unionByName(right), q).groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram-counts")
    a = _prefixes(left, freq, threshold, q)
    b = _prefixes(right, freq, threshold, q).select(F.col("v").alias("w"), F.col("l").alias("lw"), "gram", F.col("place").alias("place_w"))
    edits = F.expr(f"cast(({100 - threshold} * greatest(l, lw)) div 100 as int)")
    pair = skew_join(a, b, ["gram"]).where(keep)
    return pair.where((F.abs(F.col("l") - F.col("lw")) <= edits) & (F.abs(F.col("place") - F.col("place_w")) <= edits)).select("v", "w").distinct()


def _verified(left: DataFrame, right: DataFrame, threshold: int, keep: str) -> DataFrame:
    """Pairs (v, w) of two tables of values within the threshold that satisfy `keep`, a condition on v, l, w, lw."""
    q = _gram_size(threshold)
    few = _short_lengths(threshold, q) if q else []
    is_short = lambda x: F.length(x).isin(few) if few else F.lit(False)
    near = lambda x: F.length(x) <= (max(few) * 100 // threshold if few else 0)
    parts = []
    if q:
        parts.append(_by_grams(left.where(~is_short("v")), right.where(~is_short("v")), threshold, q, keep))
    if few or not q:
        one, two = (left.where(near("v")), right.where(near("v"))) if q else (left, right)
        some = (is_short("v") | is_short("w")) if q else F.lit(True)
        # either side may be the longer one
        down = skew_join(_short_keys(one, threshold), _long_keys(two, threshold), ["l", "lp", "i", "slice"]).select("v", "w")
        up = skew_join(_short_keys(two, threshold), _long_keys(one, threshold), ["l", "lp", "i", "slice"]).where("l < lp").select(F.col("w").alias("v"), F.col("v").alias("w"))
        sliced = down.unionByName(up).where(some).select("v", "w", F.length("v").alias("l"), F.length("w").alias("lw")).where(keep).select("v", "w").distinct()
        parts.append(sliced)
    pair = reduce(DataFrame.unionByName, parts).distinct()
    return pair.where(f"levenshtein(v, w, cast(({100 - threshold} * greatest(length(v), length(w))) div 100 as int)) >= 0")


def _values(df: DataFrame, column: str) -> DataFrame:
    return df.where(c(column).isNotNull()).select(c(column).cast("string").alias("v")).distinct()


def pairs(df: DataFrame, column: str, threshold: int = 80) -> DataFrame:
    """Unordered pairs of distinct values with score >= threshold: left < right, score."""
    v = _values(df, column)
    got = _verified(v, v, threshold, "v < w")
    return got.select(F.col("v").alias("left"), F.col("w").alias("right"), _score("v", "w").alias("score"))


def matches(left: DataFrame, right: DataFrame, left_col: str, right_col: str, threshold: int = 80) -> DataFrame:
    """All (left value, right value, score) with score >= threshold between the distinct values of two tables."""
    got = _verified(_values(left, left_col), _values(right, right_col), threshold, "true")
    return got.select(F.col("v").alias("left_value"), F.col("w").alias("right_value"), _score("v", "w").alias("score"))


def best_match(left: DataFrame, right: DataFrame, left_col: str, right_col: str, threshold: int = 80) -> DataFrame:
    """Best right value per left value; ties go to the smallest right value."""
    m = matches(left, right, left_col, right_col, threshold)
    best = F.min(F.struct((-F.col("score")).alias("neg"), F.col("right_value").alias("right_value")))
    t = m.groupBy("left_value").agg(best.alias("b"))
    return t.select("left_value", F.col("b.right_value").alias("right_value"), (-F.col("b.neg")).alias("score"))


def fuzzy_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, threshold: int = 80) -> DataFrame:
    """Left rows with the best matching right value and its score; left rows without a match are dropped."""
    best = best_match(left, right, left_col, right_col, threshold).select(
        F.col("left_value").alias(left_col), F.col("right_value").alias("matched"), "score")
    return lookup_join(left, best, [left_col], "inner")


def groups(df: DataFrame, column: str, threshold: int = 80) -> DataFrame:
    """Members of groups of similar values: representative (smallest), member, score to it, rows of the member."""
    lab = components(pairs(df, column, threshold))
    counts = df.where(c(column).isNotNull()).groupBy(c(column).cast("string").alias("node")).agg(F.count(F.lit(1)).alias("rows"))
    t = lab.join(counts, "node").select(F.col("label").alias("representative"), F.col("node").alias("member"), "rows")
    return t.select("representative", "member", F.when(F.col("representative") == F.col("member"), F.lit(100.0))
                    .otherwise(_score("representative", "member")).alias("score"), "rows")


def standardize(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace values by mapping (columns from, to); other values stay."""
    m = mapping.select(F.col("from").alias(column), F.col("to").alias("__to"))
    t = lookup_join(df, m, [column], "left")
    return t.select(*[F.coalesce("__to", c(x)).alias(x) if x == column else c(x) for x in df.columns])
