"""Table-level text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c, count_if, small_frame, text_columns
from cleanlake.functions import text as X
from cleanlake.operators.profile import histogram, per_column
from cleanlake.operators.quantiles import exact_quantiles
from cleanlake.operators.skew import lookup_join


def apply(df: DataFrame, column: str, operations: list[str]) -> DataFrame:
    return df.withColumn(column, X.chain(c(column), operations))


def replace(df: DataFrame, column: str, expr: Column) -> DataFrame:
    return df.withColumn(column, expr)


def auto_clean(df: DataFrame) -> DataFrame:
    """Lower case, strip and collapse white space in every text column."""
    return df.select(*[X.standardize_ws(F.lower(c(x))).alias(x) if x in set(text_columns(df)) else c(x) for x in df.columns])


def stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return per_column(df, columns or text_columns(df), lambda x: [
        F.count(c(x)).alias("values"), F.count_distinct(c(x)).alias("unique"), F.avg(F.length(c(x))).alias("mean_length"), F.min(F.length(c(x))).alias("min_length"),
        F.max(F.length(c(x))).alias("max_length"), count_if(c(x) == "").alias("empty"), count_if(c(x).rlike(r"^\p{Nd}+$")).alias("numeric_only")])


def length_stats(df: DataFrame, column: str) -> DataFrame:
    t = df.select(F.length(c(column)).alias("n"))
    med = exact_quantiles(t, ["n"], [0.5])["n"][0]
    return t.agg(F.avg("n").alias("mean"), F.lit(med).cast("double").alias("median"), F.min("n").alias("min"), F.max("n").alias("max"))


def length_histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    return histogram(df.select(F.length(c(column)).alias("n")), "n", bins)


def totals(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.sum(F.length(c(column))).alias("characters"), F.sum(F.size(X.words(c(column)))).alias("words"))


def word_frequency(df: DataFrame, column: str, k: int = 10, stop: list[str] | None = None, min_chars: int = 1) -> DataFrame:
    """The k most frequent lower-cased words of the whole column, ties by word."""
    w = df.select(F.explode(X.char_words(c(column))).alias("word")).where(F.length("word") >= min_chars)
    if stop:
        w = w.where(~F.col("word").isin(stop))
    t = w.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    return t.orderBy(F.col("count").desc(), "word").limit(k)


def keywords(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return word_frequency(df, column, k, X.COMMON_WORDS, 3)


def issue_counts(df: DataFrame, column: str) -> DataFrame:
    x = c(column)
    letters = x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}")
    tests = {"url": x.rlike("(?i)http|www"), "email": x.rlike(r"@.*\."), "phone": x.rlike(r"\d{3}[-.]?\d{3}[-.]?\d{4}"), "html": x.rlike("<.*?>"),
             "extra_spaces": x.rlike(X.WS + "{2,}"), "all_caps": letters, "numeric": x.rlike(r"^\p{N}+$")}
    t = df.agg(*[F.struct(F.lit(k).alias("issue"), count_if(v).alias("rows")).alias(k) for k, v in tests.items()])
    return t.select(F.inline(F.array(*list(tests))))


def empty_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    t = per_column(df, columns or text_columns(df), lambda x: [count_if(c(x) == "").alias("empty"), F.count(F.lit(1)).alias("rows"), F.avg(F.length(c(x))).alias("mean_length")])
    return t.select("column", "empty", (F.col("empty") / F.col("rows") * 100).alias("empty_pct"), "mean_length")


def _scored_words(df: DataFrame, column: str, key: str, lexicon: DataFrame) -> DataFrame:
    """key, valence per word (null when the word is not in the lexicon); lexicon: columns word, polarity."""
    w = df.select(c(key), F.explode_outer(X.char_words(c(column))).alias("word"))
    return lookup_join(w, lexicon.select("word", "polarity"), ["word"], "left")


def sentiment_class(df: DataFrame, column: str, key: str, lexicon: DataFrame) -> DataFrame:
    """Mean polarity of the known words, banded at +-0.1."""
    t = _scored_words(df, column, key, lexicon).groupBy(c(key)).agg(F.coalesce(F.avg("polarity"), F.lit(0.0)).alias("polarity"))
    return t.withColumn("sentiment", F.when(F.col("polarity") > 0.1, "Positive").when(F.col("polarity") < -0.1, "Negative").otherwise("Neutral"))


def sentiment_scores(df: DataFrame, column: str, key: str, lexicon: DataFrame) -> DataFrame:
    """Shares of positive, negative and neutral weight and the normalised sum s / sqrt(s^2 + 15)."""
    v = F.coalesce("polarity", F.lit(0.0))
    word = F.col("word").isNotNull()
    t = _scored_words(df, column, key, lexicon).groupBy(c(key)).agg(
        F.coalesce(F.sum(F.when(v > 0, v + 1)), F.lit(0.0)).alias("p"), F.coalesce(F.sum(F.when(v < 0, 1 - v)), F.lit(0.0)).alias("n"),
        count_if(word & (v == 0)).alias("z"), F.coalesce(F.sum(v), F.lit(0.0)).alias("s"))
    total = F.col("p") + F.col("n") + F.col("z")
    part = lambda x: F.when(total > 0, F.col(x) / total).otherwise(F.lit(0.0))
    return t.select(c(key), part("p").alias("pos"), part("n").alias("neg"), part("z").alias("neu"), (F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15)).alias("compound"))


def recommend(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Formatting issues per text column, tested on all values."""
    cols = columns or text_columns(df)
    if not cols:
        return small_frame(df.sparkSession, [], "column string, extra_space boolean, special_characters boolean, mixed_case boolean")
    has = lambda x, cond: F.coalesce(F.max(cond), F.lit(False))
    up = lambda x: c(x).rlike(r"\p{Lu}") & ~c(x).rlike(r"\p{Ll}")
    low = lambda x: c(x).rlike(r"\p{Ll}") & ~c(x).rlike(r"\p{Lu}")
    t = per_column(df, cols, lambda x: [has(x, c(x).rlike(X.WS + "{2,}")).alias("extra_space"), has(x, c(x).rlike(r"(?U)[^\p{L}\p{N}_\s]")).alias("special_characters"),
                                       (has(x, low(x)) & has(x, up(x))).alias("mixed_case")])
    return t.where("extra_space OR special_characters OR mixed_case")
