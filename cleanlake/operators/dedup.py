"""Exact, conditional and near duplicates.

Groups are reduced with map-side aggregates, so a group of copies that holds a large part of the table never
meets in one task; row-level results are read back through salted joins.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c, share, small_frame
from cleanlake.operators.profile import distinct_groups
from cleanlake.operators.skew import group_stats_join, skew_join


def _order(order_by: list[str]) -> Column:
    return F.struct(*[c(o) for o in order_by])


def exact_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    g = distinct_groups(df, columns)
    t = g.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("duplicates"),
              F.count(F.when(F.col("rows") > 1, 1)).alias("groups"))
    return t.select("rows", "duplicates", share(F.col("duplicates"), F.col("rows")).alias("pct"), "groups")


def repeated_rows(df: DataFrame, columns: list[str], order_by: list[str]) -> DataFrame:
    """Rows that repeat an earlier row."""
    t = group_stats_join(df, columns, {"__first": F.min(_order(order_by))}, where=F.col("__n") > 1, spread_by=order_by)
    return t.where(_order(order_by) > F.col("__first")).select(*[c(x) for x in df.columns])


def repeated_rows_all(df: DataFrame, columns: list[str], order_by: list[str] | None = None) -> DataFrame:
    """All members of groups with more than one row."""
    return group_stats_join(df, columns, {}, where=F.col("__n") > 1, spread_by=order_by).select(*[c(x) for x in df.columns])


def _pick(df: DataFrame, columns: list[str], pick, where: Column | None = None, extra: list[Column] | None = None) -> DataFrame:
    rest = [x for x in df.columns if x not in columns]
    g = df.groupBy(*[c(x) for x in columns]).agg(
        F.count(F.lit(1)).alias("__n"), pick(F.struct(*[c(x) for x in rest]) if rest else F.lit(1)).alias("__row"))
    if where is not None:
        g = g.where(where)
    return g.select(*[c(x) if x in columns else F.col("__row")[x].alias(x) for x in df.columns])


def keep_first(df: DataFrame, columns: list[str] | None, order_by: list[str]) -> DataFrame:
    if columns is None or set(columns) == set(df.columns):
        return df.dropDuplicates()
    return _pick(df, columns, lambda row: F.min_by(row, _order(order_by)))


def keep_last(df: DataFrame, columns: list[str] | None, order_by: list[str]) -> DataFrame:
    if columns is None or set(columns) == set(df.columns):
        return df.dropDuplicates()
    return _pick(df, columns, lambda row: F.max_by(row, _order(order_by)))


def keep_none(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Only rows without a copy. A surviving group has one row, so any of its values is the value."""
    cols = columns or df.columns
    return _pick(df, cols, F.any_value, F.col("__n") == 1)


def distinct_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct rows of the table and, per column, whether it holds repeats."""
    cols = columns or df.columns
    n = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(c(x)).alias("u_" + x) for x in cols],
               *[F.max(c(x).isNull().cast("int")).alias("n_" + x) for x in cols])
    per = n.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), F.col("rows"), (c("u_" + x) + c("n_" + x)).alias("distinct_values")) for x in cols])))
    table = distinct_groups(df, cols).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("distinct_values")).select(F.lit("table").alias("column"), "rows", "distinct_values")
    return table.unionByName(per).withColumn("has_repeats", F.col("distinct_values") < F.col("rows"))


def conditional_stats(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    g = distinct_groups(df, [group] + columns)
    t = g.groupBy(c(group)).agg(F.sum("rows").alias("total"), F.sum(F.col("rows") - 1).alias("duplicates"))
    return t.where("duplicates > 0").withColumn("pct", F.col("duplicates") / F.col("total") * 100)


def keep_first_within(df: DataFrame, group: str, columns: list[str], order_by: list[str]) -> DataFrame:
    return keep_first(df, [group] + columns, order_by)


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: values, unique, repeats, share, most frequent value (ties: smallest) and its count."""
    cols = columns or df.columns
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), c(x).cast("string").alias("value")) for x in cols])))
    counts = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("rows")).alias("neg"), F.col("value").alias("value"))))
    t = counts.groupBy("column").agg(F.sum("rows").alias("total"), F.count("value").alias("unique"), best.alias("b"))
    rep = F.col("total") - F.col("unique")
    return t.select("column", "total", "unique", rep.alias("repeats"), share(rep, F.col("total")).alias("pct"),
                    F.when(rep > 0, F.col("b.value")).alias("most_frequent"), F.when(rep > 0, -F.col("b.neg")).otherwise(F.lit(0)).alias("frequency"))


def dedup_column(df: DataFrame, column: str, keep: str, order_by: list[str]) -> DataFrame:
    """keep: first, last, none, or most_frequent (repeated values other than the most frequent one are dropped)."""
    if keep == "first":
        return keep_first(df, [column], order_by)
    if keep == "last":
        return keep_last(df, [column], order_by)
    if keep == "none":
        return keep_none(df, [column])
    top = (df.where(c(column).isNotNull()).groupBy(c(column)).agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.col("n").desc(), c(column)).select(c(column)).head(1))
    is_top = c(column) == F.lit(top[0][0]) if top else F.lit(False)
    return _pick(df, [column], lambda row: F.min_by(row, _order(order_by)), (F.col("__n") == 1) | is_top)


def near(df: DataFrame, columns: list[str], key: str, max_differences: int = 1) -> DataFrame:
    """Pairs of distinct value tuples that differ in 1..k of the columns, null being equal to null. Their number may grow with the square of a block:
    `near_blocks` says the same in rows linear in the input, `near_counts` how many pairs there would be.

    Equal rows are collapsed first: `left_key`/`right_key` are the smallest keys of each side and `row_pairs` is the
    number of row pairs the two tuples stand for. For each choice of m-k columns the tuples are joined on them (an equi
    join with salting); a pair that several choices could find is reported by exactly one of them.
    """
    m, k = len(columns), max_differences
    if not 1 <= k < m:
        raise ValueError("max_differences must be at least 1 and below the number of columns")
    t = df.groupBy(*[c(x) for x in columns]).agg(F.min(c(key)).alias("__key"), F.count(F.lit(1)).alias("__rows"))
    out = None
    for fixed in combinations(columns, m - k):
        free = [x for x in columns if x not in fixed]
        right = t.select(*[c(x) for x in fixed], *[c(x).alias(x + "__b") for x in free], F.col("__key").alias("__key_b"), F.col("__rows").alias("__rows_b"))
        pair = skew_join(t, right, list(fixed)).where(F.col("__key") < F.col("__key_b"))
        differs = {x: (~c(x).eqNullSafe(c(x + "__b"))).cast("int") if x in free else F.lit(0) for x in columns}
        d = reduce(lambda a, b: a + b, differs.values())
        pair = pair.withColumn("differences", d).where(F.col("differences").between(1, k))
        # canonical choice: the free columns are the differing ones plus the first equal ones
        for i, x in enumerate(columns):
            if x in free:
                equal_before = reduce(lambda a, b: a + b, [1 - differs[y] for y in columns[:i]], F.lit(0))
                pair = pair.where((differs[x] == 1) | (equal_before < F.lit(k) - F.col("differences")))
        part = pair.select(F.col("__key").alias("left_key"), F.col("__key_b").alias("right_key"), "differences",
                           ((F.lit(m) - F.col("differences")) * 100.0 / m).alias("similarity"), (F.col("__rows") * F.col("__rows_b")).alias("row_pairs"))
        out = part if out is None else out.unionByName(part)
    return out


def near_blocks(df: DataFrame, columns: list[str], key: str, max_differences: int = 1) -> DataFrame:
    """Rows that differ in at most k of the columns, as blocks instead of pairs; null equals null.

    A block is a choice of m - k columns (`fixed`) and values that at least two distinct tuples share there, so all its members are near each
    other, and every near pair is in a block. One row per member: fixed, block (its smallest key), member (smallest key of the tuple), rows (that
    have the tuple), block_members, block_rows. There are at most C(m, k) rows per distinct tuple, however large the blocks: a tuple is
    exploded once, blocks are counted by one grouped aggregation, and large ones meet their members by a salted join.
    """
    t = _near_parts(df, columns, key, [len(columns) - max_differences])
    values = [f"__v{i}" for i in range(len(columns))]
    t = group_stats_join(t, ["fixed", *values], {"block": F.min("member"), "block_members": F.count(F.lit(1)), "block_rows": F.sum("rows")}, where=F.col("__n") > 1, spread_by=["member"])
    return t.select("fixed", "block", "member", "rows", "block_members", "block_rows")


def _near_parts(df: DataFrame, columns: list[str], key: str, sizes: list[int]) -> DataFrame:
    """Every distinct tuple once per choice of `sizes` columns: fixed, the values of these columns (others null), member, rows."""
    m = len(columns)
    if not all(1 <= n < m for n in sizes):
        raise ValueError("max_differences must be at least 1 and below the number of columns")
    t = df.groupBy(*[c(x).alias(f"__v{i}") for i, x in enumerate(columns)]).agg(F.min(c(key)).alias("member"), F.count(F.lit(1)).alias("rows"))
    choices = [set(x) for n in sizes for x in combinations(range(m), n)]
    part = lambda chosen: F.struct(F.lit(",".join(columns[i] for i in sorted(chosen))).alias("fixed"), F.lit(len(chosen)).alias("size"),
                                   *[(F.col(f"__v{i}") if i in chosen else F.lit(None).cast(t.schema[f"__v{i}"].dataType)).alias(f"__v{i}") for i in range(m)])
    return t.select("member", "rows", F.inline(F.array(*[part(x) for x in choices])))


def near_counts(df: DataFrame, columns: list[str], max_differences: int = 1) -> DataFrame:
    """differences, pairs (of distinct tuples), row_pairs: how many pairs differ in exactly 1..k columns, without forming a pair.

    Blocks of every choice of j columns count the pairs that agree there; a pair that agrees in a columns is counted C(a, j) times, so the exact
    numbers follow from the largest j down.
    """
    m, k = len(columns), max_differences
    parts = _near_parts(df.withColumn("__one", F.lit(1)), columns, "__one", list(range(m - k, m)))
    blocks = parts.groupBy("fixed", "size", *[f"__v{i}" for i in range(m)]).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n"), F.sum("rows").cast("decimal(38,0)").alias("r"),
                                                                                F.sum(F.col("rows").cast("decimal(19,0)") * F.col("rows")).alias("own"))
    counts = blocks.groupBy("size").agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs"), F.sum(F.expr("(r * r - own) / 2")).alias("row_pairs")).collect()
    found = {r["size"]: [int(r["pairs"]), int(r["row_pairs"])] for r in counts}      # one row per number of columns
    exact: dict[int, list[int]] = {}
    for a in range(m - 1, m - k - 1, -1):
        exact[a] = [found.get(a, [0, 0])[i] - sum(comb(b, a) * exact[b][i] for b in exact) for i in (0, 1)]
    return small_frame(df.sparkSession, [(m - a, *x) for a, x in exact.items()], "differences int, pairs long, row_pairs long")


def similar_positions(df: DataFrame, column: str, threshold: float = 0.8) -> DataFrame:
    """Pairs of distinct lower-cased values of equal length with more than `threshold` equal characters by position.

    With fewer than (1-t)*L mismatches, one of that many fixed slices must agree; the slices are the join keys.
    """
    v = df.where(c(column).isNotNull() & (F.length(c(column)) > 0)).select(F.lower(c(column)).alias("v")).distinct()
    # largest number of mismatches still above the threshold
    v = v.withColumn("n", F.length("v")).withColumn("d", F.greatest(F.ceil((F.lit(1.0) - F.lit(threshold)) * F.col("n") - 1e-9) - 1, F.lit(0)).cast("int"))
    v = v.where("d > 0").withColumn("slices", F.expr(
        "transform(sequence(0, d), i -> substring(v, cast(i * n div (d + 1) as int) + 1, cast((i + 1) * n div (d + 1) - i * n div (d + 1) as int)))"))
    a = v.select("v", "n", "slices", F.posexplode("slices").alias("i", "slice"))
    b = a.select(F.col("v").alias("w"), "n", F.col("slices").alias("slices_b"), "i", "slice")
    pair = skew_join(a, b, ["n", "i", "slice"]).where("v < w")
    pair = pair.where("i = 0 OR NOT exists(sequence(0, i - 1), j -> slices[j] = slices_b[j])")
    same = F.expr("aggregate(zip_with(split(v, ''), split(w, ''), (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x)")
    pair = pair.withColumn("similarity", same / F.col("n"))
    return pair.where(F.col("similarity") > threshold).select(F.col("v").alias("left"), F.col("w").alias("right"), "similarity")
