"""Equi joins that survive hot keys, and look-ups that are broadcast only after a size check."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanlake.core import c

LOOKUP_ROWS = 10_000     # a look-up table is sent to every executor only below this many rows
LOOKUP_BYTES = 1_024     # ... and only while each key stays below this many bytes
HOT_KEYS = 1_024         # at most this many hot keys are broadcast to steer the salting
HOT_ROWS = 1_000_000     # a key with fewer rows than this never needs salting
SALTS = 32
PAIR_SIDE = 1_024        # a key with more pairs than the square of this is spread; no group of pairs is made smaller
MOST_SIDE = 32_768       # ... and none holds more pairs than the square of this
GROUPS = 16              # such groups for each core, as far as their size allows
HELD_ROWS = 16_384       # right rows of a group: its task holds them in memory
SORTED_ROWS = 1_048_576  # left rows of a group: its task sorts them and reads them once
GROUP_TASKS = 4_096      # up to half as many groups have two tasks each to fall into
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
PLAIN = (T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.BooleanType, T.DateType)      # key types that Python gives back as they were


def _match(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> Column:
    return reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(right[f"`{k}{suffix}`"]) for k in keys])


def hot_keys(counts: DataFrame, keys: list[str], count_col: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The heaviest keys: at most HOT_KEYS rows, so whatever is left holds at most 1/HOT_KEYS of the rows per key."""
    return (counts.where(F.col(count_col) >= hot_rows)
            .orderBy(F.col(count_col).desc(), *[c(k) for k in keys]).limit(HOT_KEYS)
            .select(*[c(k).alias(k + "__h") for k in keys], F.lit(True).alias("__hot")))


def _counted(df: DataFrame, keys: list[str], count_col: str) -> DataFrame:
    return df.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias(count_col))


def _mark(df: DataFrame, hot: DataFrame, keys: list[str], flag: str) -> DataFrame:
    marked = df.join(hot, _match(df, hot, keys, "__h"), "left")
    return marked.withColumn(flag, F.coalesce(F.col("__hot"), F.lit(False))).drop("__hot", *[k + "__h" for k in keys])


def _hashable(df: DataFrame) -> list[str]:
    """Columns that can be hashed (all but maps and variants)."""
    return [f.name for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", *,
              counts: DataFrame | None = None, count_col: str = "__n", hot_rows: int = HOT_ROWS,
              salts: int = SALTS, spread_by: list[str] | None = None, right_unique: bool = False) -> DataFrame:
    """Null-safe equi join on same-named keys whose hot keys are spread over `salts` tasks.

    Rows of a key that is hot on the left take one salt each, and the right rows of that key are copied once per
    salt. For inner joins the same is done, with a second salt, for keys that are hot on the right. Every matching
    pair still meets exactly once, so the result is that of the plain join. `counts` (keys + count_col) saves
    counting the left side; right_unique says that no key repeats on the right.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("salting keeps the meaning of inner, left, left_semi and left_anti joins only")
    both = how == "inner" and not right_unique
    counts = counts if counts is not None else _counted(left, keys, count_col)
    hot = F.broadcast(hot_keys(counts, keys, count_col, hot_rows))
    # Salts are a hash of the row, not a row number: a task that runs again after a lost executor salts its rows the same way.
    spread = F.xxhash64(*[c(k) for k in spread_by or _hashable(left)])
    one = F.pmod(spread, F.lit(salts)).cast("int")
    all_salts = F.sequence(F.lit(0), F.lit(salts - 1))
    copies = lambda flag: F.explode(F.when(F.col(flag), all_salts).otherwise(F.array(F.lit(0))))
    l = _mark(left.withColumn("__one", one), hot, keys, "__hot_l").withColumn("__salt", F.when(F.col("__hot_l"), F.col("__one")).otherwise(F.lit(0)))
    r = _mark(right, hot, keys, "__hot_l").withColumn("__salt_r", copies("__hot_l")).drop("__hot_l")
    l = l.drop("__one", "__hot_l")
    if both:
        hot_right = F.broadcast(hot_keys(_counted(right, keys, "__n"), keys, "__n", hot_rows))
        l = _mark(l, hot_right, keys, "__hot_r").withColumn("__salt2", copies("__hot_r")).drop("__hot_r")
        r = r.withColumn("__one", F.pmod(F.xxhash64(*[c(k) for k in _hashable(right)]), F.lit(salts)).cast("int"))
        r = _mark(r, hot_right, keys, "__hot_r").withColumn("__salt2_r", F.when(F.col("__hot_r"), F.col("__one")).otherwise(F.lit(0))).drop("__one", "__hot_r")
    r = r.select(*[c(n).alias(n + "__r") if n in keys else c(n) for n in r.columns])
    cond = _match(l, r, keys, "__r") & (l["__salt"] == r["__salt_r"])
    if both:
        cond = cond & (l["__salt2"] == r["__salt2_r"])
    return l.join(r, cond, how).drop("__salt", "__salt_r", "__salt2", "__salt2_r", *[k + "__r" for k in keys])


def _chunks(sizes: list[tuple[int, int]], groups: int, side: int = PAIR_SIDE) -> list[tuple[int, int]]:
    """Numbers of left and right chunks of keys with so many left and right rows.

    A left row is copied once per right chunk and a right row once per left chunk. Groups grow with the tables: all keys together have about
    `groups` of them, so copies grow with the rows and not with their pairs. That ends where a group reaches its most pairs or rows.
    """
    pairs = min(max(sum(m * n for m, n in sizes) / groups, side ** 2), MOST_SIDE ** 2)
    out = []
    for m, n in sizes:
        b = max(1, math.ceil(n / HELD_ROWS), round(n / math.sqrt(pairs)))
        out.append((max(1, math.ceil(m / SORTED_ROWS), math.ceil(m * n / (pairs * b))), b))
    return out


def spread_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner", *,
                null_safe: bool = False, side: int = PAIR_SIDE) -> DataFrame:
    """Equi join on pairs of columns of frames that share no column name; keys with many pairs are spread over tasks.

    A key with m rows on the left and n on the right makes m * n rows, however few bytes the two sides have. Above side ** 2 pairs, both sides of
    the key are dealt by the hash of their rows into chunks (see `_chunks`), and every left chunk meets every right one in a group of its own.
    Such keys have partners on both sides, so their part is an inner join for every `how`; all other keys are joined as given. One bounded
    job brings the at most LOOKUP_ROWS heaviest of these keys to the driver.
    """
    match = lambda l, r: reduce(lambda p, q: p & q, [l[f"`{a}`"].eqNullSafe(r[f"`{b}`"]) if null_safe else l[f"`{a}`"] == r[f"`{b}`"] for a, b in on])
    kind = lambda df, x: T.LongType() if isinstance(df.schema[x].dataType, INTEGRAL) else df.schema[x].dataType
    # unlike types may match several values of one side to one of the other
    if how not in ("inner", "left", "right", "outer") or any(kind(left, a) != kind(right, b) or not isinstance(kind(left, a), PLAIN) for a, b in on):
        return left.join(right, match(left, right), how)
    cell = ["__s_g", "__s_i", "__s_j"]
    names = [f"__s_k{i}" for i in range(len(on))]
    counts = [df.groupBy(*[c(x).cast(kind(df, x)).alias(k) for x, k in zip(cols, names)]).agg(F.count(F.lit(1)).alias(n))
              for df, cols, n in ((left, [a for a, _ in on], "__s_m"), (right, [b for _, b in on], "__s_n"))]
    counts[1] = counts[1].select(*[c(k).alias(k + "__r") for k in names], "__s_n")
    short = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c(k).cast("string")), F.lit(0)) for k in names]) <= LOOKUP_BYTES
    pairs = F.col("__s_m").cast("double") * F.col("__s_n")
    met = [counts[0][k].eqNullSafe(counts[1][k + "__r"]) if null_safe else counts[0][k] == counts[1][k + "__r"] for k in names]
    heavy = (counts[0].join(counts[1], reduce(lambda p, q: p & q, met)).where((pairs > float(side) ** 2) & short)
             .orderBy(pairs.desc(), *[c(k) for k in names]).limit(LOOKUP_ROWS)
             .select(*[c(k) for k in names], "__s_m", "__s_n"))
    rows = list({repr(tuple(r)[:-2]): r for r in heavy.collect()}.values())
    if not rows:
        return left.join(right, match(left, right), how)
    spark = left.sparkSession
    grid = _chunks([(r["__s_m"], r["__s_n"]) for r in rows], GROUPS * spark.sparkContext.defaultParallelism, side)
    schema = T.StructType([T.StructField("__s_g", T.IntegerType()), *heavy.schema.fields[:-2], T.StructField("__s_a", T.IntegerType()), T.StructField("__s_b", T.IntegerType())])
    h = F.broadcast(spark.createDataFrame([(g, *tuple(r)[:-2], *ab) for g, (r, ab) in enumerate(zip(rows, grid))], schema))
    same = lambda df, cols: reduce(lambda p, q: p & q, [df[f"`{x}`"].eqNullSafe(h[k]) for x, k in zip(cols, names)])
    # groups fall into tasks by their hash: with tasks to spare, few groups share one
    cells = sum(a * b for a, b in grid)
    tasks = min(2 * cells, max(cells // 8, GROUP_TASKS))

    def dealt(df, cols, own, chunks, other, copies):
        chunk = F.pmod(F.xxhash64(*[c(x) for x in _hashable(df)]), F.col(chunks)).cast("int").alias(own)
        t = df.join(h, same(df, cols)).select(*[c(x) for x in df.columns], F.col("__s_g"), chunk, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias(other))
        t = t.select(*[c(x) for x in df.columns], *[c(x).alias(x + chunks) for x in cell])
        return t.repartition(tasks, *[c(x + chunks) for x in cell])

    l, r = dealt(left, [a for a, _ in on], "__s_i", "__s_a", "__s_j", "__s_b"), dealt(right, [b for _, b in on], "__s_j", "__s_b", "__s_i", "__s_a")
    # sizes of the files say nothing about the copies: never broadcast
    many = l.join(r.hint("merge"), [l[x + "__s_a"] == r[x + "__s_b"] for x in cell]).drop(*[x + y for x in cell for y in ("__s_a", "__s_b")])
    l, r = [df.join(h, same(df, cols), "left_anti") for df, cols in ((left, [a for a, _ in on]), (right, [b for _, b in on]))]
    return many.unionByName(l.join(r, match(l, r), how))


def lookup_join(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left", *,
                max_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Join a fitted look-up table (one row per key).

    One bounded job brings at most max_rows + 1 rows to the driver. If the table proves small it is
    broadcast as data; otherwise it stays distributed and is joined with salting for hot keys.
    """
    size = [F.coalesce(F.octet_length(c(k).cast("string")), F.lit(0)) for k in keys]
    long_key = reduce(lambda a, b: a + b, size) > LOOKUP_BYTES
    probe = table.select(*[F.when(~long_key, c(n)).alias(n) for n in table.columns], long_key.alias("__long"))
    rows = probe.limit(max_rows + 1).collect()
    if len(rows) <= max_rows and not any(r["__long"] for r in rows):
        spark = df.sparkSession
        local = spark.createDataFrame([tuple(r)[:-1] for r in rows], table.schema)
        local = F.broadcast(local.select(*[c(n).alias(n + "__r") if n in keys else c(n) for n in local.columns]))
        out = df.join(local, _match(df, local, keys, "__r"), how)
        return out.drop(*[k + "__r" for k in keys])
    return skew_join(df, table, keys, how, right_unique=True)


def group_stats_join(df: DataFrame, keys: list[str], aggs: dict[str, Column], *, where: Column | None = None,
                     spread_by: list[str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Attach per-group aggregates to every row (a window over `keys` without moving a hot group to one task).

    The aggregates are combined map-side first. `where` drops groups by their statistics before the join.
    """
    stats = df.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"), *[v.alias(k) for k, v in aggs.items()])
    if where is not None:
        stats = stats.where(where)
    return skew_join(df, stats, keys, "inner", counts=stats, spread_by=spread_by, hot_rows=hot_rows, right_unique=True)
