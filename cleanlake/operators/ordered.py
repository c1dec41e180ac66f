"""Operators that follow a total row order, without moving the table through one task.

The order is cut into segments at sketched quantiles of the order columns. A segment id is a pure
function of the row, so nothing is cached and a lost executor only repeats its own tasks. Values that
cross a segment border travel in a summary of one row per segment.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanlake.core import c

SEG = "__seg"
EXACT_DOUBLE = float(2 ** 53)
SAMPLE = 20          # texts drawn per part of their order
BOUND = 16_384       # characters of a text that a bound has at most


def order_number(df: DataFrame, name: str) -> Column:
    """A double that never decreases along the order of a number, date or time column."""
    t = df.schema[name].dataType
    x = c(name)
    if isinstance(t, T.DateType):
        return F.datediff(x, F.lit("1970-01-01").cast("date")).cast("double")
    if isinstance(t, (T.TimestampNTZType, T.TimestampType)):
        x = x.cast("timestamp_ntz")
        day = F.datediff(x, F.lit("1970-01-01").cast("date")).cast("long")
        sec = F.date_part(F.lit("SECOND"), x)
        micros = day * 86_400_000_000 + F.hour(x).cast("long") * 3_600_000_000 + F.minute(x).cast("long") * 60_000_000
        return (micros + (sec * 1_000_000).cast("long")).cast("double")
    return x.cast("double")


def _text_bounds(df: DataFrame, x: Column, n: int) -> list[str]:
    """n - 1 values that cut the texts into about equal parts, from a random sample of SAMPLE rows per part: one job, one row per sample.

    Whole texts are compared, so a common prefix of any usual length does no harm; a bound longer than BOUND characters is cut there.
    """
    h = F.xxhash64(F.monotonically_increasing_id(), F.lit(17))
    drawn = df.select(F.substring(x, 1, BOUND).alias("x"), h.alias("h")).where("x is not null").groupBy(F.pmod("h", F.lit(SAMPLE * n)).alias("draw")).agg(F.min_by("x", "h").alias("x"))
    got = sorted((r["x"] for r in drawn.select("x").collect()), key=lambda t: t.encode("utf-8", "surrogatepass"))
    return [got[i * len(got) // n] for i in range(1, n)] if got else []


def _place(x: Column, bounds: list[str], low: int = 0, high: int | None = None) -> Column:
    """How many of the sorted distinct bounds are not above x, by halving."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(low).cast("long")
    mid = (low + high) // 2
    return F.when(x < F.lit(bounds[mid]), _place(x, bounds, low, mid)).otherwise(_place(x, bounds, mid + 1, high))


def segment(df: DataFrame, order_by: list[str], partition_by: list[str] | None = None, segments: int | None = None) -> DataFrame:
    """Add a segment id that never decreases along (hash of partition_by, order_by).

    A value holding more than one quantile step gets a segment of its own, which is cut further by the
    next order column, so ties in a leading column do not build one huge segment. The cuts of an order column come from one job:
    a sketch of quantiles for numbers and times, a random sample of whole values for texts.
    """
    spark = df.sparkSession
    n = segments or max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    out, seg, active = df, F.lit(0).cast("long"), F.lit(True)
    # 53 bits of the hash, so that the double is exact
    columns: list[tuple[Column, bool]] = [(F.shiftrightunsigned(F.xxhash64(*[c(k) for k in partition_by]), 11).cast("double"), False)] if partition_by else []
    columns += [(c(o), True) if isinstance(df.schema[o].dataType, T.StringType) else (order_number(df, o), False) for o in order_by]
    for level, (value, is_text) in enumerate(columns):
        name, bucket = f"__ordnum{level}", f"__ordbkt{level}"
        if is_text:
            bounds = _text_bounds(out.where(active), value, n)
            heavy = sorted({b for b in bounds if bounds.count(b) > 1 and len(b) < BOUND})
            cuts = sorted(set(bounds), key=lambda t: t.encode("utf-8", "surrogatepass"))
            if cuts:
                # two codes per cut: the value itself where it is heavy, and what lies between it and the next one; nulls sort first
                code = F.when(value.isNull(), F.lit(0)).otherwise(2 * _place(value, cuts) + F.when(value.isin(heavy), 1).otherwise(2) if heavy else 2 * _place(value, cuts) + 2)
                seg = seg * F.lit(2 * len(cuts) + 3) + F.when(active, code).otherwise(F.lit(0))
            active = active & value.isin(heavy)
        else:
            out = out.withColumn(name, value)
            bounds = out.where(active).agg(F.percentile_approx(name, F.array(*[F.lit(i / n) for i in range(1, n)]), max(10_000, 20 * n))).first()[0]
            heavy = sorted({b for b in bounds or [] if bounds.count(b) > 1 and abs(b) < EXACT_DOUBLE})
            if bounds:
                cuts = sorted(set(bounds) | {math.nextafter(b, math.inf) for b in heavy})
                out = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=name, outputCol=bucket, handleInvalid="keep").transform(out)
                code = F.when(F.col(name).isNull(), F.lit(0)).otherwise(F.col(bucket).cast("long") + 1)
                seg = seg * F.lit(len(cuts) + 3) + F.when(active, code).otherwise(F.lit(0))
            active = active & F.col(name).isin(heavy)
        if not heavy:
            break
    out = out.withColumn(SEG, seg)
    return out.drop(*[x for x in out.columns if x.startswith(("__ordnum", "__ordbkt"))])


def _order(order_by: list[str]) -> list[Column]:
    return [c(o).asc_nulls_first() for o in order_by]


def _win(partition_by: list[str], order_by: list[str]):
    return Window.partitionBy(SEG, *[c(k) for k in partition_by]).orderBy(*_order(order_by))


def _next_win(partition_by: list[str], order_by: list[str]):
    """The reversed order up to the current row: "next known" as a running value (a frame to the unbounded end is quadratic)."""
    w = Window.partitionBy(SEG, *[c(k) for k in partition_by]).orderBy(*[c(o).desc_nulls_last() for o in order_by])
    return w.rowsBetween(Window.unboundedPreceding, 0)


def _carry(summary: DataFrame, partition_by: list[str], exprs: dict[str, Column]) -> DataFrame:
    """Carry-in per segment. Only groups that span several segments need a row: at most two per segment."""
    out = summary.select(SEG, *[c(k) for k in partition_by], *[e.alias(n) for n, e in exprs.items()])
    some = None
    for n in exprs:
        some = F.col(n).isNotNull() if some is None else some | F.col(n).isNotNull()
    out = out.where(some)
    return out.select(F.col(SEG).alias("__seg_r"), *[c(k).alias(k + "__r") for k in partition_by], *exprs)


def _attach(df: DataFrame, carry: DataFrame, partition_by: list[str]) -> DataFrame:
    cond = df[SEG] == carry["__seg_r"]
    for k in partition_by:
        cond = cond & df[f"`{k}`"].eqNullSafe(carry[f"`{k}__r`"])
    return df.join(F.broadcast(carry), cond, "left").drop("__seg_r", *[k + "__r" for k in partition_by])


def _index_segmented(seg: DataFrame, order_by: list[str], partition_by: list[str], name: str) -> DataFrame:
    before = Window.partitionBy(*[c(k) for k in partition_by]).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    sizes = seg.groupBy(SEG, *[c(k) for k in partition_by]).agg(F.count(F.lit(1)).alias("__rows"))
    carry = _carry(sizes, partition_by, {"__off": F.sum("__rows").over(before)})
    out = _attach(seg, carry, partition_by)
    out = out.withColumn(name, F.row_number().over(_win(partition_by, order_by)).cast("long") - 1 + F.coalesce("__off", F.lit(0)))
    return out.drop("__off")


def with_index(df: DataFrame, order_by: list[str], name: str = "row_index", partition_by: list[str] | None = None,
               segments: int | None = None) -> DataFrame:
    """0-based position of each row in the order."""
    seg = segment(df, order_by, partition_by, segments)
    return _index_segmented(seg, order_by, partition_by or [], name).drop(SEG)


def fill(df: DataFrame, columns: list[str], order_by: list[str], *, direction: str = "forward",
         partition_by: list[str] | None = None, segments: int | None = None) -> DataFrame:
    """Last ("forward"), next ("backward") known value, or forward then backward ("both")."""
    part = partition_by or []
    seg = segment(df, order_by, part, segments)
    key = F.struct(*[c(o) for o in order_by])
    known = lambda x: F.when(c(x).isNotNull(), key)
    fwd, bwd = direction in ("forward", "both"), direction in ("backward", "both")
    aggs = []
    for i, x in enumerate(columns):
        if fwd:
            aggs.append(F.max_by(c(x), known(x)).alias(f"__l{i}"))
        if bwd:
            aggs.append(F.min_by(c(x), known(x)).alias(f"__f{i}"))
    summary = seg.groupBy(SEG, *[c(k) for k in part]).agg(*aggs)
    w = Window.partitionBy(*[c(k) for k in part]).orderBy(SEG)
    exprs = {}
    for i, _ in enumerate(columns):
        if fwd:
            exprs[f"__cl{i}"] = F.last(f"__l{i}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        if bwd:
            exprs[f"__cf{i}"] = F.first(f"__f{i}", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    out = _attach(seg, _carry(summary, part, exprs), part)
    ow = _win(part, order_by)
    for i, x in enumerate(columns):
        opts = [c(x)]
        if fwd:
            opts += [F.last(c(x), ignorenulls=True).over(ow.rowsBetween(Window.unboundedPreceding, 0)), F.col(f"__cl{i}")]
        if bwd:
            opts += [F.last(c(x), ignorenulls=True).over(_next_win(part, order_by)), F.col(f"__cf{i}")]
        out = out.withColumn(f"__v{i}", F.coalesce(*opts))
    return out.select(*[F.col(f"__v{columns.index(n)}").alias(n) if n in columns else c(n) for n in df.columns])


def interpolate(df: DataFrame, column: str, order_by: list[str], *, partition_by: list[str] | None = None,
                segments: int | None = None) -> DataFrame:
    """Linear by row position between known values; trailing nulls take the last value, leading nulls stay."""
    part = partition_by or []
    idx = _index_segmented(segment(df, order_by, part, segments), order_by, part, "__i")
    idx = idx.withColumn("__k", F.when(c(column).isNotNull(), F.struct(F.col("__i").alias("i"), c(column).cast("double").alias("v"))))
    summary = idx.groupBy(SEG, *[c(k) for k in part]).agg(F.max("__k").alias("__l"), F.min("__k").alias("__f"))
    w = Window.partitionBy(*[c(k) for k in part]).orderBy(SEG)
    carry = _carry(summary, part, {
        "__cl": F.last("__l", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "__cf": F.first("__f", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    out = _attach(idx, carry, part)
    ow = _win(part, order_by)
    out = out.withColumn("__p", F.coalesce(F.last("__k", ignorenulls=True).over(ow.rowsBetween(Window.unboundedPreceding, 0)), F.col("__cl")))
    out = out.withColumn("__n", F.coalesce(F.last("__k", ignorenulls=True).over(_next_win(part, order_by)), F.col("__cf")))
    p, n, i = F.col("__p"), F.col("__n"), F.col("__i")
    value = (F.when(c(column).isNotNull(), c(column).cast("double"))
             .when(p.isNotNull() & n.isNotNull(), p["v"] + (n["v"] - p["v"]) * (i - p["i"]) / (n["i"] - p["i"]))
             .when(p.isNotNull(), p["v"]))
    out = out.withColumn("__value", value)
    return out.select(*[F.col("__value").alias(n2) if n2 == column else c(n2) for n2 in df.columns])


def rolling_mean(df: DataFrame, column: str, window: int, order_by: list[str], name: str = "rolling_mean", *,
                 partition_by: list[str] | None = None, segments: int | None = None, block: int | None = None) -> DataFrame:
    """Mean of the last `window` rows, null until the window is full of known values.

    Rows are cut into blocks of the row index; the last window-1 rows of a block are also sent to the next one.
    """
    part = partition_by or []
    size = max(block or 65_536, window)
    idx = with_index(df, order_by, "__i", part, segments)
    own = F.floor(F.col("__i") / size).cast("long")
    tail = (F.col("__i") % size) >= size - (window - 1)
    out = idx.withColumn("__b", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("__b", *[c(k) for k in part]).orderBy("__i").rowsBetween(-(window - 1), 0)
    out = out.withColumn(name, F.when(F.count(c(column)).over(w) == window, F.avg(c(column).cast("double")).over(w)))
    return out.where(F.col("__b") == own).select(*[c(n) for n in df.columns], name)


def running_sum(df: DataFrame, values: dict[str, str], order_by: list[str], *, inclusive: bool = True,
                partition_by: list[str] | None = None, segments: int | None = None) -> DataFrame:
    """Cumulative sums along the order, with or without the row itself; `values` maps new columns to summed ones."""
    part = partition_by or []
    seg = segment(df, order_by, part, segments)
    sums = seg.groupBy(SEG, *[c(k) for k in part]).agg(*[F.sum(c(v)).alias(f"__s{i}") for i, v in enumerate(values.values())])
    before = Window.partitionBy(*[c(k) for k in part]).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    out = _attach(seg, _carry(sums, part, {f"__carry{i}": F.sum(f"__s{i}").over(before) for i in range(len(values))}), part)
    here = _win(part, order_by).rowsBetween(Window.unboundedPreceding, 0)
    for i, (name, v) in enumerate(values.items()):
        total = F.coalesce(F.sum(c(v)).over(here), F.lit(0)) + F.coalesce(F.col(f"__carry{i}"), F.lit(0))
        out = out.withColumn(name, total if inclusive else total - F.coalesce(c(v), F.lit(0)))
    return out.drop(SEG, *[f"__carry{i}" for i in range(len(values))])


def value_ranks(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """One row per distinct known value: column, rows, average rank (ties share it), dense rank from 0."""
    n = F.sum(c(weight)) if weight else F.count(F.lit(1))
    counts = df.where(c(column).isNotNull()).groupBy(c(column)).agg(n.cast("long").alias("rows")).withColumn("__one", F.lit(1).cast("long"))
    out = running_sum(counts, {"__below": "rows", "dense": "__one"}, [column], inclusive=False)
    return out.select(c(column), "rows", (F.col("__below") + (F.col("rows") + 1) / 2).alias("avg_rank"), "dense")
