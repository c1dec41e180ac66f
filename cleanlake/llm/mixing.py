"""Entropy balancing of sources to target token shares: Newton on the dual, tilted document rates, rounding into copies.

Rates w minimise sum(w log w - w + 1) over documents under sum(w * size) = target for each source and 0 <= w <= cap. The
dual has one multiplier per source, the rate of a document is min(cap, exp(lambda * size / mean size)), and the Hessian is diagonal
because a document touches the constraint of its own source only. A rate depends on (source, size) alone, so documents are
counted into such cells once, and each Newton step is one grouped aggregation over the cells.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cleanlake.core import c
from cleanlake.llm.common import checked_broadcast, n_words, stored

CAP = 3
BUCKETS = 512          # a cell is dealt into so many parts by a hash of its rows, so no part of a hot cell is large
TOLERANCE = 1e-9       # of a source's target, at which Newton stops


def cyclic_weight(rank: Column) -> Column:
    """1, 2, 3, repeating, by the rank of the source from 0."""
    return (rank % 3 + 1).cast("double")


def targets(sources: DataFrame, weight=cyclic_weight, cap: float = CAP) -> DataFrame:
    """source, source_size, target: shares of the total size by weight; a target stops at cap times its source's size and the
    excess is shared anew by weight among the rest, until none is above.

    The shares are found on the line total = sum(min(cap * size, t * weight)): a source stops at t >= cap * size / weight, so
    sources sorted by that ratio stop one after the other, and running sums give the t at which the line meets the total.
    """
    ranked = _ranked(sources).withColumn("w", weight(F.col("rank"))).withColumn("stops", F.lit(float(cap)) * F.col("source_size") / F.col("w"))
    order = Window.orderBy("stops", "rank")      # one row per source
    line = (ranked.withColumn("full", F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * float(cap))
            .withColumn("open", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))))
    total = sources.agg(F.sum("source_size").alias("total"))
    line = line.crossJoin(F.broadcast(total)).withColumn("t", (F.col("total") - F.col("full")) / F.col("open"))     # one row
    level = line.where("t <= stops").agg(F.min(F.struct("rank", "t")).alias("x"), F.max("t").alias("level"))
    return (ranked.crossJoin(F.broadcast(level)).select("source", F.col("source_size").cast("long"),
            F.least(F.lit(float(cap)) * F.col("source_size"), F.col("level") * F.col("w")).alias("target")))     # one row


def _ranked(sources: DataFrame) -> DataFrame:
    """rank from 0 by code point, null last. One row per source: names are few against documents."""
    return sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1)


def tilt(cells: DataFrame, goals: DataFrame, cap: float = CAP) -> DataFrame:
    """source, lam, mean: the multiplier of every source, by safeguarded Newton steps that all sources take together.

    f(lambda) = sum(n * size * min(cap, exp(lambda * x))) - target with x = size / mean rises in lambda; each step keeps a bracket
    of the root and falls back to its middle when Newton leaves it. The lower end is a guess until f lies below the target there: it doubles until then. A source whose target is cap times its size has lam = infinity.
    """
    spark = cells.sparkSession
    means = cells.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    top = F.log(F.lit(float(cap))) * F.col("mean") / F.col("least")     # there every document has reached the cap
    state = goals.join(means, goals["source"].eqNullSafe(means["source"])).drop(means["source"])
    state = stored(state.select("source", "source_size", "target", "mean", F.lit(0.0).alias("lam"), F.lit(-60.0).alias("low"), F.lit(False).alias("sure"), top.alias("high"), F.lit(math.inf).alias("gap")), "mix-dual")
    while True:
        s = checked_broadcast(state.select(F.col("source").alias("s"), "mean", "lam"))
        x = F.col("size") / F.col("mean")
        e = F.least(F.lit(math.log(cap)), F.col("lam") * x)
        w = F.exp(e)
        sums = (cells.where("size > 0").join(s, F.col("source").eqNullSafe(F.col("s"))).groupBy("source")
                .agg(F.sum(F.col("n") * F.col("size") * w).alias("f"), F.sum(F.when(F.col("lam") * x < math.log(cap), F.col("n") * F.col("size") * x * w).otherwise(0.0)).alias("slope")))
        sums = sums.withColumnRenamed("source", "s")
        both = state.join(sums, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("miss", F.col("f") - F.col("target"))
        both = (both.withColumn("high", F.when(F.col("miss") >= 0, F.col("lam")).otherwise(F.col("high")))
                .withColumn("low", F.when(F.col("miss") <= 0, F.col("lam")).when(~F.col("sure") & (F.col("lam") <= F.col("low")), 2 * F.col("low")).otherwise(F.col("low")))
                .withColumn("sure", F.col("sure") | (F.col("miss") <= 0)))
        newton = F.col("lam") - F.when(F.col("slope") > 0, F.col("miss") / F.col("slope"))
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        step = F.when(F.abs("miss") <= TOLERANCE * F.col("target"), F.col("lam")).when(inside, newton).when(F.col("sure"), (F.col("low") + F.col("high")) / 2).otherwise(F.col("low"))
        state = stored(both.select("source", "source_size", "target", "mean", step.alias("lam"), "low", "sure", "high",
                                   F.when(F.col("target") >= cap * F.col("source_size"), 0.0)
                                   .when(F.col("sure") & ((F.col("high") - F.col("low")) <= 1e-12 * F.greatest(F.lit(1.0), F.abs("lam"))), 0.0)
                                   .otherwise(F.abs("miss") / F.col("target")).alias("gap")), "mix-dual")
        if state.where(F.col("gap") > TOLERANCE).isEmpty():
            return state.select("source", "target", "mean", F.when(F.col("target") >= cap * F.col("source_size"), math.inf).otherwise(F.col("lam")).alias("lam"))


def _rounded(cap: int):
    def round_cells(cells: pd.DataFrame) -> pd.DataFrame:
        """Copies of every cell of one source, largest size first: what a cell misses of its expected words is carried to the next."""
        cells = cells.sort_values("size", ascending=False)
        carry, taken = 0.0, []
        sizes, counts = cells["size"].tolist(), cells["n"].tolist()
        for size, n, rate in zip(sizes, counts, cells["rate"]):
            want = n * rate * size + carry
            m = min(max(math.floor(want / size + 0.5), 0), n * cap)
            carry = want - m * size
            taken.append(m)
        # What the smallest could not take goes to larger ones that still have room.
        for i, (size, n) in enumerate(zip(sizes, counts)):
            m = min(max(taken[i] + math.floor(carry / size + 0.5), 0), n * cap)
            carry -= (m - taken[i]) * size
            taken[i] = m
        return cells.assign(base=[m // n for m, n in zip(taken, cells["n"])], extra=[m % n for m, n in zip(taken, cells["n"])])[["source", "size", "base", "extra"]]
    return round_cells


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = 0, cap: int = CAP, weight=cyclic_weight) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies of every row of docs.

    Sizes are words. Null and empty texts have size 0, rate 0 and no copies; a source without words has target 0. A null source
    is a source of its own, last in order. Rows that repeat an identifier are rows of their own (ties in the hash fall to either of
    two equal rows). No rows give no rows. Other columns are ignored.
    Rounding carries what is missing from the largest sizes to the smallest, and what those cannot take back to larger ones, so a source
    ends within about its smallest document with room of its target. The one task of a source reads its distinct sizes, at most sqrt(2 * words) of them since distinct sizes
    add up to no more than all words.
    """
    rows = stored(docs.select(c(id_col).alias("doc_id"), c(source_col).cast("string").alias("source"), n_words(c(text_col)).alias("size"))
                  .withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")), "mix-rows")
    parts = stored(rows.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "mix-parts")
    cells = stored(parts.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-cells")
    goals = stored(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weight, cap), "mix-targets")
    dual = tilt(cells, goals, cap)
    d = checked_broadcast(dual.select(F.col("source").alias("s"), "mean", "lam"))
    rate = F.exp(F.least(F.lit(math.log(cap)), F.col("lam") * F.col("size") / F.col("mean")))
    rated = cells.where("size > 0").join(d, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", F.when(F.col("lam") == math.inf, float(cap)).otherwise(rate).alias("rate"))
    rated = stored(rated, "mix-rated")
    plan = rated.groupBy("source").applyInPandas(_rounded(cap), "source string, size long, base long, extra long")
    plan = rated.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.size") == F.col("p.size"))).select("r.source", "r.size", "rate", "base", "extra")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.withColumn("before", before).alias("o").join(plan.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source")) & (F.col("o.size") == F.col("p.size")), "left")
    offsets = offsets.select(F.col("o.source").alias("s"), F.col("o.size").alias("z"), F.col("bucket").alias("b"), F.col("extra") - F.col("before"), "rate", "base").toDF("s", "z", "b", "left_over", "rate", "base")
    nth = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id"))
    out = rows.withColumn("nth", nth).join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b")))
    out = out.withColumn("copies", F.coalesce(F.col("base") + (F.col("nth") <= F.col("left_over")).cast("long"), F.lit(0)).cast("long"))
    g = checked_broadcast(goals.select(F.col("source").alias("gs"), "source_size", "target"))
    return out.join(g, F.col("source").eqNullSafe(F.col("gs"))).select("doc_id", "source", "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), "copies")
