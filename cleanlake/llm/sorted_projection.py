"""Near duplicates of vectors by sorted projection passes.

A pass gives every vector a key of concatenated random hashes (the codes of random projections), sorts all vectors by it
lexicographically, and compares each with its next WINDOW neighbours, also across the borders of sorted partitions. The verified pairs of all passes are united into classes. The window is only a way to find classes: inside a class every
pair is then compared, block against block, so the number of links of a vector does not depend on the window.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c
from cleanlake.llm.common import arrow_rows, sorted_runs, stored
from cleanlake.operators.fuzzy import components
from cleanlake.operators.skew import skew_join

COSINE = 0.9
PASSES, WINDOW = 12, 48    # at least so many passes
HASHES, LEVELS = 6, 5      # a key has at least so many hashes, each the largest of so many signed projections (a cross-polytope of that size)
RECALL, AGREE = 0.99, 0.64  # wanted chance that a lone pair at COSINE meets in a window; chance that one hash agrees at COSINE (Monte Carlo)
HOT_COPIES = 1000          # copies of a vector above which their rows are dealt over several tasks
BLOCK = 512                # members of a class compared at once


def _usable(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision of those that have `dim` finite components and are not zero."""
    ok = np.array([v is not None and len(v) == dim and all(x is not None for x in v) for v in vectors], bool)
    x = np.array([v for v, k in zip(vectors, ok) if k], np.float64).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        big = np.abs(x).max(axis=1, initial=0)
        good = np.isfinite(x).all(axis=1) & (big > 0)
        ok[np.flatnonzero(ok)[~good]] = False
        x = x[good] / big[good][:, None]
    return ok, x / np.linalg.norm(x, axis=1, keepdims=True)


def effort(vectors: int, window: int = WINDOW) -> tuple[int, int]:
    """(passes, hashes) for so many distinct vectors: a pair meets when it agrees on the leading hashes that leave about half of `window` vectors together."""
    depth = max(0.0, math.log(max(vectors, 1) / (window / 2), 2 * LEVELS))
    chance = AGREE ** depth
    passes = PASSES if chance >= RECALL else max(PASSES, math.ceil(math.log(1 - RECALL) / math.log(1 - chance)))
    return passes, max(HASHES, math.ceil(depth) + 1)


def _units(dim: int):
    def run(batches):
        for batch in batches:
            ok, x = _usable(batch.column("embedding").to_pylist(), dim)
            names = [i for i, k in zip(batch.column("row").to_pylist(), ok) if k]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([r.tobytes() for r in x + 0.0], pa.binary())], names=["row", "unit"])     # no negative zeros
    return run


def codes(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The key of every row of x in one pass: the hashes, then the size of the first one's projection."""
    y = np.einsum("nd,hld->nhl", x, planes, optimize=True)
    best = np.abs(y).argmax(axis=2)
    top = np.take_along_axis(y, best[:, :, None], 2)[:, :, 0]
    return np.hstack([(2 * best + (top < 0)).astype(np.uint8), (np.abs(top) * 8).astype(np.uint8)[:, :1]])


def _keyed(dim: int, passes: int, hashes: int, seed: int):
    planes = np.random.default_rng(seed).standard_normal((passes, hashes, LEVELS, dim))

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("unit")) if batch.num_rows else np.zeros((0, dim))
            for p in range(passes):
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(x), pa.int32()), pa.array([r.tobytes() for r in codes(x, planes[p])], pa.binary()),
                                                  batch.column("row"), batch.column("unit")], names=["pass", "code", "row", "unit"])
    return run


def _matrix(column) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1)


def _pairs(a: np.ndarray, b: np.ndarray, ids_a, ids_b, pass_a, pass_b, reach: np.ndarray, cosine: float):
    ok = (a @ b.T >= cosine) & reach & (pass_a[:, None] == pass_b[None, :])
    i, j = np.nonzero(ok)
    return np.stack([np.minimum(ids_a[i], ids_b[j]), np.maximum(ids_a[i], ids_b[j])], 1)


def _windows(window: int, cosine: float):
    """Pairs inside a sorted partition (kind 0), and its first and last `window` rows for the borders (kinds 1 and 2)."""
    def run(batches):
        part = TaskContext.get().partitionId()
        tail, head_left, seen = None, window, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, passes, x = batch.column("row").to_numpy(), batch.column("pass").to_numpy(), _matrix(batch.column("unit"))
            if head_left:
                k = min(head_left, len(ids))
                yield _border(1, part, seen, ids[:k], passes[:k], x[:k])
                head_left -= k
            seen += len(ids)
            if tail is not None:
                ids, passes, x = np.concatenate([tail[0], ids]), np.concatenate([tail[1], passes]), np.concatenate([tail[2], x])
            new = 0 if tail is None else len(tail[0])
            out = []
            for at in range(0, len(ids), 256):
                to = slice(at, min(at + 256 + window, len(ids)))
                i, j = np.arange(at, min(at + 256, len(ids))), np.arange(to.start, to.stop)
                gap = j[None, :] - i[:, None]
                out.append(_pairs(x[i], x[j], ids[i], ids[j], passes[i], passes[j], (gap > 0) & (gap <= window) & (j[None, :] >= new), cosine))
            both = np.unique(np.concatenate(out), axis=0)
            yield _found(both)
            tail = ids[-window:], passes[-window:], x[-window:]
        if tail is not None:
            yield _border(2, part, seen - len(tail[0]), *tail)
    return run


def _found(pairs: np.ndarray):
    n = len(pairs)
    return pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([None] * n, pa.int32()), pa.array([None] * n, pa.int64()), pa.array(pairs[:, 0], pa.int64()),
                                       pa.array(pairs[:, 1], pa.int64()), pa.array([None] * n, pa.int32()), pa.array([None] * n, pa.binary())], names=BORDER)


BORDER = ["kind", "part", "pos", "left", "right", "pass", "unit"]


def _border(kind: int, part: int, pos: int, ids, passes, x):
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(np.arange(pos, pos + n), pa.int64()), pa.array(ids, pa.int64()),
                                       pa.array([None] * n, pa.int64()), pa.array(passes, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=BORDER)


def _across(window: int, cosine: float):
    """Pairs over a border: the last rows before it and the first rows after it, as far as the window reaches."""
    def run(batches):
        for t in sorted_runs(batches, "border", 1):
            side, pos, ids, passes, x = t.column("kind").to_numpy(), t.column("pos").to_numpy(), t.column("left").to_numpy(), t.column("pass").to_numpy(), _matrix(t.column("unit"))
            for b in np.unique(t.column("border").to_numpy()):
                here = t.column("border").to_numpy() == b
                a, z = np.flatnonzero(here & (side == 2)), np.flatnonzero(here & (side == 1))
                if not len(a) or not len(z):
                    continue
                a, z = a[np.argsort(pos[a])], z[np.argsort(pos[z])]
                gap = np.arange(len(z))[None, :] + len(a) - np.arange(len(a))[:, None]
                both = _pairs(x[a], x[z], ids[a], ids[z], passes[a], passes[z], gap <= window, cosine)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["left", "right"])
    return run


def _counted(cosine: float):
    """Number of links of the members of one block with those of another block of the same class."""
    def run(batches):
        for t in sorted_runs(batches, "pair", 4 * BLOCK):
            pair, first, ids, x = (t.column("pair").to_numpy(), t.column("first").to_numpy(zero_copy_only=False), t.column("row").to_numpy(), _matrix(t.column("unit")))
            copies = t.column("copies").to_numpy()
            start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            rows, counts = [], []
            for a, b in zip(start, np.append(start[1:], len(pair))):
                p, q = a + np.flatnonzero(first[a:b]), a + np.flatnonzero(~first[a:b])
                for i in range(0, len(p), 1024):
                    n = np.zeros(len(p[i: i + 1024]), np.int64)
                    for j in range(0, len(q), 1024):
                        hit = x[p[i: i + 1024]] @ x[q[j: j + 1024]].T >= cosine
                        n += (hit & (ids[p[i: i + 1024]][:, None] != ids[q[j: j + 1024]][None, :])) @ copies[q[j: j + 1024]]
                    rows.append(ids[p[i: i + 1024]])
                    counts.append(n)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(counts))], names=["row", "n"])
    return run


def near_classes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, cosine: float = COSINE, passes: int | None = None, window: int = WINDOW, seed: int = 0) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors of different lengths not with each other:
    each length is searched on its own. Rows that repeat a vec_id are rows of their own; they may link with each other. A null vec_id takes part and
    is the largest of its class; alone, its component_id is null and kept is true. No rows give no rows. Other columns are ignored.
    """
    rows = vectors.select(c(id_col).cast("long").alias("vec_id"), c(vec_col).cast("array<double>").alias("embedding"))
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    several = sorted(r["d"] for r in rows.groupBy(size.alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d > 0 and n > 1").collect())      # lengths
    out = rows.where(~size.isin(several)) if several else rows
    out = out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for d in several:
        out = out.unionByName(_classes_of_length(rows.where(size == d), d, cosine, passes, window, seed))
    return out


def _classes_of_length(rows: DataFrame, dim: int, cosine: float, passes: int | None, window: int, seed: int) -> DataFrame:
    """near_classes of vectors of one length."""
    spark = rows.sparkSession
    # A row number that survives a lost task: the identifier where it is unique, else a number written once.
    named = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors-rows")
    with arrow_rows(spark, 2000):
        units = stored(named.select("row", "embedding").mapInArrow(_units(dim), "row long, unit binary").withColumn("name", F.sha2("unit", 256)), "vectors-units")
        distinct = stored(units.groupBy("name").agg(F.min("row").alias("rep"), F.first("unit").alias("unit"), F.count(F.lit(1)).alias("copies")), "vectors-distinct")
        most, hashes = effort(distinct.count(), window)
        keyed = stored(distinct.select(F.col("rep").alias("row"), "unit").mapInArrow(_keyed(dim, passes or most, hashes, seed), "pass int, code binary, row long, unit binary"), "vectors-keys")
        order = keyed.repartitionByRange("pass", "code", "row").sortWithinPartitions("pass", "code", "row")
        found = stored(order.mapInArrow(_windows(window, cosine), "kind int, part int, pos long, left long, right long, pass int, unit binary"), "vectors-windows")
        ends = found.where("kind > 0").withColumn("border", F.when(F.col("kind") == 2, F.col("part")).otherwise(F.col("part") - 1))
        across = ends.repartition("border").sortWithinPartitions("border").mapInArrow(_across(window, cosine), "left long, right long")
        links = stored(found.where("kind = 0").select("left", "right").unionByName(across).distinct(), "vectors-links")
        label = components(links)
        blocks = _blocks(label)
        unit = distinct.select(F.col("rep").alias("row"), "unit", "copies")
        member = stored(blocks.join(unit, "row"), "vectors-members")
        twice = member.select("row", "unit", "copies", "pair", F.col("first")).repartition("pair").sortWithinPartitions("pair")
        counts = stored(twice.mapInArrow(_counted(cosine), "row long, n long").groupBy("row").agg(F.sum("n").alias("n_links")), "vectors-counts")
    ids = named.select("row", "vec_id")
    known = (distinct.select("name", "rep", "copies").join(counts.withColumnRenamed("row", "rep"), "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
             .select("name", "copies", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", F.when(F.col("copies") > 1, F.col("rep"))).alias("label")))
    known = stored(known, "vectors-known")
    mine = skew_join(units.select("row", "name"), known, ["name"], counts=known.select("name", "copies"), count_col="copies", hot_rows=HOT_COPIES, right_unique=True)
    full = ids.join(mine.select("row", "n_links", "label"), "row", "left")
    classes = full.where("label is not null").groupBy("label").agg(F.min("vec_id").alias("least"), F.min(F.struct(F.col("vec_id").isNull(), "vec_id", "row")).alias("first"))
    out = full.join(classes, "label", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"),
                      F.when(F.col("label").isNull(), True).otherwise(F.col("first.row") == F.col("row")).alias("kept"))


def _blocks(label: DataFrame) -> DataFrame:
    """Members of every class with each pair of blocks they take part in: row, pair, first (asks) or not (is asked).

    The number of blocks of a class follows from its size, so no task holds more than about two blocks at once.
    """
    sizes = label.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    n = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    rows = label.join(sizes, "label").select(F.col("node").alias("row"), "label", n.alias("b"), F.pmod(F.xxhash64("node"), n).cast("int").alias("mine"))
    every = F.sequence(F.lit(0), F.col("b") - 1)
    ask = rows.select("row", F.explode(every).alias("other"), "label", "mine").select("row", F.xxhash64("label", "mine", "other").alias("pair"), F.lit(True).alias("first"))
    asked = rows.select("row", F.explode(every).alias("other"), "label", "mine").select("row", F.xxhash64("label", "other", "mine").alias("pair"), F.lit(False).alias("first"))
    return ask.unionByName(asked)
