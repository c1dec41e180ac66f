"""K nearest rows with missing cells, by a grid index per pattern of missing cells.

The distance of two rows is Euclidean over the columns that both know, scaled up to all columns. Rows with one pattern of known cells share
their known columns, so the donors of a pattern are laid on one grid per set of columns that some recipient pattern has in common with it: up to
three columns of the set, cut at quantiles, as many cells as give about `cell` donors each. A recipient searches the cells around its own
place, joined on the cell, keeps the k nearest, and widens each side of its box until that side is farther away than the k-th distance; the
box doubles from round to round. What it finds is exact.

Recipients of equal cells search once. Of donors that lie on one point of a grid only the k smallest keys can matter, so copies, however many,
neither fill a cell nor a task. With more than `max_patterns` patterns the donors are dealt to blocks instead, and every recipient meets every block by a
shuffle: exact as well, but quadratic.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cleanlake.core import c, dbl, written
from cleanlake.operators.skew import lookup_join

DIMS = 3              # columns of a grid
FINE = 1024           # quantiles per column that grids are cut at
BLOCK = 20_000        # donors of a block where there are too many patterns
BOX = ["c1", "c2", "c3"]


@dataclass(frozen=True)
class Grid:
    """Cuts of the columns (at most DIMS) of an index; `common` columns count in its distances. Without `pattern` it has blocks of all donors."""
    pattern: str | None
    common: tuple[int, ...]
    cuts: tuple[tuple[int, np.ndarray], ...]
    blocks: int = 1

    def places(self, x: np.ndarray) -> np.ndarray:
        """Cell of every row of x (rows by columns)."""
        out = np.zeros((len(x), DIMS), np.int32)
        for m, (j, edges) in enumerate(self.cuts):
            out[:, m] = np.searchsorted(edges, x[:, j], side="right")
        return out

    def widened(self, x: np.ndarray, box: np.ndarray, reach: np.ndarray, step: int) -> np.ndarray:
        """Boxes (lo, hi per dimension) moved out by `step` on the sides that lie within `reach` of x."""
        out = box.copy()
        for m, (j, edges) in enumerate(self.cuts):
            walls = np.concatenate([[-np.inf], edges, [np.inf]])
            lo, hi = box[:, 2 * m], box[:, 2 * m + 1]
            with np.errstate(invalid="ignore"):
                low = (lo > 0) & ~(x[:, j] - walls[lo] > reach)
                high = (hi < len(edges)) & ~(walls[hi + 1] - x[:, j] > reach)
            out[:, 2 * m] = np.where(low, np.maximum(lo - step, 0), lo)
            out[:, 2 * m + 1] = np.where(high, np.minimum(hi + step, len(edges)), hi)
        return out


def _cuts(common: list[int], rows: int, cell: int, edges: list[np.ndarray]) -> tuple:
    """Columns of the widest spread, cut so that cells are about as wide in each of them and hold about `cell` of the rows."""
    spread = {j: (edges[j][-1] - edges[j][0]) if len(edges[j]) > 1 else 0.0 for j in common}
    chosen = sorted((j for j in common if spread[j] > 0), key=lambda j: -spread[j])[:DIMS]
    cells = max(1.0, rows / cell)
    while chosen:
        width = (np.prod([spread[j] for j in chosen]) / cells) ** (1 / len(chosen))
        if spread[chosen[-1]] > width or len(chosen) == 1:
            break
        chosen.pop()
    out = []
    for j in chosen:
        n = int(min(len(edges[j]), max(0, round(spread[j] / width) - 1)))
        if n:
            out.append((j, edges[j][np.unique(np.linspace(0, len(edges[j]) - 1, n + 2).round().astype(int)[1:-1])]))
    return tuple(out)


def _indexes(patterns: dict[str, int], target: list[int], edges: list[np.ndarray], cell: int) -> tuple[list[Grid], dict, dict]:
    """Grids; per donor pattern its grids; per recipient pattern the (target, grid) it searches."""
    grids, known, holds, asks = [], {}, {}, {}
    for p in patterns:
        for t in target:
            if p[t] == "1":
                continue
            for q, rows in patterns.items():
                common = tuple(j for j in range(len(p)) if p[j] == q[j] == "1")
                if q[t] == "0" or not common:
                    continue
                if (q, common) not in known:
                    known[q, common] = len(grids)
                    holds.setdefault(q, []).append(len(grids))
                    grids.append(Grid(q, common, _cuts(list(common), rows, cell, edges)))
                asks.setdefault(p, []).append((t, known[q, common]))
    return grids, holds, asks


def _blocks(patterns: dict | None, target: list[int], rows: int) -> list[Grid]:
    return [Grid(None, (), (), max(1, -(-rows // BLOCK)))]


def _entries(grids: list[Grid], holds: dict | None, names: list[str]):
    """Donors on their grids: one row per grid of the donor's pattern, with the values that count there (point)."""
    def run(frames):
        for f in frames:
            x = f[names].to_numpy(float)
            parts = []
            for pattern, rows in (f.groupby("pattern").indices if holds is not None else {None: np.arange(len(f))}).items():
                for g in holds.get(pattern, ()) if holds is not None else range(len(grids)):
                    part = f.iloc[rows][["id", *names]].copy()
                    part["grid"] = g
                    place = grids[g].places(x[rows])
                    if holds is None:
                        place[:, 0] = pd.util.hash_pandas_object(part["id"], index=False).to_numpy() % np.uint64(grids[g].blocks)
                    for m, name in enumerate(BOX):
                        part[name] = place[:, m]
                    keep = np.zeros(x.shape[1], bool) if holds is not None else np.ones(x.shape[1], bool)
                    keep[list(grids[g].common)] = True
                    part["point"] = [[None if np.isnan(a) else a for a in r] for r in np.where(keep, x[rows], np.nan)]
                    parts.append(part)
            if parts:
                yield pd.concat(parts)
    return run


def _units(grids: list[Grid], asks: dict | None, target: list[int], names: list[str]):
    """Searches: one row per distinct recipient, target and grid, with the box of the first round; it has searched nothing yet."""
    def run(frames):
        for f in frames:
            x = f[names].to_numpy(float)
            parts = []
            for pattern, rows in (f.groupby("pattern").indices if asks is not None else {None: np.arange(len(f))}).items():
                for t, g in asks.get(pattern, ()) if asks is not None else [(t, 0) for t in target]:
                    at = rows if asks is not None else rows[np.isnan(x[rows, t])]
                    part = f.iloc[at][names].copy()
                    part["t"], part["grid"] = t, g
                    place = grids[g].places(x[at])
                    box = np.repeat(place, 2, axis=1)
                    box = grids[g].widened(x[at], box, np.full(len(at), np.inf), 1)
                    if asks is None:
                        box[:, 1] = grids[g].blocks - 1
                    for m in range(DIMS):
                        part[f"lo{m}"], part[f"hi{m}"] = box[:, 2 * m], box[:, 2 * m + 1]
                        part[f"lo_{m}"], part[f"hi_{m}"] = 0, -1
                    parts.append(part)
            if parts:
                yield pd.concat(parts)
    return run


def _wider(grids: list[Grid], columns: int, names: list[str], step: int):
    """Next boxes of the searches whose box does not reach the k-th distance yet."""
    def run(frames):
        for f in frames:
            parts = []
            for g, rows in f.groupby("grid").indices.items():
                grid, part = grids[g], f.iloc[rows].copy()
                if grid.pattern is None:
                    continue
                x = part[names].to_numpy(float)
                box = part[[f"{s}{m}" for m in range(DIMS) for s in ("lo", "hi")]].to_numpy(np.int64)
                # Squared distances are scaled to all columns; a hair more keeps ties at the wall inside.
                reach = np.sqrt(part["kth"].fillna(np.inf).to_numpy(float) * len(grid.common) / columns) * (1 + 1e-9)
                new = grid.widened(x, box, reach, step)
                for m in range(DIMS):
                    part[f"lo_{m}"], part[f"hi_{m}"] = box[:, 2 * m], box[:, 2 * m + 1]
                    part[f"lo{m}"], part[f"hi{m}"] = new[:, 2 * m], new[:, 2 * m + 1]
                parts.append(part[(new != box).any(axis=1)])
            if parts:
                yield pd.concat(parts).drop(columns="kth")
    return run


def _distance(left: list[Column], right: list[Column]) -> Column:
    both = [a.isNotNull() & b.isNotNull() for a, b in zip(left, right)]
    total = reduce(lambda s, x: s + x, [F.when(ok, (a - b) * (a - b)).otherwise(F.lit(0.0)) for ok, a, b in zip(both, left, right)])
    common = reduce(lambda s, x: s + x, [ok.cast("int") for ok in both])
    return F.when(common > 0, total * F.lit(float(len(left))) / common)


def nearest(df: DataFrame, columns: list[str], key: str, k: int = 5, *, cell: int = 16, max_patterns: int = 64) -> tuple[DataFrame, list[int], dict]:
    """(found, targets, means): the k nearest donors (d2, id, v) of every distinct recipient (its values as columns x0, x1, ...) and target column t.

    A donor knows the target and at least one column that the recipient knows; ties go to the smallest key. Infinite values count as unknown.
    Only column statistics and the patterns of missing cells (at most max_patterns + 1) reach the driver.
    """
    names = [f"x{j}" for j in range(len(columns))]
    finite = lambda x: F.when(~dbl(x).isin(float("inf"), float("-inf")), dbl(x))
    base = df.select(c(key).alias("id"), *[finite(x).alias(n) for x, n in zip(columns, names)])
    base = base.withColumn("pattern", F.concat(*[F.when(F.col(n).isNull(), "0").otherwise("1") for n in names]))
    cut = F.expr("array(" + ", ".join(f"{(i + 1) / FINE}D" for i in range(FINE - 1)) + ")")
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(dbl(x)).alias(f"k{j}") for j, x in enumerate(columns)], *[F.avg(finite(x)).alias(f"m{j}") for j, x in enumerate(columns)],
                 *[F.percentile_approx(finite(x), cut, 4 * FINE).alias(f"q{j}") for j, x in enumerate(columns)]).first()
    target = [j for j in range(len(columns)) if row[f"k{j}"] < row["n"]]
    means = {j: row[f"m{j}"] for j in target}
    empty = base.limit(0).select(*names, F.lit(0).alias("t"), F.lit(0.0).alias("d2"), "id", F.lit(0.0).alias("v"))
    if not target:
        return empty, target, means
    edges = [np.unique(np.array(row[f"q{j}"] or [], float)) for j in range(len(columns))]
    patterns = {r["pattern"]: r["n"] for r in base.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).limit(max_patterns + 1).collect()}
    few = len(patterns) <= max_patterns
    grids, holds, asks = _indexes(patterns, target, edges, cell) if few else (_blocks(patterns, target, row["n"]), None, None)
    values = ", ".join(f"{n} double" for n in names)
    id_type = base.schema["id"].dataType.simpleString()
    entries = base.mapInPandas(_entries(grids, holds, names), f"id {id_type}, {values}, grid int, c1 int, c2 int, c3 int, point array<double>")
    if few:      # of the donors on one point only the k smallest keys can be among the nearest
        entries = entries.withColumn("place", F.row_number().over(Window.partitionBy("grid", "point").orderBy("id"))).where(F.col("place") <= k)
    donors = written(entries.select("grid", *BOX, "id", *[F.col(n).alias("y" + n) for n in names]), "knn-donors")
    lacking = reduce(lambda a, b: a | b, [F.col(names[j]).isNull() for j in target])
    boxes = ", ".join(f"lo{m} int, hi{m} int, lo_{m} int, hi_{m} int" for m in range(DIMS))
    points = base.where(lacking).select("pattern", *names).distinct()
    units = written(points.mapInPandas(_units(grids, asks, target, names), f"{values}, t int, grid int, {boxes}"), "knn-searches")
    best, step = None, 1
    who = Window.partitionBy(*names, "t").orderBy("d2", "id")
    while not units.isEmpty():
        cells = units
        for m, name in enumerate(BOX):
            cells = cells.withColumn(name, F.explode(F.sequence(f"lo{m}", f"hi{m}")))
        seen = reduce(lambda a, b: a & b, [F.col(name).between(F.col(f"lo_{m}"), F.col(f"hi_{m}")) for m, name in enumerate(BOX)])
        pairs = cells.where(~seen).select(*names, "t", "grid", *BOX).join(donors, ["grid", *BOX])
        new = pairs.select(*names, "t", _distance([F.col(n) for n in names], [F.col("y" + n) for n in names]).alias("d2"), "id",
                           F.element_at(F.array(*[F.col("y" + n) for n in names]), F.col("t") + 1).alias("v")).where("d2 is not null and v is not null")
        best = written((new if best is None else best.unionByName(new)).withColumn("place", F.row_number().over(who)).where(F.col("place") <= k).drop("place"), "knn-best")
        kth = best.groupBy(*names, "t").agg(F.when(F.count(F.lit(1)) == k, F.max("d2")).alias("kth"))
        same = reduce(lambda a, b: a & b, [F.col("u." + n).eqNullSafe(F.col("b." + n)) for n in [*names, "t"]])
        step *= 2
        units = units.alias("u").join(kth.alias("b"), same, "left").select("u.*", "kth")
        units = written(units.mapInPandas(_wider(grids, len(columns), names, step), f"{values}, t int, grid int, {boxes}"), "knn-searches")
    return empty if best is None else best, target, means


def impute_knn(df: DataFrame, columns: list[str], key: str, k: int = 5, *, cell: int = 16, max_patterns: int = 64) -> DataFrame:
    """Mean of the k nearest rows (see `nearest`) for every missing cell of `columns`; the column's mean where no row can be compared.

    NaN counts as missing. A column without any value stays null. Other columns and all rows are kept.
    """
    best, target, means = nearest(df, columns, key, k, cell=cell, max_patterns=max_patterns)
    if not target:
        return df
    names = [f"x{j}" for j in range(len(columns))]
    own = "__knn"
    while any(x.startswith(own) for x in df.columns):
        own += "_"
    listed = F.sort_array(F.collect_list(F.struct("d2", "id", "v")))      # k entries at most
    mean = best.groupBy(*names, "t").agg((F.aggregate(listed, F.lit(0.0), lambda s, e: s + e["v"]) / F.size(listed)).alias("v"))
    wide = mean.groupBy(F.array(*names).alias(own)).agg(*[F.max(F.when(F.col("t") == j, F.col("v"))).alias(f"{own}{j}") for j in target])
    finite = [F.when(~dbl(x).isin(float("inf"), float("-inf")), dbl(x)) for x in columns]
    lacking = reduce(lambda a, b: a | b, [dbl(columns[j]).isNull() for j in target])
    rows = df.withColumn(own, F.when(lacking, F.array(*finite)))
    rows = lookup_join(rows, written(wide, "knn-values"), [own], "left")
    filled = {columns[j]: F.coalesce(dbl(columns[j]), F.col(f"{own}{j}"), F.lit(means[j]).cast("double")) for j in target}
    return rows.select(*[filled[x].alias(x) if x in filled else c(x) for x in df.columns])
