"""All registered queries."""

from __future__ import annotations

import importlib

from cleanlake.queries.registry import QUERIES, SQL

MODULES = ["q_profile", "q_clean", "q_text", "q_encode", "q_features", "q_plans"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"cleanlake.queries.{m}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_sql():
    _load()
    return dict(SQL)


def flagship(spark, sf_dir):
    """Dirty orders -> first of each order -> median fill -> IQR cap -> one-hot priority, summed per order status."""
    from pyspark.sql import functions as F

    from cleanlake.operators import dedup, encode, missing, outliers
    from cleanlake.queries.fixtures import table

    orders = dedup.keep_first(table(spark, sf_dir, "orders_dirty"), ["o_orderkey"], ["copy"])
    filled = missing.transform(orders, missing.fit_median(orders, ["o_totalprice"]))
    capped = outliers.cap(filled, outliers.fit_iqr(filled, ["o_totalprice"]))
    hot = encode.onehot(capped, ["o_orderpriority"], missing=True)
    flags = [x for x in hot.columns if x.startswith("o_orderpriority_")]
    return hot.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg("o_totalprice"), 4).alias("avg_price"),
                                            *[F.sum(F.col(f"`{x}`")).alias(x) for x in flags])
