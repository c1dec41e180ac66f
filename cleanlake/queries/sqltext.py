"""Small builders for the DuckDB side of the cross-checks."""

from __future__ import annotations

from cleanlake.queries.fixtures import ora

NUM_RE = r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*"
DATE_FORMATS = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y"]

OD_NUM = ["o_orderkey", "copy", "o_custkey", "o_totalprice"]
OD_TEXT = ["o_orderstatus", "o_orderpriority", "price_text", "flag_text", "date_text"]
OD_DT = ["o_orderdate"]
OD_ALL = ["o_orderkey", "copy", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority",
          "price_text", "flag_text", "date_text"]


def R(expr: str, digits: int = 4) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0E0"


def union(items, fn) -> str:
    return " UNION ALL ".join(fn(x) for x in items)


def isnum(x: str) -> str:
    return f"regexp_full_match({x}, '{NUM_RE}')"


def tonum(x: str) -> str:
    return f"CASE WHEN {isnum(x)} THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def clean(x: str) -> str:
    return f"regexp_replace({x}, '[,$%]', '', 'g')"


def todate(x: str, formats=None) -> str:
    return "coalesce(" + ", ".join(f"try_strptime({x}, '{f}')" for f in (formats or DATE_FORMATS)) + ")"


def isbool(x: str) -> str:
    return f"lower(trim({x})) IN ('true','1','yes','y','t','false','0','no','n','f')"


def prof(view: str, num: list[str], text: list[str], dt: list[str], order: list[str] | None = None) -> str:
    """CTE body `prof`: one row per column with every statistic the rules use."""
    order = order or num + text + dt
    rows = []
    for i, x in enumerate(order):
        base = f"SELECT {i} AS pos, '{x}' AS col, '{'numeric' if x in num else 'text' if x in text else 'datetime'}' AS role, count(*) AS n, count(*) - count({x}) AS nulls, count(DISTINCT {x}) AS uniq"
        if x in num:
            v = f"CAST({x} AS DOUBLE)"
            rows.append(f"""{base}, avg({v}) AS mean, stddev_samp({v}) AS std, min({v}) AS mn, max({v}) AS mx,
 CASE WHEN stddev_pop({v}) > 0 THEN skewness({v}) END AS skew, CASE WHEN stddev_pop({v}) > 0 THEN kurtosis({v}) END AS kurt,
 CASE WHEN stddev_pop({v}) > 0 THEN skewness({v}) * (count({x}) - 2) / sqrt(CAST(count({x}) AS DOUBLE) * (count({x}) - 1)) END AS skewp, CASE WHEN stddev_pop({v}) > 0 THEN kurtosis_pop({v}) END AS kurtp,
 quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS q2, quantile_cont({v}, 0.75) AS q3,
 count(*) FILTER (WHERE {x} = 0) AS zeros, count(*) FILTER (WHERE {x} < 0) AS negs, 0 AS num_ok, 0 AS clean_ok, 0 AS date_ok, 0 AS bool_ok,
 (SELECT count(*) FROM {view}, (SELECT quantile_cont({v}, 0.25) AS a, quantile_cont({v}, 0.75) AS b FROM {view}) WHERE {x} < a - 1.5 * (b - a) OR {x} > b + 1.5 * (b - a)) AS outl
 FROM {view}""")
        else:
            parse = (f"count(*) FILTER (WHERE {isnum(x)}), count(*) FILTER (WHERE {isnum(clean(x))}), count({todate(x)}), count(*) FILTER (WHERE {isbool(x)})"
                     if x in text else "0, 0, 0, 0")
            rows.append(f"{base}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, 0, {parse}, 0 FROM {view}")
    return "prof AS (" + " UNION ALL ".join(rows) + ")"


def od_prof(body: str) -> str:
    """SQL over the profile of orders_dirty; `dup` holds its duplicate rows without the key `copy`."""
    return ora("orders_dirty", f"WITH {prof('orders_dirty', OD_NUM, OD_TEXT, OD_DT, OD_ALL)}, "
               f"dup AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dirty)) AS d FROM orders_dirty) {body}")
