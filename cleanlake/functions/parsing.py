"""Column expressions that read numbers, dates and booleans out of text; null where the text does not parse."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accepted spellings
TRUE_WORDS = ["true", "1", "yes", "y", "t"]
FALSE_WORDS = ["false", "0", "no", "n", "f"]
BOOLEAN_MAP_TRUE = ["true", "1", "yes", "y"]
BOOLEAN_MAP_FALSE = ["false", "0", "no", "n"]
# fixed values: date patterns tried in order
DATE_PATTERNS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MM-yyyy"]
MULTI_PATTERNS = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss"]
# fixed values: strftime directives and the matching Spark pattern letters
STRFTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS",
            "p": "a", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD"}
NUMBER_RE = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def as_number(x: Column) -> Column:
    """Text as double. A pattern guards the cast, so words such as 'infinity' or '1d' are not numbers."""
    return F.when(x.rlike(NUMBER_RE), x.try_cast("double"))


def as_number_clean(x: Column) -> Column:
    """Text as double after dropping `,`, `$` and `%`."""
    return as_number(F.regexp_replace(x, "[,$%]", ""))


def as_timestamp(x: Column, pattern: str) -> Column:
    """Text as timestamp, null when it does not match the whole pattern.

    Fixed-width digit patterns are tested by shape, rearranged to ISO order and cast; the general parser, which
    raises and swallows an exception per failing value, is kept for the others.
    """
    bare = pattern.replace("'", "")
    at = {k: bare.find(k) for k in ("yyyy", "MM", "dd", "HH", "mm", "ss")}
    fixed = not re.search(r"[a-zA-Z]", re.sub("yyyy|MM|dd|HH|mm|ss", "", bare)) and min(at["yyyy"], at["MM"], at["dd"]) >= 0
    if not fixed:
        return F.try_to_timestamp(x, F.lit(pattern)).cast("timestamp_ntz")
    shape = "^" + re.sub("[yMdHms]", lambda _: r"\d", re.escape(bare)) + "$"
    cut = lambda k: F.substring(x, at[k] + 1, len(k)) if at[k] >= 0 else F.lit("00")
    iso = F.concat(cut("yyyy"), F.lit("-"), cut("MM"), F.lit("-"), cut("dd"), F.lit(" "), cut("HH"), F.lit(":"), cut("mm"), F.lit(":"), cut("ss"))
    return F.when(x.rlike(shape), iso.try_cast("timestamp_ntz"))


def first_timestamp(x: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[as_timestamp(x, p) for p in patterns])


def as_date_auto(x: Column) -> Column:
    return first_timestamp(F.trim(x), DATE_PATTERNS)


def strftime_pattern(fmt: str) -> str:
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if fmt[i + 1] not in STRFTIME:
                raise ValueError(f"unsupported directive %{fmt[i + 1]}")
            out.append(STRFTIME[fmt[i + 1]])
            i += 2
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i])
            i += 1
    return "".join(out)


def as_boolean(x: Column, true_words: list[str] = TRUE_WORDS, false_words: list[str] = FALSE_WORDS) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.isin(true_words), F.lit(True)).when(low.isin(false_words), F.lit(False))


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)
