"""Steps that are run, not only planned: each one is executed, stored and logged before the next one looks at its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cleanlake.core import discard, scratch_path, small_frame

LOG = "position int, step string, target string, success boolean, message string, rows_before long, columns_before int, rows_after long, columns_after int"


class Steps:
    """A table and the steps run on it so far.

    A step's result is written to the shared folder and read back, so that fits of later steps repeat nothing and a lost executor only costs its
    own tasks. A step that fails, while its plan is made or while it runs, leaves the table as it was. The table before the last step is removed
    once the new one is whole; the input itself is never touched.
    """

    def __init__(self, df: DataFrame):
        self.df, self.path, self.rows, self.log = df, None, None, []

    def run(self, step: str, make: Callable[[DataFrame], DataFrame], target: str = "all") -> bool:
        if self.rows is None:
            self.rows = self.df.count()
        path = scratch_path(self.df.sparkSession, "step")
        before = self.rows, len(self.df.columns)
        try:
            new = make(self.df)
            if new is not self.df:
                new.write.parquet(path)
                new = new.sparkSession.read.schema(new.schema).parquet(path)
                rows = new.count()
            else:
                path, rows = self.path, self.rows
        except Exception as e:      # of any kind: it is the step that failed, and the log says so
            discard(path)
            self.log.append((len(self.log) + 1, step, target, False, _said(e), *before, *before))
            return False
        if self.path and self.path != path:
            discard(self.path)
        self.df, self.path, self.rows = new, path, rows
        self.log.append((len(self.log) + 1, step, target, True, "ok", *before, rows, len(new.columns)))
        return True

    def log_frame(self) -> DataFrame:
        return small_frame(self.df.sparkSession, self.log, LOG)


def _said(e: Exception) -> str:
    """Error class of Spark's errors, else the type."""
    named = getattr(e, "getCondition", lambda: None)()
    return f"{type(e).__name__}: {named}" if named else type(e).__name__
