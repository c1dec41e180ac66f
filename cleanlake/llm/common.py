"""Shared parts of the operators: durable tables, checked broadcasts, ASCII case folding, words, file access in tasks."""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.core import c, scratch_path

#: Words of a text: runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A look-up side is sent to every executor only up to this many rows; beyond, the join stays a shuffle join.
BROADCAST_ROWS = 100_000
BLOCK = 1024     # rows of a file whose numbers travel together


#: Paths of the tables that the operators now running have written, innermost operator last.
_SCOPES: list[list[str]] = []


def stored(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Written to and reread from the folder that all executors share: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _SCOPES:
        _SCOPES[-1].append(path)
    (df.repartition(partitions) if partitions else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that `stored` returned, once everything made of it is stored itself."""
    remove([df.stored_at])


def tidy(name: str):
    """For operators whose result is small beside the tables on the way to it: stores the result and removes those tables."""
    def around(operator):
        @functools.wraps(operator)
        def run(*args, **more):
            _SCOPES.append([])
            try:
                result = operator(*args, **more)
            finally:
                scope = _SCOPES.pop()
            result = stored(result, name)        # belongs to the operator around this one, if there is any
            remove(scope)
            return result
        return run
    return around


def remove(paths: list[str]) -> None:
    """Deletes written tables. One that cannot be deleted stays."""
    for path in paths:
        fs, at = file_system(path)
        with contextlib.suppress(OSError):
            fs.delete_dir(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same rows, marked for broadcast only when a count of at most max_rows + 1 rows proves that they are few."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of ASCII alone take the fast built-in, which does the same there."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_bytes(frames: Iterator, column: str, limit: int) -> Iterator:
    """Arrow-sized pandas batches cut further, so that one cut holds about `limit` characters, or one text if that is longer."""
    for frame in frames:
        sizes = frame[column].str.len().fillna(0).to_numpy()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield frame.iloc[start:i]
                start, held = i, 0
            held += n
        if start < len(frame):
            yield frame.iloc[start:]


def file_system(uri: str):
    """The file system and the path of a URI; a path without a scheme is local. Tasks read and write shared files by it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for the jobs inside: texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sorted_runs(batches: Iterator, key: str, rows: int = 200_000) -> Iterator:
    """Arrow batches sorted by `key`, regrouped so that no value of the key is cut: yields tables of about `rows` rows or one long run."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= rows and (batch.num_rows == size or batch.column(key)[-1] != held[0].column(key)[0]):
            whole = pa.Table.from_batches(held).combine_chunks()
            last = whole.column(key)[-1]
            cut = pc.index(whole.column(key), last).as_py()
            if cut:
                yield whole.slice(0, cut)
            rest = whole.slice(cut)
            held, size = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def unused(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as keep it apart from the columns of docs."""
    while name.lower() in {x.lower() for x in docs.columns}:
        name += "_"
    return name


def located(docs: DataFrame, name: str = "__at") -> DataFrame:
    """docs with a column that names each row by its file and place in it. A frame that is no plain file scan is first written."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation" or "_metadata" in docs.columns:
        docs = stored(docs, "located")
    return docs.select(*[F.col("`" + x.replace("`", "``") + "`") for x in docs.columns], F.concat_ws(":", "_metadata.file_path", "_metadata.row_index").alias(name))


def placed(rows: DataFrame, values: DataFrame, at: str, value: str) -> DataFrame:
    """rows of located() with the small number (a byte) that `values` has for every one of them under the same name `at`.

    The numbers travel as one array for each block of BLOCK rows of a file. So few rows are broadcast when a count proves them few, and
    the rows with their texts stay where they are."""
    index = F.substring_index(at, ":", -1)
    file, index = c(at).substr(F.lit(1), F.length(at) - F.length(index) - 1), index.cast("long")
    block, spot = F.floor(index / BLOCK), (index % BLOCK).cast("int")
    f, b, p = (unused(rows, x) for x in ("__file", "__block", "__packed"))
    packed = values.groupBy(file.alias(f), block.alias(b)).agg(F.sort_array(F.collect_list(F.struct(spot.alias("i"), c(value).cast("byte").alias("v")))).alias(p))
    whole = F.element_at(p, -1)["i"] + 1 == F.size(p)
    numbers = F.when(whole, F.transform(p, lambda x: x["v"])).otherwise(F.raise_error(F.lit("a block has not one value for each of its rows")))
    packed = checked_broadcast(stored(packed.select(f, b, numbers.alias(p)), "placed"))
    out = rows.join(packed, (file == F.col(f)) & (block == F.col(b)))
    return out.select(*[c(x) for x in rows.columns], F.element_at(p, spot + 1).alias(value))
