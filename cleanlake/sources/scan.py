"""Sources. Every reader returns a lazy DataFrame; NaN is turned into null once, here."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanlake.core import c, nan_to_null, qn, written

FORMATS = {"csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "parquet": "parquet", "orc": "orc", "xml": "xml"}
DELIMITERS = [",", "\t", ";", "|"]


OPTIONS = {"escape": '"', "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}


def scan_delimited(spark: SparkSession, path: str | list[str], sep: str = ",", schema: str | T.StructType | None = None, multiline: bool | None = None) -> DataFrame:
    """Header row; types inferred unless a schema is given (inference costs one more pass over the files).

    Quoted values may hold line breaks. multiline=None looks for them in one pass over the lines (JVM only): without any, the files go
    through the plain reader; otherwise, or with multiline=True, records are put together block by block (see `csv_records`).
    Either way a file is read by as many tasks as it has blocks. A quote inside a value is doubled, and a value with one is quoted.
    An empty value is missing, quoted or not.
    """
    if multiline is None:
        broken = _lines(spark, path).where(_quotes("value") % 2 == 1)
        multiline = not broken.isEmpty()
    if multiline:
        return nan_to_null(_scan_records(spark, path, sep, schema))
    r = spark.read.options(header=True, sep=sep, multiLine=False, **OPTIONS)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return nan_to_null(r.csv(path))


def _quotes(column: str) -> Column:
    return F.length(column) - F.length(F.replace(F.col(column), F.lit('"'), F.lit("")))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, file, block of every line, in the order of its block within a task. Line feeds end lines, so carriage returns stay."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _joined(frames):
    """Puts the lines of a block together: whole records, and the pieces of records that other blocks hold the rest of.

    A piece is what comes before the first line that starts a record (role head), or the last record when its quote is still open (tail).
    """
    def rows(key, parts, head, start, open_end):
        role = "head" if head else "tail" if open_end else "record"
        return (*key, role, "\n".join(parts), start)

    key, held, is_open, head, first, out = None, [], False, False, False, []

    def flush():
        if held:
            out.append(rows(key, held, head, first, is_open))

    for f in frames:
        counts = f["value"].str.count('"').to_numpy()
        for value, file, block, begins_open, n in zip(f["value"], f["file"], f["block"], f["open"], counts):
            if (file, block) != key:
                flush()
                key, held, is_open, head, first = (file, block), [], bool(begins_open), bool(begins_open), block == 0
            elif not is_open:                 # the line before ended a record
                flush()
                held, head, first = [], False, False
            held.append(value)
            is_open ^= bool(n % 2)
        if out:
            yield pd.DataFrame(out, columns=["file", "block", "role", "record", "first"])
            out.clear()
    flush()
    if out:
        yield pd.DataFrame(out, columns=["file", "block", "role", "record", "first"])


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """record, first (the file's first one) of every CSV record, read in blocks although quoted values may hold line breaks.

    One pass counts the quotes of every block; a running sum over the blocks of a file (one row each) tells which blocks begin inside a
    quoted value. With that, each block's lines are put together on their own in a second pass, and only the pieces of records that cross a
    border meet again: a head belongs to the last block before it that ends with an open record.
    """
    lines = _lines(spark, path)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum(_quotes("value")).alias("n"))
    inside = written(blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("open")).where("open"), "csv-blocks")
    # At most one row per block of the files; a broadcast keeps the lines in their order.
    marked = lines.join(F.broadcast(inside), ["file", "block"], "left").select("value", "file", "block", F.coalesce("open", F.lit(False)).alias("open"))
    parts = written(marked.mapInPandas(_joined, "file string, block long, role string, record string, first boolean"), "csv-records")
    pieces = parts.where("role <> 'record'")
    upto = Window.partitionBy("file").orderBy("block", F.col("role") == "tail").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("role") == "tail", F.struct("block", "first")), ignorenulls=True)
    # A tail opens a record; heads up to the next tail close or go on with it.
    cut = pieces.select("file", "block", "role", "first").withColumn("owner", owner.over(upto))
    whole = pieces.drop("first").join(cut.drop("first"), ["file", "block", "role"]).groupBy("file", F.col("owner.block").alias("start"), F.col("owner.first").alias("first"))
    listed = F.sort_array(F.collect_list(F.struct("block", F.when(F.col("role") == "tail", 1).otherwise(0).alias("late"), "record")))
    whole = whole.agg(F.array_join(F.transform(listed, lambda x: x["record"]), "\n").alias("record"))
    return parts.where("role = 'record'").select("record", "first").unionByName(whole.select("record", "first"))


def _scan_records(spark: SparkSession, path: str | list[str], sep: str, schema: str | T.StructType | None) -> DataFrame:
    records = csv_records(spark, path).withColumn("record", F.regexp_replace("record", r"\r$", ""))
    top = records.where("first").first()
    if top is None:
        return spark.createDataFrame([], schema if schema is not None else T.StructType())
    if schema is None:
        names = next(csv.reader([top["record"]], delimiter=sep))
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        infer = True
    else:
        schema, infer = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema), False
    body = records.where(~F.col("first") & (F.length("record") > 0))
    fields = ", ".join(f"{qn(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    rows = body.select(F.from_csv("record", fields, {"sep": sep, "multiLine": "true", **OPTIONS}).alias("r")).select("r.*")
    return _typed(rows) if infer else rows


def _typed(rows: DataFrame) -> DataFrame:
    """Columns cast to the narrowest type that all of their values have: int, bigint, double, timestamp, boolean, else text."""
    kinds = ["int", "bigint", "double", "timestamp", "boolean"]
    fits = rows.agg(*[F.coalesce(F.bool_and(c(x).isNull() | c(x).try_cast(k).isNotNull()), F.lit(False)).alias(f"{i}_{k}") for i, x in enumerate(rows.columns) for k in kinds]).first()
    chosen = [next((k for k in kinds if fits[f"{i}_{k}"]), "string") for i in range(len(rows.columns))]
    return rows.select(*[c(x).cast(k).alias(x) for x, k in zip(rows.columns, chosen)])


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs to columns with dotted names, at any depth."""
    def leaves(t: T.StructType, path: list[str]):
        for f in t.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, path + [f.name])
            else:
                yield path + [f.name]
    def get(path: list[str]) -> Column:
        return reduce(lambda col, name: col.getField(name), path[1:], c(path[0]))
    return df.select(*[get(p).alias(sep.join(p)) for p in leaves(df.schema, [])])


def scan_json(spark: SparkSession, path: str | list[str], multiline: bool = False, schema: str | T.StructType | None = None) -> DataFrame:
    """List of records (or one object) per document with multiline=True, otherwise JSON lines; nested objects are flattened."""
    r = spark.read.option("multiLine", multiline)
    return nan_to_null(flatten((r.schema(schema) if schema is not None else r).json(path)))


def json_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse a JSON text column and flatten it next to the other columns."""
    parsed = df.withColumn(column, F.from_json(c(column), schema))
    return flatten(parsed)


def scan_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return nan_to_null(spark.read.parquet(*([path] if isinstance(path, str) else path)))


def scan_orc(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.orc(path))


def scan_xml(spark: SparkSession, path: str, row_tag: str, schema: str | T.StructType | None = None) -> DataFrame:
    r = spark.read.format("xml").option("rowTag", row_tag)
    return nan_to_null(flatten((r.schema(schema) if schema is not None else r).load(path)))


def scan_zip_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", rows_per_batch: int = 50_000) -> DataFrame:
    """All CSV members of every zip archive under the path: an archive is read by one task, rows leave it in batches.

    An archive without a CSV member stops the job.
    """
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    text = ", ".join(f"`{n}` string" for n in names)

    def unzip(batches):
        for pdf in batches:
            for path, blob in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    members = [m for m in z.namelist() if m.lower().endswith(".csv")]
                    if not members:
                        raise ValueError(f"{path}: no CSV file in the archive")
                    for member in members:
                        with z.open(member) as f:
                            for part in pd.read_csv(f, sep=sep, dtype=str, keep_default_na=False, na_values=[""], chunksize=rows_per_batch):
                                yield part[names]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    raw = files.mapInPandas(unzip, text)
    types = {f.name: f.dataType for f in T.StructType.fromDDL(schema).fields}
    return raw.select(*[c(n).try_cast(types[n]).alias(n) for n in names])


def scan_uri(spark: SparkSession, uri: str, fmt: str | None = None) -> DataFrame:
    """Object store or file system location (s3a://, gs://, abfss://, hdfs://, file://); format by extension."""
    ext = fmt or re.sub(r"/+$", "", uri).rsplit(".", 1)[-1].lower()
    if ext not in ("csv", "tsv", "json", "parquet", "orc"):
        raise ValueError(f"no reader for .{ext}; pass fmt")
    if ext in ("csv", "tsv"):
        return scan_delimited(spark, uri, "\t" if ext == "tsv" else ",")
    return {"json": scan_json, "parquet": scan_parquet, "orc": scan_orc}[ext](spark, uri)


def jdbc_options(url: str, query: str | None = None, table: str | None = None, partition: tuple[str, str, str, int] | None = None, **extra: str) -> dict[str, str]:
    """Options of a JDBC read: a query as one partition, or a table split on (column, lower, upper, parts)."""
    if (query is None) == (table is None):
        raise ValueError("give a query or a table")
    out = {"url": url, **extra}
    if query is not None and partition is None:
        out["query"] = query
        return out
    out["dbtable"] = table if table is not None else f"({query}) q"
    if partition:
        out.update(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, partition)))
    return out


def scan_jdbc(spark: SparkSession, url: str, query: str | None = None, table: str | None = None, partition: tuple[str, str, str, int] | None = None, **extra: str) -> DataFrame:
    """PostgreSQL, MySQL, SQLite, SQL Server or any other JDBC source; Catalyst pushes filters and columns down."""
    return nan_to_null(spark.read.format("jdbc").options(**jdbc_options(url, query, table, partition, **extra)).load())


def scan_many(spark: SparkSession, paths: dict[str, str], sep: str = ",") -> dict[str, DataFrame]:
    return {name: scan_delimited(spark, p, sep) for name, p in paths.items()}


def many_totals(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per named table; the counts run as one job."""
    parts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns")) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def guess_delimiter(lines: DataFrame) -> str:
    """Delimiter that splits the lines (column value) most evenly into most fields, from one aggregate over all of them."""
    n = lambda sep: F.length("value") - F.length(F.translate("value", sep, ""))
    row = lines.where(F.trim("value") != "").agg(*[F.struct(F.min(n(x)).alias("least"), F.max(n(x)).alias("most")).alias(f"d{i}") for i, x in enumerate(DELIMITERS)]).first()
    score = lambda r: (int(r["least"] is not None and r["least"] == r["most"] and r["least"] > 0), r["least"] or 0)
    return max(DELIMITERS, key=lambda x: score(row[f"d{DELIMITERS.index(x)}"]))


def scan_text_guess(spark: SparkSession, path: str) -> DataFrame:
    """Text file whose delimiter is read off all its lines."""
    return scan_delimited(spark, path, guess_delimiter(spark.read.text(path)))
