"""Token counts of documents in flat token files that have no index, by scanning for the end-of-document identifier.

Files are cut into blocks; a block is searched by one vectorised comparison and gives the places of its separators. What a block
cannot know (how many documents ended before it, and where its first document began) comes from a prefix scan over blocks:
sums and last places are scanned inside groups of GROUP blocks, then over the groups, so no task sees all blocks of a large file.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cleanlake.core import c, scratch_path
from cleanlake.llm.common import arrow_rows, file_system, stored

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""     # fixed: the split that belongs to the rank files
END_OF_DOCUMENT = 50256
WIDTH = "<u2"              # little-endian 16-bit identifiers; "<u4" for larger vocabularies
BLOCK = 4 << 20            # tokens of one block
GROUP = 1024               # blocks of one group of the scan


@functools.lru_cache(1)
def encoder(ranks: str):
    import base64

    import tiktoken
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", *, ranks: str = RANKS, end: int = END_OF_DOCUMENT, width: str = WIDTH) -> DataFrame:
    """Encodes all texts into flat files `tokens-<number>.bin`, each document followed by `end`; returns (file, ordinal, doc_id).

    Each task writes one file under its attempt's number, and only committed attempts are in the result. Null texts are empty.
    """
    def write(batches):
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        number, ordinal, out, enc = TaskContext.get().taskAttemptId(), 0, None, encoder(ranks)
        for batch in batches:
            ids = batch.column("doc_id")
            for text in batch.column("text").to_pylist():
                tokens = enc.encode_ordinary(text or "")
                out = out or fs.open_output_stream(f"{path}/tokens-{number}.bin")
                out.write(np.array([*tokens, end], width).tobytes())
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.array(np.arange(ordinal, ordinal + n), pa.int64()), ids], names=["file", "ordinal", "doc_id"])
            ordinal += n
        if out:
            out.close()

    rows = docs.select(c(id_col).cast("long").alias("doc_id"), c(text_col).cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, 500):
        return stored(rows.mapInArrow(write, "file long, ordinal long, doc_id long"), "token-order")


def blocks(spark: SparkSession, folder: str, width: str = WIDTH, block: int = BLOCK) -> DataFrame:
    """path, block, first (token), tokens of every block of the .bin files of a folder. Only names and lengths are read here.

    A file whose length is not a multiple of the token width stops the job.
    """
    size = np.dtype(width).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    n = (F.col("length") / F.lit(size)).cast("long")
    whole = F.when(F.col("length") % size == 0, n).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(" ends inside a token"))).cast("long"))
    files = files.select("path", whole.alias("n")).where("n > 0")
    return files.select("path", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(block)))).alias("block")).select(
        "path", "block", (F.col("block") * block).alias("first"), F.least(F.lit(block), F.col("n") - F.col("block") * block).cast("long").alias("tokens"))


def search(parts: DataFrame, end: int = END_OF_DOCUMENT, width: str = WIDTH) -> DataFrame:
    """The blocks with `ends`: the places in the file of their separators."""
    size = np.dtype(width).itemsize

    def find(batches):
        for batch in batches:
            for path, block, first, tokens in zip(*(batch.column(x).to_pylist() for x in ("path", "block", "first", "tokens"))):
                fs, name = file_system(path)
                with fs.open_input_file(name) as f:
                    data = np.frombuffer(f.read_at(tokens * size, first * size), width)
                at = np.flatnonzero(data == end) + first
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([tokens], pa.int64()), pa.array([at], pa.list_(pa.int64()))],
                                                 names=["path", "block", "first", "tokens", "ends"])
    return parts.mapInArrow(find, "path string, block long, first long, tokens long, ends array<long>")


def scan(spark: SparkSession, folder: str, *, end: int = END_OF_DOCUMENT, width: str = WIDTH, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """path, ordinal (from 0 in its file), start (token), n_tokens, complete of every document in the .bin files of a folder.

    Neighbouring separators enclose a document of no tokens. Tokens after the last separator of a file are a document that is not
    complete. Empty files and folders without files give no rows.
    """
    parts = blocks(spark, folder, width, block)
    spread = parts.repartition("path", "block")
    found = stored(search(spread, end, width), "token-ends")
    facts = found.select("path", "block", F.floor(F.col("block") / group).alias("group"), F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = before(Window.partitionBy("path", "group").orderBy("block"))
    over = before(Window.partitionBy("path").orderBy("group"))
    sums = facts.groupBy("path", "group").agg(F.sum("n").alias("gn"), F.max("last").alias("glast"))
    sums = sums.select("path", "group", F.coalesce(F.sum("gn").over(over), F.lit(0)).alias("gn"), F.max("glast").over(over).alias("glast"))
    local = facts.select("path", "group", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("bn"), F.max("last").over(inside).alias("blast"))
    carried = local.join(sums, ["path", "group"]).select("path", "block", (F.col("bn") + F.col("gn")).alias("base"), (F.coalesce(F.greatest("blast", "glast"), F.lit(-1)) + 1).alias("carry"))
    docs = found.join(carried, ["path", "block"]).select("path", "base", "carry", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.get("ends", F.col("i") - 1) + 1)
    closed = docs.select("path", (F.col("base") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("complete"))
    files = found.groupBy("path").agg(F.max(F.col("first") + F.col("tokens")).alias("size"), F.sum(F.size("ends")).cast("long").alias("ordinal"), (F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))), F.lit(-1)) + 1).alias("start"))
    rest = files.where("start < size").select("path", "ordinal", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete"))
    return closed.unionByName(rest)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, file, ordinal of every row of docs: written to flat files, then counted from the files alone.

    Null and empty texts have no tokens; rows that repeat an identifier, or have none, are rows of their own. No rows give no rows.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    order = write_tokens(docs, folder, id_col, text_col, ranks=ranks)
    if order.isEmpty():
        return order.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), "file", "ordinal")
    found = scan(spark, folder).where("complete").select(F.regexp_extract("path", r"tokens-(\d+)\.bin$", 1).cast("long").alias("file"), "ordinal", "n_tokens")
    return order.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
