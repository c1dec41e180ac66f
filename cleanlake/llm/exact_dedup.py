"""Exact dedup as a stateful stream: keyed state on disk without expiry, full bytes compared on every hit.

Small rows (digest, stable identifier, content locator) land in a folder and are consumed by Structured Streaming. The state, one
entry per digest, lives in RocksDB and is checkpointed to the shared folder; it holds the largest identifier, where its content is
(file and row) and the number of rows. No watermark, so no entry expires, and a later run on the same checkpoint goes on where the
last one ended. Texts do not enter the state: on a hit the bytes are fetched by locator and compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c, scratch_path
from cleanlake.llm.common import ascii_lower, checked_broadcast, located, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",     # a store is on an executor's disk only while its task runs
}


def content(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the locator (file, row) of every row. A frame that is no plain file scan is first written to the shared folder."""
    rows = located(docs)
    return rows.select(c(id_col).alias("id"), F.coalesce(c(text_col), F.lit("")).alias("text"), F.col("__at").alias("at"))


def consume(landed: str, schema, checkpoint: str, session, max_files: int = 1000) -> None:
    """Adds the landed rows that the checkpoint has not seen to the keyed state, micro-batch by micro-batch."""
    stream = session.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(landed)
    state = stream.groupBy("digest").agg(F.max(F.struct("id", "at")).alias("keep"), F.count(F.lit(1)).alias("n"))
    query = (state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def read_state(spark, checkpoint: str) -> DataFrame:
    """digest, keep (id, at), n of every key, from the newest checkpoint."""
    state = spark.read.format("statestore").load(checkpoint)
    keep, n = state.schema["value"].dataType.names
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.`{keep}`").alias("keep"), F.col(f"value.`{n}`").alias("n"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest=lambda text: F.sha2(text, 256),
          checkpoint: str | None = None, max_files: int = 1000) -> DataFrame:
    """Every row of docs with its group: doc_id, keep_id, group_size, kept, text_sha256 (normalised text).

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest identifier stays; of rows that
    repeat that identifier as well, the last one by locator, so exactly one row per group has kept = true.
    Null and empty texts are one group. A null identifier counts as smaller than any other; keep_id is null only if the whole group
    has null identifiers. No rows give no rows. Other columns are ignored, whatever their names; the result has the names above.
    Two texts that share a digest without being equal are told apart by their bytes: their rows are grouped anew by whole text.
    """
    groups = grouped(content(docs, id_col, text_col), digest, checkpoint, max_files)
    return groups.select(F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
                         (F.col("at") == F.col("keep.at")).alias("kept"), F.col("digest").alias("text_sha256"))


def grouped(base: DataFrame, digest=lambda text: F.sha2(text, 256), checkpoint: str | None = None, max_files: int = 1000) -> DataFrame:
    """id, at, digest, keep (id, at of the row that stays), n of every row of base (id, text, at), by way of the keyed state."""
    spark = base.sparkSession
    keyed = base.select("id", "at", digest(ascii_lower(F.col("text"))).alias("digest"))
    rows = stored(keyed, "dedup-rows")
    # The stream reads one folder as long as its checkpoint lives: a later run adds its rows to it.
    landed = f"{checkpoint.rstrip('/')}-landed" if checkpoint else scratch_path(spark, "dedup-landed")
    rows.write.mode("append").parquet(landed)
    session = spark.newSession()
    for k, v in STREAM_CONF.items():
        session.conf.set(k, v)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    checkpoint = checkpoint or scratch_path(spark, "dedup-state")
    consume(landed, keyed.schema, checkpoint, session, max_files)
    state = stored(read_state(spark, checkpoint), "dedup-groups")
    wrong = _unequal(base, rows, state, digest)
    plain = rows.join(state, "digest").select("id", "at", "digest", "keep", "n")
    if not wrong.isEmpty():
        plain = plain.join(checked_broadcast(wrong), "digest", "left_anti").unionByName(_by_text(base, wrong, digest))
    return plain


def _unequal(base: DataFrame, rows: DataFrame, state: DataFrame, digest) -> DataFrame:
    """Digests of these rows under which some row's bytes differ from the bytes at the kept locator, which may lie in the files of an earlier run."""
    hits = checked_broadcast(state.where("n > 1").select("digest", F.col("keep.at").alias("keep_at")))
    text = ascii_lower(F.col("text"))
    member = base.withColumn("digest", digest(text)).join(hits, "digest").select("digest", text.alias("text"), (F.col("at") == F.col("keep_at")).alias("is_kept"))
    member = stored(member, "dedup-hits")
    held = member.where("is_kept").select("digest", F.col("text").alias("held"))
    earlier = hits.join(rows.select("digest").distinct(), "digest", "left_semi").join(held.select("digest"), "digest", "left_anti")
    files = [r["file"] for r in earlier.select(F.regexp_replace("keep_at", r":[0-9]+$", "").alias("file")).distinct().collect()]      # one row per file
    if files:
        held = held.unionByName(_fetched(base.sparkSession, files).join(earlier, F.col("at") == F.col("keep_at")).select("digest", text.alias("held")))
    # Written before it is made distinct: a grouping by the same key would keep Spark from splitting a large group's join.
    differ = stored(member.where("not is_kept").join(held, "digest").where("text <> held").select("digest"), "dedup-differ")
    return differ.distinct()


def _fetched(spark, files: list[str], text_col: str = "text") -> DataFrame:
    """text, at of all rows of files that earlier runs read or wrote."""
    return spark.read.parquet(*files).select(F.coalesce(c(text_col), F.lit("")).alias("text"), F.concat_ws(":", "_metadata.file_path", "_metadata.row_index").alias("at"))


def _by_text(base: DataFrame, wrong: DataFrame, digest) -> DataFrame:
    """The rows of colliding digests, grouped by their whole text."""
    text = ascii_lower(F.col("text"))
    rows = base.select("id", "at", text.alias("text"), digest(text).alias("digest")).join(wrong, "digest", "left_semi")
    groups = rows.groupBy("digest", "text").agg(F.max(F.struct("id", "at")).alias("keep"), F.count(F.lit(1)).alias("n"))
    return rows.join(groups, ["digest", "text"]).select("id", "at", "digest", "keep", "n")
