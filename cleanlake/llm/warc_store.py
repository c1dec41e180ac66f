"""Content-addressed WARC archive: payload bytes once per verified digest, exact record headers apart, records rebuilt by joins.

    write_warc   pages -> .warc.gz files, one per task; equal payloads of some size become revisit records
    read_warc    files -> one row per record: exact header bytes, payload
    archive      files -> tables `headers` and `payloads` in a folder
    rebuild      both tables -> the bytes of every record as they were, or the full payload of every record
"""

from __future__ import annotations

import gzip
import hashlib
import io
import urllib.parse
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.core import c, scratch_path
from cleanlake.llm.common import checked_broadcast, file_system, stored

REVISIT_FROM = 1000       # bytes: smaller payloads are always stored as responses
FILE_BYTES = 1 << 30      # a task starts a new file beyond this
CHUNK = 4 << 20           # bytes of payload in one Arrow batch
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
RECORD = "file string, pos long, page_id long, record_type string, refers_to long, sha256 string, header binary, http_header binary, payload binary"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, sha256, record_type, refers_to of every row; a null page has an empty payload.

    Of equal payloads of at least REVISIT_FROM bytes the largest page_id is the response and the others revisit it. Rows that repeat
    that page_id, or null identifiers alone, are all responses. Other columns are ignored.
    """
    html = F.coalesce(c(html_col).cast("string"), F.lit(""))
    rows = pages.select(c(id_col).cast("long").alias("page_id"), c(url_col).cast("string").alias("url"), html.alias("html"))
    keyed = rows.where(F.octet_length("html") >= REVISIT_FROM).select("page_id", F.sha2("html", 256).alias("sha256"))
    repeated = keyed.groupBy("sha256").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
    repeated = checked_broadcast(stored(repeated.select("sha256", "first_id"), "warc-repeated"))
    rows = rows.withColumn("sha256", F.sha2("html", 256)).join(repeated, "sha256", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select("page_id", "url", F.col("html").cast("binary").alias("payload"), "sha256", F.when(again, "revisit").otherwise("response").alias("record_type"),
                       F.when(again, F.col("first_id")).alias("refers_to"))


def _record(page_id, url, payload: bytes, sha256: str, kind: str, refers) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if kind == "revisit" else payload)
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:x-page:%s>" % str(page_id).encode(), b"WARC-Date: " + DATE.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + urllib.parse.quote(url, safe="".join(map(chr, range(33, 127)))).encode())
    head.append(b"WARC-Payload-Digest: sha256:" + sha256.encode())
    if kind == "revisit":
        head += [b"WARC-Refers-To: <urn:x-page:%d>" % refers, b"WARC-Profile: " + PROFILE.encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + END + block + END


def write_warc(rows: DataFrame, folder: str) -> DataFrame:
    """Writes records() as gzipped WARC files and returns the manifest (file, records, bytes).

    A file's name holds the task attempt, and only attempts whose manifest rows were committed count, so a task that runs twice
    leaves no double records.
    """

    def write(batches):
        fs, path = file_system(folder)
        task = TaskContext.get()
        name, number, out, count, size = f"{path}/part-{task.partitionId():05d}-{task.taskAttemptId()}", 0, None, 0, 0
        done = []
        fs.create_dir(path, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out, count, size = fs.open_output_stream(f"{name}-{number}.warc.gz", compression=None), 0, 0
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = z.compress(_record(row["page_id"], row["url"], row["payload"], row["sha256"], row["record_type"], row["refers_to"])) + z.flush()
                out.write(data)
                count, size = count + 1, size + len(data)
                if size > FILE_BYTES:
                    out.close()
                    done.append((f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number}.warc.gz", count, size))
                    out, number = None, number + 1
        if out is not None:
            out.close()
            done.append((f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number}.warc.gz", count, size))
        if done:
            yield pa.RecordBatch.from_pydict({"file": [x[0] for x in done], "records": [x[1] for x in done], "bytes": [x[2] for x in done]})

    return stored(rows.select("page_id", "url", "payload", "sha256", "record_type", "refers_to")
                  .mapInArrow(write, "file string, records long, bytes long"), "warc-manifest")


def read_warc(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the files (RECORD), parsed as a stream; payload is null without `payloads` and for revisits.

    A response whose bytes do not have the digest of its header stops the job.
    """
    schema = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("sha256", pa.string()), ("header", pa.binary()), ("http_header", pa.binary()), ("payload", pa.binary())])

    def parse(batches):
        fs, path = file_system(folder)
        held, size = [], 0
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_stream(f"{path}/{name}", compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) as f:
                    for pos, (fields, header, http, payload) in enumerate(_parsed(f)):
                        digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{name}, record {pos}: payload and digest differ")
                        held.append((name, pos, _page(fields["warc-record-id"]), kind, _page(fields.get("warc-refers-to")), digest, header, http,
                                     payload if payloads and kind == "response" else None))
                        size += len(payload) + 500 if payloads else 500
                        if size > CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held), schema)], schema=schema)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held), schema)], schema=schema)

    parts = max(1, manifest.count())
    return manifest.select("file").repartition(parts, "file").mapInArrow(parse, RECORD)


def _page(urn: str | None) -> int | None:
    name = urn and urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(name) if name and name != "None" else None


def _parsed(f):
    """fields, header bytes, HTTP header bytes and payload of each record of a stream."""
    while line := f.readline():
        lines = [line]
        while lines[-1] not in (b"\r\n", b""):
            lines.append(f.readline())
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8").partition(":") for x in lines[1:-1])}
        block = f.read(int(fields["content-length"]))
        f.read(len(END))
        cut = block.find(END) + len(END)
        yield fields, b"".join(lines), block[:cut], block[cut:]


def archive(manifest: DataFrame, folder: str, store: str) -> tuple[DataFrame, DataFrame]:
    """The tables headers and payloads in `store`: every record's exact headers, and each payload once under its SHA-256.

    Of equal payloads the first record by (file, pos) brings the bytes; the bytes of the others are compared with it, and a
    difference, that is a digest that is not unique, stops the job.
    """
    spark = manifest.sparkSession
    read_warc(manifest, folder, payloads=False).drop("payload").write.parquet(f"{store}/headers")
    headers = spark.read.parquet(f"{store}/headers")
    shared = (headers.where("record_type = 'response'").groupBy("sha256").agg(F.min(F.struct("file", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").select("sha256", "first"))
    rows = read_warc(manifest, folder).where("record_type = 'response'").join(checked_broadcast(shared), "sha256", "left")
    kind = F.when(F.col("first").isNull(), "lone").when(F.col("first") == F.struct("file", "pos"), "first").otherwise("copy")
    rows.select("sha256", "payload", kind.alias("kind")).write.partitionBy("kind").parquet(f"{store}/payloads")
    every = spark.read.schema("sha256 string, payload binary, kind string").parquet(f"{store}/payloads")
    copies = every.where("kind = 'copy'").select("sha256", F.col("payload").alias("other"))
    # A payload that only one record has stays out of the join.
    if not copies.join(every.where("kind = 'first'"), "sha256").where("payload <> other").isEmpty():
        raise ValueError("two payloads share a SHA-256 digest")
    return headers, every.where("kind <> 'copy'").select("sha256", "payload")


def rebuild(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """file, pos, page_id, record (the bytes as archived), payload (the full payload, for revisits too)."""
    rows = headers.join(payloads, "sha256")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat("header", "http_header", body, F.lit(END))
    return rows.select("file", "pos", "page_id", record.alias("record"), "payload")


def page_report(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages as WARC, archives the files by content, and reports every page from the archive by a join on the digest."""
    folder = folder or scratch_path(spark, "warc")
    manifest = write_warc(records(pages), f"{folder}/warc")
    headers, payloads = archive(manifest, f"{folder}/warc", f"{folder}/store")
    facts = payloads.select("sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    return headers.join(facts, "sha256").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
