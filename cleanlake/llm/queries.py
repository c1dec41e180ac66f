"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.llm import burst_trie, exact_dedup, jaccard_join, langid, lattice, mixing, orchard, quality_ftrl, secret_forest, separators, sorted_projection, surrogates, warc_store
from cleanlake.llm.common import arrow_rows, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn
    return register


@query("op3_warc_store", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
         g AS (SELECT html, max(page_id) AS first_id FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html)
    SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
           CASE WHEN g.first_id <> p.page_id OR (p.page_id IS NULL AND g.first_id IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN g.first_id <> p.page_id OR p.page_id IS NULL THEN g.first_id END AS refers_to
    FROM p LEFT JOIN g ON p.html = g.html""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.page_report(spark, table(spark, sf_dir, "pages"))


@query("op4_entropy_mix")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.copies(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


@query("op8_stream_dedup", """
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
         g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


@query("op10_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(langid.document_evidence(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "lang", F.round("posterior", 6).alias("posterior"), "text_lang", "declared", "grams", "kept")


@query("op6_lattice_topk")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    with arrow_rows(spark, 256):      # holds for jobs that run here, hence the table
        return stored(lattice.report(table(spark, sf_dir, "documents")).withColumnRenamed("row_key", "doc_id"), "pieces-report")


@query("op5_sorted_projection")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_projection.near_classes(table(spark, sf_dir, "embeddings"))


@query("op1_separator_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(table(spark, sf_dir, "documents"))


@query("op2_surrogates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents"))


@query("op7_secret_forest")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(table(spark, sf_dir, "documents"))


@query("op11_quality_ftrl")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ftrl.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _rounds_sql(rounds: int) -> str:
    """The rounds of op12 as chained tables: nearest centroid of every vector (n), then the centroids that follow (c)."""
    nearest = """near{i} AS MATERIALIZED (SELECT vec_id, row, cluster, distance FROM (
          SELECT p.vec_id, p.row, m.cluster, sum((p.x - m.x) * (p.x - m.x)) AS distance
          FROM parts p JOIN c{i} m ON p.j = m.j GROUP BY p.vec_id, p.row, m.cluster)
          QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)"""
    move = """c{j} AS MATERIALIZED (SELECT m.cluster, m.j, coalesce(s.x, m.x) AS x FROM c{i} m LEFT JOIN (
          SELECT n.cluster, p.j, CAST((sum(p.x) - ((sum(p.x) % count(*) + count(*)) % count(*))) // count(*) AS BIGINT) AS x
          FROM near{i} n JOIN parts p ON n.row = p.row GROUP BY n.cluster, p.j) s ON m.cluster = s.cluster AND m.j = s.j)"""
    out = []
    for i in range(rounds):
        out += [nearest.format(i=i), move.format(i=i, j=i + 1)]
    return ",\n".join([*out, nearest.format(i=rounds)])


@query("op12_orchard", f"""
    WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
         parts AS MATERIALIZED (SELECT row, vec_id, unnest(range(64)) AS j, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept),
         first AS (SELECT row, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster FROM kept WHERE vec_id IS NOT NULL ORDER BY sha256('3:' || vec_id) LIMIT 8),
         c0 AS MATERIALIZED (SELECT f.cluster, p.j, p.x FROM first f JOIN parts p ON f.row = p.row),
         {_rounds_sql(10)},
         named AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c10 GROUP BY cluster)
    SELECT n.vec_id, CAST(n.cluster AS INTEGER) AS cluster, CAST(n.distance AS BIGINT) AS distance,
           CAST(sum(n.distance) OVER (PARTITION BY n.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(n.distance) OVER () AS BIGINT) AS inertia, d.centroid_sha256
    FROM near10 n JOIN named d ON n.cluster = d.cluster""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.cluster(table(spark, sf_dir, "embeddings"))


@query("op13_burst_trie", """
    WITH table8 AS MATERIALIZED (SELECT list(list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY x) AS t
                                 FROM range(256) r(x)),
         turns AS MATERIALIZED (SELECT conv_id, md5(octet_length(encode(role)) || ':' || role || text) AS id, octet_length(encode(text)) AS bytes,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(role)) || ':' || role || text)) AS i
                   FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
         own AS MATERIALIZED (SELECT c.conv_id, c.conv_id - c.conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
                   [ascii(x)::BIGINT for x in string_split(c.conv_id::VARCHAR, '')]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
                   FROM (SELECT DISTINCT conv_id FROM turns) c, table8),
         parts AS (SELECT o.conv_id, 0 AS part, t.i, t.id, t.bytes FROM own o JOIN turns t ON t.conv_id = o.base AND t.i <= o.h
                   UNION ALL SELECT o.conv_id, 1, t.i, t.id, t.bytes FROM own o JOIN turns t ON t.conv_id = o.conv_id AND t.i > o.h),
         rows AS MATERIALIZED (SELECT conv_id, count(*) OVER w AS depth, sha256(string_agg(id, ',') OVER w) AS node, bytes FROM parts
                   WINDOW w AS (PARTITION BY conv_id ORDER BY part, i ROWS UNBOUNDED PRECEDING)),
         paths AS MATERIALIZED (SELECT conv_id, depth, node, lag(node, 1, 'root') OVER (PARTITION BY conv_id ORDER BY depth) AS parent, bytes,
                   depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM rows
                   UNION ALL SELECT conv_id, 0, 'root', NULL, 0, conv_id NOT IN (SELECT conv_id FROM rows) FROM own),
         nodes AS MATERIALIZED (SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, count(*) AS n_convs, any_value(bytes) AS bytes,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM paths GROUP BY node),
         children AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
         counted AS MATERIALIZED (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.node = c.parent),
         below AS (SELECT p.node, sum((n.n_convs - 1) * n.bytes) AS saved, count(*) FILTER (n.n_children = 0) AS leaves
                   FROM counted n JOIN paths q ON q.node = n.node AND q.conv_id = n.conv_id JOIN paths p ON p.conv_id = q.conv_id AND p.depth <= q.depth GROUP BY p.node)
    SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children,
           CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM counted n JOIN below b ON n.node = b.node LEFT JOIN nodes u ON n.parent = u.node""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burst_trie.prefixes(table(spark, sf_dir, "conversations"))
