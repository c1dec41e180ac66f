import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleanlake.core import scratch_path
from cleanlake.llm.common import stored
from cleanlake.llm import exact_dedup, separators, warc_store

FOLD = {ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def test_separator_scan_against_loop(spark, tmp_path):
    rng, want = np.random.default_rng(1), {}
    for name, n in (("a", 1000), ("b", 0), ("c", 37), ("d", 5000)):
        x = rng.integers(0, 12, n).astype("<u2")
        x.tofile(tmp_path / f"{name}.bin")
        start = 0
        for i, v in enumerate(x):
            if v == 7:
                want.setdefault(name, []).append((start, i - start, True))
                start = i + 1
        if start < n:
            want.setdefault(name, []).append((start, n - start, False))
    for block, group in ((16, 3), (1, 2), (4096, 1024)):
        got = {}
        for r in separators.scan(spark, str(tmp_path), end=7, block=block, group=group).collect():
            got.setdefault(r.path.rsplit("/")[-1][0], []).append((r.ordinal, (r.start, r.n_tokens, r.complete)))
        assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == want
        assert all(sorted(o for o, _ in v) == list(range(len(v))) for v in got.values())


def test_separator_scan_stops_at_half_a_token(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"\1\2\3")
    with pytest.raises(Exception, match="inside a token"):
        separators.scan(spark, str(tmp_path)).collect()


def test_token_counts(odd_docs, empty_docs):
    enc = separators.encoder(separators.RANKS)
    got = sorted((r.doc_id or 0, r.n_tokens) for r in separators.token_counts(odd_docs).collect())
    assert got == sorted((r.doc_id or 0, len(enc.encode_ordinary(r.text or ""))) for r in odd_docs.collect())
    assert separators.token_counts(empty_docs).count() == 0


def pages(spark):
    big, small = "<html>" + "é" * 600, "<p>small</p>"
    rows = [(1, "http://a/1", big), (2, "http://a/ 2\r\nX: y", big), (3, None, big), (4, "http://b", small), (5, "http://b", small), (6, "u", None), (7, "u", ""),
            (None, "n", big), (3, "http://again", big), (8, "v", "x" * 999), (9, "v", "x" * 999), (10, "w", "y" * 1000), (11, "w", "y" * 1000), (12, "z", "q" * 300_000)]
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, sha256 string, payload int")


def test_warc_report_and_round_trip(spark):
    df = pages(spark)
    report = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_store.page_report(spark, df).collect())
    want = []
    for r in df.collect():
        b = (r.html or "").encode()
        top = max((x.page_id or 0) for x in df.collect() if x.html == r.html) if len(b) >= 1000 else r.page_id
        want.append((r.page_id or 0, len(b), hashlib.sha1(b).hexdigest(), "response" if r.page_id == top else "revisit", None if r.page_id == top else top))
    assert report == sorted(want, key=lambda x: x[:4])
    folder = scratch_path(spark, "warc-test")
    manifest = warc_store.write_warc(warc_store.records(df), folder)
    assert manifest.agg(F.sum("records")).first()[0] == df.count()
    headers, payloads = warc_store.archive(manifest, folder, folder + "-store")
    assert payloads.count() == payloads.select("sha256").distinct().count()
    raw = {(r.file, r.pos): bytes(r.header) + bytes(r.http_header) + bytes(r.payload or b"") + b"\r\n\r\n" for r in warc_store.read_warc(manifest, folder).collect()}
    back = {(r.file, r.pos): (bytes(r.record), bytes(r.payload), r.page_id) for r in warc_store.rebuild(headers, payloads).collect()}
    assert {k: v[0] for k, v in back.items()} == raw
    assert sorted((v[2] or 0, v[1]) for v in back.values()) == sorted((r.page_id or 0, (r.html or "").encode()) for r in df.collect())
    for r in headers.collect():
        assert bytes(r.header).endswith(b"\r\n\r\n") and b"\r\nX:" not in bytes(r.header)


def test_warc_bad_bytes_stop(spark, tmp_path):
    manifest = warc_store.write_warc(warc_store.records(pages(spark)).withColumn("sha256", F.lit("0" * 64)), str(tmp_path))
    with pytest.raises(Exception, match="payload and digest differ"):
        warc_store.read_warc(manifest, str(tmp_path)).collect()


def test_warc_lone_payloads_stay_out_of_the_comparison(spark, monkeypatch):
    """Only payloads that several records bring are compared; of those a difference under one digest stops the job."""
    folder = scratch_path(spark, "warc-test")
    manifest = warc_store.write_warc(warc_store.records(pages(spark)), folder)
    _, payloads = warc_store.archive(manifest, folder, folder + "-store")
    kinds = {r.kind: r.n for r in spark.read.parquet(folder + "-store/payloads").groupBy("kind").agg(F.count("payload").alias("n")).collect()}
    assert kinds == {"lone": 2, "first": 4, "copy": 4} and payloads.count() == 6
    real = warc_store.read_warc
    monkeypatch.setattr(warc_store, "read_warc", lambda *a, **b: real(*a, **b).withColumn("payload", F.when((F.col("page_id") == 4), F.lit(b"other")).otherwise(F.col("payload"))))
    with pytest.raises(ValueError, match="share a SHA-256"):
        warc_store.archive(manifest, folder, folder + "-store2")


def test_warc_empty(spark):
    assert warc_store.page_report(spark, pages(spark).where("false")).count() == 0


def brute_groups(rows):
    norm = [(r.text or "").translate(FOLD) for r in rows]
    keep = {}
    for r, t in zip(rows, norm):
        keep[t] = max(keep.get(t, (-1, 0)), (r.doc_id if r.doc_id is not None else -1, 0))
    return sorted((r.doc_id if r.doc_id is not None else -1, None if keep[t][0] < 0 else keep[t][0], norm.count(t), hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, norm))


def test_stream_dedup(odd_docs, empty_docs):
    got = exact_dedup.dedup(odd_docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_groups(odd_docs.collect())
    for key in {r.text_sha256 for r in got}:
        assert sum(r.kept for r in got if r.text_sha256 == key) == 1
    assert exact_dedup.dedup(empty_docs).count() == 0


def test_stream_dedup_tells_colliding_digests_apart(odd_docs):
    weak = lambda text: F.concat(F.substring(F.sha2(text, 256), 1, 0), F.lit("same"))
    got = exact_dedup.dedup(odd_docs, digest=weak).collect()
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size) for r in got) == [x[:3] for x in brute_groups(odd_docs.collect())]


def test_stream_goes_on_from_its_checkpoint(spark, odd_docs):
    """A second run on the same state sees the first one's rows as well."""
    base = exact_dedup.content(odd_docs, "doc_id", "text")
    rows = base.select("id", "at", F.sha2("text", 256).alias("digest"))
    landed, state = scratch_path(spark, "landed"), scratch_path(spark, "state")
    session = spark.newSession()
    for k, v in exact_dedup.STREAM_CONF.items():
        session.conf.set(k, v)
    rows.write.parquet(landed)
    exact_dedup.consume(landed, rows.schema, state, session)
    rows.write.mode("append").parquet(landed)
    exact_dedup.consume(landed, rows.schema, state, session, max_files=1)
    once = {r.digest: r["count"] for r in rows.groupBy("digest").count().collect()}
    assert {r.digest: r.n for r in exact_dedup.read_state(spark, state).collect()} == {k: 2 * v for k, v in once.items()}


def test_dedup_runs_again_on_its_checkpoint(spark, odd_docs):
    """The second run counts the first one's rows, compares bytes with texts that only the first one had, and tells colliding digests apart."""
    rows = [(1, "Same text"), (2, "other"), (5, "alone")]
    more = [(3, "same TEXT"), (4, "same text"), (0, "other"), (6, "fresh")]
    first, second = (stored(spark.createDataFrame(r, "doc_id long, text string"), "two-runs") for r in (rows, more))
    state = scratch_path(spark, "state")
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup(first, checkpoint=state).collect()} == {1: (1, 1), 2: (2, 1), 5: (5, 1)}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(second, checkpoint=state).collect()}
    assert got == {3: (4, 3, False), 4: (4, 3, True), 0: (2, 2, False), 6: (6, 1, True)}


def test_stream_dedup_plan_is_native(odd_docs):
    import re
    plan = exact_dedup.dedup(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
