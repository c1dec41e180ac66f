import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleanlake.llm import burst_trie, orchard, quality_ftrl
from cleanlake.llm.queries import QUERIES


# ---- op11 -------------------------------------------------------------------------------------------------------------------

def plain_features(text):
    """The buckets of one text by loops over its words."""
    words, out = [], collections.defaultdict(float)
    data, start, end, hashed, _ = quality_ftrl.word_bounds([(text or "").encode()])
    first = np.arange(len(hashed)) == 0
    shape = quality_ftrl.shapes(data, start, end, hashed, first)
    for kind, values, most in ((False, hashed, quality_ftrl.WORDS), (True, shape, quality_ftrl.SHAPES)):
        for n in range(1, most + 1):
            counts = collections.Counter()
            for i in range(len(values) - n + 1):
                _, b = quality_ftrl.grams(values[i:i + n], np.array([n - 1]), n, (100 if kind else 0) + 10 * n)
                counts[int(b[0])] += 1
            for b, k in counts.items():
                out[b] += (k / sum(counts.values())) ** 0.5
    return dict(out)


def test_features_equal_loops_over_words():
    texts = ["", None, "one", "One two, two TWO!! 12", "a b c d e " * 30, "Ünïcode straße 漢字 | $$$ x"]
    row, bucket, weight = quality_ftrl.features(texts)
    for i, t in enumerate(texts):
        got = dict(zip(bucket[row == i].tolist(), weight[row == i].tolist()))
        want = plain_features(t)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_long_texts_are_read_to_their_end(monkeypatch):
    monkeypatch.setattr(quality_ftrl, "PIECE", 64)
    text = " ".join(f"w{i}" for i in range(100))
    parts = [p for _, ps in quality_ftrl.pieces([text, "", "x" * 300]) for p in ps]
    assert b"".join(parts).decode() == text + "x" * 300 and all(len(p) <= 64 for p in parts)
    row, bucket, _ = quality_ftrl.features([text])
    assert len(bucket) > 150


def test_updates_equal_the_textbook_recursion():
    rng = np.random.default_rng(1)
    size = 12
    examples = [(np.sort(rng.choice(size, 4, replace=False)), rng.random(4), float(rng.integers(2))) for _ in range(60)]
    z, n = np.zeros(size), np.zeros(size)
    quality_ftrl.train(z, n, examples)
    zs, ns = [0.0] * size, [0.0] * size
    for at, x, y in examples:
        w = {}
        for i in at:
            w[i] = 0.0 if abs(zs[i]) <= quality_ftrl.L1 else -(zs[i] - (1 if zs[i] > 0 else -1) * quality_ftrl.L1) / ((quality_ftrl.BETA + ns[i] ** 0.5) / quality_ftrl.ALPHA + quality_ftrl.L2)
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(at, x))))
        for i, v in zip(at, x):
            g = (p - y) * v
            zs[i] += g - ((ns[i] + g * g) ** 0.5 - ns[i] ** 0.5) / quality_ftrl.ALPHA * w[i]
            ns[i] += g * g
    assert np.allclose(z, zs) and np.allclose(n, ns)


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op11_quality_ftrl"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and list(got.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    both = got.merge(labels, on="doc_id")
    both = both[both.held_out]
    right = both.predicted == both.quality
    assert len(both) > 50 and all(right[both.quality == y].mean() > 0.95 for y in (0, 1))


def test_quality_ignores_what_is_not_text(spark, odd_docs, empty_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (8, 0), (8, 1), (10, 0), (None, 1), (11, 7), (4, None)], "doc_id long, quality int")
    labels = labels.withColumn("label", F.lit("x")).withColumn("text", F.lit("y"))
    got = quality_ftrl.judge(odd_docs, labels).collect()
    assert len(got) == odd_docs.count()
    other = odd_docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")).withColumn("score", F.lit("clash"))
    assert sorted(map(str, got)) == sorted(map(str, quality_ftrl.judge(other.repartition(3), labels).collect()))
    score = {r.doc_id: r.score for r in got}
    assert score[3] == score[4] and score[1] == score[None]
    assert quality_ftrl.judge(empty_docs, labels).count() == 0
    none = quality_ftrl.judge(odd_docs, labels.limit(0))
    assert {(r.score, r.predicted) for r in none.collect()} == {(0.5, 1)}
    ones = quality_ftrl.judge(odd_docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert min(r.score for r in ones.collect()) > 0.99


def test_labels_that_are_held_out_teach_nothing(spark, odd_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(quality_ftrl.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(str, quality_ftrl.judge(odd_docs, labels).collect())) == sorted(map(str, quality_ftrl.judge(odd_docs, flipped).collect()))


# ---- op12 -------------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("k,dims,n,scale", [(200, 4, 2000, 30), (1, 3, 10, 5), (2, 2, 50, 2), (60, 8, 1000, 100), (300, 2, 2000, 3)])
def test_search_equals_all_distances(k, dims, n, scale):
    rng = np.random.default_rng(k)
    centers, v = rng.integers(-scale, scale, (k, dims)), rng.integers(-scale, scale, (n, dims))
    want = ((v[:, None] - centers[None]) ** 2).sum(-1)
    for start in (None, rng.integers(0, k, n)):
        near, best, looked = orchard.search(orchard.Lists.of(centers), v, start)
        assert (near == want.argmin(1)).all() and (best == want.min(1)).all()
        assert looked <= n * k and (k < 100 or looked < n * k / 3)


def lloyd(rows, k, rounds, dims, scale):
    """vec_id -> cluster, distance; centroids: by plain loops on whole numbers."""
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centers = [v for _, v in sorted((r for r in kept if r[0] is not None), key=key)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((dist(v, c), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centers = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(centers)]
    return [(i, *nearest(v)[::-1]) for i, v in kept], centers


@pytest.mark.parametrize("k", [3, 25])
def test_clusters_equal_loops(spark, k):
    rng = random.Random(k)
    rows = [(i, [rng.choice([-2.5, -1.0, -0.3, 0.0, 0.2, 1.5, 3.0]) + rng.random() * (i % 3) for _ in range(4)]) for i in range(150)]
    rows += [(None, [0.5] * 4), (7, rows[8][1]), (7, rows[8][1]), (500, None), (501, [1.0, None, 2.0, 3.0]), (502, [float("nan")] * 4), (503, [float("inf")] * 4),
             (504, [1.0]), (505, []), (506, [1e30, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "vec_id long, embedding array<double>, cluster string, distance int, v double")
    got = orchard.cluster(df.repartition(5), k=k, rounds=4, dims=4, scale=8).collect()
    want, centers = lloyd([r for r in rows if r[0] != 506], k, 4, 4, 8)
    assert collections.Counter((r.vec_id, r.cluster, r.distance) for r in got) == collections.Counter(want)
    assert {r.inertia for r in got} == {sum(w[2] for w in want)}
    for r in got:
        assert r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centers[r.cluster])).encode()).hexdigest()


def test_clusters_of_little(spark):
    few = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.25, -1.0])], "vec_id long, embedding array<float>")
    assert orchard.cluster(few.limit(0), dims=2).count() == 0
    assert orchard.cluster(few.withColumn("vec_id", F.lit(None).cast("long")), dims=2).count() == 0
    got = orchard.cluster(few, dims=2)
    assert {(r.vec_id, r.distance) for r in got.collect()} == {(1, 0), (2, 0)} and got.schema["distance"].dataType.simpleString() == "bigint"


# ---- op13 -------------------------------------------------------------------------------------------------------------------

def plain_trie(rows):
    """Nodes by dictionaries of prefixes."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {k: [x[3:] for x in sorted(v)] for k, v in own.items()}
    full = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 9
        full[conv] = tuple(own.get(conv - int(np.fmod(conv, 5)), [])[:h]) + tuple(own[conv][h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for conv, turns in full.items():
        ends[turns].append(conv)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    out = []
    for p, convs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in members)]
        saved = sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below)
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(children), len(leaves), saved,
                    hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


def found(df, **more):
    return sorted((tuple(r[x] for x in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in burst_trie.prefixes(df, **more).collect()), key=repr)


@pytest.mark.parametrize("container", [1, 7, 100_000])
def test_trie_equals_dictionaries(spark, container):
    rng = random.Random(4)
    rows = []
    for conv in list(range(60)) + [-7, -5, 10**12]:
        for t in range(rng.randint(1, 12)):
            rows.append((conv, t, rng.choice(["user", "assistant"]) if t > 1 else "user", rng.choice(["a", "bé", "漢", "long text " * 3]) if t > 2 else "hi"))
    rows += [(70, None, "user", "first"), (70, 0, None, None), (70, 0, "", ""), (70, 0, "user", "tie"), (70, 0, "user", "tie"), (None, 0, "user", "lost"),
             (71, 5, "u", "ser"), (72, 5, "us", "er"), (73, 0, "user", "x" * 50_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", head string, n int")
    assert found(df.repartition(6), container=container) == plain_trie(rows)


def test_trie_of_copies_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(burst_trie, "ENDS", 5)
    rows = [(conv, t, "user", f"turn {t}") for conv in range(0, 400) for t in range(6)] + [(conv, 0, "user", "own") for conv in range(400, 420)]
    df = spark.createDataFrame(rows, SCHEMA)
    for container in (2, 50):
        assert found(df, container=container) == plain_trie(rows)
    assert burst_trie.prefixes(df.limit(0)).count() == 0


def test_oversized_containers_burst(spark):
    rows = [(conv, t, "user", "same" if t < 3 else f"{conv}-{t}") for conv in range(0, 500, 5) for t in range(6)]
    seqs = burst_trie.distinct(burst_trie.rebuilt(burst_trie.sequences(spark.createDataFrame(rows, SCHEMA))))
    resting, heads = burst_trie.burst(seqs, 40)
    assert len(heads) == 4 and [h.count() for h in heads] == [1, 1, 1, 1]
    sizes = resting.groupBy("head").agg(F.sum(F.size("ids") - F.col("depth") + 1).alias("size"), F.count(F.lit(1)).alias("seqs")).collect()
    assert all(r["size"] <= 40 or r.seqs == 1 for r in sizes) and resting.count() == 100
