import math
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cleanlake.llm import jaccard_join, langid, mixing, sorted_projection
from cleanlake.llm.shingles import chunks, shingle_sets
from llm_brute import FOLD, brute_classes, brute_targets, shingles

def same(df, rows):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in jaccard_join.classes(df).collect())
    assert got == brute_classes(rows)


def test_jaccard_odd_rows(odd_docs, empty_docs):
    same(odd_docs, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert jaccard_join.classes(empty_docs).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_against_all_pairs(spark, seed):
    """Families of edited copies around the threshold, of all sizes, with a passage that most texts share."""
    rng, rows = random.Random(seed), []
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    shared = [word() for _ in range(12)]
    for n in [4, 5, 8, 9, 10, 12, 14, 20, 25, 30, 40, 60, 90, 140, 220]:
        base = [word() for _ in range(n)]
        for _ in range(10):
            w = list(base)
            for _ in range(rng.randrange(0, 2 + n // 20)):
                i = rng.randrange(len(w))
                w[i:i + rng.randrange(2)] = [word()] * rng.randrange(2)
            rows.append((len(rows), " ".join(w + (shared if rng.random() < 0.6 else []))))
    same(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_jaccard_stage_at_five_words(spark):
    """The pipeline's stage finds what all pairs at five words and 0.8 give: sets of 3 to 7 shingles, and copies with a fifth of text appended."""
    from cleanlake.llm import stages
    rng, rows = random.Random(9), []
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    for n in range(3, 8):
        for less, more in ((0, 1), (1, 0), (1, 1), (0, 2)):
            base = [word() for _ in range(n + 4)]
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[less:] + [word() for _ in range(more)]))]
    for n in (20, 50, 120, 300):
        for share in (0.15, 0.18, 0.22, 0.25, 0.3):
            base = [word() for _ in range(n + 4)]
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + [word() for _ in range(int(n * share))]))]
    parts, sets = {i: i for i, _ in rows}, {i: shingles(t, 5) for i, t in rows}
    for i in range(1, len(rows), 2):
        both = len(sets[i] & sets[i - 1])
        if 100 * both >= 80 * (len(sets[i]) + len(sets[i - 1]) - both):
            parts[i] = i - 1
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {(4, 5), (5, 6)} <= {tuple(sorted((len(sets[i]), len(sets[i - 1])))) for i in parts if parts[i] != i}
    got = {r.doc_id: r.component_id for r in jaccard_join.classes(df, words=5, percent=80).collect()}
    assert got == parts
    assert sorted(r.doc_id for r in stages.drop_near_copies(spark, df, "").collect()) == sorted(i for i in parts if parts[i] == i)


def test_jaccard_hot_signatures_are_dealt(spark, monkeypatch):
    """The same classes when every signature of more than two sets is dealt over several tasks."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(9999)}" for _ in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(200)] = f"v{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "RUN", 2)
    same(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_jaccard_keeps_only_sets_that_may_find_each_other(spark):
    """Of a signature's sets only askers with a set of fitting size before them, and sets that an asker may find, are kept, with the number each would find."""
    import pyarrow as pa
    rng = random.Random(2)
    rows = sorted({(rng.randrange(40), rng.choice([50, 60, 61, 75, 100, 101]), rng.randrange(300), rng.choice([jaccard_join.OWN, jaccard_join.UPPER])) for _ in range(200)})
    rows = [r for i, r in enumerate(rows) if not i or r[:3] != rows[i - 1][:3]]
    columns = list(zip(*[(s, k, n * 4 + kind) for s, n, k, kind in rows]))
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["sig", "key", "meta"])
    want = {}
    for s, n, k, kind in rows:
        finds = [(s, x[2]) for x in rows if x[0] == s and x[1:3] < (n, k) and 100 * x[1] >= 80 * n]
        if kind != jaccard_join.UPPER and finds:
            want[s, k] = len(finds)
            for x in finds:
                want.setdefault(x, 0)
    got = [(r["sig"], r["key"], r["cost"], r["freq"]) for t in jaccard_join._shared(80)(iter([batch])) for r in t.to_pylist()]
    assert {(s, k): n for s, k, n, _ in got} == want and len(got) == len(want) < len(rows)
    assert all(f == sum(x[0] == s for x in got) for s, _, _, f in got)


def test_mixing_stage_packs_copies_by_block(spark, tmp_path, monkeypatch):
    """The stage brings one packed row per block of a file to the texts, not one per document, and takes what the operator says."""
    from collections import Counter

    from cleanlake.llm import common, stages
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(30)), "en", rng.choice("ab") + ":c", i, "x") for i in range(700)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __file string").repartition(3).write.parquet(f"{tmp_path}/a b:c")
    docs = spark.read.parquet(f"{tmp_path}/a b:c")
    monkeypatch.setattr(common, "BLOCK", 100)
    sizes, limited = [], common.checked_broadcast
    monkeypatch.setattr(common, "checked_broadcast", lambda df, *a: sizes.append(df.count()) or limited(df, *a))
    want = {r.doc_id: r.copies for r in mixing.copies(common.located(docs, "at_"), id_col="at_").join(common.located(docs, "at_").select(F.col("at_").alias("doc_id"), F.col("doc_id").alias("id")), "doc_id")
            .select(F.col("id").alias("doc_id"), "copies").collect()}
    for packed in (True, False):
        if not packed:
            monkeypatch.setattr(common, "checked_broadcast", lambda df, *a: df)
        out = stages.mix_sources(spark, docs, "")
        assert out.columns == docs.columns
        assert Counter(r.doc_id for r in out.collect()) == {i: n for i, n in want.items() if n}
    assert set(want.values()) >= {0, 1} and 7 <= sizes[-1] <= 10


def test_forest_connects_what_the_edges_connect():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n, m = int(rng.integers(2, 30)), int(rng.integers(0, 80))
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        w = rng.random(m).round(1)
        keep = jaccard_join._forest(u, v, w, n)
        parts = lambda e: len({frozenset(x) for x in _parts(n, e)})
        assert parts(list(zip(u, v))) == parts(list(zip(u[keep], v[keep]))) == n - len(keep)


def _parts(n, edges):
    part = {i: {i} for i in range(n)}
    for a, b in edges:
        if part[a] is not part[b]:
            part[a] |= part[b]
            for x in part[b]:
                part[x] = part[a]
    return part.values()


def test_shingle_sets_of_chunks():
    texts = ["", "a", "a b", "A b c", "a b c d", "a b c d a b c d", " \t\n", "é É x y z é É x y"]
    values, counts = shingle_sets([t.encode() for t in texts], 4)
    assert counts.tolist() == [len(shingles(t)) for t in texts] and len(values) == counts.sum()
    alone = [shingle_sets([t.encode()], 4)[0].tolist() for t in texts]
    assert [x.tolist() for x in np.split(values, np.cumsum(counts)[:-1])] == alone


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, label string")


def brute_vectors(rows, dim, cosine=0.9):
    def unit(v):
        if v is None or len(v) != dim or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, np.float32).astype(np.float64)
        return a / np.linalg.norm(a)
    u = [unit(v) for _, v in rows]
    link = [[j for j in range(len(rows)) if j != i and u[i] is not None and u[j] is not None and u[i] @ u[j] >= cosine] for i in range(len(rows))]
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in link[todo.pop()] if j not in seen]
            seen |= set(new)
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((d, len(link[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def test_sorted_projection(spark):
    rng, rows = np.random.default_rng(0), []
    for i in range(40):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (base + 0.15 * rng.standard_normal(16)).tolist()))
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [None] + [1.0] * 15), (904, [float("nan")] * 16), (905, [float("inf")] + [1.0] * 15), (906, [1.0] * 3), (0, rows[0][1]), (None, rows[0][1])]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in sorted_projection.near_classes(vectors(spark, rows)).collect()), key=str)
    assert got == brute_vectors(rows, 16)


def test_sorted_projection_counts_inside_large_classes(spark, monkeypatch):
    """A class far wider than the window and cut into many blocks has all its links."""
    monkeypatch.setattr(sorted_projection, "BLOCK", 7)
    rng = np.random.default_rng(2)
    base = rng.standard_normal(8)
    rows = [(i, (base + 0.1 * rng.standard_normal(8)).tolist()) for i in range(120)] + [(500 + i, rng.standard_normal(8).tolist()) for i in range(20)]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in sorted_projection.near_classes(vectors(spark, rows), window=4).collect()), key=str)
    assert got == brute_vectors(rows, 8)


def test_sorted_projection_window_crosses_partitions(spark):
    """The pairs of one pass do not depend on how many partitions hold the order."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(300)]
    out = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted((r.vec_id, r.n_links, r.component_id) for r in sorted_projection.near_classes(vectors(spark, rows), passes=2, window=3).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


def test_sorted_projection_copies_do_not_fill_the_windows(spark, monkeypatch):
    """Many copies of two vectors near each other: one vector each in keys and windows, all links in the counts."""
    monkeypatch.setattr(sorted_projection, "HOT_COPIES", 20)
    rng = np.random.default_rng(6)
    a = rng.standard_normal(8)
    b = a + 0.1 * rng.standard_normal(8)
    rows = [(i, (a if i % 2 else b).tolist()) for i in range(80)] + [(100 + i, (a + 0.12 * rng.standard_normal(8)).tolist()) for i in range(4)]
    rows += [(200, [1.0] + [0.0] * 7), (201, [1.0] + [-0.0] * 7), (300, rng.standard_normal(8).tolist())]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in sorted_projection.near_classes(vectors(spark, rows), passes=2, window=6).collect()), key=str)
    assert got == brute_vectors(rows, 8)


def test_sorted_projection_passes_follow_the_rows():
    """The number of passes grows with the table, and lone pairs at the threshold are found as often as it says."""
    assert [sorted_projection.effort(n)[0] for n in (0, 100, 10 ** 3)] == [12, 12, 12] and sorted_projection.effort(10 ** 7)[0] > sorted_projection.effort(10 ** 6)[0] > 24
    assert sorted_projection.effort(10 ** 9)[1] > sorted_projection.HASHES
    assert recall(20_000, 300, 16) > 0.96


def recall(n, lone, dim, seed=1):
    """Share of `lone` pairs at cosine 0.9 among n vectors that meet in a window of the passes."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.standard_normal((lone, dim))
    other -= (other * x[:lone]).sum(axis=1, keepdims=True) * x[:lone]
    x[lone: 2 * lone] = 0.9 * x[:lone] + math.sqrt(1 - 0.81) * other / np.linalg.norm(other, axis=1, keepdims=True)
    passes, hashes = sorted_projection.effort(n)
    planes, met = np.random.default_rng(0).standard_normal((passes, hashes, sorted_projection.LEVELS, dim)), np.zeros(lone, bool)
    for p in range(passes):
        place = np.empty(n, np.int64)
        place[np.lexsort(sorted_projection.codes(x, planes[p]).T[::-1])] = np.arange(n)
        met |= np.abs(place[:lone] - place[lone: 2 * lone]) <= sorted_projection.WINDOW
    return met.mean()


def test_sorted_projection_empty(spark):
    assert sorted_projection.near_classes(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    only = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in sorted_projection.near_classes(only).collect()] == [(1, 0, 1, True)]


def check_mix(df):
    rows = [r.asDict() for r in mixing.copies(df).collect()]
    d = pd.DataFrame(rows)
    size = {}
    for r in df.collect():
        size[r.source] = size.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = brute_targets(size)
    assert len(d) == df.count()
    for r in rows:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) <= 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["copies"] <= 3
    for s, t in want.items():
        here = [r for r in rows if r["source"] == s]
        taken = sum(r["copies"] * r["size"] for r in here)
        least = min((r["size"] for r in here if r["size"]), default=0)
        assert abs(taken - t) <= max(least, 0.01 * t), (s, taken, t)
        rates = sum(r["rate"] * r["size"] for r in here)
        assert abs(rates - t) <= 1e-6 * max(1.0, t)
    return sorted((str(r["doc_id"]), r["size"], r["copies"]) for r in rows)


def test_mixing_odd_rows(odd_docs, empty_docs):
    assert check_mix(odd_docs) == check_mix(odd_docs)
    assert mixing.copies(empty_docs).count() == 0


def test_mixing_documents(spark, sf):
    check_mix(spark.read.parquet(f"{sf}/documents.parquet"))


def test_mixing_rates_are_entropic(spark, sf):
    """Inside a source log(rate) is proportional to size below the cap: the dual has one multiplier."""
    d = mixing.copies(spark.read.parquet(f"{sf}/documents.parquet")).where("size > 0 and rate < 2.999999").select("source", (F.log("rate") / F.col("size")).alias("slope"))
    spread = d.groupBy("source").agg((F.max("slope") - F.min("slope")).alias("s")).agg(F.max("s")).first()[0]
    assert spread < 1e-9


def test_mixing_one_source_without_words(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "a"), (3, "x y z", "b"), (4, "q", "b")], "doc_id long, text string, source string")
    check_mix(df)


def test_mix_meets_small_targets(spark):
    """The multiplier of a source whose single words weigh next to nothing beside one long text lies far below the first bracket."""
    rows = [(i, "w", "b") for i in range(400)] + [(400, "w " * 40_000, "b")] + [(1000 + i, "x " * 30, f"a{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = spark.createDataFrame([("b", 1, 400), ("b", 40_000, 1)], "source string, size long, n long")
    goal = spark.createDataFrame([("b", 40_400, 167.05)], "source string, source_size long, target double")
    dual = mixing.tilt(sizes, goal).first()
    rate = lambda size: math.exp(min(math.log(3), dual.lam * size / dual.mean))
    assert abs(400 * rate(1) + 40_000 * rate(40_000) - 167.05) < 0.01
    assert mixing.copies(df).count() == len(rows)


def test_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.01]), (3, [1.0, 2.0, 0.0]), (9, [7.0]), (10, None), (11, [0.0, 0.0])] + [(20 + i, [1.0, 0.0, float(i), 1.0]) for i in range(5)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in sorted_projection.near_classes(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, row string")).collect()}
    assert len(got) == len(rows) and got[1] == (1, 1) and got[2] == (1, 1) and got[3] == (0, 3) and got[9] == (0, 9) and got[10] == (0, 10) and got[11] == (0, 11)
    assert got[24][0] >= 1


def test_workers_hold_little_at_once():
    """Python workers live on from stage to stage: what hashing a batch takes and keeps, and what language ID counts at once, stays small."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**5)}" for _ in range(300)) for _ in range(1200)]
    whole = [shingle_sets([t.encode()], 5)[0].tolist() for t in texts[::100]]
    tracemalloc.start()
    sets = []
    for at, part in chunks(texts):
        values, counts = shingle_sets(part, 5)
        sets += [x.tolist() if (at + i) % 100 == 0 else None for i, x in enumerate(np.split(values, np.cumsum(counts)[:-1]))]
        del values, counts
    most = tracemalloc.get_traced_memory()[1]
    shingle_sets([b"ab c " * 600_000], 5)         # a long text leaves nothing behind
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert sets[::100] == whole
    assert most < 32e6 and kept < 8e6
    texts.append("long text " * 150_000)
    groups = list(langid._pieces(texts))
    assert [r for rows, _ in groups for r in rows] == [*range(1201), 1200]
    assert all(len(parts) == 1 or sum(map(len, parts)) <= 1 << 17 for _, parts in groups)
