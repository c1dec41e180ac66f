"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A text becomes counts of hashed n-grams: of its words (one and two in a row, A-Z folded) and of their shapes (one to three in a row). A
shape tells which kinds of bytes a word has, its first kind, its last byte, its length class, and whether it repeats the word before it, so
that what is learnt carries over to words never seen. A count c of N n-grams of its kind weighs sqrt(c / N), so long texts weigh no more
than short ones; whole texts count.

Training (`fit`) takes about `sample` labelled rows of each class (by a hash of the identifier; the intercept is put back to the measured
shares of the classes), deals them to shards, and runs per-coordinate updates with L1 and L2 over each shard in Spark tasks. The states of
the shards are mixed per coordinate between rounds; the state has BUCKETS coordinates at most, however large the corpus. Scoring is a sparse
dot product per text, in one pass over the documents without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c
from cleanlake.llm.common import arrow_rows, checked_broadcast, stored
from cleanlake.llm.shingles import mix, word_bounds

BITS = 18
BUCKETS = 1 << BITS            # weights of the model; one more is the intercept
WORDS, SHAPES = 2, 3           # n-grams of words and of shapes, up to so many in a row
SAMPLE = 6_000                 # labelled rows of each class that training takes, in expectation
SHARDS, ROUNDS, EPOCHS = 8, 2, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01
PIECE = 1 << 20                # bytes of text looked at together; n-grams do not cross the pieces of a longer text
#: Kinds of bytes, as bits: capital, small letter, digit, other sign, part of a letter beyond ASCII.
_KIND = np.array([1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 4 if 48 <= b <= 57 else 16 if b >= 128 else 8 for b in range(256)], np.uint8)
_KIND[[32, *range(9, 14)]] = 0


@dataclass(frozen=True)
class Model:
    """Weights of the buckets and the intercept, which is that of the whole labelled table."""
    weights: np.ndarray
    intercept: float


def pieces(texts):
    """Groups of about PIECE bytes: row number of every part, and the parts. A longer text is cut after white space where there is any."""
    rows, parts, held = [], [], 0
    for i, text in enumerate(texts):
        b = (text or "").encode("utf-8", "surrogatepass")
        at = 0
        while True:
            end = len(b)
            if end - at > PIECE:
                end = max(b.rfind(b" ", at, at + PIECE), b.rfind(b"\n", at, at + PIECE)) + 1 or at + PIECE
            if parts and held + end - at > PIECE:
                yield np.array(rows), parts
                rows, parts, held = [], [], 0
            rows.append(i)
            parts.append(b[at:end])
            held += end - at
            at = end
            if at >= len(b):
                break
    if parts:
        yield np.array(rows), parts


def shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shape of every word as a number; `first` marks the words that no word of their text comes before."""
    if not len(start):
        return np.zeros(0, np.uint64)
    kinds = _KIND[data]
    mask = np.bitwise_or.reduceat(kinds, start).astype(np.uint64)
    last = np.where(kinds[end - 1] == 8, data[end - 1], kinds[end - 1]).astype(np.uint64)
    size = np.minimum(np.log2(end - start) * 2, 15).astype(np.uint64)
    again = np.zeros(len(words), np.uint64)
    again[1:] = (words[1:] == words[:-1]) & ~first[1:]
    return mask | kinds[start].astype(np.uint64) << np.uint64(8) | last << np.uint64(16) | size << np.uint64(24) | again << np.uint64(32)


def grams(values: np.ndarray, left: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and buckets of the n-grams; `left` is the number of words that follow a word in its part."""
    at = np.flatnonzero(left >= n - 1)
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for i in range(n):
            h += mix(values[at + i], seed + i)
    return at, (mix(h, seed) >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and weight of every n-gram bucket of every text, by row and bucket."""
    n_texts = len(texts)
    kinds = [(False, n) for n in range(1, WORDS + 1)] + [(True, n) for n in range(1, SHAPES + 1)]
    held = [([], [], []) for _ in kinds]
    for rows, parts in pieces(texts):
        data, start, end, words, counts = word_bounds(parts)
        owner = np.repeat(np.arange(len(parts)), counts)
        last = np.cumsum(counts)
        left = last[owner] - 1 - np.arange(len(words))
        first = np.arange(len(words)) == (last - counts)[owner]
        shape = shapes(data, start, end, words, first)
        for (kind, n), (keys, sizes, _) in zip(kinds, held):
            at, bucket = grams(shape if kind else words, left, n, 100 * kind + 10 * n)
            key, size = np.unique(rows[owner[at]] * BUCKETS + bucket, return_counts=True)
            keys.append(key)
            sizes.append(size)
    all_keys, all_weights = [], []
    for keys, sizes, _ in held:
        key, spot = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_inverse=True)
        size = np.bincount(spot, np.concatenate(sizes) if sizes else None, len(key))
        whole = np.bincount(key // BUCKETS, size, n_texts)
        all_keys.append(key)
        all_weights.append(np.sqrt(size / whole[key // BUCKETS]))
    key, spot = np.unique(np.concatenate(all_keys), return_inverse=True)
    weight = np.bincount(spot, np.concatenate(all_weights), len(key))
    return key // BUCKETS, key % BUCKETS, weight


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a state: zero where the L1 term holds them there."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(z: np.ndarray, n: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray, float]]) -> None:
    """One pass of updates over (buckets, weights, label), in place. The intercept is the last coordinate."""
    for at, x, y in examples:
        zi, ni = z[at], n[at]
        w = weights_of(zi, ni)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35.0, 35.0)))
        g = (p - y) * x
        grown = ni + g * g
        z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
        n[at] = grown


def _featured(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        row, bucket, weight = features(texts)
        cut = np.searchsorted(row, np.arange(len(texts) + 1))
        lists = lambda x, t: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, t))
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("turn"), batch.column("label"), lists(bucket, pa.int32()), lists(weight, pa.float32())],
                                         names=["shard", "turn", "label", "bucket", "weight"])


def _round(z0: np.ndarray, n0: np.ndarray):
    """Runs the examples of every shard from one common state; yields what changed: shard's coordinates and their new state."""
    def run(batches):
        held, shard = [], None

        def state():
            z, n = z0.copy(), n0.copy()
            for _ in range(EPOCHS):
                train(z, n, held)
            at = np.flatnonzero(n > n0)
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(z[at] - z0[at]), pa.array(n[at] - n0[at])], names=["at", "dz", "dn"])

        for batch in batches:
            for s, y, b, x in zip(*(batch.column(k) for k in ("shard", "label", "bucket", "weight"))):
                if shard is not None and s.as_py() != shard:
                    yield state()
                    held = []
                shard = s.as_py()
                held.append((np.append(b.values.to_numpy(), BUCKETS), np.append(x.values.to_numpy().astype(np.float64), 1.0), float(y.as_py())))
        if held:
            yield state()
    return run


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", learn: Column | None = None) -> DataFrame:
    """id, label of the identifiers that training may use: labelled 0 or 1, and alike in all of their rows."""
    rows = labels.where(c(id_col).isNotNull() & c(label_col).isin(0, 1))
    rows = rows.where(learn) if learn is not None else rows
    return (rows.groupBy(c(id_col).alias("id")).agg(F.min(c(label_col)).cast("int").alias("label"), F.max(c(label_col)).cast("int").alias("most"))
            .where("label = most").select("id", "label"))


def fit(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample: int = SAMPLE, shards: int = SHARDS, rounds: int = ROUNDS) -> Model:
    """Model of documents whose identifier is in `known` (id, label).

    Without labelled rows of both classes every score is the share of the one class there is (one half without any). Null texts count as empty.
    """
    spark = docs.sparkSession
    known = stored(known, "quality-known")
    size = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        odds = {0: -35.0, 1: 35.0}.get(next(iter(size), None), 0.0)
        return Model(np.zeros(BUCKETS), odds)
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = {y: min(1.0, sample / n) for y, n in size.items()}
    chosen = known.where(F.when(F.col("label") == 1, draw < share[1]).otherwise(draw < share[0]))
    rows = docs.select(c(id_col).alias("id"), c(text_col).cast("string").alias("text")).join(checked_broadcast(chosen, 4 * sample), "id")
    rows = rows.select(F.pmod(F.xxhash64("id", F.lit(12)), F.lit(shards)).alias("shard"), F.xxhash64("id", F.lit(13)).alias("turn"), F.col("label").cast("double").alias("label"), "text")
    with arrow_rows(spark, 500):
        examples = stored(rows.mapInArrow(_featured, "shard long, turn long, label double, bucket array<int>, weight array<float>"), "quality-examples")
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    dealt = examples.repartition(shards, "shard").sortWithinPartitions("shard", "turn", "label", F.size("bucket"), F.hash("bucket"))
    for _ in range(rounds):
        with arrow_rows(spark, 1000):
            moved = dealt.mapInArrow(_round(z, n), "at long, dz double, dn double").groupBy("at").agg(F.avg("dz").alias("dz"), F.avg("dn").alias("dn")).toArrow()      # BUCKETS + 1 rows at most
        at = moved["at"].to_numpy()
        z[at] += moved["dz"].to_numpy()
        n[at] += moved["dn"].to_numpy()
    w = weights_of(z, n)
    return Model(w[:BUCKETS], float(w[BUCKETS] + np.log(share[0] / share[1])))


def scores(model: Model, texts) -> np.ndarray:
    """Chance of label 1 of every text."""
    row, bucket, weight = features(texts)
    margin = np.bincount(row, weight * model.weights[bucket], len(texts)) + model.intercept
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -35.0, 35.0)))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with one more column: the chance of label 1. Null and empty texts have no n-grams: the intercept alone speaks."""
    schema, names = docs.schema.add(name, "double"), [*docs.columns, name]

    def run(batches):
        for batch in batches:
            found = scores(model, batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=names)
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for the third of the identifiers that training never sees; null identifiers are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs, by a model of the labelled rows that are not held out.

    Rows that repeat an identifier are scored one by one; equal texts have equal scores, whatever else their rows hold. Contradicting labels of
    one identifier teach nothing. No rows give no rows. Other columns are ignored, whatever their names.
    """
    known = labelled(labels, id_col, label_col, ~held_out(c(id_col)))
    model = fit(docs, known, id_col, text_col)
    rows = docs.select(c(id_col).alias("doc_id"), c(text_col).cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, 1000):      # holds for jobs that run here, hence the table
        found = stored(_slim(rows, model), "quality-scores")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def _slim(rows: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(model, batch.column("text").to_pylist()))], names=["doc_id", "score"])
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
