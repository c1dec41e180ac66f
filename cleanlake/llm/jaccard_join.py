"""N-gram Jaccard join by the pigeonhole over a partitioned universe.

Two sets with 100 * |x & y| >= percent * |x | y| differ in at most H = (|x| + |y|) * (100 - percent) // (100 + percent) elements.
The universe is cut into m segments by a hash, m fixed per size band, so both sets of a pair are cut alike:

* every set is indexed under each of its segments (a signature is the hash of the segment's subset), in its own size band and, if a
  larger partner may be there, in the next band;
* the first segment is indexed with its one-deletion neighbourhood as well;
* the larger set of a pair probes. If it looks up c segments exactly, and one of them with the neighbourhood, and these cover H + 1
  differences, a partner must show up. The allocation takes the cheapest look-ups by the measured number of sets that each would find; a
  signature without any set of a fitting size costs nothing, so most sets need no look-up at all, and common passages are looked up last;
* what shows up is thinned by sizes and by parity sketches (their Hamming distance never exceeds the number of differences, so no
  pair is lost) and verified on the shingles of both whole texts.

Equal sets are one node from the start. Signatures that many sets share are dealt over several tasks.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c
from cleanlake.llm.common import arrow_rows, checked_broadcast, discard, sorted_runs, stored, tidy
from cleanlake.llm.shingles import chunks, mix, shingle_sets
from cleanlake.operators.fuzzy import components

WORDS, PERCENT = 4, 85
GROWTH = 1.5          # of the upper size from band to band
SKETCH = 8            # 64-bit words of the parity sketch, at least; four bits per difference that a matching pair may have
HELD = 50_000         # index rows that a task holds at once, or those of one signature or set
RUN = 20_000          # rows of a signature that one task compares; more are dealt over several
OWN, FIRST, NEAR, UPPER = range(4)      # kinds of index rows: own segment, the first one, its neighbourhood, a segment of the next band


@functools.lru_cache(8)
def _bands(percent: int) -> np.ndarray:
    """Upper sizes of the bands. The first ends where two sets of at most that size match only when they are equal: (n - 1) / n is below percent."""
    out = [99 // max(1, 100 - percent)]
    while out[-1] < 1 << 40:
        out.append(int(out[-1] * GROWTH) + 1)
    return np.array(out)


def differences(size, percent: int):
    """Largest symmetric difference of a matching pair whose sizes add up to `size`."""
    return size * (100 - percent) // (100 + percent)


def segments(band: int, percent: int) -> int:
    return int(differences(2 * _bands(percent)[band], percent)) + 1


def _segmented(tokens: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature of every segment, and of the first segment without each of its tokens."""
    m = segments(band, percent)
    place = (mix(tokens, 11) % np.uint64(m)).astype(np.int64)
    value = mix(tokens, 12)
    with np.errstate(over="ignore"):
        order = np.argsort(place, kind="stable")
        run = np.concatenate([np.zeros(1, np.uint64), value[order].cumsum()])
        cut = np.searchsorted(place[order], np.arange(m + 1))
        sums = run[cut[1:]] - run[cut[:-1]]
        tag = np.uint64(band << 40) + np.arange(m, dtype=np.uint64)
        full = mix(sums ^ mix(tag, 13), 14)
        near = mix((sums[0] - value[place == 0]) ^ mix(tag[:1], 13), 14)
    return full.view(np.int64), near.view(np.int64)


@functools.lru_cache(256)
def sketch_words(band: int, percent: int) -> int:
    """64-bit words of the sketches of a band, a power of two. Sets that have nothing in common differ in nearly half of the bits, about twice as many as a
    matching pair may, at every size; a fixed number of bits would fill up."""
    need = -(-4 * segments(band, percent) // 64)
    return max(SKETCH, 1 << (need - 1).bit_length())


def _sketch(tokens: np.ndarray, words: int) -> bytes:
    """Parity of the number of tokens on each of the bits."""
    bit = np.bincount((mix(tokens, 15) % np.uint64(words * 64)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(bit.astype(np.uint8)).tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one length, the shortest there is: a longer one is the sum of its halves modulo two, which counts the same parities on fewer bits."""
    sizes = np.array([len(x) for x in sketches])
    least, out = sizes.min(), np.zeros((len(sketches), sizes.min() // 8), np.uint64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        bits = np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), -1)
        while bits.shape[1] * 8 > least:
            half = bits.shape[1] // 2
            bits = bits[:, :half] ^ bits[:, half:]
        out[at] = bits
    return out


NODES = "doc_id long, n long, key long, other long, sketch binary, own array<long>, near array<long>, upper array<long>"


def _nodes(words: int, percent: int):
    def nodes(batches):
        bands, seen = _bands(percent), set()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for at, part in chunks(texts):
                values, counts = shingle_sets(part, words)
                ends = np.cumsum(counts)
                out = []
                for i, n in enumerate(counts.tolist()):
                    tokens = values[ends[i] - n: ends[i]]
                    with np.errstate(over="ignore"):
                        key, other = int(mix(tokens, 16).sum().view(np.int64)) if n else 0, int(mix(tokens, 17).sum().view(np.int64)) if n else 0
                    row = (ids[at + i], n, key, other, None, None, None, None)
                    if n > bands[0] and ids[at + i] is not None and key not in seen:
                        seen.add(key)
                        b = int(np.searchsorted(bands, n))
                        own, near = _segmented(tokens, b, percent)
                        upper = np.concatenate(_segmented(tokens, b + 1, percent)) if 100 * n >= percent * (int(bands[b]) + 1) else own[:0]
                        row = (*row[:4], _sketch(tokens, sketch_words(b, percent)), own, near, upper)
                    elif n and ids[at + i] is not None and key not in seen and 100 * n >= percent * (int(bands[0]) + 1):      # no partner but a larger one
                        seen.add(key)
                        row = (*row[:4], _sketch(tokens, SKETCH), np.zeros(0, np.int64), np.zeros(0, np.int64), np.concatenate(_segmented(tokens, 1, percent)))
                    out.append(row)
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(),) * 4 + (pa.binary(),) + (pa.list_(pa.int64()),) * 3)],
                                                 names=["doc_id", "n", "key", "other", "sketch", "own", "near", "upper"])
    return nodes


def _shared(percent: int):
    """Rows of the signatures under which some set may look up another: sets that may ask (cost above 0) and sets that one of them may find.

    The larger set of a pair asks, of equal sizes the one with the larger key. cost: how many sets it would find, that is those before it
    by (n, key) that are not too small for it; freq: how many rows of the signature are kept."""
    def shared(batches):
        for t in sorted_runs(batches, "sig", HELD):
            sig, key, meta = (t.column(x).to_numpy() for x in ("sig", "key", "meta"))
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])      # sorted by size, key and kind inside a signature
            sig, key, meta = sig[new], key[new], meta[new]
            group = np.cumsum(np.concatenate([[False], sig[1:] != sig[:-1]])) << 32      # a text has less than 2**32 words
            place, least = np.arange(len(sig)), -(-percent * (meta // 4) // 100)
            low = np.searchsorted(group + meta // 4, group + least)
            cost = np.where(meta % 4 != UPPER, place - low, 0)
            asker = np.append(np.minimum.accumulate(np.where(cost > 0, place, len(sig))[::-1])[::-1], len(sig))[1:]      # the next one: it asks for the smallest sets
            keep = (cost > 0) | (np.append(low, len(sig))[asker] <= place)
            group = group[keep] >> 32
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(key[keep]), pa.array(meta[keep]), pa.array(cost[keep]), pa.array(np.bincount(group)[group] if len(group) else group)],
                                             names=["sig", "key", "meta", "cost", "freq"])
    return shared


def _allocated(percent: int):
    """Chooses the look-ups of every set: the cheapest that cover one difference more than a matching pair can have. A look-up that finds nothing is free
    and no row here."""
    def allocate(batches):
        bands = _bands(percent)
        for t in sorted_runs(batches, "key", HELD):
            sig, key, meta, costs, freq = (t.column(x).to_numpy() for x in ("sig", "key", "meta", "cost", "freq"))
            probe = np.zeros(len(sig), bool)
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for a, b in zip(start, np.append(start[1:], len(key))):
                kind, n, cost = meta[a:b] % 4, int(meta[a] // 4), costs[a:b]
                band = int(np.searchsorted(bands, n))
                mine = np.flatnonzero(kind <= FIRST)
                near = np.flatnonzero(kind == NEAR)
                first_free = not (kind[mine] == FIRST).any()
                need = int(differences(2 * n, percent)) + 1 - (segments(band, percent) - len(mine)) - (first_free and not len(near))
                if need <= 0:
                    continue
                order = mine[np.argsort(cost[mine], kind="stable")]
                chosen = []
                for i in order:
                    if need <= 0:
                        break
                    chosen.append(i)
                    need -= 1 + (kind[i] == FIRST and not len(near))
                if len(near) and (first_free or any(kind[i] == FIRST for i in chosen)) and need <= 0 and len(chosen) > 1:
                    last = chosen[-1] if kind[chosen[-1]] != FIRST else chosen[-2]
                    if cost[near].sum() < cost[last]:
                        chosen = [i for i in chosen if i != last] + list(near)
                elif need > 0:
                    chosen += list(near)
                probe[a + np.array(chosen)] = True
            yield pa.RecordBatch.from_arrays([pa.array(sig[probe]), pa.array(key[probe]), pa.array(meta[probe] // 4), pa.array(freq[probe])], names=["sig", "key", "n", "freq"])
    return allocate


def _forest(u: np.ndarray, v: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Places of the edges of a spanning forest of the lightest edges (every part takes its lightest way out, until none is left)."""
    order = np.argsort(weight, kind="stable")
    part, kept = np.arange(size), []
    while len(order):
        a, b = part[u[order]], part[v[order]]
        order, a, b = order[a != b], a[a != b], b[a != b]
        if not len(order):
            break
        first = np.full(size, len(order))
        np.minimum.at(first, a, np.arange(len(order)))
        np.minimum.at(first, b, np.arange(len(order)))
        take = np.unique(first[first < len(order)])
        kept.append(order[take])
        a, b = a[take], b[take]
        while True:                                     # the parts of the chosen edges get their smallest number
            low = np.minimum(part[a], part[b])
            if (part[a] == low).all() and (part[b] == low).all():
                break
            for x in (a, b):
                np.minimum.at(part, part[x], low)
            while (part[part] != part).any():
                part = part[part]
    return np.concatenate(kept) if kept else order


def _candidates(percent: int, forest: bool):
    """Pairs (left < right) of a looking-up set and an indexed set under one signature that sizes and sketches do not rule out and
    that are not yet in one class. With `forest`, only those that connect them, the most alike first."""
    def pairs(batches):
        for t in sorted_runs(batches, "run", HELD // 5):
            run, key, n, probe, part = (t.column(x).to_numpy() for x in ("run", "key", "n", "probe", "part"))
            sketches = t.column("sketch").to_pylist()
            start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            found = []
            for a, b in zip(start, np.append(start[1:], len(run))):
                ask, have = a + np.flatnonzero(probe[a:b]), a + np.flatnonzero(~probe[a:b])
                names, spot = np.unique(part[a:b], return_inverse=True)
                bits, edges = _folded(sketches[a:b]), []
                for i in range(0, len(ask), 256):
                    x = ask[i: i + 256]
                    for j in range(0, len(have), 1024):
                        y = have[j: j + 1024]
                        fits = (n[y][None, :] <= n[x][:, None]) & (100 * n[y][None, :] >= percent * n[x][:, None]) & (part[x][:, None] != part[y][None, :])
                        u, v = np.nonzero(fits)
                        apart = np.concatenate([np.bitwise_count(bits[x[u[k: k + 4096]] - a] ^ bits[y[v[k: k + 4096]] - a]).sum(axis=1, dtype=np.int64)
                                                for k in range(0, max(1, len(u)), 4096)])
                        both = n[x[u]] + n[y[v]]
                        ok = apart <= differences(both, percent)
                        edges.append((x[u[ok]], y[v[ok]], apart[ok] / both[ok]))
                    if forest and sum(len(e[0]) for e in edges) > 1_000_000:
                        edges = [_thinned(edges, spot, a, len(names))]
                if edges:
                    u, v, _ = _thinned(edges, spot, a, len(names)) if forest else [np.concatenate(e) for e in zip(*edges)]
                    found.append(np.stack([np.minimum(key[u], key[v]), np.maximum(key[u], key[v]), run[u]], 1))
            if found:
                both = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(both[:, 2])], names=["left", "right", "run"])
    return pairs


def _thinned(edges, spot, a, size):
    u, v, w = (np.concatenate(e) for e in zip(*edges))
    keep = _forest(spot[u - a], spot[v - a], w, size)
    return u[keep], v[keep], w[keep]


def _verified(words: int, percent: int):
    def verify(batches):
        for batch in batches:
            left, right = batch.column("left").to_numpy(), batch.column("right").to_numpy()
            texts = [x for pair in zip(batch.column("left_text").to_pylist(), batch.column("right_text").to_pylist()) for x in pair]
            good, sets = [], []
            for _, part in chunks(texts):
                values, counts = shingle_sets(part, words)
                sets += np.split(values, np.cumsum(counts)[:-1])
                while len(sets) >= 2:
                    x, y = sets.pop(0), sets.pop(0)
                    with np.errstate(over="ignore"):
                        same = mix(x, 16).sum().view(np.int64) == left[len(good)] and mix(y, 16).sum().view(np.int64) == right[len(good)]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(bool(same and 100 * both >= percent * (len(x) + len(y) - both)))
            good = np.array(good, bool)
            yield pa.RecordBatch.from_arrays([pa.array(left[good]), pa.array(right[good])], names=["left", "right"])
    return verify


def _checked(rows: DataFrame, pairs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose whole texts match."""
    needed = pairs.select(F.explode(F.array("left", "right")).alias("key")).distinct().join(sets.select("key", "rep"), "key")
    texts = stored(rows.join(checked_broadcast(stored(needed, "jaccard-needed")), F.col("doc_id") == F.col("rep")).select("key", "text"), "jaccard-texts")
    pairs = (pairs.join(texts.select(F.col("key").alias("left"), F.col("text").alias("left_text")), "left")
             .join(texts.select(F.col("key").alias("right"), F.col("text").alias("right_text")), "right").select("left", "right", "left_text", "right_text"))
    with arrow_rows(rows.sparkSession, 200):
        return stored(pairs.mapInArrow(_verified(words, percent), "left long, right long").distinct(), "jaccard-links")


def connected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(nodes, labels): doc_id, n, key of every row of docs, and node, label of the keys that links connect: the class by its least key.

    Rows of equal sets have equal keys. Texts that are null, empty or without words have n = 0 and no links. A row without
    identifier keeps its n and has no links of its own.
    """
    spark = docs.sparkSession
    rows = docs.select(c(id_col).cast("long").alias("doc_id"), c(text_col).cast("string").alias("text"))
    with arrow_rows(spark, 1000):
        full = stored(rows.mapInArrow(_nodes(words, percent), NODES), "jaccard-nodes")
    nodes = stored(full.select("doc_id", "n", "key", "other", "sketch"), "jaccard-sketches")
    sets = stored(nodes.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("other").alias("a"), F.max("other").alias("b")), "jaccard-sets")
    if not sets.where("a <> b").isEmpty():
        raise ValueError("two different sets share a 64-bit key")
    index = full.where("sketch is not null")
    meta = lambda kind: (F.col("n") * 4 + kind).alias("meta")
    own = index.select("key", "n", F.posexplode("own").alias("i", "sig")).select("sig", "key", meta(F.when(F.col("i") == 0, FIRST).otherwise(OWN)))
    near = index.select("key", "n", F.explode("near").alias("sig")).select("sig", "key", meta(F.lit(NEAR)))
    upper = index.select("key", "n", F.explode("upper").alias("sig")).select("sig", "key", meta(F.lit(UPPER)))
    every = own.unionByName(near).unionByName(upper).repartition("sig").sortWithinPartitions("sig", F.shiftright("meta", 2), "key", "meta")
    with arrow_rows(spark, 50_000):
        shared = stored(every.mapInArrow(_shared(percent), "sig long, key long, meta long, cost long, freq long"), "jaccard-shared")
        discard(full)        # its arrays are the largest table here
        asking = shared.where("cost > 0").repartition("key").sortWithinPartitions("key")
        ask = stored(asking.mapInArrow(_allocated(percent), "sig long, key long, n long, freq long"), "jaccard-chosen")
    # Of a signature that is looked up, the sets that one of the askers may find.
    size = F.shiftright("meta", 2)
    asked = ask.groupBy("sig").agg(F.min("n").alias("least"), F.max(F.struct("n", "key")).alias("most"))
    found = shared.join(asked, "sig").where((100 * size >= percent * F.col("least")) & (F.struct(size.alias("n"), "key") < F.col("most"))).select("sig", "key", size.alias("n"), "freq")
    parts = F.ceil(F.col("freq") / F.lit(RUN)).cast("int")
    run = lambda salt: F.xxhash64("sig", salt).alias("run")
    have = found.select(run(F.pmod(F.xxhash64("key"), parts).cast("int")), "key", "n", F.lit(False).alias("probe"))
    ask = ask.select("sig", "key", "n", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt")).select(run(F.col("salt")), "key", "n", F.lit(True).alias("probe"))
    sketches = nodes.where("sketch is not null").groupBy("key").agg(F.min("sketch").alias("sketch"))
    both = stored(have.unionByName(ask).join(sketches, "key"), "jaccard-runs")

    def candidates(parted: DataFrame, forest: bool) -> DataFrame:
        with arrow_rows(spark, 10_000):
            return stored(parted.repartition("run").sortWithinPartitions("run").mapInArrow(_candidates(percent, forest), "left long, right long, run long"), "jaccard-candidates")

    # First what connects the sets of each signature best. Where all of that is verified, every other pair under the signature is inside a class
    # and needs no check of its own, so a large group of copies does not give all its pairs.
    first = candidates(both.withColumn("part", F.col("key")), True)
    links = _checked(rows, stored(first.select("left", "right").distinct(), "jaccard-pairs"), sets, words, percent)
    label = components(links)
    of = lambda side: label.select(F.col("node").alias(side), F.col("label").alias(side + "_label"))
    apart = first.join(of("left"), "left", "left").join(of("right"), "right", "left").where(~F.coalesce(F.col("left_label") == F.col("right_label"), F.lit(False)))
    # Under the other signatures every pair between two classes is looked at.
    broken = stored(apart.select("run").distinct(), "jaccard-broken")
    if not broken.isEmpty():
        parted = both.join(checked_broadcast(broken), "run", "left_semi").join(label, F.col("key") == F.col("node"), "left").withColumn("part", F.coalesce("label", "key")).drop("node", "label")
        rest = _checked(rows, stored(candidates(parted, False).select("left", "right").distinct(), "jaccard-pairs"), sets, words, percent)
        label = components(links.unionByName(rest))
    return nodes.select("doc_id", "n", "key"), label


@tidy("jaccard-classes")
def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs: the smallest doc_id that links reach, itself included.

    A row without words is its own component; so is a row without identifier, whose component_id is null. Rows that repeat an
    identifier are rows of their own: each has the component of its own text. No rows give no rows. Other columns are ignored.
    """
    nodes, labels = connected(docs, id_col, text_col, words=words, percent=percent)
    used = nodes.where("n > 0 and doc_id is not null")
    named = used.groupBy("key").agg(F.min("doc_id").alias("least")).join(labels, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("label", "key").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_key = stored(named.join(least, "label").select("key", "component_id"), "jaccard-components")
    out = used.join(by_key, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = nodes.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(rest)
