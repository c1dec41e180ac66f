"""SentencePiece encoding by Gumbel top-k without replacement over the segmentation lattice, and decoding.

A text is cut into units (spaces and the characters up to the next space), which no piece crosses, so its lattice is the chain
of the units' lattices. Backward sums over a unit's lattice give the exact chance of every next piece, and a search from the
root draws perturbed values top-down: the value of a node is the maximum over all segmentations below it, so the best-first
(A-star) search with these exact bounds pops complete segmentations in the order of their perturbed log-probabilities. Values are
kept as arrival times T = exp(-G): a child with chance q and exponential E arrives at T(parent) + (E / q - min E / q) / P(parent).
All texts of a chunk walk their lattices together in numpy; the random numbers are a hash of (row key, sample, place, piece), so
they depend on nothing else.

Pieces weigh 1 / (rank + 10) by their rank in the given model (Zipf's law), as a merge model has ranks and no probabilities.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c
from cleanlake.llm.shingles import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
REACH = 80.0           # nats of a prefix beyond which siblings are not drawn (see sample)
CHUNK = 256 << 10      # bytes of text that walk together; a longer text is a chunk of its own
SPACE = "▁"


class Pieces:
    """The vocabulary as arrays: a trie from bytes to piece, weights, and the bytes of every piece."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.n, text, ids = n, [b""] * n, []
        self.byte_id = np.full(256, -1)
        rank = np.zeros(n)
        scored = sorted((i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))), key=lambda i: (-sp.get_score(i), i))
        rank[scored] = np.arange(len(scored))
        for i in range(n):
            if sp.is_byte(i):
                text[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
                self.byte_id[text[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                text[i] = sp.id_to_piece(i).replace(SPACE, " ").encode()
                if " " not in sp.id_to_piece(i).replace(SPACE, " ").lstrip(" "):
                    ids.append(i)
        self.weight = 1.0 / (rank + 10.0)
        self.weight[self.byte_id[self.byte_id >= 0]] = 1.0 / (n + 10.0)
        self.text = pa.array(text, pa.large_binary())
        self.longest = max(len(text[i]) for i in ids)
        # All beginnings of pieces form a trie in one array (a double array): the child of state s by byte b is state base[s] + b if
        # parent[base[s] + b] is s. State 0 is the root; base is -1 where no longer piece begins so.
        kids: dict[bytes, list[int]] = {}
        for start in {text[i][:size] for i in ids for size in range(1, len(text[i]) + 1)}:
            kids.setdefault(start[:-1], []).append(start[-1])
        used, bases, spot = bytearray(b"\1" + bytes(1024)), {}, 1              # its end is always free
        for start in sorted(kids, key=lambda x: (-len(kids[x]), x)):          # the fullest first; only children fill the gaps
            least, *more = sorted(kids[start])
            spot = used.find(0, spot)
            at, tries = spot, 0
            while at < least or any(used[at - least + x] for x in more):
                at, tries = used.find(0, at + 1), tries + 1
            bases[start] = base = at - least
            for x in kids[start]:
                used[base + x] = 1
            used.extend(bytes(max(0, base + 1024 - len(used))))
            if tries > 16:                                                    # nearly full down there
                spot += 64
        size = len(used)                                                      # a base and any byte, or 256 for the end of a unit, stay inside
        self.base, self.parent, self.piece = np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.full(size, n)
        piece, todo = {text[i]: i for i in ids}, [(b"", 0)]
        for start, state in todo:
            self.piece[state] = piece.get(start, n)
            if start in kids:
                self.base[state] = bases[start]
                for x in kids[start]:
                    self.parent[bases[start] + x] = state
                    todo.append((start + bytes([x]), bases[start] + x))
        self.salt = mix(np.arange(n, dtype=np.uint64), 42)


@functools.lru_cache(1)
def pieces(model: str) -> Pieces:
    return Pieces(model)


class Lattice:
    """Lattices of the distinct units of a chunk, side by side. A node is a place between two bytes; the edges of node v are first[v] to first[v + 1].

    Nodes are numbered by falling distance to the end of their unit, among equal ones longer units first. So nodes of one distance lie
    together, and the place after the next byte of node v is node v + jump[v].
    """

    def __init__(self, vocab: Pieces, units: list[bytes] | pa.BinaryArray):
        units = pa.array(units, pa.binary())
        lens = pc.binary_length(units).to_numpy().astype(np.int64)
        rank = np.empty(len(lens), np.int64)
        rank[np.argsort(-lens, kind="stable")] = np.arange(len(lens))
        count = np.cumsum(np.bincount(lens)[::-1])[::-1]                      # nodes of every distance: one of each unit that is so long
        base = np.cumsum(count[::-1])[::-1] - count
        self.start, self.end = base[lens] + rank, base[0] + rank
        n, left = int(base[0] + count[0]), int(base[0])                       # the ends of units are the last nodes
        far = np.repeat(np.cumsum(lens), lens) - np.arange(left)
        value = np.full(n, 256)                                               # the byte after every node, 256 at ends
        value[base[far] + np.repeat(rank, lens)] = _bytes(units)
        jump = np.repeat(count[::-1], count[::-1])
        char = (value & 0xC0) != 0x80
        char[left:] = False
        width = np.ones(n, np.int8)
        width[(value & 0xE0) == 0xC0], width[(value & 0xF0) == 0xE0], width[(value & 0xF8) == 0xF0] = 2, 3, 4
        one = np.zeros(n, bool)
        degree = np.zeros(n, np.int64)                                        # edges of every node so far; they come by rising length
        found = []
        at = spot = np.flatnonzero(char)
        state = np.zeros(len(at), np.int64)
        for length in range(1, vocab.longest + 1):
            child = vocab.base[state] + value[spot]
            ok = np.flatnonzero(vocab.parent[child] == state)
            if not len(ok):
                break
            at, spot, state = at[ok], spot[ok], child[ok]
            spot = spot + jump[spot]
            pid = vocab.piece[state]
            ok = np.flatnonzero(pid < vocab.n)
            here = at[ok]
            turn = degree[here]
            found.append((here, turn, spot[ok] << 32 | pid[ok]))
            degree[here] = turn + 1
            if length <= 4:
                one[here[width[here] == length]] = True
        raw = np.flatnonzero(char & ~one)                                     # characters that are no piece go by bytes
        while len(raw):
            spot = raw + jump[raw]
            found.append((raw, degree[raw], spot << 32 | vocab.byte_id[value[raw]] & 0xFFFFFFFF))
            degree[raw] += 1
            raw = spot
            raw = raw[(raw < left) & ~char[raw]]
        self.first = np.concatenate([[0], np.cumsum(degree)])
        edge = np.empty(self.first[-1], np.int64)                             # the node it leads to, and in the lower half its piece
        for here, turn, to in found:
            edge[self.first[here] + turn] = to
        self.dst, self.pid = edge >> 32, edge.astype(np.int32)
        pids = self.pid.astype(np.int64)
        self.salt = vocab.salt[pids]
        self._backward(vocab.weight[pids], degree, base, lens.max() <= 150)   # no sum of products underflows there

    def _backward(self, w: np.ndarray, degree: np.ndarray, base: np.ndarray, short: bool) -> None:
        """log of the sum of weights of all ways from each node to the end of its unit, and the chance of every edge."""
        w = w if short else np.log(w)
        beta = np.full(len(degree), 0.0 if short else -np.inf)
        beta[base[0]:] = 1.0 if short else 0.0
        bounds = self.first[base].tolist()
        base = base.tolist()
        full = degree[: base[0]].all()
        for far in range(1, len(base)):                                       # all nodes this far from their end
            s, e = slice(base[far], base[far - 1]), slice(bounds[far], bounds[far - 1])
            if e.start == e.stop:
                continue
            if not full:
                s = s.start + np.flatnonzero(degree[s])
            head = self.first[s] - e.start
            if short:
                w[e] *= beta[self.dst[e]]
                beta[s] = np.add.reduceat(w[e], head)
            else:
                w[e] += beta[self.dst[e]]
                top = np.maximum.reduceat(w[e], head)
                top = np.where(np.isfinite(top), top, 0.0)
                with np.errstate(divide="ignore"):
                    beta[s] = top + np.log(np.add.reduceat(np.exp(w[e] - np.repeat(top, degree[s])), head))
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            if short:
                w /= np.repeat(beta, degree)
                self.log_q, self.inv_q = np.log(w), 1.0 / w
            else:
                self.log_q = w - np.repeat(beta, degree)
                self.inv_q = np.exp(-self.log_q)
        dead = np.isnan(self.log_q)
        if dead.any():
            self.log_q[dead], self.inv_q[dead] = -np.inf, np.inf


def _bytes(values: pa.BinaryArray) -> np.ndarray:
    """The bytes of all values, one after the other."""
    cut = np.frombuffer(values.buffers()[1], np.int32)[values.offset: values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[cut[0]: cut[-1]]


def _units(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """Units of all texts in order, and the number of units of every text: a cut before each space that follows a non-space."""
    data = b"".join(texts)
    space = np.frombuffer(data, np.uint8) == 32
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = space[1:] & ~space[:-1]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    cut[ends] = True
    cut = np.flatnonzero(cut)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(data)]), np.diff(np.searchsorted(cut, ends), prepend=0)


def _races(lat: Lattice, a: np.ndarray, deg: np.ndarray, key: np.ndarray):
    """E / q of every edge of every node, given by its first edge and their number: the start of each node's edges, the nodes, the edges, and
    the races. key seeds each node."""
    till = np.cumsum(deg)
    head = till - deg
    node = np.repeat(np.arange(len(deg)), deg)
    edge = (a - head)[node]
    edge += np.arange(len(edge))
    bits = key[node]
    with np.errstate(over="ignore", divide="ignore"):
        bits += lat.salt[edge]
        u = _unit(mix(bits))
        np.log(u, out=u)
        np.negative(u, out=u)
        u *= lat.inv_q[edge]
    return head, node, edge, u


def _unit(bits: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 of hashes."""
    u = (bits >> np.uint64(11)).view(np.int64).astype(np.float64)
    u += 0.5
    u *= 2.0 ** -53
    return u


_STEP = np.uint64(0x632BE59BD9B4E019)


def _walk(lat: Lattice, node: np.ndarray, key: np.ndarray):
    """Walks from `node` to the end of the unit for many walkers at once: edges of all steps, walker by walker, by how much the race of each
    was ahead of the next one of its node, and the number of steps of every walker."""
    steps, who, seed = [], np.arange(len(node)), key
    walked = np.zeros(len(node), np.int64)
    while True:
        a = lat.first[node]
        deg = lat.first[node + 1] - a
        live = np.flatnonzero(deg)
        if len(live) < len(who):
            who, a, deg, seed = who[live], a[live], deg[live], seed[live]
        if not len(who):
            break
        head, at, edge, race = _races(lat, a, deg, seed)
        bits = race.view(np.int64)                                            # floats from 0 on are in the order of their bits, which is faster
        least = np.minimum.reduceat(bits, head)
        hit = np.flatnonzero(bits == least[at])
        if len(hit) > len(head):                                              # a tie, or edges without chance: the first counts
            hit = hit[np.searchsorted(hit, head)]
        best = edge[hit]
        race[hit] = np.inf
        with np.errstate(invalid="ignore"):
            ahead = np.minimum.reduceat(bits, head).view(np.float64) - least.view(np.float64)
        steps.append((who, best, ahead))
        walked[who] = len(steps)
        node = lat.dst[best]
        with np.errstate(over="ignore"):
            seed = seed + _STEP
    to = np.cumsum(walked) - walked
    edges, gaps = np.empty(int(walked.sum()), np.int64), np.empty(int(walked.sum()))
    for i, (who, best, ahead) in enumerate(steps):                            # step i of a walker follows its step i - 1
        place = to[who] + i
        edges[place], gaps[place] = best, ahead
    return edges, gaps, walked


def sample(vocab: Pieces, texts: list[bytes], keys: np.ndarray, k: int, seed: int = 0) -> list[list[tuple[np.ndarray, float, float]]]:
    """Up to k distinct segmentations of every text: (piece ids, log-probability, log inclusion chance), in the order they were drawn.

    Fewer than k come back only where the lattice has fewer; their inclusion chance is then 1 (log 0). An empty text has one, of no pieces.
    """
    units, counts = _units(texts)
    coded = units.dictionary_encode()
    unit = coded.indices.to_numpy().astype(np.int64)
    out = [[] for _ in texts]
    if not len(units):
        return [[(np.zeros(0, np.int32), 0.0, 0.0)] for _ in texts]
    lat = Lattice(vocab, coded.dictionary)
    first_unit = np.concatenate([[0], np.cumsum(counts)[:-1]])
    root = np.array([-np.log(x) for x in _uniform(keys, seed)])              # arrival time of the root: exponential of rate 1
    # tasks of a round: (text, unit from, start node, arrival time, prefix pieces, prefix log-probability)
    queue = [[] for _ in texts]
    active = [(t, 0, lat.start[unit[first_unit[t]]], root[t], np.zeros(0, np.int32), 0.0) for t in range(len(texts)) if counts[t]]
    done = [[] for _ in texts]
    for r in range(k):
        if not active:
            break
        n_walk = np.array([counts[a[0]] - a[1] for a in active])
        offset = np.concatenate([[0], np.cumsum(n_walk)])
        place = np.concatenate([np.arange(a[1], counts[a[0]]) for a in active])
        text = np.repeat([a[0] for a in active], n_walk)
        which = unit[first_unit[text] + place]
        node = lat.start[which].copy()
        node[offset[:-1]] = [a[2] for a in active]
        with np.errstate(over="ignore"):
            key = mix(mix(keys[text] + np.uint64(seed), r + 41) + place.astype(np.uint64))
        edge, gap, walked = _walk(lat, node, key)
        till = np.cumsum(walked)
        ends = np.concatenate([[0], till])[offset]                            # of every task in the steps
        run = np.concatenate([[0.0], np.cumsum(lat.log_q[edge])])
        size = np.diff(ends)
        prefix = np.array([a[5] for a in active])
        owner = np.repeat(np.arange(len(active)), size)
        before = run[:-1] - run[ends[:-1]][owner] + prefix[owner]
        pid = lat.pid[edge]
        # A sibling arrives exp(-before) * (its race - the smallest race) after its parent. Races are made of 53-bit numbers, so the
        # difference is no less than 2**-106 = exp(-73.5), and past REACH no sibling can be among the next ones: they are not drawn.
        near = np.flatnonzero(before > (prefix - REACH)[owner])
        later = k - r                                                         # that many more can still be asked for
        with np.errstate(divide="ignore"):
            late = np.log(gap[near]) - before[near]                           # of the earliest sibling of every step
        near = near[np.sort(_earliest(late, owner[near], later))]             # no other step has one of the next ones
        who = np.searchsorted(till, near, "right")
        step = near - (till - walked)[who]
        start = np.where(step > 0, lat.dst[edge[near - 1]], node[who])
        with np.errstate(over="ignore"):
            seeds = key[who] + step.astype(np.uint64) * _STEP
        first = lat.first[start]
        head, at, rival, race = _races(lat, first, lat.first[start + 1] - first, seeds)
        pos = near[at]
        lose = np.flatnonzero((rival != edge[pos]) & (lat.log_q[rival] > -np.inf))
        least = np.minimum.reduceat(race, head) if len(head) else race
        pos, rival, race = pos[lose], rival[lose], race[lose] - least[at[lose]]
        with np.errstate(over="ignore", divide="ignore"):
            late = np.log(race) - before[pos]
            when = np.array([a[3] for a in active])[owner[pos]] + np.exp(np.minimum(late, 709.0))
        best = _earliest(late, owner[pos], later)
        for i in best:
            o, j = owner[pos[i]], pos[i]
            t, a = active[o][0], active[o]
            queue[t].append((when[i], place[np.searchsorted(till, j, "right")], lat.dst[rival[i]], lat.pid[rival[i]], before[j] + lat.log_q[rival[i]], r, j - ends[o] + len(a[4])))
        for i, a in enumerate(active):
            ids = np.concatenate([a[4], pid[ends[i]: ends[i + 1]]])
            done[a[0]].append((ids, prefix[i] + run[ends[i + 1]] - run[ends[i]]))
        active = []
        for t, q in enumerate(queue):
            if not q:
                continue
            q.sort(key=lambda x: x[0])
            if r + 1 < k and len(done[t]) == r + 1:
                when_, place_, node_, piece, log_p, source, cut = q.pop(0)
                del q[k - r:]
                active.append((t, int(place_), node_, when_, np.append(done[t][source][0][:cut], np.int32(piece)), log_p))
    for t in range(len(texts)):
        rest = np.log(queue[t][0][0]) if queue[t] else np.inf
        out[t] = [(ids, float(p), _log_inclusion(p + rest)) for ids, p in done[t]] or [(np.zeros(0, np.int32), 0.0, 0.0)]
    return out


def _earliest(late: np.ndarray, owner: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` smallest finite values of every owner, in rising order (equal ones by place), all first ones first. Owners lie one after the other."""
    has = np.flatnonzero(np.diff(owner, prepend=-1))
    many = np.diff(np.append(has, len(owner)))
    left, best = np.where(late < 709.0, late, np.inf), [np.zeros(0, np.int64)]
    for _ in range(most if len(late) else 0):
        first = np.minimum.reduceat(left, has)
        hit = np.flatnonzero((left == np.repeat(first, many)) & (left < 709.0))
        hit = hit[np.diff(owner[hit], prepend=-1) > 0]
        if not len(hit):
            break
        left[hit] = np.inf
        best.append(hit)
    return np.concatenate(best)


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))), where x is log(p * T) with the arrival time T of the next segmentation."""
    return float(x if x < -30 else np.log(-np.expm1(-np.exp(min(x, 30.0)))))


def _uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((mix(keys + np.uint64(seed), 40) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def decode_ids(vocab: Pieces, ids: np.ndarray) -> bytes:
    """The bytes that pieces stand for."""
    return _decoded(vocab, pa.array(np.asarray(ids, np.int64)))[0].tobytes()


def _decoded(vocab: Pieces, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that pieces stand for, and where each piece begins in them and the last one ends."""
    text = vocab.text.take(ids)
    cut = np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    return np.frombuffer(text.buffers()[2] or b"", np.uint8)[cut[0]: cut[-1]], cut - cut[0]


SCHEMA = "row_key long, sample int, ids array<int>, log_prob double, log_inclusion double"


def encode(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", *, k: int = SAMPLES, seed: int = 0, model: str = MODEL, keep_text: bool = False) -> DataFrame:
    """row_key, sample (from 0), ids, log_prob, log_inclusion: up to k distinct segmentations of every text without replacement.

    log_inclusion is the logarithm of the chance that a segmentation is among the k, given the arrival time of the next one. Null and empty texts have one
    sample of no pieces. Null keys are seeded as 0; rows that repeat a key and text get the same samples. Texts are lossless:
    unknown characters, line breaks and the space sign itself go by byte pieces. No rows give no rows; other columns are ignored.
    keep_text adds the text as given, `source`.
    """
    rows = docs.select(c(key_col).cast("long").alias("row_key"), c(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoded(k, seed, model, keep_text), SCHEMA + (", source string" if keep_text else ""))


def _encoded(k: int, seed: int, model: str, keep_text: bool = False):
    def run(batches):
        vocab = pieces(model)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            start = 0
            while start < len(sizes):                                         # only one chunk of a batch is held as Python objects
                stop, held = start, 0
                while stop < len(sizes) and (stop == start or held + sizes[stop] <= CHUNK):
                    held += sizes[stop]
                    stop += 1
                part = batch.slice(start, stop - start)
                start = stop
                raw = part.column("row_key").to_pylist()
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
                keys = np.array([x or 0 for x in raw], np.int64).view(np.uint64)
                found = sample(vocab, texts, keys, k, seed)
                rows = [(i, j, *x) for i, some in enumerate(found) for j, x in enumerate(some)]
                at = pa.array([x[0] for x in rows], pa.int64())
                flat = np.concatenate([x[2] for x in rows])
                cut = np.concatenate([[0], np.cumsum([x[2].size for x in rows])]).astype(np.int32)
                cols = [part.column("row_key").take(at), pa.array([x[1] for x in rows], pa.int32()), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat, pa.int32())),
                        pa.array([x[3] for x in rows], pa.float64()), pa.array([x[4] for x in rows], pa.float64())]
                names = ["row_key", "sample", "ids", "log_prob", "log_inclusion"]
                yield pa.RecordBatch.from_arrays([*cols, part.column("text").take(at)] if keep_text else cols, names=[*names, "source"] if keep_text else names)
    return run


def report(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", *, k: int = SAMPLES, seed: int = 0, model: str = MODEL) -> DataFrame:
    """row_key, sample, pieces, log_prob, log_inclusion, ids_digest, round_trip: encode()'s ids digested, and whether decode() gives the text back."""
    back = decode(encode(docs, key_col, text_col, k=k, seed=seed, model=model, keep_text=True), model)
    same = F.col("text") == F.coalesce("source", F.lit(""))
    return back.select("row_key", "sample", F.size("ids").cast("long").alias("pieces"), "log_prob", "log_inclusion", "ids_digest", same.alias("round_trip"))


def _digests(ids: pa.ListArray) -> np.ndarray:
    """Hash of every row's ids and their places."""
    flat, cut = ids.flatten().to_numpy(zero_copy_only=False).astype(np.uint64), np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])
    size = np.diff(cut)
    place = np.arange(len(flat), dtype=np.uint64) - np.repeat(cut[:-1], size).astype(np.uint64)
    with np.errstate(over="ignore"):
        run = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat + (place << np.uint64(20))), dtype=np.uint64)])
        return mix(size.astype(np.uint64) + (run[cut[1:]] - run[cut[:-1]])).view(np.int64)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encode()'s rows with their text again, and a digest of the ids."""
    def run(batches):
        vocab = pieces(model)
        for batch in batches:
            ids = batch.column("ids")
            cut = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])
            raw, ends = _decoded(vocab, ids.flatten())                         # pieces of all rows at once
            ends = ends[cut]
            text = [raw[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string()), pa.array(_digests(ids))], names=[*batch.schema.names, "text", "ids_digest"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, fields + ", text string, ids_digest long")
