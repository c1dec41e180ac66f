"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once on their UTF-8 bytes (numpy, inside tasks)."""

from __future__ import annotations

import functools

import numpy as np

CHUNK = 1 << 17     # bytes hashed at once (about 100 bytes of arrays for each); a longer text is a chunk of its own
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)     # odd, so that it has an inverse modulo 2**64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scrambles 64-bit values (a bijection for each seed)."""
    x = x ^ np.uint64(seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64), 7)


@functools.lru_cache(1)
def _chunk_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(2 * CHUNK)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE)]).cumprod(), np.concatenate([np.ones(1, np.uint64), np.full(size, inverse)]).cumprod()


def word_bounds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, first byte, byte after the last one and hash of every word, in order, and the number of words of every text.
    Words are hashed with A-Z folded to a-z."""
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined.translate(_FOLD), np.uint8)
    gap = _SEPARATOR[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    start, end = edge[0::2], edge[1::2]
    power, inverse = _chunk_powers() if len(data) <= 2 * CHUNK else _powers(len(data))     # those of a longer text are not kept
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), (_BYTE[data] * power[: len(data)]).cumsum()])
        words = mix((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.frombuffer(joined, np.uint8), start, end, words, np.diff(np.searchsorted(start, ends), prepend=0)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, in order, and the number of words of every text."""
    return word_bounds(texts)[3:]


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, text by text in rising order, and the size of every set.

    A text of fewer than k words has its whole sequence as its one shingle; a text without words has none.
    """
    words, counts = word_hashes(texts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    owner = np.repeat(np.arange(len(texts)), counts)
    with np.errstate(over="ignore"):
        whole = counts >= k
        at = np.flatnonzero((np.arange(len(words)) - first[owner] <= counts[owner] - k) & whole[owner]) if len(words) else np.zeros(0, int)
        hashes = np.zeros(len(at), np.uint64)
        for i in range(k):
            hashes += mix(words[at + i], i + 1)
        short = np.flatnonzero((counts > 0) & ~whole)
        rest = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            use = counts[short] > i
            rest[use] += mix(words[first[short[use]] + i], 100 * k + 10 + i)
    doc = np.concatenate([owner[at], short])
    value = np.concatenate([mix(hashes), mix(rest)])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(doc[new], minlength=len(texts))


def chunks(texts: list[str | None]):
    """Slices of a batch that hold about CHUNK bytes each, with the texts as bytes."""
    out, at, held = [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if out and held + len(b) > CHUNK:
            yield at, out
            out, at, held = [], i, 0
        out.append(b)
        held += len(b)
    if out:
        yield at, out
