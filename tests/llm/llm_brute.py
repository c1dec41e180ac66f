"""Plain versions of operators, by loops over all rows or pairs."""

import math
import re

FOLD = {ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_classes(rows, percent=85, words=4):
    """(doc_id, n, component) by comparing all pairs."""
    sets = [shingles(t, words) for _, t in rows]
    part = list(range(len(rows)))
    find = lambda a: a if part[a] == a else find(part[a])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                part[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), math.inf), d if d is not None else math.inf)
    return sorted((d if d is not None else -1, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def brute_targets(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(x) for x in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out
