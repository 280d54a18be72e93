"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import xxhash


def fold(doc_id, folds):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()


def fingerprint(text, words):
    parts = lower(text).split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def classes(items, near):
    """The least item reachable from each item."""
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    items = list(items)
    for n, a in enumerate(items):
        for b in items[:n]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def simhash_classes(rows, words, radius):
    prints = [fingerprint(t, words) for _, t in rows]
    group = classes(set(prints), lambda a, b: (a ^ b).bit_count() <= radius)
    least = {}
    for (doc_id, _), p in zip(rows, prints, strict=True):
        if doc_id is not None:
            least[group[p]] = min(doc_id, least.get(group[p], doc_id))
    return Counter((d, f"{p:016x}", least.get(group[p])) for (d, _), p in zip(rows, prints, strict=True))


def without_repeats(rows, length):
    """doc_id, n_bytes, n_removed, n_spans, kept for each row."""
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = Counter()
    for d, b in data:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[(d, len(b), int(gone.sum()), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))] += 1
    return out


def lm_counts(rows, folds, left_out):
    """Tokens of each row, and counts of words and pairs over the training rows."""
    tokens = [[*lower(t).split(), None] for _, t in rows]
    words, pairs = Counter(), Counter()
    for (d, _), own in zip(rows, tokens, strict=True):
        if fold(d, folds) != left_out:
            words.update(own)
            pairs.update(zip([None, *own[:-1]], own, strict=True))
    return tokens, words, pairs


def lm_score(own, words, pairs, weights):
    n, v = sum(words.values()), len(words)
    base = score = 0.0
    for before, token in zip([None, *own[:-1]], own, strict=True):
        context = words[before]
        w = weights[min(int(math.log2(context + 1)), len(weights) - 1)]
        base += math.log10((words[token] + 1) / (n + v + 1))
        score += math.log10(
            w[0] * pairs[before, token] / max(context, 1) + w[1] * words[token] / max(n, 1) + w[2] / (v + 1)
        )
    return base, score


def waterfill(sizes, weights, cap):
    """Targets by sharing the excess again until no source is above its limit."""
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        level = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * level > cap * sizes[i] + 1e-9]
        if not over:
            for i in free:
                target[i] = weights[i] * level
            break
        for i in over:
            target[i] = float(cap * sizes[i])
            left -= target[i]
            free.discard(i)
    return target
