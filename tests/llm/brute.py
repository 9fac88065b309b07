"""Brute-force versions of the text operators, on Python lists of rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lower(text):
    return (text or "").translate(LOWER)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def exact(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[lower(text)].append(i)
    out = []
    for i, text in rows:
        own = groups[lower(text)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, sha(lower(text))))
    return out


def shingles(text, size=5):
    words = SPACED.findall(lower(text))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near(rows):
    own_sizes = [(i, len(shingles(t))) for i, t in rows]
    sets = {}
    for i, t in rows:  # of one id's sets the largest counts
        if i is not None and len(shingles(t)) >= len(sets.get(i, ())):
            sets[i] = shingles(t)
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    shared = Counter()
    for own in index.values():
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                shared[own[a], own[b]] += 1
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [(i, n, None if i is None else find(i)) for i, n in own_sizes]


def suffix(rows, size=400):
    seen = Counter()
    for _, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - size + 1):
            seen[hashlib.blake2b(data[k : k + size], digest_size=12).digest()] += 1
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        end = 0
        for k in range(len(data) - size + 1):
            if seen[hashlib.blake2b(data[k : k + size], digest_size=12).digest()] > 1:
                for j in range(max(k, end), k + size):
                    gone[j] = 1
                end = k + size
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, sha(bytes(x for x, g in zip(data, gone, strict=True) if not g))))
    return out


def windows(words, size=13):
    n = min(size, len(words))
    return [tuple(words[k : k + n]) for k in range(len(words) - n + 1)] if words else []


def contamination(rows, items):
    found = defaultdict(set)
    for item, text in items:
        for w in windows(LETTERS.findall(lower(text))):
            found[w].add("" if item is None else str(item))
    sizes = sorted({len(w) for w in found})
    out = []
    for i, text in rows:
        words = LETTERS.findall(lower(text))
        hit, own = set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                w = tuple(words[k : k + n])
                if w in found:
                    own |= found[w]
                    hit.update(range(k, k + n))
        out.append((i, len(words), len(hit), len(own), sha(",".join(sorted(own))), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def substring(rows, size=13):
    least = {}
    for i, text in rows:
        if i is None:
            continue
        words = SPACED.findall(text or "")
        for k in range(len(words) - size + 1):
            w = tuple(words[k : k + size])
            least[w] = min(least.get(w, i), i)
    out = []
    for i, text in rows:
        words = SPACED.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            if i is not None and least[tuple(words[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((i, len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone, strict=True) if not g))))
    return out


def mixing_targets(rows, share=1.5, weights=(3, 1, 2)):
    size = defaultdict(int)
    for _, source, text in rows:
        size[source] += len(SPACED.findall(text or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, target = share * sum(size.values()), set(names), dict.fromkeys(names, 0.0)
    while open_ and left > 1e-9:
        each = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + each * weight[s] >= 2 * size[s]}
        if not full:
            for s in open_:
                target[s] += each * weight[s]
            break
        for s in full:
            left -= 2 * size[s] - target[s]
            target[s] = 2.0 * size[s]
        open_ -= full
    return dict(size), target


def stupid_backoff(rows, order, backoff, log):
    """(doc_id, words, words seen nowhere else, log score) with every count less the scored occurrence."""
    counts = Counter()
    texts = [(i, SPACED.findall(t or "")) for i, t in rows]
    total = sum(len(w) for _, w in texts)
    for _, words in texts:
        for n in range(1, order + 1):
            counts.update(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    out = []
    for i, words in texts:
        score, unseen = 0.0, 0
        for k in range(len(words)):
            unseen += counts[words[k],] == 1
            value = None
            off = 0
            for n in range(min(order, k + 1), 0, -1):
                gram = tuple(words[k - n + 1 : k + 1])
                if counts[gram] > 1:
                    below = counts[gram[:-1]] - 1 if n > 1 else max(total - 1, 1)
                    value = log((counts[gram] - 1) / below) + off * log(backoff)
                    break
                if n > 1:
                    off += 1
            if value is None:
                value = log(1 / max(total - 1, 1)) + off * log(backoff)
            score += value
        out.append((i, len(words), unseen, score if words else None))
    return out
