"""Plain single-process versions of what the operators return."""

import hashlib
import re
from collections import Counter

import numpy as np

PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_licenses(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    hits = [(i, label) for i in range(len(words)) for p, label in PHRASES.items() if tuple(words[i : i + len(p)]) == p]
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def removed(texts, window):
    """For each text: bytes, removed bytes, spans, hash of the rest."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        cover = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                cover[i : i + window] = True
        cover = cover[: len(r)]
        spans = int((np.diff(cover.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(r, np.uint8)[~cover]) if r else b""
        out.append((len(r), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def quality(text):
    text = text or ""
    words = BLANK_WORD.findall(text)
    lines = [x for x in text.split("\n") if BLANK_WORD.search(x)]
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(threes), set()
    for i, w in enumerate(threes):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    n, repeat = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, n < 50 or 100 * repeat > 50 * n


def near_classes(rows):
    """Classes of (id, text) by the Jaccard similarity of five-word shingles."""
    words = {i: BLANK_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    root = {i: i for i in words}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(words)
    index = {}
    for i in ids:
        for s in sets[i]:
            index.setdefault(s, []).append(i)
    shared = Counter((a, b) for group in index.values() for x, a in enumerate(group) for b in group[x + 1 :])
    pairs = {p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    equal = {}
    for i in ids:
        if words[i]:
            pairs.add((equal.setdefault(tuple(words[i]), i), i))
    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def targets(sizes):
    """Target of each source by resharing until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        whole = sum(weight[s] for s in free)
        share = {s: weight[s] * rest / whole for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


def best_fit_decreasing(lengths, capacity):
    """Number of bins that best fit takes over falling lengths."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return len(room)
