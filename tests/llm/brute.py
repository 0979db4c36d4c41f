"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WHITE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = {c: c + 32 for c in range(65, 91)}


def base_measures(text):
    words = WHITE_WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WHITE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, symbols = len(words), sum(c in "#*$%&|<>" for c in text or "")
    return n, sum(map(len, words)), symbols, dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def contamination(docs, items):
    """docs, items: [(id, text)]. Per document: (n_words, n_hit, item ids as sorted strings)."""
    windows = defaultdict(set)
    for item, text in items:
        words = PLAIN_WORD.findall((text or "").translate(SMALL))
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[i:i + size])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        words, hit, found = PLAIN_WORD.findall((text or "").translate(SMALL)), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if tuple(words[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(words[i:i + size])]
        out[doc] = len(words), len(hit), sorted(str(x) for x in found if x is not None)
    return out


def shingles(text, words=5):
    tokens = WHITE_WORD.findall((text or "").translate(SMALL))
    if not tokens:
        return frozenset()
    return frozenset(tuple(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1)))


def near_duplicates(docs):
    """{doc_id: (n_shingles, component)} of documents with distinct ids, by all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    classes = defaultdict(list)
    for d, s in sets.items():
        classes[s].append(d)
    where, parent = defaultdict(list), {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    reps = {min(ds): s for s, ds in classes.items() if s}
    for s, ds in classes.items():
        for d in ds if s else []:
            parent[d] = min(ds)
    for d, s in reps.items():
        for x in s:
            where[x].append(d)
    for d, s in reps.items():
        shared = Counter(o for x in s for o in where[x] if o < d)
        for o, i in shared.items():
            if 100 * i >= 75 * (len(s) + len(reps[o]) - i):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def covered(docs, size=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha of the rest)}: bytes in strings that start in a smaller doc_id too."""
    first, out = {}, {}
    for d, t in sorted(docs):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            if first.setdefault(raw[i:i + size], d) < d:
                gone[i:i + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        out[d] = len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest()
    return out
