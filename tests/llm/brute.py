"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = {c: c + 32 for c in range(65, 91)}
SECRETS = [
    ("assign", re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def words(text):
    return WORDS.findall((text or "").translate(FOLD))


def spans(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(SECRETS):
        found += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return ",".join(x[2] for x in sorted(found))


def contamination(docs, items):
    windows = defaultdict(set)
    for name, text in items:
        w = words(text)
        for i in range(max(0, len(w) - min(10, len(w)) + 1) if w else 0):
            windows[tuple(w[i : i + min(10, len(w))])].add(str(name))
    lengths = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w = words(text)
        hit, who = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i : i + n])):
                    who |= owners
                    hit.update(range(i, i + n))
        out.append((key, len(w), len(hit), sorted(who)))
    return out


def grams(text, k=5):
    w = words(text)
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def classes(keys, linked):
    up = {k: k for k in keys}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


def jaccard(docs, threshold=0.8):
    """(key, class, links) of documents with different keys."""
    sets = [(k, grams(t)) for k, t in docs]
    linked = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and len(x & y) >= threshold * len(x | y)]
    roots = classes([k for k, _ in sets], linked)
    n = defaultdict(int)
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    return sorted((k, roots[k], n[k]) for k, _ in sets)


def crc(text):
    import zlib

    return zlib.crc32((text or "").encode())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
