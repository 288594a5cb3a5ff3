"""Plain counterparts of the operators, and small tables with every awkward case."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, k string"


def words(text, fold=True):
    raw = (text or "").encode()
    if fold:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    return re.findall(rb"[^\x20\x09-\x0d]+", raw)


def shingles(text, k):
    found = words(text)
    if not found:
        return set()
    return {tuple(found)} if len(found) < k else {tuple(found[i : i + k]) for i in range(len(found) - k + 1)}


def components(texts, k, percent):
    """Smallest id reachable over links, by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeated(texts, length):
    """Per text the mask of bytes covered by a string of ``length`` bytes that starts elsewhere too."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t in raw:
        for j in range(len(t) - length + 1):
            seen[t[j : j + length]] = seen.get(t[j : j + length], 0) + 1
    masks = []
    for t in raw:
        mask = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] > 1:
                mask[j : j + length] = b"\1" * length
        masks.append(mask)
    return raw, masks


def prose(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.05 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(text, changes, seed):
    rng = random.Random(seed)
    found = text.split(" ")
    for _ in range(changes):
        found[rng.randrange(len(found))] = f"new{rng.randrange(10**6)}"
    return " ".join(found)


def rows(texts):
    """Rows of DOCS from texts numbered from 1, with columns whose names the operators use inside."""
    return [(i, t, "en", f"s{i % 3}", None, "x", i, "y") for i, t in enumerate(texts, 1)]
