"""Plain versions of the operators, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def suffix_dedup(rows, length=100):
    """doc -> (bytes, removed, spans, digest of what is kept)."""
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = [True] * length
            else:
                seen[window] = True
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()
    return out


def word_dedup(rows, length=13):
    """doc -> (words, removed, digest of what is kept)."""
    seen, out = {}, {}
    order = lambda d: (d is not None, d or 0)
    for doc, text in sorted(set(rows), key=lambda r: order(r[0])):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen and order(seen[window]) < order(doc):
                gone[i : i + length] = [True] * length
            else:
                seen.setdefault(window, doc)
        out[doc] = len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone, strict=True) if not g).encode()).hexdigest()
    return out


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def jaccard(rows, n, num, den):
    """doc -> (size, component)."""
    sets = {doc: shingles(text, n) for doc, text in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets, key=lambda d: len(sets[d]))
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if den * len(sets[a]) < num * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}
