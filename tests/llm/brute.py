"""Plain Python forms of the operators' rules, for small tables."""

import collections
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contamination(docs, items, size=13):
    """docs, items: lists of (id, text). Per document words, hit words, sorted item ids."""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = alnum(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = alnum(text)
        hit, found = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    found |= {str(x) for x in windows[tuple(w[i:i + n])] if x is not None}
                    hit[i:i + n] = [True] * n
        out.append((doc, len(w), sum(hit), sorted(found)))
    return out


def shingles(text, n=5):
    w = spaced((text or "").translate(LOW))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(docs):
    """The smallest position of each document's component, by position."""
    sets = [shingles(t) for _, t in docs]
    to = list(range(len(docs)))

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                to[y] = x
    return [root(i) for i in range(len(docs))], sets


def bytes_kept(docs, size=100):
    """docs in order of id, ids distinct: kept bytes, removed, runs."""
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            k = b[i:i + size]
            if k in seen:
                gone[i:i + size] = b"\1" * size
            seen.add(k)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, bytes(x for x, g in zip(b, gone) if not g), sum(gone), runs))
    return out


def words_kept(docs, size=13):
    """docs: (id, text); kept text, words, removed words; equal ids don't remove from each other."""
    order = lambda d: (d is not None, d or 0)
    first, out = {}, []
    for doc, text in docs:
        w = spaced(text)
        for i in range(len(w) - size + 1):
            k = tuple(w[i:i + size])
            first[k] = min(first.get(k, doc), doc, key=order)
    for doc, text in docs:
        w = spaced(text)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if order(first[tuple(w[i:i + size])]) < order(doc):
                gone[i:i + size] = [True] * size
        out.append((doc, " ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return out
