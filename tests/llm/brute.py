"""Plain versions of the contracts, one document at a time."""

import collections
import hashlib
import re

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(t or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def passages(rows, length=50):
    """rows: (doc_id, text) -> (n_words, n_removed, sha) each."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - length + 1):
            if i is not None:
                key = tuple(w[k : k + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def strings(rows, length=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def contamination(rows, items, width=13):
    index, sizes = collections.defaultdict(set), set()
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        if w:
            n = min(width, len(w))
            sizes.add(n)
            for k in range(len(w) - n + 1):
                index[tuple(w[k : k + n])].add(str(i) if i is not None else "")
    out = []
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                s = index.get(tuple(w[k : k + n]))
                if s:
                    found |= s
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def fingerprint(t):
    w = words((t or "").translate(LOWER))
    grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    count = np.zeros(64, int)
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        count += [(h >> k) & 1 for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * count[k] > len(grams))


def linked(prints, most=4):
    """The component's first index for each fingerprint."""
    f = np.array(prints, dtype=np.uint64)
    parent = list(range(len(f)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= most):
            a, b = root(i), root(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(f))]


def quality(t):
    t = t or ""
    w = words(t)
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    repeat = set()
    for k in range(len(w) - 2):
        if grams[tuple(w[k : k + 3])] > 1:
            repeat |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeat)


def spread(rows, least):
    """rows: (id, text, source) -> (id, n_lines, n_removed, sha)."""
    bare = lambda x: x.strip("\x20\t\n\x0b\x0c\r")
    sites = collections.defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if s is not None and bare(line):
                sites[bare(line)].add(s)
    out = []
    for i, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if len(sites[bare(x)]) < least]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out
