"""Plain versions of the operators, over lists of rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def suffix_masks(rows, length=100):
    """rows: (id, text) in order; the removed bytes of each as a mask."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        mask = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                mask[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        out.append((data, mask))
    return out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def simhash(text, k=3):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def groups(prints, radius=3):
    """prints: {id: fingerprint}; the smallest id that links reach."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fp = np.array([prints[i] for i in ids], np.uint64)
    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(fp[a + 1 :] ^ fp[a]) <= radius):
            x, y = find(ids[a]), find(ids[a + 1 + b])
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_groups(texts, share=0.8, k=5):
    """texts: {id: text}; the smallest id that near fingerprints and alike sets of five words reach. All pairs are looked at."""
    ids = sorted(texts)
    words = {i: WORD.findall(lower(texts[i])) for i in ids}
    sets = {i: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set() for i, w in words.items()}
    root = groups({i: simhash(texts[i]) for i in ids})

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= share * max(len(x), len(y)) and len(x & y) >= share * len(x | y) - 1e-9:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def quality_counts(text):
    text = text or ""
    w = WORD.findall(text)
    n = len(w)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    hit = {j for i in range(n - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def fertility(text, model):
    ids = [i for w in WORD.findall(text) for i in model.encode(w)]
    count = collections.Counter(ids)
    n = len(ids)
    entropy = -sum(c / n * math.log2(c / n) for c in count.values())
    return n, sum(map(len, WORD.findall(text))) / n, sum(model.is_byte(i) for i in ids) / n, entropy


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    found.sort()
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)
    n = collections.Counter(k for _, k, _ in found)
    return n[0], n[1], n[2], hashlib.sha256(joined.encode()).hexdigest()


def site_lines(rows, ratio=0.1, least=5, distinct=False):
    """rows: (id, text, site); the new texts. Pages are rows, or distinct texts of a site."""
    blanks = " \t\r\x0b\x0c"
    on, pages = collections.defaultdict(set), collections.defaultdict(set)
    for n, (_, text, site) in enumerate(rows):
        page = text if distinct else n
        pages[site].add(page)
        for line in text.split("\n"):
            if line.strip(blanks):
                on[site, line.strip(blanks)].add(page)
    bad = {k for k, v in on.items() if len(v) >= least and len(v) > ratio * len(pages[k[0]])}
    return ["\n".join(x for x in text.split("\n") if (site, x.strip(blanks)) not in bad) for _, text, site in rows]


def leaks(text, items, window=13, agree=0.8):
    """Items of which a window stands in the text, at any place, seeds aside: (item, most equal words)."""
    split = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    w, out = split(text), {}
    for item, t in items:
        q = split(t)
        span = min(window, len(q))
        if not q:
            continue
        for shift in range(-len(q) + 1, len(w)):
            flags = [w[j] == q[j - shift] for j in range(max(0, shift), min(len(w), shift + len(q)))]
            if sum(flags) < math.ceil(agree * span):
                continue
            best = max(sum(flags[i : i + span]) for i in range(max(1, len(flags) - span + 1)))
            if best >= math.ceil(agree * span):
                out[item] = max(best, out.get(item, 0))
    return out
