"""Array steps of the suffix-array de-duplication: bucket identifiers, anchors and bucket-pointer refinement.

Everything here works on one bounded block of bytes with numpy; Spark deals the blocks and the buckets.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
MUL = U(0xD6E8FEB86659FD93)
#: Bytes of documents that are handled at once. Arrays of this length stay in a core's cache.
BLOCK = 1 << 17
POS_BITS = 20
POS_MASK = U((1 << POS_BITS) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= MUL
    x ^= x >> U(29)
    return x


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The identifier of the bucket whose members agree on both identifiers."""
    x = left * ODD
    x += right
    return mix(x)


def identifiers(buf: np.ndarray, q: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of every position at depth ``q`` and at depth ``length``.

    A position's bucket at depth 2k is named by its bucket at depth k and the bucket k bytes later, so that each
    refinement reuses the identifiers of the last one.
    """
    ids = mix(buf.astype(U) + ODD)
    depth, at_q = 1, ids
    while depth * 2 <= length:
        ids = pair(ids[:-depth], ids[depth:])
        depth *= 2
        if depth == q:
            at_q = ids
    if depth < length:
        ids = pair(ids[: len(ids) - (length - depth)], ids[length - depth :])
    return at_q, ids


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    k = 1
    while k * 2 <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (w - k)], x[w - k :]) if k < w else x


def anchors(buf: np.ndarray, start: np.ndarray, end: np.ndarray, q: int, length: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts that share one anchor, for documents laid end to end in ``buf``.

    Each window of ``length`` bytes is filed under the leftmost q-gram in it with the least identifier, so that equal
    windows have equal anchors at equal offsets. Returns, for each run: document number, anchor identifier, identifier
    of all bytes that the run's windows cover, and the positions in ``buf`` of anchor, first and last window.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none.view(U), none.view(U), none, none, none
    at_q, at_len = identifiers(buf, q, length)
    order = (at_q & ~POS_MASK) | np.arange(len(at_q), dtype=U)
    place = (sliding_min(order, length - q + 1) & POS_MASK).astype(np.int64)
    which = np.searchsorted(end, np.arange(len(place)), side="right")
    fits = np.zeros(len(place) + 1, np.int32)
    a, b = start, np.maximum(end - length + 1, start)
    np.add.at(fits, np.minimum(a, len(place)), 1)
    np.add.at(fits, np.minimum(b, len(place)), -1)
    good = np.cumsum(fits[:-1]) > 0
    s = np.flatnonzero(good)
    if not len(s):
        return none, none.view(U), none.view(U), none, none, none
    p, d = place[s], which[s]
    new = np.r_[True, (p[1:] != p[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)]
    at = np.flatnonzero(new)
    lo, hi, p, d = s[at], s[np.r_[at[1:] - 1, len(s) - 1]], p[at], d[at]
    sig = pair(pair(at_len[lo], at_len[hi]), ((p - lo) * 128 + (p - hi)).astype(U))
    return d, at_q[p], sig, p, lo, hi


def digests(buf: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two identifiers of the ``length`` bytes from every position on, 128 bits together."""
    return identifiers(buf, 1, length)[1], identifiers(buf ^ np.uint8(0xA5), 1, length)[1]


def _numbered(key: np.ndarray, *parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal keys together and a flag for the first of each; ``key`` is a hash of ``parts``, if any."""
    o = np.argsort(key)
    new = np.r_[True, key[o][1:] != key[o][:-1]] if len(o) else np.zeros(0, bool)
    differ = np.zeros(max(0, len(o) - 1), bool)
    for x in parts:
        differ |= x[o][1:] != x[o][:-1]
    if (differ & ~new[1:]).any():  # two kinds have one hash
        o = np.lexsort(parts)
        new = np.r_[True, np.logical_or.reduce([x[o][1:] != x[o][:-1] for x in parts])]
    return o, new


def refine(buf: np.ndarray, begin: np.ndarray, first: np.ndarray, count: np.ndarray, group: np.ndarray, rank: np.ndarray, length: int, q: int = 8) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket-pointer refinement of the windows in some contexts; tells which windows start earlier elsewhere.

    Context i has ``count[i]`` windows from ``begin[i]`` in ``buf`` on, the first at offset ``first[i]`` to its anchor;
    ``group`` is its anchor, and contexts are in order of document and position by ``rank``. Every position of a context
    points to its bucket: at first those of its anchor, with its offset, that begin with the same q-gram. A round sorts
    the members of buckets on the pointers of their members' later offsets, as many bytes on as the buckets agree on, and
    writes the new pointers back, so that the next round reads them at its later offsets: what buckets agree on doubles
    each time. A position that is alone keeps a pointer of its own and is not sorted again.

    Returns contexts and window numbers of windows that are not the first of their kind, and the number of rounds.
    Windows of the same place (equal rank and position) count as one.
    """
    size = count + (length - 1)
    start = np.cumsum(size) - size
    ctx = np.repeat(np.arange(len(size)), size)
    nth = np.arange(int(size.sum())) - np.repeat(start, size)
    place = nth + np.repeat(begin, size)
    words = np.zeros(len(buf), U)
    for k in range(q):
        words[: len(buf) - k] |= buf[k:].astype(U) << U(8 * (q - 1 - k))
    left = np.repeat(size, size) - nth  # bytes of the context from here on
    slot = np.repeat(group.astype(np.int64) * 256 + first + 128, size) - nth
    live = np.flatnonzero((np.bincount(slot)[slot] > 1) & (left >= q))
    pointer = np.full(len(ctx), -1)  # of a position that is alone
    depth, rounds, parts = q, 0, (words[place[live]], slot[live])
    key = pair(parts[1].astype(U), parts[0])
    while True:
        o, new = _numbered(key, *parts)
        alone = new & np.r_[new[1:], True] if len(o) else new
        pointer[live] = -1
        live, number = live[o[~alone]], (np.cumsum(new) - 1)[~alone]
        pointer[live] = number
        if depth == length or not len(live):
            break
        step, parts = min(depth, length - depth), ()
        rounds += 1
        far = left[live] >= depth + step
        here, number = live[far], number[far]
        later = pointer[here + step]
        met = later >= 0
        live, key = here[met], number[met] * (int(number.max(initial=0)) + int(later.max(initial=0)) + 1) + later[met]
        fresh = np.full(len(ctx), -1)
        pointer, depth = fresh, depth + step
    at = rank[ctx[live]]
    o = np.lexsort((nth[live], at, number))
    live, number, at = live[o], number[o], at[o]
    new = np.r_[True, number[1:] != number[:-1]] if len(live) else np.zeros(0, bool)
    lead = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))] if len(live) else live
    again = ~new & (rank[ctx[lead]] != at)
    return ctx[live[again]], nth[live[again]], rounds
