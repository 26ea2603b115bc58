"""Suffix arrays by induced sorting, and permuted common prefixes.

A first induction from the leftmost-smaller places sorts the substrings between them; their names make a reduced
string, whose suffix array, found the same way, gives the order from which a second induction sorts all suffixes.
The first level has the byte alphabet: its inductions run bucket by bucket on whole numpy arrays. Reduced strings
have as many symbols as distinct leftmost-smaller substrings; their inductions are plain linear scans.
"""

from __future__ import annotations

import numpy as np

#: Largest alphabet whose buckets are induced as arrays.
SMALL = 1024


def smaller_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the end of the string is smallest)."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = (s[1:] > s[:-1]).astype(np.int8) - (s[1:] < s[:-1])
    step[-1] = -1
    place = np.where(step != 0, np.arange(n), n - 1)
    decided = np.minimum.accumulate(place[::-1])[::-1]
    return step[decided] > 0


def leftmost_smaller(smaller: np.ndarray) -> np.ndarray:
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _induce_buckets(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Suffix array from leftmost-smaller suffixes in the given order, bucket by bucket."""
    n, k = len(s), len(size)
    tail = np.cumsum(size)
    head = tail - size
    sa = np.full(n, -1, np.int32)
    seeds = np.bincount(s[lms], minlength=k)
    by = lms[np.argsort(s[lms], kind="stable")] if len(lms) else lms
    seed_at = np.cumsum(seeds) - seeds
    free = head.copy()

    def put_larger(before):
        before = before[before >= 0]
        before = before[~smaller[before]]
        if not len(before):
            return
        c = s[before]
        order = np.argsort(c, kind="stable")
        before, c = before[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        count = np.diff(np.concatenate([first, [len(c)]]))
        sa[free[c] + np.arange(len(c)) - np.repeat(first, count)] = before
        free[c[first]] += count

    put_larger(np.array([n - 1]))
    for c in range(k):
        if not size[c]:
            continue
        done = head[c]
        while done < free[c]:
            part = sa[done : free[c]]
            done = free[c]
            put_larger(part - 1)
        if seeds[c]:
            put_larger(by[seed_at[c] : seed_at[c] + seeds[c]] - 1)
    larger_end = free.copy()
    free = tail.copy()

    def put_smaller(before):
        """before: in descending order of the suffixes that follow."""
        before = before[before >= 0]
        before = before[smaller[before]]
        if not len(before):
            return
        c = s[before]
        order = np.argsort(c, kind="stable")
        before, c = before[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        count = np.diff(np.concatenate([first, [len(c)]]))
        sa[free[c] - 1 - (np.arange(len(c)) - np.repeat(first, count))] = before
        free[c[first]] -= count

    for c in range(k - 1, -1, -1):
        if not size[c]:
            continue
        done = tail[c]
        while done > free[c]:
            part = sa[free[c] : done][::-1]
            done = free[c]
            put_smaller(part - 1)
        if larger_end[c] > head[c]:
            put_smaller(sa[head[c] : larger_end[c]][::-1] - 1)
    return sa


def _induce_scan(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same as two scans over the array, for alphabets with many small buckets."""
    n = len(s)
    tail = np.cumsum(size)
    # of each place the symbol before it, if a larger (or smaller) suffix starts there; place n stands for no suffix
    larger_before, smaller_before = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    larger_before[1:n][~smaller[:-1]] = s[:-1][~smaller[:-1]]
    smaller_before[1:n][smaller[:-1]] = s[:-1][smaller[:-1]]
    of = s[lms]
    by = np.argsort(of, kind="stable")
    seeds = np.bincount(of, minlength=len(size))
    seed_at = (tail - np.cumsum(seeds))[of[by]] + np.arange(len(lms))
    start = np.full(n, n, np.int64)
    start[seed_at] = lms[by]
    sa, head, before = start.tolist(), (tail - size).tolist(), larger_before.tolist()
    c = int(s[n - 1])
    sa[head[c]] = n - 1
    head[c] += 1
    for p in sa:  # sees what is put behind
        c = before[p]
        if c >= 0:
            h = head[c]
            sa[h] = p - 1
            head[c] = h + 1
    for i in seed_at.tolist():  # leftmost-smaller suffixes are placed anew from the right
        sa[i] = n
    end, before = tail.tolist(), smaller_before.tolist()
    for p in reversed(sa):
        c = before[p]
        if c >= 0:
            e = end[c] - 1
            sa[e] = p - 1
            end[c] = e
    return np.array(sa, np.int32)


def different(s: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether s[a : a + length] and s[b : b + length] differ, for arrays of places and lengths."""
    out = np.zeros(len(a), bool)
    live, t, width = np.flatnonzero(length > 0), 0, 8
    while len(live):
        step = np.arange(t, t + width)
        inside = step < length[live][:, None]
        x, y = (s[np.minimum(p[live][:, None] + step, len(s) - 1)] for p in (a, b))
        no = ((x != y) & inside).any(1)
        out[live[no]] = True
        t += width
        live = live[~no]
        live = live[length[live] > t]
        width = max(8, min(2 * width, (1 << 20) // max(len(live), 1)))
    return out


def substring_names(s: np.ndarray, sa: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the leftmost-smaller substrings in text order, equal for equal ones, and their number.

    sa is induced from the leftmost-smaller places in text order, which sorts these substrings (each runs to the next
    such place, that one included). The last one ends with the string and is equal to none.
    """
    place = np.full(len(s), -1, np.int64)
    place[lms] = np.arange(len(lms))
    order = place[sa]
    order = order[order >= 0]
    length = np.append(np.diff(lms) + 1, 0)[order]
    a, b = order[:-1], order[1:]
    new = (length[:-1] != length[1:]) | (length[:-1] == 0)
    new[~new] = different(s, lms[a[~new]], lms[b[~new]], length[1:][~new])
    name = np.zeros(len(lms), np.int64)
    name[order] = np.concatenate([[0], np.cumsum(new)])
    return name, int(new.sum()) + 1


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of symbols 0 .. k-1 (the end sorts before every symbol)."""
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    size = np.bincount(s, minlength=k)
    if size.max() == 1:
        return np.argsort(s, kind="stable").astype(np.int32)
    smaller = smaller_types(s)
    lms = leftmost_smaller(smaller)
    induce = _induce_buckets if k <= SMALL else _induce_scan
    if len(lms) > 1:
        names, kinds = substring_names(s, induce(s, smaller, lms, size), lms)
        # names that are all different are the order already
        lms = lms[suffix_array(names.astype(np.int32), kinds) if kinds < len(lms) else np.argsort(names)]
    return induce(s, smaller, lms, size)


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position, the common prefix with the suffix before it in the array, counted up to `most`.

    s is a byte array; eight bytes are compared at once, and the lowest differing bit tells the first difference.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.zeros(n + most + 16, np.uint8)
    padded[:n] = s
    words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    out = np.zeros(n, np.int32)
    live = np.flatnonzero(before >= 0)
    for t in range(0, most, 8):
        x = words[live + t] ^ words[before[live] + t]
        same = x == 0
        low = x[~same]
        out[live[~same]] = t + (np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int32) >> 3)
        live = live[same]
        if not len(live):
            break
    out[live] = most
    place = np.maximum(np.arange(n), before)
    return np.minimum(out, np.minimum(most, n - place)).astype(np.int16)
