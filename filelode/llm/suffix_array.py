"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller or larger than their successor; the leftmost smaller ones, with what reaches to the
next of them, are sorted by induction, named, and ordered by the suffix array of their names, recursively; all others
follow from their order by two linear passes over the buckets of first symbols. A bucket is induced in batches, one for
each step of a run of its symbol; the named strings, with alphabets nearly as large as they are long, are induced symbol
by symbol.
"""

from __future__ import annotations

import numpy as np


def smaller_suffixes(s: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next; ``s`` ends with a symbol smaller than all others."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    decisive = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = np.append(step, 1)[decisive] > 0
    return out


def _dealt(places: np.ndarray, symbols: np.ndarray, to: list[list[np.ndarray]]) -> None:
    """Append ``places`` to the buckets of ``symbols``, order kept."""
    if not len(places):
        return
    order = np.argsort(symbols, kind="stable")
    places, symbols = places[order], symbols[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    starts = [0, *cuts.tolist()]
    for a, b in zip(starts, [*starts[1:], len(places)]):
        to[symbols[a]].append(places[a:b])


def _induced(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in the order that the given order of leftmost-smaller ones induces."""
    large: list[list[np.ndarray]] = [[] for _ in range(size)]
    tails: list[list[np.ndarray]] = [[] for _ in range(size)]
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    none = np.zeros(0, np.int64)
    _dealt(lms, s[lms], seeds)
    done: list[np.ndarray] = []
    for c in range(size):
        now, out = np.concatenate(large[c]) if large[c] else none, []
        while len(now):
            out.append(now)
            j = now[now > 0] - 1
            j = j[~small[j]]
            symbols = s[j]
            same = symbols == c
            _dealt(j[~same], symbols[~same], large)
            now = j[same]
        done.append(np.concatenate(out) if out else none)
        if seeds[c]:
            j = np.concatenate(seeds[c])
            j = j[j > 0] - 1
            j = j[~small[j]]
            _dealt(j, s[j], large)
    parts: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        now, out = np.concatenate(tails[c]) if tails[c] else none, []
        while len(now):
            out.append(now)
            j = now[now > 0] - 1
            j = j[small[j]]
            symbols = s[j]
            same = symbols == c
            _dealt(j[~same], symbols[~same], tails)
            now = j[same]
        j = done[c][::-1]
        j = j[j > 0] - 1
        j = j[small[j]]
        _dealt(j, s[j], tails)
        if out:
            parts.append(np.concatenate(out)[::-1])
        elif c == 0:
            parts.append(np.array([len(s) - 1]))
        parts.append(done[c])
    return np.concatenate(parts[::-1])


def _induce_names(s: list[int], size: int) -> list[int]:
    """The suffix array of a list of names that ends with its only 0, symbol by symbol."""
    n = len(s)
    if n == 1:
        return [0]
    small = [False] * n
    small[-1] = True
    for i in range(n - 2, -1, -1):
        small[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and small[i + 1])
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]
    counts = [0] * size
    for c in s:
        counts[c] += 1
    ends, total = [], 0
    for k in counts:
        total += k
        ends.append(total)
    starts = [e - k for e, k in zip(ends, counts)]

    # the symbol before a suffix if that makes a larger, or smaller, suffix, else -1; the last entry is that of no suffix
    to_large = [-1, *(-1 if t else c for c, t in zip(s, small))]
    to_small = [-1, *(c if t else -1 for c, t in zip(s, small))]
    to_large[n] = to_small[n] = -1  # nothing follows the last symbol

    def induced(order: list[int]) -> list[int]:
        out = [-1] * n
        tail = ends[:]
        for i in reversed(order):
            c = s[i]
            tail[c] -= 1
            out[tail[c]] = i
        head = starts[:]
        for i in out:  # fills up ahead of the loop
            c = to_large[i]
            if c >= 0:
                out[head[c]] = i - 1
                head[c] += 1
        tail = ends[:]
        for i in reversed(out):
            c = to_small[i]
            if c >= 0:
                tail[c] -= 1
                out[tail[c]] = i - 1
        return out

    follows = {a: b for a, b in zip(lms, lms[1:])}
    is_lms = bytearray(n)
    for i in lms:
        is_lms[i] = 1
    found = [i for i in induced(lms) if is_lms[i]]
    names, name, last = {}, -1, None
    for i in found:
        end = follows.get(i, i)
        part = s[i : end + 1]
        if last is None or part != last:
            name += 1
            last = part
        names[i] = name
    if name + 1 < len(lms):
        order = [lms[i] for i in _induce_names([names[i] for i in lms], name + 1)]
    else:
        order = found
    return induced(order)


def suffix_array(data: np.ndarray, size: int) -> np.ndarray:
    """Places of the suffixes of ``data`` (symbols from 1 to ``size - 1``) in order."""
    s = np.append(data, 0).astype(np.int64)
    n = len(s)
    small = smaller_suffixes(s)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) > 1:
        found = _induced(s, small, lms, size)
        found = found[is_lms[found]]
        ends = np.append(lms[1:], n - 1)
        rank = np.empty(n, np.int64)
        rank[lms] = np.arange(len(lms))
        stop = ends[rank[found]]
        with np.errstate(over="ignore"):
            base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
            powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]))
            back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse)]))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((s + 1).astype(np.uint64) ** np.uint64(3) * powers[:n])])
            digest = (sums[stop + 1] - sums[found]) * back[found]
        new = np.ones(len(found), bool)
        new[1:] = (digest[1:] != digest[:-1]) | ((stop - found)[1:] != (stop - found)[:-1])
        name = np.cumsum(new) - 1
        if name[-1] + 1 < len(found):
            names = np.empty(len(lms), np.int64)
            names[rank[found]] = name
            found = lms[np.array(_induce_names(names.tolist(), int(name[-1]) + 1), np.int64)]
        lms = found
    return _induced(s, small, lms, size)[1:]


def permuted_common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place the length of the prefix that its suffix shares with the suffix before it in order.

    Where the symbols before both are equal, the length is one less than at the place before; all others are compared.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    same = (i > 0) & (before > 0)
    same[same] = data[i[same] - 1] == data[before[same] - 1]
    fixed = np.flatnonzero(~same)
    length = np.zeros(n, np.int64)
    x, y, at = fixed, before[fixed], fixed
    live = y >= 0
    x, y, at = x[live], y[live], at[live]
    width, place = 32, np.arange(32)
    padded = np.concatenate([data.astype(np.int16), np.full(width, -1, np.int16)])
    while len(x):
        differs = (padded[np.minimum(x[:, None] + place, n)] != padded[np.minimum(y[:, None] + place, n)]) | (np.maximum(x, y)[:, None] + place >= n)
        some = differs.any(axis=1)
        length[at] += np.where(some, differs.argmax(axis=1), width)
        x, y, at = x[~some] + width, y[~some] + width, at[~some]
    last = np.maximum.accumulate(np.where(same, 0, i))
    return length[last] - (i - last)
