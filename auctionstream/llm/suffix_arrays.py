"""Suffix arrays by induced sorting, and permuted common prefixes, as array operations."""

from collections.abc import Callable

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one to its right; the sentinel at the end counts as such."""
    n = len(s)
    differs = s[1:] != s[:-1]
    following = np.where(differs, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(following[::-1])[::-1]
    rises = np.append(s[1:] > s[:-1], True)
    return np.append(rises[following], True)


def _dealt(places: np.ndarray, s: np.ndarray, waiting: dict[int, list[np.ndarray]]) -> None:
    """Append places to the buckets of their symbols, keeping their order."""
    if not len(places):
        return
    symbols = s[places]
    order = np.argsort(symbols, kind="stable")
    symbols, places = symbols[order], places[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    starts = [0, *cuts.tolist()]
    for symbol, part in zip(symbols[starts].tolist(), np.split(places, cuts)):
        waiting.setdefault(symbol, []).append(part)


def _bucket(first: list[np.ndarray], symbol: int, smaller: np.ndarray, s: np.ndarray, wanted: bool):
    """All suffixes of one type in a bucket, in the order in which a scan reaches them, and the
    predecessors of that type that belong to other buckets. Runs of one symbol take a step per symbol."""
    front = np.concatenate(first) if first else np.zeros(0, np.int64)
    found, others = [front], []
    while len(front):
        before = front[front > 0] - 1
        before = before[smaller[before] == wanted]
        same = s[before] == symbol
        others.append(before[~same])
        front = before[same]
        found.append(front)
    return np.concatenate(found), others


def _induced(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Sort all suffixes from leftmost-smaller ones given in (some) order: larger ones by a scan upwards
    from them, then smaller ones by a scan downwards."""
    symbols = np.unique(s).tolist()
    leftmost: dict[int, list[np.ndarray]] = {}
    _dealt(lms, s, leftmost)
    waiting: dict[int, list[np.ndarray]] = {}
    larger: dict[int, np.ndarray] = {}
    for c in symbols:
        larger[c], out = _bucket(waiting.pop(c, []), c, smaller, s, False)
        for part in leftmost.get(c, []):
            out.append(part[part > 0] - 1)
        _dealt(np.concatenate(out) if out else larger[c][:0], s, waiting)
    waiting = {}
    lesser: dict[int, np.ndarray] = {}
    for c in reversed(symbols):
        down, out = _bucket(waiting.pop(c, []), c, smaller, s, True)
        above = larger[c][::-1]
        above = above[above > 0] - 1
        out.append(above[smaller[above]])
        lesser[c] = down[::-1]
        _dealt(np.concatenate(out), s, waiting)
    lesser[symbols[0]] = np.array([len(s) - 1])  # the sentinel has no right neighbour to come from
    return np.concatenate([part for c in symbols for part in (larger[c], lesser[c])])


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the sorted leftmost-smaller substrings, equal ones alike, in the order of the text."""
    place = np.zeros(len(s), np.int64)
    place[lms] = np.arange(len(lms))
    lengths = np.append(np.diff(lms), 0) + 1
    index = place[order]
    same = np.append(False, lengths[index[1:]] == lengths[index[:-1]])
    open_ = np.flatnonzero(same)
    step = 0
    while len(open_):
        open_ = open_[lengths[index[open_]] > step]
        equal = s[order[open_] + step] == s[order[open_ - 1] + step]
        same[open_[~equal]] = False
        open_ = open_[equal]
        step += 1
    names = np.cumsum(~same) - 1
    out = np.empty(len(lms), np.int64)
    out[index] = names
    return out, int(names[-1]) + 1


def _induced_singly(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """As _induced, one place after the other, for names: their buckets are too small for an array operation each."""
    sizes = np.bincount(s)
    ends = np.cumsum(sizes)
    heads, tails = (ends - sizes).tolist(), (ends - 1).tolist()
    order = np.argsort(s[lms], kind="stable")
    symbols = s[lms][order]
    _, first, counts = np.unique(symbols, return_index=True, return_counts=True)
    within = np.arange(len(lms)) - np.repeat(first, counts)
    start = np.full(len(s), -1)
    start[ends[symbols] - np.repeat(counts, counts) + within] = lms[order]
    # By place: whether its left neighbour is induced from it. The last entry is read for places not yet known.
    left_larger = [False, *(~smaller[:-1]).tolist(), False]
    left_smaller = [False, *smaller[:-1].tolist(), False]
    symbol, sa = s.tolist(), start.tolist()
    for p in sa:
        if left_larger[p]:
            c = symbol[p - 1]
            sa[heads[c]] = p - 1
            heads[c] += 1
    for p in reversed(sa):
        if left_smaller[p]:
            c = symbol[p - 1]
            sa[tails[c]] = p - 1
            tails[c] -= 1
    return np.array(sa)


def suffix_array(s: np.ndarray, induced: Callable = _induced) -> np.ndarray:
    """Places of the sorted suffixes of ``s``, whose last symbol is 0 and occurs only there.

    Suffixes are classified, the leftmost-smaller substrings sorted by induction and named; the string of
    names is sorted recursively, and its order induces all the rest.
    """
    if len(s) < 3:
        return np.arange(len(s))[::-1].copy()
    smaller = _types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    first = induced(s, smaller, lms)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    names, n_names = _names(s, lms, first[is_lms[first]])
    order = np.argsort(names) if n_names == len(lms) else suffix_array(names, _induced_singly)
    return induced(s, smaller, lms[order])


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place: the suffix before its own in the order (-1 for the first), and the symbols they share.

    Where the symbols left of both are equal too, the value is one less than that of the place to the left;
    only the others are compared.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    left = np.where((place > 0) & (before > 0), s[np.maximum(place - 1, 0)] != s[np.maximum(before - 1, 0)], True)
    heads = place[left]
    shared = np.zeros(len(heads), np.int64)
    padded = np.append(s.astype(np.uint64), np.zeros(8, np.uint64))
    words = padded[: n + 4] | padded[1 : n + 5] << np.uint64(16) | padded[2 : n + 6] << np.uint64(32) | padded[3 : n + 7] << np.uint64(48)
    open_ = np.flatnonzero(before[heads] >= 0)
    while len(open_):
        a, b = heads[open_] + shared[open_], before[heads[open_]] + shared[open_]
        differ = words[a] ^ words[b]
        whole = differ == 0
        shared[open_[whole]] += 4
        rest = open_[~whole]
        d = differ[~whole]
        for symbols in (1, 2, 3):
            shared[rest] += (d & np.uint64((1 << 16 * symbols) - 1)) == 0
        open_ = open_[whole]
    head = np.maximum.accumulate(np.where(left, place, 0))
    value = np.zeros(n, np.int64)
    value[heads] = shared
    return before, value[head] - (place - head)
