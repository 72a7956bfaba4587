"""Suffix arrays by induced sorting, and common prefixes in text order.

Positions are classified as larger (L) or smaller (S) than their right neighbour; leftmost S positions (LMS)
part the text into substrings. These are sorted by an induction from any order of their first letters, named,
and the string of their names is sorted the same way; its order gives that of the LMS suffixes, from which one
more induction gives all suffixes. Over bytes a bucket is induced at a time in numpy; over the names, whose
buckets hold a position or two, position by position.
"""

from __future__ import annotations

import numpy as np

#: Letters up to which whole buckets are handled at a time.
FEW = 1024
#: Positions in a lane along which common prefixes are carried.
LANE = 512


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` (whole numbers from 0) in the order of their suffixes; a text sorts before its extensions."""
    if len(text) < 2:
        return np.arange(len(text))
    s = np.concatenate([np.asarray(text, np.int64) + 1, [0]])
    return _sorted(s, int(s.max()) + 1)[1:]


def _types(s: np.ndarray) -> np.ndarray:
    """True for S; the last position, whose letter is the least, is S."""
    differs = np.append(s[:-1] != s[1:], True)
    smaller = np.append(s[:-1] < s[1:], True)
    at = np.where(differs, np.arange(len(s)), len(s))
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # a run of equal letters has the type of its end
    return smaller[nearest]


def _sorted(s: np.ndarray, letters: int) -> np.ndarray:
    n = len(s)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce_buckets if letters <= FEW else _induce_positions
    first = induce(s, small, lms, letters)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = first[is_lms[first]]
    names, count = _names(s, lms, ranked)
    if count < len(lms):
        order = lms[_sorted(names, count)]
    else:
        order = ranked
    return induce(s, small, order, letters)


def _names(s: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the LMS substrings in text order, equal for equal substrings."""
    n = len(s)
    size = np.zeros(n, np.int64)
    size[lms] = np.append(np.diff(lms), 0)
    a, b = ranked[:-1], ranked[1:]
    differs = size[a] != size[b]
    open_ = np.flatnonzero(~differs)
    d = 0
    while len(open_):
        x, y = a[open_], b[open_]
        unlike = s[x + d] != s[y + d]
        differs[open_[unlike]] = True
        open_ = open_[~unlike & (d < size[x])]
        d += 1
    of = np.empty(n, np.int64)
    of[ranked] = np.concatenate([[0], np.cumsum(differs)])
    return of[lms], int(differs.sum()) + 1


def _induce_buckets(s: np.ndarray, small: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    n, narrow = len(s), s.astype(np.uint16)
    begin = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=letters))])
    sa = np.full(n, -1, np.int64)
    # LMS positions at the ends of their buckets, in the order given.
    order = np.argsort(narrow[lms], kind="stable")
    held = np.bincount(s[lms], minlength=letters)
    upto = np.cumsum(held)
    placed = lms[order]
    before = [placed[upto[c] - held[c] : upto[c]] for c in range(letters)]
    sa[0] = n - 1

    def deal(of: np.ndarray, at: np.ndarray, step: int) -> None:
        """Appends positions, in order, to the buckets of their letters."""
        by = np.argsort(narrow[of], kind="stable")  # of 16-bit numbers: a radix sort, linear
        chars = s[of[by]]
        first = np.flatnonzero(np.diff(chars, prepend=-1))
        size = np.diff(np.append(first, len(chars)))
        rank = np.arange(len(chars)) - np.repeat(first, size)
        sa[at[chars] + step * rank] = of[by]
        at[chars[first]] += step * size

    def sources(found: np.ndarray, kind: bool) -> np.ndarray:
        j = found[found > 0] - 1
        return j[small[j] == kind]

    head = begin[:-1].copy()
    for c in range(letters):
        at = begin[c]
        while at < head[c]:
            upto_, at = at, head[c]
            if len(j := sources(sa[upto_:at], False)):
                deal(j, head, 1)
        if len(before[c]) and len(j := sources(before[c], False)):
            deal(j, head, 1)
    tail = begin[1:] - 1
    for c in reversed(range(letters)):
        at = begin[c + 1] - 1
        while at > tail[c]:
            upto_, at = at, tail[c]
            if len(j := sources(sa[at + 1 : upto_ + 1][::-1], True)):
                deal(j, tail, -1)
        if head[c] > begin[c] and len(j := sources(sa[begin[c] : head[c]][::-1], True)):
            deal(j, tail, -1)
    sa[0] = n - 1
    return sa


def _induce_positions(s: np.ndarray, small: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    n = len(s)
    ends = np.cumsum(np.bincount(s, minlength=letters))
    heads, tails = (ends - np.bincount(s, minlength=letters)).tolist(), (ends - 1).tolist()
    letter, sa = s.tolist(), [-1] * n
    # Only positions left of an L (of an S) of their own kind are induced; the rest are marked.
    left = np.where(np.append([True], small[:-1]), -1, np.append([0], s[:-1])).tolist()  # letter of an L neighbour
    right = np.where(np.append([False], small[:-1]), np.append([0], s[:-1]), -1).tolist()  # letter of an S neighbour
    at = tails.copy()
    for p in lms[::-1].tolist():
        c = letter[p]
        sa[at[c]] = p
        at[c] -= 1
    for i in range(n):
        p = sa[i]
        if p > 0 and (c := left[p]) >= 0:
            k = heads[c]
            sa[k] = p - 1
            heads[c] = k + 1
    # S places are filled anew from the right; those not yet filled hold LMS positions that are overwritten
    # before they are read, for a bucket's S positions are all induced.
    at = tails
    for i in range(n - 1, -1, -1):
        p = sa[i]
        if p > 0 and (c := right[p]) >= 0:
            k = at[c]
            sa[k] = p - 1
            at[c] = k - 1
    return np.array(sa, np.int64)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """In text order, the common prefix of each suffix and the one ranked before it, up to ``most`` letters.

    A suffix shares with its neighbour at least what the one before it in the text shares with its own, less a
    letter, so the length is carried along the text and only what is beyond it is compared. The text is cut into
    lanes that are walked side by side; the carrying begins anew at the start of a lane.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    carried = np.zeros(-(-n // LANE), np.int64)
    for step in range(min(LANE, n)):
        at = np.arange(step, n, LANE)
        h = np.maximum(carried[: len(at)] - 1, 0)
        other = before[at]
        h[other < 0] = 0
        open_ = np.flatnonzero(other >= 0)
        while len(open_):
            k = h[open_]
            a, b = at[open_] + k, other[open_] + k
            fits = (k < most) & (np.maximum(a, b) < n)
            open_, a, b = open_[fits], a[fits], b[fits]
            open_ = open_[text[a] == text[b]]
            h[open_] += 1
        out[at] = carried[: len(at)] = h
    return out


def repeats_before(text: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """In text order, whether the common prefix of a suffix and the one ranked before it has ``length`` or more letters."""
    return permuted_prefixes(text, sa, length) >= length
