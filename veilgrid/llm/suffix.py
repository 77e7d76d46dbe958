"""Suffix arrays by induced sorting, and permuted common prefixes, in array operations.

The scan order of induced sorting matters only between buckets of the first character. Inside a bucket, suffixes that
start a run of that character follow each other in rank order, so a whole bucket moves at once: the induced list is
extended by its runs, the predecessors are split by character with a stable sort, and each part is appended to its
bucket. Two such passes sort the leftmost-smaller (LMS) substrings; these are named, the string of names is sorted, and
two more passes induce all suffixes. The string of names has a large alphabet, where moving bucket by bucket degrades to
moving one suffix at a time; it is sorted by recursive naming of pairs (ranks of 2**k names from ranks of 2**(k-1)).
"""

from __future__ import annotations

import numpy as np

_I = np.int32


class _Induce:
    """Types, runs and buckets of one text (unsigned, 16 bits at most); its last character is a unique smallest 0."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.text, self.n = text, n
        step = np.sign(text[1:].astype(_I) - text[:-1].astype(_I))  # +1: smaller than the next
        differs = np.flatnonzero(step)
        # the type of a run is that of its last member
        nxt = np.searchsorted(differs, np.arange(n - 1))
        self.small = np.append(step[differs[np.minimum(nxt, len(differs) - 1)]] > 0, True) if n > 1 else np.array([True])
        lms = np.zeros(n, bool)
        lms[1:] = self.small[1:] & ~self.small[:-1]
        self.lms = np.flatnonzero(lms).astype(_I)
        count = np.bincount(text, minlength=int(text.max()) + 1)
        self.chars = np.flatnonzero(count)
        self.ends = np.cumsum(count)
        self.begins = self.ends - count
        # equal characters directly before each position
        start = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        self.run = (np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))).astype(_I)

    @staticmethod
    def _with_runs(first: np.ndarray, run: np.ndarray) -> np.ndarray:
        """first, then all first-1 that stay in the run, then all first-2, ..."""
        if not len(run) or not run.max():
            return first
        who = np.repeat(np.arange(len(first)), run + 1)
        back = np.arange(len(who)) - np.repeat(np.cumsum(run + 1) - (run + 1), run + 1)
        order = np.argsort(back, kind="stable")
        return (first[who] - back)[order].astype(_I)

    def _append(self, items: np.ndarray, place: np.ndarray, sa: np.ndarray, sign: int) -> None:
        """Put items at their buckets' open ends, in order. place: the next free slot of each bucket."""
        c = self.text[items]
        order = np.argsort(c, kind="stable")
        c = c[order]
        begin = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.append(begin, len(c)))
        rank = np.arange(len(c)) - np.repeat(begin, size)
        sa[place[c] + sign * rank] = items[order]
        place[c[begin]] += sign * size

    def sort(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes, induced from the LMS suffixes (or substrings) in the given order."""
        text, small, run, n = self.text, self.small, self.run, self.n
        sa = np.full(n, -1, _I)
        by_char = np.argsort(text[lms], kind="stable")
        seeds, cuts = lms[by_char], np.searchsorted(text[lms][by_char], np.arange(len(self.ends) + 1))
        place = self.begins.copy()
        for c in self.chars:
            # larger-typed suffixes of this bucket: those induced so far, then their runs
            first = sa[self.begins[c] : place[c]].copy()
            if len(first):
                full = self._with_runs(first, run[first])
                sa[self.begins[c] : self.begins[c] + len(full)] = full
                place[c] = self.begins[c] + len(full)
                # run members' predecessors are in the run; its first member's is of another character
                prev = full[(run[full] == 0) & (full > 0)] - 1
                prev = prev[~small[prev]]
                if len(prev):
                    self._append(prev, place, sa, 1)
            own = seeds[cuts[c] : cuts[c + 1]]
            if len(own):
                own = own[own > 0] - 1
                if len(own):
                    self._append(own, place, sa, 1)
        large_end = place.copy()
        place = self.ends - 1
        for c in self.chars[::-1]:
            # smaller-typed suffixes, from the right end; those seeded above are placed anew
            first = sa[place[c] + 1 : self.ends[c]][::-1].copy()
            if c == 0:
                first = np.array([n - 1], _I)
            if len(first):
                full = self._with_runs(first, run[first])
                sa[self.ends[c] - len(full) : self.ends[c]] = full[::-1]
                place[c] = self.ends[c] - 1 - len(full)
                prev = full[(run[full] == 0) & (full > 0)] - 1
                prev = prev[small[prev]]
                if len(prev):
                    self._append(prev, place, sa, -1)
            own = sa[self.begins[c] : large_end[c]][::-1]
            own = own[(own > 0) & (run[own] == 0)] - 1
            own = own[small[own]]
            if len(own):
                self._append(own, place, sa, -1)
        return sa


def _doubling(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names by recursive naming of pairs; only groups still tied are sorted again."""
    n = len(names)
    rank = names.astype(np.int64)
    sa = np.argsort(rank, kind="stable")
    tied = np.arange(n)  # slots of sa that are not settled
    own = rank[sa]
    head = np.concatenate([[True], own[1:] != own[:-1]])
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 1
    while True:
        lone = head & np.append(head[1:], True)
        tied = tied[~lone]
        if not len(tied):
            return sa
        at = sa[tied]
        after = at + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[at]
        order = np.argsort(first * (n + 2) + second, kind="stable")
        sa[tied] = at = at[order]
        first, second = first[order], second[order]
        head = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        rank[at] = tied[np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))]
        h *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of text (values 1 .. 65535 as uint16, then one final 0)."""
    text = np.ascontiguousarray(text, np.uint16)
    if len(text) < 2:
        return np.arange(len(text), dtype=_I)
    ind = _Induce(text)
    lms = ind.lms
    if len(lms) < 2:
        return ind.sort(lms)
    sa = ind.sort(lms)
    is_lms = np.zeros(ind.n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    # equal neighbours among the sorted LMS substrings get one name: first by length, then character by character
    where = np.empty(ind.n, _I)
    where[lms] = np.arange(len(lms))
    length = np.append(np.diff(lms), 0).astype(np.int64)  # the last one is the final 0 alone
    k = where[order]
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    same = np.flatnonzero(length[k[:-1]] == length[k[1:]])
    span = length[k[same]] + 1
    span[length[k[same]] == 0] = 1
    differ = np.zeros(len(same), bool)
    step = 1 << 16
    ends = np.cumsum(span)
    at = 0
    while at < len(same):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (step << 4))))
        s = span[at:to]
        off = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
        left, right = np.repeat(a[same[at:to]], s) + off, np.repeat(b[same[at:to]], s) + off
        differ[at:to] = np.add.reduceat((text[left] != text[right]) | (ind.small[left] != ind.small[right]), np.cumsum(s) - s) > 0
        at = to
    new = np.ones(len(order), np.int64)
    new[1:][same[~differ]] = 0
    name = np.empty(len(lms), np.int64)
    name[k] = np.cumsum(new) - 1
    if int(new.sum()) == len(lms):
        return ind.sort(order)
    return ind.sort(lms[_doubling(name)])


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """PLCP: for each position, the common prefix (up to ``most``) of its suffix with the one before it in sa.

    Positions whose predecessors match too are reducible: theirs is one less than the position before. Only the others
    are compared, eight characters a step.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    here = np.arange(n)
    before = np.maximum(phi - 1, 0)
    reducible = (phi > 0) & (here > 0)
    reducible &= text[np.maximum(here - 1, 0)] == text[before]
    # a run of reducible positions cannot outlive its prefix, and ``most`` cuts prefixes: restart where a cut one ends
    start = np.flatnonzero(~reducible)
    value = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(most + 8, text.dtype)])

    def compare(p: np.ndarray) -> np.ndarray:
        q, got = phi[p], np.zeros(len(p), np.int64)
        live = np.flatnonzero(q >= 0)
        while len(live):
            i, j = p[live] + got[live], q[live] + got[live]
            stop = np.full(len(live), 8, np.int64)
            for d in range(7, -1, -1):
                stop[padded[np.minimum(i + d, n)] != padded[np.minimum(j + d, n)]] = d
            stop = np.minimum(stop, np.minimum(n - i, n - j))
            got[live] += stop
            live = live[(stop == 8) & (got[live] < most)]
        return np.minimum(got, most)

    value[start] = compare(start)
    while True:
        owner = start[np.searchsorted(start, here, "right") - 1]
        out = value[owner] - (here - owner)
        # beyond a prefix cut at ``most`` the next reducible position may still have a long one: compare it directly
        open_ = reducible & (here - owner == 1) & (value[owner] == most)
        again = np.flatnonzero(open_)
        if not len(again):
            return np.maximum(out, 0)
        # all positions up to where the chain of cut prefixes ends have ``most``; find the ends by jumps
        jump = []
        for p in again.tolist():
            q, k = int(phi[p]), 0
            end = start[np.searchsorted(start, p)] if np.searchsorted(start, p) < len(start) else n
            limit = min(n - p, n - q, int(end - p) + most)
            while k < limit:
                size = min(1 << 14, limit - k)
                differ = np.flatnonzero(text[p + k : p + k + size] != text[q + k : q + k + size])
                if len(differ):
                    k += int(differ[0])
                    break
                k += size
            jump.append(k)
        value[again] = jump
        start = np.union1d(start, again)
        reducible[again] = False
