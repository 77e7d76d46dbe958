"""Re-Pair grammar compression of token-id shards (operator 1).

Each round counts adjacent pairs of the whole shard and replaces many frequent ones at once. The pairs of a round use
every symbol in one role only (left or right), so no two replacements overlap; a pair of two equal symbols has its symbol
to itself and is replaced from the left of each run. Rounds go on until no pair is met often enough to pay for its rule:
a rule takes 12 bytes, a use of it saves a symbol of two or three. Pairs never cross documents.

A shard stores its rules, each rule's expansion length, the symbol sequence and the documents' symbol offsets: a document,
or any range of its ids, is found by prefix sums of expansion lengths and decoded without the rest.

After the first round only places are looked at that can still matter: those whose pair was frequent, and those beside a
new symbol. No other pair can become frequent, as replacing never puts two old symbols side by side.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

MAGIC = b"VGRP2\0\0\0"
#: Uses that pay for a rule; pairs chosen in a round; so few places are counted by sorting.
LEAST, MOST, FEW = 6, 16_384, 300_000
_SLOTS = 1 << 20


def _choose(pairs: np.ndarray, counts: np.ndarray, least: int, most: int) -> np.ndarray:
    """The most frequent pairs whose symbols keep to one role, which the first pair kept gives a symbol.

    In each turn all pairs are settled before which no open pair has a symbol of theirs without a role.
    """
    order = np.flatnonzero(counts >= least)
    order = order[np.lexsort((pairs[order, 1], pairs[order, 0], -counts[order]))]
    left, right = pairs[order].T.astype(np.intp)
    role = np.zeros(int(pairs.max(initial=0)) + 1, np.int8)  # 1 left, 2 right, 3 both
    first = np.zeros(len(role), np.int64)
    keep, rest = np.zeros(len(order), bool), np.arange(len(order))
    while len(rest):
        a, b = left[rest], right[rest]
        fits = (role[a] <= (a != b)) & (role[b] % 2 == 0)
        rest, a, b = rest[fits], a[fits], b[fits]
        place = np.arange(len(rest))
        first[np.stack([a, b], axis=1).ravel()[::-1]] = np.repeat(place, 2)[::-1]
        sure = ((role[a] == 1) | (first[a] == place)) & ((role[b] == 2) | (first[b] == place))
        keep[rest[sure]] = True
        role[a[sure]] = 1
        role[b[sure]] = 2
        role[a[sure & (a == b)]] = 3
        rest = rest[~sure]
    return order[np.flatnonzero(keep)[:most]]


def _by_slots(left: np.ndarray, right: np.ndarray, least: int, most: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, their rules, the pairs of a round, and the places that may be frequent, counted by hash slots.

    Another hash each turn, as a slot counts its first pair only.
    """
    odd = np.uint32(0x85EBCA6B + 2 * turn * 0x51ED270B & 0xFFFFFFFF)
    slot = (((left * np.uint32(0x9E3779B1)) ^ (right * odd)) >> np.uint32(12)).astype(np.intp)
    count = np.bincount(slot, minlength=_SLOTS)
    often = np.flatnonzero(count >= least)
    top = often
    if len(top) > 4 * most:
        top = top[np.argpartition(-count[top], 4 * most)[: 4 * most]]
    # each place's rank among the top slots; -1: a frequent slot, -2: none
    rank = np.full(_SLOTS, -2, np.int32)
    rank[often] = -1
    rank[top] = np.arange(len(top))
    of_place = rank.take(slot)
    del slot, count
    maybe, at = np.flatnonzero(of_place > -2), np.flatnonzero(of_place >= 0)
    r = of_place.take(at).astype(np.intp)
    key = left.take(at).astype(np.uint64) << np.uint64(32) | right.take(at)
    pair_key = np.zeros(len(top), np.uint64)
    pair_key[r[::-1]] = key[::-1]  # the first pair met stands for its slot
    same = np.flatnonzero(pair_key.take(r) == key)
    del key
    r = r.take(same)
    pair = _halves(pair_key)
    keep = _choose(pair, np.bincount(r, minlength=len(top)), least, most)
    number = np.full(len(top), -1, np.int32)
    number[keep] = np.arange(len(keep))
    rule = number.take(r)
    ok = np.flatnonzero(rule >= 0)
    return at.take(same.take(ok)), rule.take(ok), pair[keep], maybe


def _halves(key: np.ndarray) -> np.ndarray:
    """Pairs of symbols from their 64-bit keys."""
    return np.stack([key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)


def _exactly(left: np.ndarray, right: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``_by_slots``, from sorted pairs: none that is frequent is missed."""
    key = (left.astype(np.uint64) << np.uint64(32)) | right
    kinds, which, count = np.unique(key, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count >= least)
    pair = _halves(kinds[often])
    keep = _choose(pair, count[often], least, most)
    number = np.full(len(kinds), -1, np.int32)
    number[often[keep]] = np.arange(len(keep))
    rule = number[which]
    at = np.flatnonzero(rule >= 0)
    return at, rule[at], pair[keep], np.flatnonzero((count >= least)[which])


def _from_left(at: np.ndarray, rule: np.ndarray, pairs: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without every second place of a run of one symbol, as those overlap the places before. after: each place's next."""
    twins = pairs[:, 0] == pairs[:, 1]
    if not twins.any():
        return at, rule
    equal = np.flatnonzero(twins.take(rule))
    place, follow, of = at.take(equal), after.take(equal), rule.take(equal)
    fresh = np.concatenate([[True], (place[1:] != follow[:-1]) | (of[1:] != of[:-1])])[: len(equal)]
    turn = np.arange(len(equal))
    stay = np.ones(len(at), bool)
    stay[equal[(turn - np.maximum.accumulate(np.where(fresh, turn, 0))) % 2 == 1]] = False
    return at[stay], rule[stay]


def compress(ids: np.ndarray, doc_lengths: np.ndarray, first_free: int, most: int = MOST, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rules[n, 2], symbols of each document). Rule k makes symbol first_free + k."""
    size = len(ids)
    seq = ids.astype(np.uint32)
    ends = np.cumsum(doc_lengths)  # documents are never empty: each ends with the end id
    # places form a list per document; ``size`` stands for none
    after, before = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32)
    after[ends - 1] = size
    before[np.concatenate([[0], ends[:-1]])] = size
    after, before = np.append(after, np.int32(size)), np.append(before, np.int32(size))
    gone, pairable = np.zeros(size, bool), after < size  # no longer in the list; has a next place
    pairable[size] = False
    where = np.flatnonzero(pairable)
    rules, n, turn = [np.empty((0, 2), np.uint32)], 0, 0
    while len(where):
        follow = after.take(where)
        left, right = seq.take(where), seq.take(follow)
        exact = len(where) <= FEW
        at, rule, pairs, maybe = _exactly(left, right, least, most) if exact else _by_slots(left, right, least, most, turn)
        turn += 1
        if exact and not len(pairs):
            break
        at, rule = _from_left(where.take(at), rule, pairs, follow.take(at))
        second = after.take(at)
        third = after.take(second)
        seq[at] = (first_free + n + rule).astype(np.uint32)
        gone[second] = True
        pairable[second] = False
        pairable[at] = third < size
        after[at] = third
        before[third] = at  # the place ``size`` is written, never read
        look = np.zeros(size + 1, bool)
        look[where.take(maybe)] = True
        look[at] = True
        look[before.take(at)] = True
        where = np.flatnonzero(look & pairable)
        rules.append(pairs)
        n += len(pairs)
    alive = ~gone
    return seq[alive], np.concatenate(rules), np.diff(np.concatenate([[0], np.cumsum(alive)[ends - 1]]))


def _blocks(rules: np.ndarray, first_free: int) -> Iterator[tuple[int, int]]:
    """Ranges of rules that use only ids and rules before the range."""
    uses = np.maximum.accumulate(rules.max(axis=1, initial=0).astype(np.int64) - first_free) if len(rules) else np.empty(0)
    begin = 0
    while begin < len(rules):
        end = int(np.searchsorted(uses, begin))
        yield begin, end
        begin = end


def expansion_lengths(rules: np.ndarray, first_free: int) -> np.ndarray:
    """Ids that each rule expands to; a rule uses only ids and earlier rules."""
    size = np.ones(first_free + len(rules), np.int64)
    for begin, end in _blocks(rules, first_free):
        size[first_free + begin : first_free + end] = size[rules[begin:end]].sum(axis=1)
    return size[first_free:]


def pack(doc_ids: np.ndarray, valid: np.ndarray, doc_lengths: np.ndarray, ids: np.ndarray, vocab: int) -> bytes:
    """One shard: header, then doc ids, validity, id counts, symbol counts, rules, expansion lengths, sequence."""
    seq, rules, doc_symbols = compress(ids, doc_lengths, vocab) if len(ids) else (ids, np.empty((0, 2), np.uint32), np.empty(0, np.int64))
    # symbols are stored as planes: the low 16 bits of all, then as many bytes more as they need
    more = max(0, -(-((vocab + len(rules) - 1).bit_length() - 16) // 8))
    planes = [seq.astype("<u2"), *((seq >> np.uint32(16 + 8 * k)).astype("u1") for k in range(more))]
    head = struct.pack("<8sIIQQB", MAGIC, vocab, len(rules), len(doc_ids), len(seq), more)
    parts = [doc_ids.astype("<i8"), valid.astype("u1"), doc_lengths.astype("<u8"), doc_symbols.astype("<u8"), rules.astype("<u4"), expansion_lengths(rules, vocab).astype("<u4"), *planes]
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """A read shard; ``document(k)`` decodes one document, ``ids()`` all."""

    def __init__(self, raw: bytes):
        magic, self.vocab, n_rules, n_docs, n_seq, more = struct.unpack_from("<8sIIQQB", raw)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize("<8sIIQQB")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.valid, self.lengths, self.symbols = take("<i8", n_docs), take("u1", n_docs).astype(bool), take("<u8", n_docs).astype(np.int64), take("<u8", n_docs).astype(np.int64)
        self.rules, lengths = take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules).astype(np.int64)
        self.seq = take("<u2", n_seq)
        for k in range(more):
            self.seq = self.seq.astype("<u4") | (take("u1", n_seq).astype("<u4") << np.uint32(16 + 8 * k))
        # expansions of all symbols end to end: ids stand for themselves, rules copy what they use
        self.size = np.concatenate([np.ones(self.vocab, np.int64), lengths])
        self.at = np.concatenate([np.arange(self.vocab), self.vocab + np.cumsum(lengths) - lengths]).astype(np.int64)
        self.flat = np.empty(self.vocab + int(lengths.sum()), "<u4")
        self.flat[: self.vocab] = np.arange(self.vocab)
        for begin, end in _blocks(self.rules, self.vocab):
            own = self.expand(self.rules[begin:end].ravel())
            to = self.at[self.vocab + begin]
            self.flat[to : to + len(own)] = own
        self.ends = np.cumsum(self.symbols)

    def expand(self, seq: np.ndarray) -> np.ndarray:
        seq = seq.astype(np.int64)
        sizes = self.size[seq]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.at[seq] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def document(self, k: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids [begin, end) of document k: only the symbols that cover them are expanded."""
        own = self.seq[self.ends[k] - self.symbols[k] : self.ends[k]]
        ends = np.cumsum(self.size[own])
        end = int(self.lengths[k]) if end is None else min(end, int(self.lengths[k]))
        if begin >= end:
            return np.empty(0, "<u4")
        lo, hi = int(np.searchsorted(ends, begin, "right")), int(np.searchsorted(ends, end, "left"))
        skip = begin - int(ends[lo - 1] if lo else 0)
        return self.expand(own[lo : hi + 1])[skip : skip + end - begin]

    def ids(self) -> np.ndarray:
        return self.expand(self.seq)
