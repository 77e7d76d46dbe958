"""BPE encoding and decoding with the tokenizers library, long text by tree concatenation (operator 7).

White space ends every pre-token of this tokenizer family, so a text's ids are the ids of its white-space-free pieces in
order; pieces recur, so each worker keeps a bounded memo of them. A piece longer than ``leaf`` characters is encoded as a
tree: it is halved until leaves are short, leaves are encoded side by side, and neighbours are joined by re-encoding a
window around the join. The window grows until it and each half hold the same two adjacent tokens at the same offsets
(two, not one: two adjacent tokens that stand in a valid encoding remain valid next to each other, hence the spliced
sequence is the encoding of the whole), or until it spans both halves.

Defined cases: null is the empty text (no ids, empty decoding); special-token strings in a text are encoded as the
library does; texts with separators that only some regex engines call white space go to the library whole.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, release_memory

_DOUBTFUL = re.compile("[\x1c-\x1f]")
#: For texts of these characters alone, str.lower() is the normalizer and _RUNS the pre-tokenizer of the file.
_OTHER = re.compile("[^\x00-\x7f\u00c0-\u012f\u0131-\u024f]|<\\|")
_RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Fixed value: the pre-tokenizer pattern that _RUNS reproduces.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks that often end a piece; next to each other they are one run.
_ENDS = ".,;:!?#&"
_BATCH_CHARS = 2_000_000
_SLICE_CHARS = 8_000_000


class _Memo(dict):
    """Values of a function of strings. A value is kept once its key was met ``often``, as most never are; a full memo starts anew."""

    def __init__(self, make: Callable[[str], bytes], most: int, often: int, longest: int = 64):
        self.make, self.most, self.often, self.longest, self.met = make, most, often, longest, bytearray(1 << 22)

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        slot = hash(key) & 0x3FFFFF
        times = self.met[slot] + 1
        if times < self.often:
            self.met[slot] = times
        elif len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def _strings(column: pa.Array) -> list[str]:
    """As to_pylist, without a scalar for each value."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _taken(sizes: np.ndarray, flat: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values, end to end, of the lists picked from those that sizes and flat hold."""
    lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), flat)
    return sizes[which], lists.take(pa.array(which)).flatten().to_numpy()


class PieceEncoder:
    """Encodes texts to id arrays. ``split`` says that white space separates pre-tokens (checked against the file)."""

    def __init__(self, path: str, memo: int = 200_000, leaf: int = 2048):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        bare = dict(spec, normalizer=None, post_processor=None, truncation=None, padding=None, added_tokens=[])
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [spec.get("pre_tokenizer") or {}])
        # removed white space is what makes pieces independent; a tokenizer that keeps it is used whole
        self.split = any(s.get("type") == "Split" and s.get("behavior") == "Removed" for s in steps)
        self.vocab_size = self.tok.get_vocab_size()
        # the pre-tokenizer and normalizer that _RUNS and lower() stand for; any other file takes the general way
        steps_ = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split_by = [x["pattern"].get("Regex") for x in steps if x.get("type") == "Split"]
        self.plain = steps_ == ["NFC", "Replace", "Lowercase"] and split_by == [_SPLIT] and steps[-1].get("type") == "ByteLevel"
        self.merge = self.bare.model.tokenize
        self.id_bytes = [struct.pack("<I", k) for k in range(self.vocab_size)]
        self.words = _Memo(self._word, memo, 2)
        # byte-level letters: printable bytes stand for themselves, the others for 256 and on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        table = np.arange(256, dtype="<u2")
        table[[b for b in self.letters if b != 32]] = [ord(x) for b, x in self.letters.items() if b != 32]
        self.table = table
        # where a suffix marks the last token of a word, many words are merged in one call and told apart after
        suffix = spec["model"].get("end_of_word_suffix")
        self.line = Tokenizer(self.bare.model)
        self.line.pre_tokenizer = WhitespaceSplit()
        self.last = np.zeros(self.vocab_size, bool)
        self.last[[k for token, k in spec["model"]["vocab"].items() if suffix and token.endswith(suffix)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.half = memo // 2
        self.leaf, self.memo = leaf, _Memo(self._piece, memo, 2)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece. A plain one is cut into pre-tokens here, and they are merged one by one, with a memo."""
        if len(piece) > self.leaf:
            return self.tree(piece).astype("<u4").tobytes()
        if not self.plain or not piece.isascii() and _OTHER.search(piece) or "<|" in piece:
            return self._whole([piece])[0]
        words = self.words
        core = piece.rstrip(_ENDS)
        if core.isalpha():  # letters, then marks: two runs at most
            return words[core.lower()] + words[piece[len(core) :]] if len(core) < len(piece) else words[core.lower()]
        return b"".join([words[r] for r in _RUNS.findall(piece.lower())])

    def _word(self, run: str) -> bytes:
        word = run if run.isascii() and run.isalnum() else run.encode().decode("latin-1").translate(self.letters)
        known = self.id_bytes
        return b"".join([known[t.id] for t in self.merge(word)])

    def _merged(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words of letters. New ones are merged in one call and kept for two generations of the memo."""
        young, old = self.young, self.old
        out = list(map(young.get, words))
        gone = [k for k, x in enumerate(out) if x is None]
        for k in gone:
            out[k] = old.get(words[k])
        new = [k for k in gone if out[k] is None]
        line = self.table[np.frombuffer(" ".join([words[k] for k in new]).encode(), "u1")].tobytes().decode("utf-16-le")
        ids = np.asarray(self.line.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        cuts = 4 * (np.flatnonzero(self.last[ids]) + 1)
        if len(cuts) != len(new):
            return [self.words[w] for w in words]
        raw, begin = ids.tobytes(), 0
        for k, end in zip(new, cuts.tolist(), strict=True):
            out[k] = raw[begin:end]
            begin = end
        if len(young) + len(gone) > self.half:
            self.old, self.young = young, {}
        self.young.update((words[k], out[k]) for k in gone)
        return out

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Id arrays (uint32) in input order."""
        return (np.frombuffer(raw, "<u4") for raw in self.encode_raw(texts))

    def encode_raw(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers in input order, by slices of texts."""
        some: list[str] = []
        size = 0
        for t in texts:
            some.append(t or "")
            size += len(some[-1])
            if size >= _SLICE_CHARS:
                yield from self._slice(some)
                some, size = [], 0
        yield from self._slice(some)

    def _slice(self, texts: list[str]) -> list[bytes]:
        """Ids of each text: whole, piece by piece, or (texts lowered as one) from the distinct pieces of all."""
        out, low, places = [b""] * len(texts), [], []
        ids_of = self.memo.__getitem__
        for k, t in enumerate(texts):
            if not self.split or _DOUBTFUL.search(t):
                out[k] = self._whole([t])[0]
            elif self._lowers(t):
                low.append(t.lower())
                places.append(k)
            else:
                out[k] = b"".join(map(ids_of, t.split()))
        for k, raw in zip(places, self._by_pieces(low), strict=True):
            out[k] = raw
        return out

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        """As piece by piece, but from the distinct pieces of all texts, and these from their distinct words.

        Arrow and Python agree on white space and letters in texts that pass ``_lowers``; Arrow's empty pieces have no ids.
        """
        if not texts:
            return []
        lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        column = lists.flatten().dictionary_encode()
        pieces, words = column.dictionary, self.words
        core = pc.utf8_rtrim(pieces, _ENDS)
        tail = pc.subtract(pc.binary_length(pieces), pc.binary_length(core)).to_numpy()
        # letters, then marks: a word and a tail; any other piece is its own word
        easy = pc.and_not(pc.and_(pc.utf8_is_alpha(core), pc.less_equal(pc.utf8_length(pieces), self.leaf)), pc.match_substring_regex(core, "[\u0080-\u00bf]"))
        firsts = pc.if_else(easy, core, pieces).dictionary_encode()
        plain = np.zeros(len(firsts.dictionary), bool)
        plain[firsts.indices.to_numpy()] = easy.to_numpy(zero_copy_only=False)
        kinds = _strings(firsts.dictionary)
        merged = iter(self._merged(list(itertools.compress(kinds, plain.tolist()))))
        found = [next(merged) if p else self.memo[x] for x, p in zip(kinds, plain.tolist(), strict=True)]
        ended = np.flatnonzero((tail > 0) & easy.to_numpy(zero_copy_only=False))
        ends = pa.array([x[-n:] for x, n in zip(_strings(pieces.take(pa.array(ended))), tail[ended].tolist(), strict=True)], pa.string()).dictionary_encode()
        none = len(found)
        found += [b"", *(words[x] for x in ends.dictionary.to_pylist())]
        parts = np.full((len(pieces), 2), none, np.int64)
        parts[:, 0] = firsts.indices.to_numpy()
        parts[ended, 1] = ends.indices.to_numpy() + none + 1
        sizes, ids = _taken(np.fromiter(map(len, found), np.int64, len(found)) // 4, np.frombuffer(b"".join(found), "<u4"), parts.ravel())
        sizes, ids = _taken(sizes.reshape(-1, 2).sum(axis=1), ids, column.indices.to_numpy())
        at = np.concatenate([[0], np.cumsum(sizes)])[lists.offsets.to_numpy()] * 4
        raw = memoryview(ids).cast("B")
        return [bytes(raw[a:b]) for a, b in itertools.pairwise(at.tolist())]

    def _lowers(self, text: str) -> bool:
        """Whether lower-casing all of text is what the normalizer does: its characters are lowered one by one, and it names no special token."""
        if not self.plain or "<|" in text:
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return not _OTHER.search(text)
        return True

    def tree(self, piece: str) -> np.ndarray:
        """Ids of one long piece without white space, by tree concatenation."""
        if any(s in piece for s in self.specials):
            return np.frombuffer(self._whole([piece])[0], "<u4")
        text = self.tok.normalizer.normalize_str(piece) if self.tok.normalizer else piece
        n = max(1, 1 << max(0, (len(text) - 1) // self.leaf).bit_length())
        cuts = [len(text) * k // n for k in range(n + 1)]
        spans = [(a, b) for a, b in itertools.pairwise(cuts) if b > a]
        with ThreadPoolExecutor(2) as pool:  # encode_batch leaves the interpreter lock
            nodes = [x for part in pool.map(lambda s: self._spans(text, [s]), spans) for x in part]
        while len(nodes) > 1:
            nodes = [self._join(text, *nodes[k : k + 2]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
        return np.asarray(nodes[0][2] if nodes else [], "<u4")

    def _spans(self, text: str, spans: list[tuple[int, int]]) -> list[tuple]:
        """(begin, end, ids, starts) of each span; starts are character offsets in text."""
        done = self.bare.encode_batch([text[a:b] for a, b in spans], add_special_tokens=False)
        return [(a, b, np.asarray(e.ids, np.int64), np.asarray([o[0] for o in e.offsets], np.int64) + a) for (a, b), e in zip(spans, done, strict=True)]

    def _join(self, text: str, left: tuple, right: tuple) -> tuple:
        a, m, b = left[0], left[1], right[1]
        reach = 32
        while True:
            lo, hi = max(a, m - reach), min(b, m + reach)
            window = self._spans(text, [(lo, hi)])[0]
            if lo == a and hi == b:
                return window
            at_left = self._meet(left, window, first=False) if lo > a else (0, 0)
            at_right = self._meet(window, right, first=True) if hi < b else (len(window[2]), len(right[2]))
            if at_left and at_right and at_left[1] <= at_right[0]:
                parts = ((left, 0, at_left[0]), (window, at_left[1], at_right[0]), (right, at_right[1], len(right[2])))
                return a, b, np.concatenate([x[2][i:j] for x, i, j in parts]), np.concatenate([x[3][i:j] for x, i, j in parts])
            reach *= 2

    @staticmethod
    def _meet(x: tuple, y: tuple, first: bool) -> tuple[int, int] | None:
        """Positions (i, j) with x[i-1] = y[j-1] and x[i] = y[j], ids and offsets alike; the token after must follow too.

        Artificial edges are kept out: neither pair may hold the last token of x or the first of y.
        """
        common, i, j = np.intersect1d(x[3], y[3], assume_unique=False, return_indices=True)
        ok = (x[2][i] == y[2][j]) & (i >= 1) & (j >= 2) & (i < len(x[2]) - 2)
        i, j = i[ok], j[ok]
        ok = (x[2][i - 1] == y[2][j - 1]) & (x[3][i - 1] == y[3][j - 1]) & (x[3][i + 1] == y[3][np.minimum(j + 1, len(y[3]) - 1)]) & (j + 1 < len(y[3]))
        i, j = i[ok], j[ok]
        # bytes of one character share an offset; the splice must not fall between them
        ok = (x[3][i] > x[3][i - 1]) & (x[3][i + 1] > x[3][i])
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        k = 0 if first else -1
        return int(i[k]), int(j[k])


_ENCODERS: dict[tuple[str, int], PieceEncoder] = KEPT.setdefault("encoders", {})


def encoder(path: str, memo: int = 200_000) -> PieceEncoder:
    """One encoder per worker process, file and memo size."""
    if (path, memo) not in _ENCODERS:
        _ENCODERS[path, memo] = PieceEncoder(path, memo)
    return _ENCODERS[path, memo]


def encode_decode(df: DataFrame, path: str) -> DataFrame:
    """df(doc_id, text) -> doc_id, ids array<int>, decoded string; one row per input row, no shuffle."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            begin = 0
            while begin < len(texts):  # output batches of a few MB
                end, size = begin, 0
                while end < len(texts) and size < _BATCH_CHARS:
                    size += len(texts[end] or "")
                    end += 1
                ids = list(enc.encode(texts[begin:end]))
                decoded = enc.tok.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, end - begin), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
                begin = end
        release_memory("encoders")

    kind = dict(df.dtypes)["doc_id"]
    return df.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
