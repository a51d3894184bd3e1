"""Token ids of whole texts by the public lower-casing word BPE, with a bounded memo of words and pieces.

The tokenizer drops white space, and no token spans it or the pieces that it cuts words into, so a text's ids are its pieces' ids in a row. Texts of Latin letters,
ASCII digits and signs are cut into pieces at once; others into words at ASCII white space only, and what else counts as space is left to the tokenizer. Texts that hold
a special token's string take the tokenizer's own path as well, word by word, with the same ids.

Pieces are remembered as rows of arrays, found by their own bytes: a text's pieces are cut, looked up and replaced by ids all at once, and a piece takes about 75 bytes.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

#: Texts whose lower case and pieces are the same by Python's rules as by the tokenizer's.
SIMPLE = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
#: Words of other texts, and pieces, that one worker remembers at most.
MEMO, PARTS = 100_000, 1_000_000
#: Bytes of a piece that is kept in a row; bytes of text whose pieces are looked up at once, and of longer pieces that one worker remembers.
WIDE, CHUNK, LONG = 24, 1 << 18, 1 << 22

_U = np.uint64
#: Kinds of bytes of simple lower-case texts: white space 0, letters 1 (all beyond ASCII are), digits 2, signs 3.
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 1
_KIND[[*range(ord("0"), ord("9") + 1)]] = 2
#: For each length, which bits of its three words of 8 bytes a piece has.
_MASK = np.array([[(1 << 8 * min(8, max(0, n - 8 * j))) - 1 for j in range(3)] for n in range(WIDE + 1)], dtype=_U)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=_U)


def cut_pieces(data: np.ndarray, kind: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pieces of data[a:b], which begins and ends beside white space, by the tokenizer's rule for pre-tokens (a fixed value):

    's|'t|'re|'ve|'m|'ll|'d|[letters]+|[digit]|[signs]+
    """
    own, text = kind[a:b], data[a : b + 2]
    edge = np.empty(b - a + 3, dtype=bool)
    edge[:1] = edge[b - a :] = True
    np.not_equal(own[1:], own[:-1], out=edge[1 : b - a])
    edge[: b - a] |= own == 2
    # A lone ' before letters takes one or two of them.
    for q in np.flatnonzero(text[: b - a] == 39).tolist():
        if edge[q] and edge[q + 1] and q + 1 < b - a and own[q + 1] == 1:
            n = 1 if text[q + 1] in b"stmd" else 2 if bytes(text[q + 1 : q + 3]) in (b"re", b"ve", b"ll") else 0
            if n:
                edge[q + 1], edge[q + 1 + n] = False, True
    at = np.flatnonzero(edge[: b - a + 1])
    word = own[at[:-1]] != 0
    return a + at[:-1][word], a + at[1:][word]


class Rows:
    """Ids of pieces of WIDE bytes at most. A piece is its bytes, as three numbers; slots lead to rows, the next slot is tried where another piece lies."""

    def __init__(self):
        self.n = self.used = 0
        self.slots, self.keys = np.full(1 << 12, -1, dtype=np.int32), np.empty((1 << 11, 3), dtype=_U)
        self.first, self.count, self.ids = np.zeros(1 << 11, dtype=np.int64), np.zeros(1 << 11, dtype=np.int32), np.zeros(1 << 13, dtype="<u4")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * _ODD[0] + keys[:, 1] * _ODD[1] + keys[:, 2] * _ODD[2]
        h ^= h >> _U(29)
        return ((h * _ODD[0]) >> _U(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each piece's row, -1 if it is not here."""
        out, left, at = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), self._slot(keys)
        while len(left):
            row = self.slots[at]
            have = self.keys[row]
            same = (row >= 0) & (have[:, 0] == keys[:, 0]) & (have[:, 1] == keys[:, 1]) & (have[:, 2] == keys[:, 2])
            out[left[same]] = row[same]
            on = (row >= 0) & ~same
            left, keys, at = left[on], keys[on], (at[on] + 1) & (len(self.slots) - 1)
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Adds pieces that are new and distinct: their ids in a row, and how many each has."""
        n, used, new = self.n + len(keys), self.used + len(ids), np.arange(self.n, self.n + len(keys), dtype=np.int32)
        for name, size in (("keys", n), ("first", n), ("count", n), ("ids", used)):
            have = getattr(self, name)
            if size > len(have):
                more = np.empty((max(size, 2 * len(have)), *have.shape[1:]), dtype=have.dtype)
                more[: len(have)] = have
                setattr(self, name, more)
        self.keys[self.n : n], self.ids[self.used : used] = keys, ids
        self.first[self.n : n], self.count[self.n : n] = self.used + np.cumsum(count) - count, count
        self.n, self.used = n, used
        if 2 * n > len(self.slots):
            self.slots, new = np.full(1 << (4 * n).bit_length(), -1, dtype=np.int32), np.arange(n, dtype=np.int32)
        at = self._slot(self.keys[new])
        while len(new):
            free = self.slots[at] < 0
            self.slots[at[free]] = new[free]  # of several that want a slot one gets it
            left = self.slots[at] != new
            new, at = new[left], (at[left] + 1) & (len(self.slots) - 1)


@functools.cache
def loaded(path: str, plain: bool = False):
    """This process's tokenizer of a file: tasks share it, as each that is dropped leaves much of its memory behind. It runs in one thread, as Spark gives every core a worker.

    plain: one that takes special tokens' strings as text.
    """
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = plain
    return own


class WordBpe:
    """Ids of texts; an instance lives in one Python worker, and its memo serves all tasks that run there."""

    _loaded: dict[str | None, WordBpe] = {}

    @classmethod
    def shared(cls, path: str | None = None) -> WordBpe:
        """This process's instance for a vocabulary."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str | None = None):
        import public_tokenizers

        self.tokenizer = loaded(path or public_tokenizers.path("word_bpe_49k.json"))
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}
        self.rows = Rows()
        self.long: dict[bytes, np.ndarray] = {}
        self.long_size = 0

    def pieces(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count) of pieces that are one pre-token each: encoded in one text, whose word ends show where each one's ids end."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(names).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(names):
            raise ValueError("the vocabulary doesn't mark word ends")
        return ids, np.diff(at, prepend=0)

    def _long(self, name: bytes) -> np.ndarray:
        if name not in self.long:
            if self.long_size > LONG:
                self.long, self.long_size = {}, 0
            self.long[name] = self.pieces([name])[0]
            self.long_size += 5 * len(name)
        return self.long[name]

    def _chunk(self, data: np.ndarray, kind: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, count, ids) of the pieces of data[a:b]; WIDE bytes follow at least."""
        start, end = cut_pieces(data, kind, a, b)
        size = end - start
        words = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
        keys = np.stack([words[start + 8 * j] for j in range(3)], axis=1) & _MASK[np.minimum(size, WIDE)]
        short = size <= WIDE
        row = np.where(short, self.rows.find(keys), 0)
        for all_ in (False, True):
            missing = np.flatnonzero(short if all_ else row < 0)
            if not missing.size:
                break
            text, at = data[a:b].tobytes(), {}
            for i, x, y in zip(missing.tolist(), (start[missing] - a).tolist(), (end[missing] - a).tolist(), strict=True):
                at.setdefault(text[x:y], i)
            if all_ or self.rows.n + len(at) <= PARTS:
                self.rows.add(keys[list(at.values())], *self.pieces(list(at)))
                row[missing] = self.rows.find(keys[missing])
                break
            self.rows = Rows()
        first, count = self.rows.first[row], self.rows.count[row].astype(np.int64)
        others = [(i, self._long(data[start[i] : end[i]].tobytes())) for i in np.flatnonzero(~short).tolist()]
        for i, own in others:
            first[i], count[i] = 0, len(own)
        upto = np.cumsum(count)
        ids = self.rows.ids.take(np.repeat(first - upto + count, count) + np.arange(count.sum()), mode="clip")
        for i, own in others:
            ids[upto[i] - len(own) : upto[i]] = own
        return start, count, ids

    def simple(self, texts: list[str]) -> list[bytes]:
        """Ids of simple texts in lower case."""
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"\n".join([*raw, b"\n" * (WIDE + 8)]), dtype=np.uint8)
        begin = np.cumsum([0, *(len(t) + 1 for t in raw)])
        kind, at, found = _KIND[data], 0, []
        while at < begin[-1]:
            to = min(at + CHUNK, int(begin[-1]))
            while kind[to]:
                to += 1
            found.append(self._chunk(data, kind, at, to))
            at = to
        if not found:
            return []
        start, count, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        ends = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, begin)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]

    def learn(self, words: set[bytes]) -> None:
        """Adds words of texts that aren't simple: those that are simple themselves by their pieces, others by the tokenizer alone."""
        new = words.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = words
        plain: list[bytes] = []
        odd: list[bytes] = []
        for w in new:
            text = w.decode()
            (plain if SIMPLE.fullmatch(text) and "<|" not in text else odd).append(w)
        self.memo |= zip(plain, self.simple([w.decode().lower() for w in plain]), strict=True)
        if odd:
            for w, e in zip(odd, self.tokenizer.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False), strict=True):
                self.memo[w] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, null as empty."""
        out: list[bytes] = [b""] * len(texts)
        simple = {i: t.lower() for i, t in enumerate(texts) if t and "<|" not in t and SIMPLE.fullmatch(t)}
        for i, own in zip(simple, self.simple(list(simple.values())), strict=True):
            out[i] = own
        other = {i: t.encode().split() for i, t in enumerate(texts) if t and i not in simple}
        self.learn(set().union(*other.values()))
        for i, words in other.items():
            out[i] = b"".join(map(self.memo.__getitem__, words))
        return out
