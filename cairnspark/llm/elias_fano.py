"""Elias-Fano sequences, and a trie of n-grams made of them.

A sequence of n ascending integers below u keeps its lower log2(u / n) bits packed and the rest as a bit vector in unary:
about 2 + log2(u / n) bits an element.  All look-ups take arrays.
"""

from __future__ import annotations

import io

import numpy as np

ONE = np.uint64(1)
_bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
#: Of each byte, the place of its k-th one.
PLACE = np.array([[next((i for i in range(8) if b >> i & 1 and bin(b & ((1 << i) - 1)).count("1") == k), 8) for k in range(8)] for b in range(256)], dtype=np.uint8)
COUNT = _bits.sum(axis=1).astype(np.uint8)


def select_in(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th one (from 0) of each 64-bit word."""
    octets = words.astype("<u8").view(np.uint8).reshape(-1, 8)
    ahead = np.cumsum(COUNT[octets], axis=1, dtype=np.int64)
    octet = (ahead <= k[:, None]).sum(axis=1)
    row = np.arange(len(words))
    rest = k - np.where(octet > 0, ahead[row, np.maximum(octet - 1, 0)], 0)
    return octet * 8 + PLACE[octets[row, octet], rest]


class EliasFano:
    """``low``: packed lower bits; ``high``: unary upper bits; ``ones``: how many ones are before each word of ``high``."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones.astype(np.int64)

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, dtype=np.uint64)
        if width:
            part = values & ((ONE << np.uint64(width)) - ONE)
            at = np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(width) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = int(universe >> width) + n + 1
        high = np.zeros(size // 64 + 1, dtype=np.uint64)
        np.bitwise_or.at(high, place >> 6, ONE << (place & 63).astype(np.uint64))
        counts = np.bitwise_count(high).astype(np.int64)
        return cls(n, width, low, high, (np.cumsum(counts) - counts).astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=np.int64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        # a shift by 64 isn't defined, so the upper word moves in two steps
        both = (self.low[word] >> shift) | ((self.low[word + 1] << (np.uint64(63) - shift)) << ONE)
        return (both & ((ONE << np.uint64(self.width)) - ONE)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Element i."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + select_in(self.high[word], i - self.ones[word].astype(np.int64))
        return (place - i << self.width) | self._low(i)

    def _before(self, h: np.ndarray) -> np.ndarray:
        """How many elements have upper bits below h."""
        k = np.maximum(h - 1, 0)
        word = np.searchsorted(self.zeros, k, side="right") - 1
        place = word * 64 + select_in(~self.high[word], k - self.zeros[word])
        return np.where(h > 0, place - k, 0)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of the successor of x where it is x itself, else -1; elements are distinct and x is below the universe."""
        h, part = x >> self.width, x & ((1 << self.width) - 1)
        at, end = self._before(h), self._before(h + 1)
        low, high = at.copy(), end.copy()
        left = np.flatnonzero(low < high)
        while len(left):  # values may lie close together, so the range is halved
            middle = (low[left] + high[left]) >> 1
            less = self._low(middle) < part[left]
            low[left[less]] = middle[less] + 1
            high[left[~less]] = middle[~less]
            left = left[low[left] < high[left]]
        inside = np.flatnonzero(low < end)
        hit = inside[self._low(low[inside]) == part[inside]]
        out = np.full(len(x), -1, dtype=np.int64)
        out[hit] = low[hit]
        return out

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.head": np.array([self.n, self.width]), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @classmethod
    def among(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, width = arrays[f"{name}.head"].tolist()
        return cls(n, width, *(arrays[f"{name}.{x}"] for x in ("low", "high", "ones")))


#: Probabilities are kept as one byte: log10, rounded down to one of 256 levels from 0 to LEAST.
LEAST = -8.0


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.ceil(np.log10(np.maximum(p, 10.0**LEAST)) * 255 / LEAST - 1e-9), 0, 255).astype(np.uint8)


LEVELS = 10.0 ** (np.arange(256) * LEAST / 255)


def words_in(keys: np.ndarray, order: int, bits: int) -> list[np.ndarray]:
    return [keys >> (bits * (order - 1 - k)) & ((1 << bits) - 1) for k in range(order)]


class Trie:
    """N-grams of one order as a trie: a level for each of its words.

    A level's words are one ascending sequence: each is relative to its context, whose first value is where the words of
    the context before end.  ``begin[k]`` has, for each node of level k, the value where its children begin, and
    ``pointer[k]`` the index of the first; both are monotone and coded like the words.  Leaves have a discounted
    probability, their contexts what is left to lower orders.
    """

    def __init__(self, order: int, word: list[EliasFano], begin: list[EliasFano], pointer: list[EliasFano], probability: np.ndarray, left: np.ndarray):
        self.order, self.word, self.begin, self.pointer, self.probability, self.left = order, word, begin, pointer, probability, left

    @classmethod
    def of(cls, keys: np.ndarray, order: int, bits: int, probability: np.ndarray, left: np.ndarray) -> Trie:
        """``keys``: distinct ascending, ``bits`` for each word; ``probability`` of each; ``left`` of each distinct context, ascending."""
        return cls.of_words(words_in(keys, order, bits), 1 << bits, probability, left)

    @classmethod
    def of_words(cls, columns: list[np.ndarray], universe: int, probability: np.ndarray, left: np.ndarray) -> Trie:
        """Of n-grams, distinct and ascending, whose k-th words are ``columns[k]``, below ``universe``."""
        word, begin, pointer, n = [], [], [], len(columns[0])
        new, parent_of = np.arange(n) < 1, None
        for own in columns:
            new = new.copy()
            new[1:] |= own[1:] != own[:-1]
            nodes = np.flatnonzero(new)
            own = own[nodes]
            if parent_of is None:
                word.append(EliasFano.of(own, universe))
            else:
                parent = parent_of[nodes]
                last = np.append(np.flatnonzero(parent[1:] != parent[:-1]), len(nodes) - 1) if len(nodes) else np.zeros(0, np.int64)
                begins = np.concatenate(([0], np.cumsum(own[last] + 1)))
                begin.append(EliasFano.of(begins, int(begins[-1]) + 1))
                pointer.append(EliasFano.of(np.concatenate(([0], last + 1)), len(nodes) + 1))
                word.append(EliasFano.of(begins[parent] + own, int(begins[-1]) + 1))
            parent_of = np.cumsum(new) - 1
        return cls(len(columns), word, begin, pointer, quantised(probability), quantised(left))

    def find(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each n-gram: its leaf, and the node of its context; -1 if unseen."""
        leaf, context = np.full(len(columns[0]), -1, dtype=np.int64), np.full(len(columns[0]), -1, dtype=np.int64)
        at = np.arange(len(columns[0]))
        node = self.word[0].find(columns[0])
        for k in range(1, self.order):
            at, node = at[node >= 0], node[node >= 0]
            if k == self.order - 1:
                context[at] = node
            own = columns[k][at]
            first, end = self.begin[k - 1].get(node), self.begin[k - 1].get(node + 1)
            inside = first + own < end
            at, value = at[inside], (first + own)[inside]
            node = self.word[k].find(value)
        leaf[at] = node
        return leaf, context

    def look_up(self, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """For each key: its discounted probability (0 if unseen), and what its context leaves to lower orders (1 if unseen)."""
        leaf, context = self.find(words_in(keys, self.order, bits))
        return np.where(leaf >= 0, LEVELS[self.probability[leaf]], 0.0), np.where(context >= 0, LEVELS[self.left[context]], 1.0)

    def dump(self) -> bytes:
        arrays = {"probability": self.probability, "left": self.left, "order": np.array([self.order])}
        for name in ("word", "begin", "pointer"):
            for k, x in enumerate(getattr(self, name)):
                arrays |= x.arrays(f"{name}{k}")
        out = io.BytesIO()
        for name, x in arrays.items():  # aligned raw arrays behind one line each
            head = f"{name} {x.dtype.str} {len(x)}\n".encode()
            out.write(head + b" " * (-(out.tell() + len(head)) % 64) + x.tobytes())
            out.write(b"\0" * (-out.tell() % 64))
        return out.getvalue()

    @classmethod
    def load(cls, data: np.ndarray) -> Trie:
        """From the bytes of :meth:`dump` as an array of uint8, memory-mapped or not; nothing is copied."""
        arrays, at = {}, 0
        while at < len(data):
            end = at + int(np.flatnonzero(data[at : at + 256] == 10)[0]) + 1
            name, kind, n = bytes(data[at : end - 1]).decode().split()
            begin = end + (-end % 64)
            stop = begin + int(n) * np.dtype(kind).itemsize
            arrays[name] = data[begin:stop].view(kind)
            at = stop + (-stop % 64)
        order = int(arrays["order"][0])
        several = lambda name, n: [EliasFano.among(arrays, f"{name}{k}") for k in range(n)]
        return cls(order, several("word", order), several("begin", order - 1), several("pointer", order - 1), arrays["probability"], arrays["left"])
