"""Symbols, words and hashes of texts, worked out over whole batches of texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Symbols that stand for no character: before a text, after it, and before a word that repeats the word before it.
PAD, END, AGAIN = 0x10FFFF, 0x10FFFE, 0x10FFFD
#: Factors of the hashes of words and of grams.
WORD_FACTOR, GRAM_FACTOR, KEY_FACTOR = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD
#: Scripts written without spaces, whose characters are words of their own.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
#: The same words as a pattern of Spark's.
WORDS_PATTERN = "[{0}]|[^\\x20\\x09-\\x0D{0}]+".format("".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in UNSPACED))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _point_hashes() -> np.ndarray:
    return mixed(np.arange(1, 0x110001, dtype=np.uint64))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after another, and the length of each text."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), np.array([len(x) for x in texts], np.int64)


class Words:
    """The words of texts: runs without white space; with `single`, characters of UNSPACED are words of their own.

    kept: places of the characters that are no white space; of: the word of each;
    first, sizes, texts, hashes: of each word its first place in kept, its length,
    its text's number and its hash.
    """

    def __init__(self, points: np.ndarray, lengths: np.ndarray, single: bool = False):
        blank = (points == 32) | ((points >= 9) & (points <= 13))
        begins = np.zeros(len(points) + 1, bool)
        begins[np.concatenate([[0], np.cumsum(lengths)])] = True
        begins = begins[:-1]
        begins[1:] |= blank[:-1]
        if single and len(points) and points.max() >= UNSPACED[0][0]:
            alone = np.zeros(len(points), bool)
            for a, b in UNSPACED:
                alone |= (points >= a) & (points <= b)
            begins |= alone
            begins[1:] |= alone[:-1]
        begins &= ~blank
        self.kept = np.flatnonzero(~blank)
        self.first = np.flatnonzero(begins[self.kept])
        self.sizes = np.diff(np.append(self.first, len(self.kept)))
        self.of = np.repeat(np.arange(len(self.first)), self.sizes)
        self.texts = np.searchsorted(np.cumsum(lengths), self.kept[self.first], "right")
        self.hashes = np.zeros(0, np.uint64)
        if len(self.first):
            powers = np.cumprod(np.full(int(self.sizes.max()), WORD_FACTOR, np.uint64))
            inside = np.arange(len(self.kept)) - self.first[self.of]
            hashes = _point_hashes()[points[self.kept]] * powers[inside]
            self.hashes = mixed(np.add.reduceat(hashes, self.first) ^ self.sizes.astype(np.uint64))


def symbols(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts one after another, and the number of each text's.

    A text is order - 1 pads, then each word after a space, or after AGAIN if it
    equals the word before it, then an end.
    """
    points, lengths = code_points(texts)
    words = Words(points, lengths)
    text_of = words.texts[words.of]
    place = np.arange(len(words.kept)) + words.of + 1 + order * text_of + order - 1
    counts = np.bincount(text_of, minlength=len(texts)) + np.bincount(words.texts, minlength=len(texts)) + order
    out = np.full(int(counts.sum()), PAD, np.uint32)
    out[np.cumsum(counts) - 1] = END
    kept = points[words.kept]
    out[place] = np.where(kept >= AGAIN, 0xFFFD, kept) if len(kept) and kept.max() >= AGAIN else kept
    same = np.zeros(len(words.first), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.sizes[1:] == words.sizes[:-1]) & (words.texts[1:] == words.texts[:-1])
    out[place[words.first] - 1] = np.where(same, AGAIN, 32)
    return out, counts


def seeds_of(group: int, order: int) -> np.ndarray:
    """What tells the grams of a group and of each order from 1 to `order` from others."""
    return mixed(np.uint64(group % 2**64) + np.arange(1, order + 1, dtype=np.uint64) * np.uint64(WORD_FACTOR))


def gram_keys(run: np.ndarray, order: int):
    """For each order from 1 up, the hashes of the grams that end at each symbol (without seeds); those that begin before the first symbol mean nothing."""
    own = _point_hashes()[run]
    hashes = own
    for k in range(1, order + 1):
        if k > 1:
            hashes = np.concatenate([own[:1], hashes[:-1] * np.uint64(GRAM_FACTOR) + own[1:]])
        yield k, hashes


def key_of(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return (hashes ^ seeds) * np.uint64(KEY_FACTOR)


class Table:
    """Keys with weights at one of PROBES places each; keys that find no free place are left over.

    Keys are placed in LOTS lots, so those that come first are the last to be left over.
    """

    PROBES, LOTS = 3, 16

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bits: int):
        self.bits = bits
        self.keys, self.weights = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float64)
        over = [np.flatnonzero(keys == 0)]
        for left in np.array_split(np.flatnonzero(keys != 0), self.LOTS):
            for probe in range(self.PROBES):
                at = self._places(keys[left], probe)
                free = self.keys[at] == 0
                _, first = np.unique(at[free], return_index=True)
                chosen = np.flatnonzero(free)[first]
                self.keys[at[chosen]] = keys[left[chosen]]
                self.weights[at[chosen]] = weights[left[chosen]]
                left = np.delete(left, chosen)
            over.append(left)
        self.left_over = np.concatenate(over)

    def __getstate__(self):
        """Without the free places, so that what is sent follows the keys."""
        at = np.flatnonzero(self.keys)
        return self.bits, self.left_over, at.astype(np.uint32), self.keys[at], self.weights[at]

    def __setstate__(self, state):
        self.bits, self.left_over, at, keys, weights = state
        self.keys, self.weights = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.float64)
        self.keys[at], self.weights[at] = keys, weights

    def _places(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys >> np.uint64((min(44, 64 - self.bits), 23, 2)[probe])) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, 0 where a key is not held; the places of those keys)."""
        at = self._places(keys, 0)
        hit = self.keys[at] == keys
        out = np.where(hit, self.weights[at], 0.0)
        missing = np.flatnonzero(~hit)
        for probe in range(1, self.PROBES):
            at = self._places(keys[missing], probe)
            hit = self.keys[at] == keys[missing]
            out[missing[hit]] = self.weights[at[hit]]
            missing = missing[~hit]
        return out, missing
