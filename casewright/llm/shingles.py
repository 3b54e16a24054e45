"""Shingle sets of whole texts, as sorted 64-bit hashes, computed over arrays of words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import blake2b

import numpy as np

N, WORDS = 5, 5
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Bytes as they are compared: A-Z as a-z, and every separator as a space.
_PLAIN = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The first k bytes of eight, and the longest word that is hashed by eights of bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 64
#: So many bytes of texts are hashed at once: a short text costs little more than its words.
_BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finish)."""
    x = x.copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@cache
def _places(n: int) -> np.ndarray:
    """An odd factor for each place of a word in its shingle (word hashes are mixed already, so sums of products do)."""
    return np.random.default_rng(20240608).integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (maximal run of bytes other than space and \\t to \\r), A-Z as a-z, and where it begins."""
    raw = b" %b         " % data.translate(_PLAIN)
    inside = np.frombuffer(raw, np.uint8) != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edges[0::2], edges[1::2]
    eights = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the eight bytes from each place on
    length = end - begin
    with np.errstate(over="ignore"):
        out = mix((eights[begin] & _FIRST[np.minimum(length, 8)]) + length.astype(np.uint64) * _U(_BASE))
        at, done = np.flatnonzero((length > 8) & (length <= _LONG)), 8
        while len(at):
            out[at] = mix(out[at] * _U(_BASE) + (eights[begin[at] + done] & _FIRST[np.minimum(length[at] - done, 8)]))
            done += 8
            at = at[length[at] > done]
    for k in np.flatnonzero(length > _LONG):
        out[k] = int.from_bytes(blake2b(raw[begin[k] : end[k]], digest_size=8).digest(), "little")
    return out, begin - 1


def _sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    words, begin = word_hashes(b" ".join(texts))
    cuts = np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    with np.errstate(over="ignore"):
        m = max(0, len(words) - n + 1)
        place = _places(n)
        rolled = words[:m] * place[0]
        for i in range(1, n):
            rolled += words[i : m + i] * place[i]
        rolled = mix(rolled)  # of all runs of n words; those across two texts are not taken
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi - lo >= n:
                found = np.sort(rolled[lo : hi - n + 1])
                new = np.empty(len(found), bool)
                new[0] = True
                np.not_equal(found[1:], found[:-1], out=new[1:])
                yield found[new]
            elif hi > lo:
                whole = np.array([_U(hi - lo)])
                for w in words[lo:hi]:
                    whole = mix(whole * _U(_BASE) + w)
                yield whole
            else:
                yield np.empty(0, np.uint64)


def shingle_sets(texts: Iterable[str | None], n: int = WORDS) -> Iterator[np.ndarray]:
    """For each text: sorted distinct hashes of its n-word shingles; of the whole sequence if it is shorter; empty without words."""
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode("utf-8", "replace"))
        size += len(held[-1])
        if size >= _BLOCK:
            yield from _sets(held, n)
            held, size = [], 0
    if held:
        yield from _sets(held, n)


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """The shingle set of one text."""
    return next(shingle_sets([text], n))


def set_key(hashes: np.ndarray) -> int:
    """A 64-bit key of a set, as a signed integer (equal sets have equal keys)."""
    with np.errstate(over="ignore"):
        total = mix(np.array([np.add.reduce(mix(hashes ^ _U(0xD1B54A32D192ED03))) + _U(len(hashes)) * _U(_BASE)], np.uint64))
    return int(total.view(np.int64)[0])
