"""Seeded draws on the driver: FNV-1a keys and the mulberry32 generator."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TypeVar

T = TypeVar("T")
_MASK = 0xFFFFFFFF


def fnv1a(key: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    units = key.encode("utf-16-le")
    h = 2166136261
    for lo, hi in zip(units[::2], units[1::2], strict=True):
        h = ((h ^ (lo | hi << 8)) * 16777619) & _MASK
    return h


def mulberry32(seed: int) -> Callable[[], float]:
    """A generator of floats in [0, 1)."""
    state = seed & _MASK

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & _MASK
        t = ((state ^ (state >> 15)) * (state | 1)) & _MASK
        t = (t ^ (t + (((t ^ (t >> 7)) * (t | 61)) & _MASK))) & _MASK
        return (t ^ (t >> 14)) / 4294967296

    return draw


def generator(key: object) -> Callable[[], float]:
    return mulberry32(fnv1a(str(key)))


def pick(draw: Callable[[], float], items: Sequence[T]) -> T:
    return items[int(draw() * len(items))]
