"""A table of bounded size for results that recur."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Collection, Hashable
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa


class Kept(dict):
    """Two generations of entries: what is used again outlives a change of generation, the rest is forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most
        self.old: dict = {}

    def lacking(self, keys: Collection[Hashable]) -> list:
        """The distinct keys whose values must be made; after they are, all ``keys`` are in the table."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        out = []
        for k in dict.fromkeys([k for k in keys if k not in self]):
            if k in self.old:
                self[k] = self.old[k]
            else:
                out.append(k)
        return out


def laid(values: pa.Array, at: pa.Array, ends: np.ndarray) -> list[bytes]:
    """The large_binary values at the places ``at`` one after the other, cut where ``ends`` (from 0) tells."""
    found = values.take(at)
    _, offsets, data = found.buffers()
    if data is None or not len(found):
        return [b""] * (len(ends) - 1)
    stops = np.frombuffer(offsets, np.int64)[ends].tolist()
    return [data.slice(a, b - a).to_pybytes() for a, b in pairwise(stops)]


_MADE: list = []


def in_worker(make: Callable) -> Callable:
    """``make`` with its results kept in the worker, for the tasks to come, until the worker turns to another operator."""
    cached = lru_cache(maxsize=2)(make)
    _MADE.append(cached)
    return cached


def trim() -> None:
    """Gives memory that is no longer used back to the system; a worker outlives its tasks, and others share the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def give_up() -> None:
    """What other operators keep in this worker goes."""
    if any(cached.cache_info().currsize for cached in _MADE):
        for cached in _MADE:
            cached.cache_clear()
        trim()
