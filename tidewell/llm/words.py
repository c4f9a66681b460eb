"""Words of texts as numpy arrays of 64-bit names, shared by the operators on shingles and windows.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. Names depend on the bytes of the word alone, so every task gives a word the same
name. Sequences of words are named by two independent polynomials over these names (128 bits).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from tidewell.llm.kept import trim

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes named at once. The powers for them take 16 times that in every worker, the arrays of a block as much again or more.
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
STEPS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, ..., base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = powers(_BASE, BLOCK + 1), powers(_INVERSE, BLOCK + 1)


def _name_block(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTES)[data] * _UP[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * _DOWN[start] + (end - start).astype(np.uint64)), start, end


def _long_name(data: np.ndarray, lower: bool) -> np.ndarray:
    """The name of one word of any length, block by block."""
    total, scale = 0, 1
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        total += scale * int(((_LOWER if lower else _BYTES)[part] * _UP[: len(part)]).sum(dtype=np.uint64))
        scale = scale * pow(_BASE, BLOCK, 1 << 64) % (1 << 64)
    return mix(np.array([(total + len(data)) % (1 << 64)], np.uint64))


def spans(text: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, first bytes and ends of the words of one text; ``lower`` takes A-Z as a-z."""
    data = np.frombuffer(text, np.uint8)
    names, starts, ends, at = [], [], [], 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        if stop < len(data):  # a block ends at white space, or is one long word
            back = np.flatnonzero(_SPACE[data[at:stop]])
            if len(back):
                stop = at + int(back[-1]) + 1
            else:
                while stop < len(data) and not len(ahead := np.flatnonzero(_SPACE[data[stop : stop + BLOCK]])):
                    stop += BLOCK
                stop = min(stop, len(data)) if stop >= len(data) else stop + int(ahead[0])
                names.append(_long_name(data[at:stop], lower))
                starts.append(np.array([at]))
                ends.append(np.array([stop]))
                at = stop
                continue
        n, s, e = _name_block(data[at:stop], lower)
        names.append(n)
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    if not names:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    return np.concatenate(names), np.concatenate(starts), np.concatenate(ends)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows; unused memory is given back after each."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
            trim()


def groups(texts: list[bytes], limit: int = BLOCK // 2):
    """Runs of consecutive texts of about ``limit`` bytes, or one longer text: first and last index."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) + 1 > limit:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def name_texts(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of all texts, in order, and the number of words of each text."""
    names, _, _ = spans(b"\n".join(texts), lower)
    return names, count_words(texts)


def count_words(texts: list[bytes]) -> np.ndarray:
    """The number of words of each text."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    size = np.cumsum([len(t) + 1 for t in texts])
    total = np.concatenate([[0], np.cumsum(first)])
    return np.diff(total[np.concatenate([[0], size])]) if len(texts) else np.zeros(0, np.int64)


def window_names(names: np.ndarray, width: int, step: int) -> np.ndarray:
    """The name of the ``width`` words from each place on; none for the last ``width`` - 1 places."""
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = names[:n].copy()
    for j in range(1, width):
        out *= np.uint64(step)
        out += names[j : n + j]
    return mix(out)


def places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words listed text by text: the text of each word and its place in the text."""
    text = np.repeat(np.arange(len(counts)), counts)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
