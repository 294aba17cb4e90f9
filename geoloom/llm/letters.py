"""Words of letters in byte arrays: runs of a-z (A-Z and the letters of Latin-1 lower-cased) and bytes outside ASCII, without punctuation, symbols and pictographs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textblocks import bytes_of


def _lower() -> np.ndarray:
    table = np.full(256, 0x20, np.uint8)
    table[0x61:0x7B] = table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


LOWER = _lower()
#: First byte, length and second bytes of signs that are no letters: Latin-1 signs, U+2000 to U+2BFF, CJK punctuation, selectors, pictographs.
SIGNS = [(0xC2, 2, range(0x80, 0xC0)), (0xE2, 3, range(0x80, 0xB0)), (0xE3, 3, [0x80]), (0xEF, 3, [0xB8]), (0xF0, 4, [0x9F])]


def letter_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with a space in the place of what is no letter, starts and ends of the words, the first word of each text, with the end.

    Each text has one more space behind it.
    """
    data, offsets = bytes_of(texts)
    data = np.insert(LOWER[data], offsets[1:], 0x20)
    offsets = offsets + np.arange(len(offsets))
    for lead, size, seconds in SIGNS:
        at = np.flatnonzero(data == lead)
        at = at[np.isin(data[at + 1], list(seconds))]
        for i in range(size):
            data[at + i] = 0x20
    at = np.flatnonzero(data == 0xC3) + 1  # the capital letters of Latin-1, but for the multiplication sign
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    data[at] += 0x20
    ink = data != 0x20
    edge = np.flatnonzero(np.diff(ink.astype(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    return data, starts, ends, np.searchsorted(starts, offsets)
