"""Windows of bytes and their anchors, for substring dedup.

Every window of WINDOW bytes has as its anchor the leftmost of the GRAM-byte strings in it with the least hash. The anchor
depends on the window's bytes alone, so equal windows have equal anchors at equal offsets, whatever stands around them.
Successive windows share anchors: a run is a longest row of windows with one anchor. About one byte in fourteen begins a run.
"""

from __future__ import annotations

import numpy as np

WINDOW, GRAM = 50, 24
SPAN = WINDOW - GRAM + 1
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _D
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position (uint8 in, uint64 out)."""
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), "<u8", buffer=data.data, strides=(1,))
    h = words[:n] * _A
    h ^= h >> np.uint64(31)
    h += words[8 : n + 8]
    h *= _B
    h ^= h >> np.uint64(29)
    h += words[16 : n + 16]
    h *= _C
    return mix(h)


def anchor_offsets(h: np.ndarray) -> np.ndarray:
    """For each position, the offset of the leftmost least value among SPAN values from there on."""
    value, offset, size = h, np.zeros(len(h), np.uint8), 1
    while size < SPAN:
        step = min(size, SPAN - size)
        left, right = value[:-step], value[step:]
        later = right < left
        value = np.where(later, right, left)
        offset = np.where(later, offset[step:] + np.uint8(step), offset[:-step])
        size += step
    return offset


class Runs:
    """The runs of some documents (bytes): document index, first window, number of windows and anchor hash."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        long = np.flatnonzero(sizes >= WINDOW)
        self.data = np.frombuffer(b"".join([*(texts[i] for i in long), b"\0" * 8]), np.uint8)
        ends = np.cumsum(sizes[long])
        starts = ends - sizes[long]
        if not len(long):
            self.doc = self.at = self.count = self.start = np.zeros(0, np.int64)
            self.gram = np.zeros(0, np.uint64)
            return
        h = gram_hashes(self.data)[: len(self.data) - 8 - GRAM + 1]
        off = anchor_offsets(h)  # one for each window, also for those that cross documents
        anchor = np.arange(len(off)) + off
        fresh = np.r_[True, anchor[1:] != anchor[:-1]]
        fresh[starts] = True
        stop = np.minimum(ends - WINDOW + 1, len(off))
        fresh[stop[stop < len(off)]] = True
        first = np.flatnonzero(fresh)
        count = np.diff(np.r_[first, len(off)])
        which = np.searchsorted(starts, first, "right") - 1
        sound = first < stop[which]
        first, count, which = first[sound], count[sound], which[sound]
        self.gram = mix(h[anchor[first]] * _A)  # anchors are least values; mixed again they are even
        self.count = count
        self.doc, self.at, self.start = long[which], first - starts[which], first
