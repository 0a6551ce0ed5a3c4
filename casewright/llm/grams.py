"""Hashes of all grams of a byte string and the sampled suffixes that stand for its windows."""

from __future__ import annotations

import numpy as np

#: Length of a window that counts as a match, and of the gram that samples it.
WINDOW, GRAM = 100, 32
_SPAN = WINDOW - GRAM + 1
_POS_BITS = 24
#: Windows hashed at a time; a longer text is worked on in segments, so memory does not follow its length.
SEGMENT = 1 << 19
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_A, _B, _C, _D = (np.uint64(x) for x in _ODD)
_S29, _S32 = np.uint64(29), np.uint64(32)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> _S29
    x *= _C
    x ^= x >> _S32
    return x


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * _A + b * _B)


def gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 32-byte and of the 64-byte grams that start at each position, by doubling."""
    h, n = _BYTE[data], 1
    while n < GRAM:
        h = _pair(h[:-n], h[n:])
        n *= 2
    return h, _pair(h[:-GRAM], h[GRAM:])


def hashed(rows: np.ndarray) -> np.ndarray:
    """One hash for each row of 32 bytes."""
    a, b, c, d = np.ascontiguousarray(rows).view(np.uint64).reshape(-1, 4).T
    return _pair(_pair(a, b), _pair(c, d)).view(np.int64)


def window_hashes(h32: np.ndarray, h64: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows that start at ``at``, each over all 100 bytes by a different route."""
    one = _pair(h64[at], h64[at + (WINDOW - 64)])
    two = _mix(_mix(h32[at] * _D + h32[at + 32]) * _A + _mix(h32[at + 64] * _B + h32[at + (WINDOW - 32)]))
    return one, two


def sampled(h32: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes that stand for the windows at ``starts`` (sorted): (position, first, last window).

    A window is sampled by its smallest gram, the leftmost among equals. That depends on the window's
    bytes alone, so equal windows are sampled at the same place within them.
    """
    keys = (h32 >> np.uint64(_POS_BITS) << np.uint64(_POS_BITS)) | np.arange(len(h32), dtype=np.uint64)
    n = 1
    while 2 * n <= _SPAN:
        keys = np.minimum(keys[:-n], keys[n:])
        n *= 2
    at = (np.minimum(keys[: len(keys) - (_SPAN - n)], keys[_SPAN - n :])[starts] & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    return at[new], starts[new], starts[np.r_[new[1:], len(starts)] - 1]


def block_hashes(h64: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of all bytes of the windows first..last, with their shape around the sampled suffix."""
    end = last + (WINDOW - 64)
    shape = ((at - first) * 128 + (at - last)).astype(np.uint64)
    return _mix(_pair(_pair(h64[first], h64[end]), h64[(first + end) >> 1]) + shape * _D)


class Segment:
    """Some texts, or a part of one long text, laid end to end with the hashes of all grams."""

    def __init__(self, owners: list[int], offsets: list[int], parts: list[bytes]):
        self.owners, self.offsets = np.array(owners), np.array(offsets)
        sizes = np.array([len(x) for x in parts])
        self.begin = np.cumsum(sizes) - sizes
        self.windows = sizes - (WINDOW - 1)
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.h32, self.h64 = gram_hashes(self.data)

    def starts(self) -> np.ndarray:
        """Start positions of all windows that lie within one text."""
        return np.repeat(self.begin, self.windows) + np.arange(self.windows.sum()) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)

    def bytes_at(self, at: np.ndarray) -> np.ndarray:
        """The grams that start at these positions, one row each."""
        return np.lib.stride_tricks.sliding_window_view(self.data, GRAM)[at]

    def locate(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the text, position in it) of positions in the segment."""
        part = np.searchsorted(self.begin, at, "right") - 1
        return self.owners[part], at - self.begin[part] + self.offsets[part]


def segments(texts: list[bytes]):
    """``Segment``s covering every window of every text exactly once."""
    owners, offsets, parts, held = [], [], [], 0
    for k, data in enumerate(texts):
        for lo in range(0, max(0, len(data) - WINDOW + 1), SEGMENT):
            part = data[lo : lo + SEGMENT + WINDOW - 1]
            if held and held + len(part) > SEGMENT:
                yield Segment(owners, offsets, parts)
                owners, offsets, parts, held = [], [], [], 0
            owners.append(k)
            offsets.append(lo)
            parts.append(part)
            held += len(part)
    if parts:
        yield Segment(owners, offsets, parts)
