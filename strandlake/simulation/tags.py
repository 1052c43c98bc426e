"""Arrangement tags as bit masks: inversion k has bit 2k for S and 2k + 1 for I."""

from __future__ import annotations

S, I = 1, 2  # noqa: E741
#: The S bits of all inversions that a mask of 64 bits has room for.
STANDARD = 0x5555555555555555


def tag(inversion: int, letter: str) -> int:
    return (S if letter == "S" else I) << 2 * inversion


def conflict(mask: int) -> bool:
    """Whether some inversion has both tags."""
    return bool(mask & mask >> 1 & STANDARD)


def flipped(mask: int, inversion: int) -> int:
    bits = mask >> 2 * inversion & 3
    return mask & ~(3 << 2 * inversion) | (bits >> 1 | bits << 1) % 4 << 2 * inversion


def cleared(mask: int, inversion: int) -> int:
    return mask & ~(3 << 2 * inversion)


def share(mask: int, frequencies: list[float]) -> float:
    """Product of the frequencies of the arrangements that a mask names."""
    out, k = 1.0, 0
    while mask:
        bits = mask & 3
        if bits == S:
            out *= 1 - frequencies[k]
        elif bits == I:
            out *= frequencies[k]
        mask >>= 2
        k += 1
    return out
