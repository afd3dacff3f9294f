"""Edit distance of long texts: bit vectors in a band about the diagonal that doubles until the distance fits.

A column of the table of distances is kept as two Python integers, a bit for each row of the band: where the distance
grows by one from the row above, and where it falls by one. A column costs some dozen operations on integers as wide as
the band, so two texts of n characters at distance d take time in the order of n * d / 64, and memory for the positions
of each letter. The band moves down a row with each column, so the bits of a row keep their place by a shift of one.
"""

from __future__ import annotations

import numpy as np

LEAST = 64  # rows beside the diagonal of the first band


def shared_start(a: str, b: str) -> int:
    """How many characters two texts share from the first on, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Places:
    """Bits of where a letter stands in a text with `pad` places before it, in windows that only move on.

    Only the blocks of letters about the present window are held.
    """

    def __init__(self, text: str, pad: int, width: int):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        order = np.argsort(codes, kind="stable")
        letters, first = np.unique(codes[order], return_index=True)
        self.of = {chr(c): p + pad for c, p in zip(letters.tolist(), np.split(order, first[1:]))}
        self.width, self.block, self.mask = width, max(width, 2048), (1 << width) - 1
        self.number, self.held = -1, {}

    def window(self, letter: str, start: int) -> int:
        number, shift = divmod(start, self.block)
        if number != self.number:
            self.number, self.held = number, {}
        bits = self.held.get(letter)
        if bits is None:
            bits = self.held[letter] = self.bits(letter, number * self.block)
        return bits >> shift & self.mask

    def bits(self, letter: str, base: int) -> int:
        """Two blocks from a place on."""
        places = self.of.get(letter)
        if places is None:
            return 0
        some = places[np.searchsorted(places, base) : np.searchsorted(places, base + 2 * self.block)] - base
        row = np.zeros(2 * self.block, np.uint8)
        row[some] = 1
        return int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")


def banded(a: str, b: str, reach: int) -> int:
    """The distance if it is at most `reach`, else a number over it. The lengths differ by at most `reach`."""
    rows, width = len(a), 2 * reach + 1
    places, full = Places(a, reach, width), (1 << width) - 1
    # Bit t of a column's window is row column - reach + t; rows up to 0 have no bit set.
    up, down = full ^ ((1 << reach) - 1), 0
    found, last = min(reach, rows), 1 << width - 1
    for j, letter in enumerate(b):
        same = places.window(letter, j)
        diagonal = (((same & up) + up ^ up) | same | down) & full
        right, left = down | full ^ (diagonal | up), diagonal & up
        at = rows - (j + 1) + reach  # the bit of the last row
        if at >= width - 1 and rows >= j + 1 + reach:
            found += not diagonal & last
        else:
            found += (right >> at & 1) - (left >> at & 1)
        diagonal >>= 1
        up, down = left | full ^ (diagonal | right), diagonal & right
    return found


def distance(a: str, b: str) -> int:
    """How many characters are put in, left out or changed to make one text of the other."""
    if len(a) < len(b):
        a, b = b, a
    start = shared_start(a, b)
    a, b = a[start:], b[start:]
    end = shared_start(a[::-1], b[::-1])
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not b:
        return len(a)
    reach = max(LEAST, len(a) - len(b))
    while (found := banded(a, b, reach)) > reach:
        reach = min(2 * reach, len(a))
    return found
