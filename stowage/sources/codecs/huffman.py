"""Bit readers and canonical Huffman codes for the block decoders."""

from __future__ import annotations

from ...model import ArchiveError, malformed


class Msb:
    """Bits, most significant first; zeros follow the end, which `past` counts."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.hold, self.n = data, at, 0, 0

    def _fill(self, n: int) -> None:
        while self.n < n:
            chunk = self.data[self.at : self.at + 8]
            self.at += 8
            self.hold = self.hold << 64 | int.from_bytes(chunk.ljust(8, b"\0"), "big")
            self.n += 64

    def peek(self, n: int) -> int:
        if self.n < n:
            self._fill(n)
        return self.hold >> self.n - n & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        if self.n < n:
            self._fill(n)
        self.n -= n
        self.hold &= (1 << self.n) - 1

    def bits(self, n: int) -> int:
        v = self.peek(n)
        self.skip(n)
        return v

    def past(self) -> bool:
        return self.at - self.n // 8 > len(self.data) + 4


class Lsb:
    """Bits, least significant first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.hold, self.n = data, at, 0, 0

    def _fill(self, n: int) -> None:
        while self.n < n:
            chunk = self.data[self.at : self.at + 8]
            self.at += 8
            self.hold |= int.from_bytes(chunk.ljust(8, b"\0"), "little") << self.n
            self.n += 64

    def peek(self, n: int) -> int:
        if self.n < n:
            self._fill(n)
        return self.hold & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        if self.n < n:
            self._fill(n)
        self.hold >>= n
        self.n -= n

    def bits(self, n: int) -> int:
        v = self.peek(n)
        self.skip(n)
        return v

    def align(self) -> None:
        self.skip(self.n % 8)

    def past(self) -> bool:
        return self.at - self.n // 8 > len(self.data)


class Code:
    """A canonical code from lengths; decodes by one table look-up per symbol."""

    def __init__(self, lengths: list[int], lsb: bool = False, allow_short: bool = False):
        self.width = max(lengths, default=0)
        self.table: list[tuple[int, int] | None] = []
        used = [n for n in lengths if n]
        self.only = None
        if not used:
            return
        space = sum(1 << self.width - n for n in used)
        if space > 1 << self.width:
            raise malformed("Huffman code over-subscribed")
        self.table = [None] * (1 << self.width)
        code = 0
        for n in range(1, self.width + 1):
            for symbol, own in enumerate(lengths):
                if own != n:
                    continue
                if lsb:
                    turned = int(f"{code:0{n}b}"[::-1], 2)
                    for i in range(turned, 1 << self.width, 1 << n):
                        self.table[i] = (symbol, n)
                else:
                    first = code << self.width - n
                    self.table[first : first + (1 << self.width - n)] = [(symbol, n)] * (1 << self.width - n)
                code += 1
            code <<= 1

    def read(self, bits) -> int:
        if not self.table:
            raise malformed("empty Huffman code")
        hit = self.table[bits.peek(self.width)]
        if hit is None:
            raise malformed("Huffman code")
        bits.skip(hit[1])
        if bits.past():
            raise ArchiveError("truncated")
        return hit[0]


def copy_back(out: bytearray, back: int, count: int) -> None:
    """Appends `count` bytes from `back` before the end; the copy may overlap itself."""
    if not 0 < back <= len(out):
        raise malformed("match before the start")
    start = len(out) - back
    if back >= count:
        out += out[start : start + count]
    else:
        out += (bytes(out[start:]) * (count // back + 1))[:count]
