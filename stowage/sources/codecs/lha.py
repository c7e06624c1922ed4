"""LHA methods: static Huffman blocks (lh4 to lh7, ARJ 1 to 3), adaptive Huffman (lh1), and the LArc forms."""

from __future__ import annotations

from ...model import ArchiveError, malformed
from .huffman import Code, Msb


def _lengths(bits: Msb, count: int, width: int, special: int) -> list[int] | int:
    """A code-length table; a single symbol if the table is empty. After `special` entries a 2-bit run of zeros follows."""
    n = bits.bits(width)
    if n == 0:
        return bits.bits(width)
    if n > count:
        raise malformed("LHA code table")
    out: list[int] = []
    while len(out) < n:
        c = bits.bits(3)
        if c == 7:
            while bits.bits(1):
                c += 1
                if c > 16:
                    raise malformed("LHA code length")
        out.append(c)
        if len(out) == special:
            out += [0] * bits.bits(2)
    return out[:count] + [0] * (count - len(out))


class _One:
    """A code of one symbol, which takes no bits."""

    def __init__(self, symbol: int):
        self.symbol = symbol

    def read(self, bits) -> int:
        return self.symbol


def static(data: bytes, size: int, window: int, position_bits: int, filler: int = 32) -> bytes:
    """Blocks of literal/length codes and positions; distances reach into a window that begins as blanks."""
    bits, out = Msb(data), bytearray([filler]) * window
    total = window + size
    positions = 14 if position_bits == 4 else 16 if window <= 1 << 15 else 17
    while len(out) < total:
        left = bits.bits(16)
        if bits.past():
            raise ArchiveError("truncated")
        t = _lengths(bits, 19, 5, 3)
        pre = _One(t) if isinstance(t, int) else Code(t)
        n = bits.bits(9)
        if n == 0:
            main = _One(bits.bits(9))
        else:
            got: list[int] = []
            while len(got) < n:
                c = pre.read(bits)
                if c == 0:
                    got.append(0)
                elif c == 1:
                    got += [0] * (bits.bits(4) + 3)
                elif c == 2:
                    got += [0] * (bits.bits(9) + 20)
                else:
                    got.append(c - 2)
            main = Code(got[:510])
        p = _lengths(bits, positions, position_bits, -1)
        far = _One(p) if isinstance(p, int) else Code(p)
        read, left = main.read, left or 65536
        for _ in range(left):
            if len(out) >= total:
                break
            c = read(bits)
            if c < 256:
                out.append(c)
                continue
            count = c - 253
            k = far.read(bits)
            back = (k if k < 2 else (1 << k - 1) + bits.bits(k - 1)) + 1
            if back > window:
                raise malformed("LHA distance")
            start = len(out) - back
            if back >= count:
                out += out[start : start + count]
            else:
                out += (bytes(out[start:]) * (count // back + 1))[:count]
        if bits.past():
            raise ArchiveError("truncated")
    return bytes(out[window:total])


class _Adaptive:
    """The adaptive Huffman tree of LZHUF: 314 symbols, halved when the root reaches 0x8000."""

    SYMBOLS = 314

    def __init__(self):
        n = self.SYMBOLS
        size = 2 * n - 1
        self.freq, self.parent, self.son = [0] * (size + 1), [0] * (size + n), [0] * size
        for i in range(n):
            self.freq[i], self.son[i], self.parent[i + size] = 1, i + size, i
        i, j = 0, n
        while j < size:
            self.freq[j], self.son[j] = self.freq[i] + self.freq[i + 1], i
            self.parent[i] = self.parent[i + 1] = j
            i, j = i + 2, j + 1
        self.freq[size] = 0xFFFF
        self.size, self.root = size, size - 1

    def read(self, bits: Msb) -> int:
        c = self.son[self.root]
        while c < self.size:
            c = self.son[c + bits.bits(1)]
        self._seen(c)
        return c - self.size

    def _rebuild(self) -> None:
        size, n = self.size, self.SYMBOLS
        j = 0
        for i in range(size):
            if self.son[i] >= size:
                self.freq[j], self.son[j] = (self.freq[i] + 1) // 2, self.son[i]
                j += 1
        i = 0
        for j in range(n, size):
            f = self.freq[i] + self.freq[i + 1]
            k = j
            while k and f < self.freq[k - 1]:
                k -= 1
            self.freq.insert(k, f)
            del self.freq[size]
            self.son.insert(k, i)
            del self.son[size]
            i += 2
        while len(self.freq) < size + 1:
            self.freq.append(0xFFFF)
        self.freq[size] = 0xFFFF
        for i in range(size):
            k = self.son[i]
            self.parent[k] = i
            if k < size:
                self.parent[k + 1] = i

    def _seen(self, leaf: int) -> None:
        if self.freq[self.root] == 0x8000:
            self._rebuild()
        c = self.parent[leaf]
        while True:
            self.freq[c] += 1
            k = self.freq[c]
            up = c + 1
            if k > self.freq[up]:
                while k > self.freq[up + 1]:
                    up += 1
                self.freq[c], self.freq[up] = self.freq[up], k
                i, j = self.son[c], self.son[up]
                self.parent[i] = up
                if i < self.size:
                    self.parent[i + 1] = up
                self.parent[j] = c
                if j < self.size:
                    self.parent[j + 1] = c
                self.son[c], self.son[up] = j, i
                c = up
            c = self.parent[c]
            if c == 0:
                break


def _position_code() -> Code:
    """Upper six bits of an lh1 position: 1, 3, 8, 12, 24 and 16 codes of 3 to 8 bits."""
    return Code([3] * 1 + [4] * 3 + [5] * 8 + [6] * 12 + [7] * 24 + [8] * 16)


def adaptive(data: bytes, size: int) -> bytes:
    """lh1."""
    bits, tree, far = Msb(data), _Adaptive(), _position_code()
    window = 4096
    out = bytearray(b" ") * window
    total = window + size
    while len(out) < total:
        c = tree.read(bits)
        if c < 256:
            out.append(c)
        else:
            back = (far.read(bits) << 6 | bits.bits(6)) + 1
            for _ in range(c - 253):
                out.append(out[-back])
        if bits.past():
            raise ArchiveError("truncated")
    return bytes(out[window:total])


def lzs(data: bytes, size: int) -> bytes:
    """LArc -lzs-: bits of 2 KiB windows with absolute places."""
    bits, window, at = Msb(data), bytearray(b" ") * 2048, 2048 - 17
    out = bytearray()
    while len(out) < size:
        if bits.bits(1):
            run = [bits.bits(8)]
            for c in run:
                out.append(c)
                window[at] = c
                at = at + 1 & 2047
        else:
            place, n = bits.bits(11), bits.bits(4) + 2
            for i in range(n):
                c = window[place + i & 2047]
                out.append(c)
                window[at] = c
                at = at + 1 & 2047
        if bits.past():
            raise ArchiveError("truncated")
    return bytes(out[:size])


def lz5(data: bytes, size: int) -> bytes:
    """LArc -lz5-: flag bytes, 4 KiB window with a fixed first content."""
    window = bytearray(b" ") * 4096
    at = 18
    for i in range(256):
        window[at : at + 13] = bytes([i]) * 13
        at += 13
    window[at : at + 256] = bytes(range(256))
    at += 256
    window[at : at + 256] = bytes(range(255, -1, -1))
    at += 256
    window[at : at + 128] = bytes(128)
    at = 4096 - 18
    out, p, flags = bytearray(), 0, 0
    while len(out) < size:
        if flags < 2:
            if p >= len(data):
                raise ArchiveError("truncated")
            flags, p = data[p] | 256, p + 1
        take, flags = flags & 1, flags >> 1
        if take:
            if p >= len(data):
                raise ArchiveError("truncated")
            got, p = [data[p]], p + 1
            for c in got:
                out.append(c)
                window[at] = c
                at = at + 1 & 4095
        else:
            if p + 1 >= len(data):
                raise ArchiveError("truncated")
            place, n = data[p] | (data[p + 1] & 0xF0) << 4, (data[p + 1] & 15) + 3
            p += 2
            for i in range(n):
                c = window[place + i & 4095]
                out.append(c)
                window[at] = c
                at = at + 1 & 4095
    return bytes(out[:size])
