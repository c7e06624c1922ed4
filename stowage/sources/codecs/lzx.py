"""LZX as cabinets, compiled help and WIM have it, and XPRESS Huffman."""

from __future__ import annotations

from ...model import ArchiveError, malformed
from .huffman import Code, copy_back


class _Words:
    """Bits from 16-bit little-endian words, most significant first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.hold, self.n = data, at, 0, 0

    def _fill(self, n: int) -> None:
        while self.n < n:
            w = self.data[self.at : self.at + 2].ljust(2, b"\0")
            self.at += 2
            self.hold = self.hold << 16 | w[0] | w[1] << 8
            self.n += 16

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


def _slots() -> list[tuple[int, int]]:
    """(base, extra bits) of position slots: pairs of slots for each number of bits up to 17, which then stays."""
    out, base = [], 0
    for i in range(290):
        extra = 0 if i < 4 else min(17, i // 2 - 1)
        out.append((base, extra))
        base += 1 << extra
    return out


_SLOTS = _slots()


class Lzx:
    """A decoder with its window; `wim` has blocks of 32 KiB by default and fixed call translation."""

    def __init__(self, window_bits: int, wim: bool = False):
        if not 15 <= window_bits <= 21 and not (wim and 15 <= window_bits <= 25):
            raise malformed("LZX window")
        self.window = 1 << window_bits
        self.slots = {15: 30, 16: 32, 17: 34, 18: 36, 19: 38, 20: 42, 21: 50}.get(window_bits, 2 * window_bits)
        self.wim = wim
        self.reset()

    def reset(self) -> None:
        self.main = [0] * (256 + 8 * self.slots)
        self.lengths = [0] * 249
        self.recent = [1, 1, 1]
        self.out = bytearray()
        self.kind = self.left = 0
        self.started = False
        self.translate = 0

    def _table(self, b: _Words, table: list[int], first: int, last: int) -> None:
        pre = Code([b.bits(4) for _ in range(20)])
        i = first
        while i < last:
            c = pre.read(b)
            if c == 17 or c == 18:
                n = b.bits(4) + 4 if c == 17 else b.bits(5) + 20
                for k in range(i, min(i + n, last)):
                    table[k] = 0
                i += n
            elif c == 19:
                n = b.bits(1) + 4
                v = (table[i] - pre.read(b)) % 17
                for k in range(i, min(i + n, last)):
                    table[k] = v
                i += n
            else:
                table[i] = (table[i] - c) % 17
                i += 1

    def _block(self, b: _Words) -> None:
        self.kind = b.bits(3)
        if self.wim:
            self.left = 32768 if b.bits(1) else b.bits(16)
        else:
            self.left = b.bits(8) << 16 | b.bits(16)
        if self.kind == 2:
            self.aligned = Code([b.bits(3) for _ in range(8)])
        if self.kind in (1, 2):
            self._table(b, self.main, 0, 256)
            self._table(b, self.main, 256, len(self.main))
            self._table(b, self.lengths, 0, 249)
            self.code, self.length_code = Code(self.main), Code(self.lengths)
        elif self.kind == 3:
            b.skip(b.n % 16 or (16 if self._at_word(b) else 0))
            at = b.at - b.n // 8
            b.hold = b.n = 0
            self.recent = [int.from_bytes(b.data[at + 4 * i : at + 4 * i + 4], "little") for i in range(3)]
            b.at = at + 12
        else:
            raise malformed("LZX block type")

    @staticmethod
    def _at_word(b: _Words) -> bool:
        return b.n == 0

    def run(self, b: _Words, size: int, frame: int = 32768) -> bytes:
        """The next `size` bytes; input is aligned after each frame."""
        start, stop = len(self.out), len(self.out) + size
        if not self.started and not self.wim:
            self.started = True
            self.translate = b.bits(16) << 16 | b.bits(16) if b.bits(1) else 0
        out = self.out
        edge = start + frame
        while len(out) < stop:
            if self.left <= 0:
                if self.kind == 3 and self.odd:
                    b.at += 1
                self._block(b)
                self.odd = self.left & 1
            goal = min(stop, len(out) + self.left, edge)
            before = len(out)
            if self.kind == 3:
                n = goal - len(out)
                out += b.data[b.at : b.at + n]
                b.at += n
                if len(out) < goal:
                    raise ArchiveError("truncated")
            else:
                self._codes(b, out, goal)
            self.left -= len(out) - before
            if len(out) >= edge:
                if not self.wim and self.kind != 3:
                    b.skip(b.n % 16)
                edge += frame
        return bytes(out[start:stop])

    def _codes(self, b: _Words, out: bytearray, goal: int) -> None:
        recent, read = self.recent, self.code.read
        while len(out) < goal:
            c = read(b)
            if c < 256:
                out.append(c)
                continue
            c -= 256
            n, slot = c & 7, c >> 3
            if n == 7:
                n += self.length_code.read(b)
            n += 2
            if slot < 3:
                back = recent[slot]
                recent[slot] = recent[0]
                recent[0] = back
            else:
                base, extra = _SLOTS[slot]
                if self.kind == 2 and extra >= 3:
                    v = b.bits(extra - 3) << 3
                    v += self.aligned.read(b)
                else:
                    v = b.bits(extra)
                back = base + v - 2
                recent[2], recent[1], recent[0] = recent[1], recent[0], back
            copy_back(out, back, n)


def untranslate(data: bytes, at: int, size: int) -> bytes:
    """x86 call targets of a frame back to relative ones."""
    out = bytearray(data)
    i, end = 0, len(out) - 10
    while i < end:
        if out[i] != 0xE8:
            i += 1
            continue
        v = int.from_bytes(out[i + 1 : i + 5], "little", signed=True)
        here = at + i
        if -here <= v < size:
            out[i + 1 : i + 5] = ((v - here if v >= 0 else v + size) & 0xFFFFFFFF).to_bytes(4, "little")
        i += 5
    return bytes(out)


def decode_frames(data: bytes, size: int, window_bits: int, reset_each: int = 0, places: list[int] | None = None) -> bytes:
    """Frames of 32 KiB; after `reset_each` bytes the decoder starts anew at the next place."""
    lzx, out, b = Lzx(window_bits), [], _Words(data)
    done = 0
    while done < size:
        if reset_each and done and done % reset_each == 0:
            lzx.reset()
            if places and done // 32768 < len(places):
                b = _Words(data, places[done // 32768])
        n = min(32768, size - done)
        frame = lzx.run(b, n)
        out.append(untranslate(frame, done, lzx.translate) if lzx.translate and done < 1 << 30 else frame)
        done += n
        if len(lzx.out) > 4 * lzx.window:
            del lzx.out[: -lzx.window]
    return b"".join(out)


def decode_cab(data: bytes, size: int, window_bits: int) -> bytes:
    return decode_frames(data, size, window_bits)


def decode_wim(data: bytes, size: int, window_bits: int = 15) -> bytes:
    """One WIM chunk."""
    lzx = Lzx(window_bits, wim=True)
    out = lzx.run(_Words(data), size, frame=1 << 30)
    return untranslate(out, 0, 12_000_000)


def decode_xpress(data: bytes, size: int) -> bytes:
    """One XPRESS Huffman chunk: 512 lengths of four bits, then codes with byte-sized extras between words."""
    if len(data) < 256:
        raise ArchiveError("truncated")
    code = Code([x for b in data[:256] for x in (b & 15, b >> 4)])
    at, out = 260, bytearray()
    hold = int.from_bytes(data[256:258], "little") << 16 | int.from_bytes(data[258:260], "little")
    left = 16

    def need(n: int) -> int:
        nonlocal hold, left, at
        v = hold >> 32 - n if n else 0
        hold = hold << n & 0xFFFFFFFF
        left -= n
        if left < 0:
            hold |= int.from_bytes(data[at : at + 2].ljust(2, b"\0"), "little") << -left
            left += 16
            at += 2
        return v

    while len(out) < size:
        hit = code.table[hold >> 32 - code.width] if code.table else None
        if hit is None:
            raise malformed("XPRESS code")
        need(hit[1])
        c = hit[0]
        if c < 256:
            out.append(c)
            continue
        c -= 256
        n, bits = c & 15, c >> 4
        if n == 15:
            n += data[at] if at < len(data) else 0
            at += 1
            if n == 270:
                n = int.from_bytes(data[at : at + 2], "little")
                at += 2
        back = (1 << bits) + need(bits)
        copy_back(out, back, n + 3)
        if at > len(data) + 8:
            raise ArchiveError("truncated")
    return bytes(out[:size])
