"""RAR 5 compression: blocks of Huffman-coded literals and matches, with filters over the output."""

from __future__ import annotations

from collections.abc import Callable

from ...model import ArchiveError, malformed
from .huffman import Code, Msb, copy_back

#: Symbols of the four codes (main, distance, low distance, repeated length) and of the code for their lengths.
SYMBOLS, LENGTH_SYMBOLS = (306, 64, 16, 44), 20


def _codes(bits: Msb) -> list[Code]:
    lengths: list[int] = []
    while len(lengths) < LENGTH_SYMBOLS:
        n = bits.bits(4)
        if n == 15 and (zeros := bits.bits(4)):
            lengths += [0] * (zeros + 2)
        else:
            lengths.append(n)
    code, out = Code(lengths[:LENGTH_SYMBOLS]), []
    while len(out) < sum(SYMBOLS):
        s = code.read(bits)
        if s < 16:
            out.append(s)
            continue
        count = bits.bits(7) + 11 if s & 1 else bits.bits(3) + 3
        if s < 18 and not out:
            raise malformed("RAR code repeats nothing")
        out += [out[-1] if s < 18 else 0] * count
    at, found = 0, []
    for n in SYMBOLS:
        found.append(Code(out[at : at + n]))
        at += n
    return found


def _number(bits: Msb) -> int:
    """A filter's place or size."""
    return sum(bits.bits(8) << 8 * i for i in range(bits.bits(2) + 1))


def _length(slot: int, bits: Msb) -> int:
    if slot < 8:
        return 2 + slot
    more = (slot >> 2) - 1
    return 2 + ((4 | slot & 3) << more) + bits.bits(more)


def _delta(block: bytearray, channels: int) -> bytearray:
    out, at = bytearray(len(block)), 0
    for c in range(channels):
        last = 0
        for i in range(c, len(block), channels):
            last = last - block[at] & 255
            out[i] = last
            at += 1
    return out


def _calls(block: bytearray, place: int, marks: bytes) -> bytearray:
    """Absolute targets of x86 calls become relative again."""
    space, i = 1 << 24, 0
    while i + 4 < len(block):
        i += 1
        if block[i - 1] not in marks:
            continue
        here, to = (i + place) % space, int.from_bytes(block[i : i + 4], "little")
        if to >> 31:
            if not (to + here) >> 31 & 1:
                block[i : i + 4] = (to + space & 0xFFFFFFFF).to_bytes(4, "little")
        elif to < space:
            block[i : i + 4] = (to - here & 0xFFFFFFFF).to_bytes(4, "little")
        i += 4
    return block


def _branches(block: bytearray, place: int) -> bytearray:
    """The same for ARM branches."""
    for i in range(0, len(block) - 3, 4):
        if block[i + 3] == 0xEB:
            block[i : i + 3] = (int.from_bytes(block[i : i + 3], "little") - (place + i) // 4 & 0xFFFFFF).to_bytes(3, "little")
    return block


class Unpacker:
    """What goes on from one file of a solid group to the next: window, codes and last distances."""

    def __init__(self, window: int):
        self.window, self.past, self.codes = window, bytearray(), None
        self.old, self.last = [0, 0, 0, 0], 0

    def unpack(self, data: bytes, size: int) -> bytes:
        """One file of `size` bytes."""
        out, start, filters, at, end = self.past, len(self.past), [], 0, False
        while not end and len(out) - start < size:
            head = data[at : at + 2]
            if len(head) < 2:
                raise ArchiveError("truncated", "RAR block")
            flags, check = head
            n = (flags >> 3 & 3) + 1
            length = data[at + 2 : at + 2 + n]
            if n == 4 or len(length) < n or 0x5A ^ flags ^ (length[0] ^ (length[1] if n > 1 else 0) ^ (length[2] if n > 2 else 0)) != check:
                raise malformed("RAR block")
            body, end = at + 2 + n, bool(flags & 0x40)
            at = body + int.from_bytes(length, "little")
            if at > len(data):
                raise ArchiveError("truncated", "RAR block")
            bits = Msb(data[body:at])
            stop = 8 * (at - body - 1) + (flags & 7) + 1
            if flags & 0x80:
                self.codes = _codes(bits)
            if self.codes is None:
                raise malformed("RAR block without codes")
            self._block(bits, stop, out, start, size, filters)
        made = bytearray(out[start : start + size])
        del out[: max(0, len(out) - self.window)]
        if len(made) < size:
            raise ArchiveError("truncated", "RAR data")
        for kind, place, n, channels in filters:
            block = made[place : place + n]
            if len(block) == n:
                made[place : place + n] = _delta(block, channels) if kind == 0 else _branches(block, place) if kind == 3 else _calls(block, place, b"\xe8\xe9" if kind == 2 else b"\xe8")
        return bytes(made)

    def _block(self, bits: Msb, stop: int, out: bytearray, start: int, size: int, filters: list) -> None:
        main, distances, low, repeated = self.codes
        while 8 * bits.at - bits.n < stop and len(out) - start < size:
            s = main.read(bits)
            if s < 256:
                out.append(s)
                continue
            if s >= 262:
                n = _length(s - 262, bits)
                slot = distances.read(bits)
                if slot < 4:
                    back = 1 + slot
                else:
                    more = (slot >> 1) - 1
                    back = 1 + ((2 | slot & 1) << more)
                    if more < 4:
                        back += bits.bits(more)
                    else:
                        back += (bits.bits(more - 4) << 4 if more > 4 else 0) + low.read(bits)
                n += (back > 0x100) + (back > 0x2000) + (back > 0x40000)
                self.old = [back, *self.old[:3]]
            elif s == 256:
                place, length, kind = len(out) - start + _number(bits), _number(bits), bits.bits(3)
                if kind > 3:
                    raise ArchiveError("unsupportedMethod", "RAR filter")
                filters.append((kind, place, length, bits.bits(5) + 1 if kind == 0 else 0))
                continue
            elif s == 257:
                if not self.last:
                    continue
                n, back = self.last, self.old[0]
            else:
                back = self.old.pop(s - 258)
                self.old.insert(0, back)
                n = _length(repeated.read(bits), bits)
            self.last = n
            copy_back(out, back, n)


class Solid:
    """Files that are unpacked one after the other; reading them in order unpacks each once."""

    def __init__(self, make: Callable):
        self.make, self.files, self.next, self.state = make, [], 0, None

    def add(self, data: Callable[[], bytes], size: int) -> Callable[[], bytes]:
        k = len(self.files)
        self.files.append((data, size))
        return lambda: self.read(k)

    def read(self, k: int) -> bytes:
        if self.state is None or k < self.next:
            self.state, self.next = self.make(), 0
        out = b""
        try:
            while self.next <= k:
                data, size = self.files[self.next]
                out = self.state.unpack(data(), size)
                self.next += 1
        except Exception:
            self.state = None
            raise
        return out
