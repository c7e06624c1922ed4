"""RAR 2.0 and 2.9 to 4 compression: Huffman-coded matches, sound prediction, PPMd blocks and the standard filters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from ...model import ArchiveError, malformed
from .huffman import Code, Msb, copy_back
from .ppmd import Model, RarCoder
from .rar5 import _calls, _delta

#: The least length of each slot and its extra bits; the same of short distances; how many distance slots have how many extra bits.
LENGTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224)
LENGTH_BITS = (0,) * 8 + (1,) * 4 + (2,) * 4 + (3,) * 4 + (4,) * 4 + (5,) * 4
SHORT, SHORT_BITS = (0, 4, 8, 16, 32, 64, 128, 192), (2, 2, 3, 4, 5, 6, 6, 6)
DISTANCE_SLOTS = {0: 4} | dict.fromkeys(range(1, 16), 2) | {16: 14, 18: 12}
DISTANCE_BITS = [n for n, count in DISTANCE_SLOTS.items() for _ in range(count)]
DISTANCES = [sum(1 << n for n in DISTANCE_BITS[:i]) for i in range(len(DISTANCE_BITS))]
#: Symbols of the codes of 2.9 (main, distance, low distance, repeated length) and 2.0 (main, distance, repeated length; sound).
SYMBOLS_29, SYMBOLS_20, SYMBOLS_SOUND = (299, 60, 17, 28), (298, 48, 28), 257
#: Size and CRC-32 of the programs of the standard filters.
FILTERS = {(53, 0xAD576887): "e8", (57, 0x3CD7E57E): "e8e9", (120, 0x3769893F): "itanium", (29, 0x0E06077D): "delta", (149, 0x1C2C5DC8): "rgb", (216, 0xBC85E701): "audio"}
#: Instruction slots of an Itanium bundle that may branch, by template from 16.
ITANIUM = (4, 4, 6, 6, 0, 0, 7, 7, 4, 4, 0, 0, 4, 4, 0, 0)
WINDOW = 1 << 22


def _slot(bits: Msb, at: int, first, extra) -> int:
    return first[at] + (bits.bits(extra[at]) if extra[at] else 0)


def _signed(v: int) -> int:
    return (v & 255 ^ 128) - 128


class Sound:
    """Predicts a channel's next byte from its last differences; weights follow what would have been nearer."""

    def __init__(self, terms: int, past: int, count: int = 0):
        self.k, self.d, self.past = [0] * terms, [0] * terms, past
        self.char, self.delta, self.count = 0, 0, count
        self.off = [0] * (2 * terms + 1)

    def next(self, coded: int, beside: int = 0) -> int:
        d, k = self.d, self.k
        self.count += 1
        for i in range(self.past - 1, 1, -1):
            d[i] = d[i - 1]
        d[1], d[0] = self.delta - d[0], self.delta
        if self.past < len(d):
            d[-1] = beside
        char = (8 * self.char + sum(a * b for a, b in zip(k, d)) >> 3 & 255) - coded & 255
        e = _signed(coded) << 3
        self.off[0] += abs(e)
        for i, v in enumerate(d):
            self.off[2 * i + 1] += abs(e - v)
            self.off[2 * i + 2] += abs(e + v)
        self.delta = _signed(char - self.char)
        self.char = char
        if not self.count & 31:
            best = self.off.index(min(self.off))
            self.off = [0] * len(self.off)
            if best:
                i = (best - 1) // 2
                if best & 1:
                    k[i] -= k[i] >= -16
                else:
                    k[i] += k[i] < 16
        return char


def _audio(block: bytearray, channels: int) -> bytearray:
    out, at = bytearray(len(block)), 0
    for c in range(channels):
        sound = Sound(3, 3, -1)
        for i in range(c, len(block), channels):
            out[i] = sound.next(block[at])
            at += 1
    return out


def _rgb(block: bytearray, width: int, first: int) -> bytearray:
    out, at = bytearray(len(block)), 0
    for c in range(3):
        left = 0
        for i in range(c, len(block), 3):
            if i - width >= 3:
                up, corner = out[i - width], out[i - width - 3]
                guess = left + up - corner
                a, b, d = abs(guess - left), abs(guess - up), abs(guess - corner)
                left = left if a <= b and a <= d else up if b <= d else corner
            left = left - block[at] & 255
            out[i] = left
            at += 1
    for i in range(first, len(out) - 2, 3):
        g = out[i + 1]
        out[i], out[i + 2] = out[i] + g & 255, out[i + 2] + g & 255
    return out


def _itanium(block: bytearray, place: int) -> bytearray:
    place >>= 4
    for at in range(0, len(block) - 21, 16):
        kind = (block[at] & 31) - 16
        if kind >= 0 and ITANIUM[kind]:
            bundle = int.from_bytes(block[at : at + 16], "little")
            for i in range(3):
                start = 41 * i + 5
                if ITANIUM[kind] >> i & 1 and bundle >> start + 37 & 15 == 5:
                    to = bundle >> start + 13 & 0xFFFFF
                    bundle += ((to - place & 0xFFFFF) - to) << start + 13
            block[at : at + 16] = bundle.to_bytes(16, "little")
        place += 1
    return block


def _filtered(kind: str, block: bytearray, regs: list[int], place: int) -> bytearray:
    if kind in ("delta", "audio") and not 0 < regs[0] <= 1024:
        raise malformed("RAR filter")
    if kind == "delta":
        return _delta(block, regs[0])
    if kind == "audio":
        return _audio(block, regs[0])
    if kind == "rgb":
        if regs[0] < 3 or regs[1] > 2:
            raise malformed("RAR filter")
        return _rgb(block, regs[0] - 3, regs[1])
    if kind == "itanium":
        return _itanium(block, place)
    return _calls(block, place, b"\xe8\xe9" if kind == "e8e9" else b"\xe8")


def _lengths(bits: Msb, old: list[int], count: int, first: int, longer: bool) -> list[int]:
    """Code lengths as differences from the last ones; longer: the forms of 2.9."""
    own: list[int] = []
    while len(own) < first:
        n = bits.bits(4)
        if longer and n == 15 and (zeros := bits.bits(4)):
            own += [0] * (zeros + 2)
        else:
            own.append(n)
    code, out = Code(own[:first]), []
    while len(out) < count:
        s = code.read(bits)
        if s < 16:
            out.append(s + old[len(out)] & 15)
            continue
        repeat = s < 18 if longer else s == 16
        if repeat and not out:
            raise malformed("RAR code repeats nothing")
        width, least = ((7, 11) if s & 1 else (3, 3)) if longer else ((2, 3), (3, 3), (7, 11))[s - 16]
        n = bits.bits(width) + least
        out += [out[-1] if repeat else 0] * n
    return out[:count]


class Unpacker20:
    """What goes on from one file of a solid group to the next."""

    def __init__(self):
        self.past, self.codes, self.lengths = bytearray(), None, [0] * 4 * SYMBOLS_SOUND
        self.old, self.last = [0, 0, 0, 0], 0
        self.sound, self.channel, self.beside = None, 0, 0
        self.sounds = [Sound(5, 4) for _ in range(4)]

    def _tables(self, bits: Msb) -> None:
        sound, keep = bits.bits(1), bits.bits(1)
        if not keep:
            self.lengths = [0] * len(self.lengths)
        channels = bits.bits(2) + 1 if sound else 0
        sizes = (SYMBOLS_SOUND,) * channels if sound else SYMBOLS_20
        found = _lengths(bits, self.lengths, sum(sizes), 19, False)
        self.lengths[: len(found)] = found
        self.sound = channels
        if sound and self.channel >= channels:
            self.channel = 0
        self.codes = [Code(found[sum(sizes[:i]) : sum(sizes[: i + 1])]) for i in range(len(sizes))]

    def unpack(self, data: bytes, size: int) -> bytes:
        out, start, bits = self.past, len(self.past), Msb(data)
        if self.codes is None and size:
            self._tables(bits)
        while len(out) - start < size:
            if self.sound:
                s = self.codes[self.channel].read(bits)
                if s == 256:
                    self._tables(bits)
                    continue
                voice = self.sounds[self.channel]
                out.append(voice.next(s, self.beside))
                self.beside = voice.delta
                self.channel = (self.channel + 1) % self.sound
                continue
            s = self.codes[0].read(bits)
            if s < 256:
                out.append(s)
                continue
            if s == 269:
                self._tables(bits)
                continue
            if s > 269:
                n = _slot(bits, s - 270, LENGTHS, LENGTH_BITS) + 3
                back = _slot(bits, self.codes[1].read(bits), DISTANCES, DISTANCE_BITS) + 1
                n += (back >= 0x2000) + (back >= 0x40000)
            elif s == 256:
                n, back = self.last, self.old[0]
            elif s < 261:
                back = self.old[s - 257]
                n = _slot(bits, self.codes[2].read(bits), LENGTHS, LENGTH_BITS) + 2
                n += (back >= 0x101) + (back >= 0x2000) + (back >= 0x40000)
            else:
                n, back = 2, _slot(bits, s - 261, SHORT, SHORT_BITS) + 1
            self.old, self.last = [back, *self.old[:3]], n
            copy_back(out, back, n)
        if len(data) - (bits.at - bits.n // 8) >= 3 and self.codes:
            mark, code = (256, self.codes[self.channel]) if self.sound else (269, self.codes[0])
            try:
                if code.read(bits) == mark:
                    self._tables(bits)
            except ArchiveError:
                pass
        made = bytes(out[start : start + size])
        del out[: max(0, len(out) - WINDOW)]
        return made


class Unpacker29:
    """What goes on from one file of a solid group to the next."""

    def __init__(self, memory: int):
        self.past, self.codes, self.lengths, self.ready = bytearray(), None, [0] * sum(SYMBOLS_29), False
        self.old, self.last = [0, 0, 0, 0], 0
        self.low, self.repeat = 0, 0
        self.model, self.escape, self.ppm, self.memory = None, 2, False, memory
        self.programs: list[tuple[str, list[int]]] = []
        self.program = 0

    def _tables(self, bits: Msb) -> None:
        bits.skip((bits.n - 8 * bits.at) % 8)
        self.ppm = bool(bits.peek(1))
        if self.ppm:
            flags = bits.bits(8)
            size = bits.bits(8) + 1 << 20 if flags & 0x20 else 0
            if flags & 0x40:
                self.escape = bits.bits(8)
            if size:
                order = (flags & 31) + 1
                order = order if order <= 16 else 16 + 3 * (order - 16)
                if order == 1:
                    raise malformed("PPMd order")
                if size > self.memory:
                    raise ArchiveError("limitExceeded", "PPMd memory")
                self.model = Model(order, size)
            elif self.model is None:
                raise malformed("RAR block without a model")
            self.model.coder = RarCoder(lambda: self._byte(bits))
            return
        bits.skip(1)
        self.low = self.repeat = 0
        if not bits.bits(1):
            self.lengths = [0] * len(self.lengths)
        self.lengths = found = _lengths(bits, self.lengths, sum(SYMBOLS_29), 20, True)
        at, self.codes = 0, []
        for n in SYMBOLS_29:
            self.codes.append(Code(found[at : at + n]))
            at += n
        self.ready = True

    @staticmethod
    def _byte(bits: Msb) -> int:
        if bits.at - bits.n // 8 > len(bits.data) + 8:
            raise ArchiveError("truncated", "PPMd data")
        return bits.bits(8)

    def unpack(self, data: bytes, size: int) -> bytes:
        """One file; what follows its last byte counts too, for the next one."""
        if not size:
            return b""
        out, start, bits, filters = self.past, len(self.past), Msb(data), []
        if not self.ready or self.codes is None and not self.ppm:
            self._tables(bits)
        try:
            while len(out) - start <= size and (self._predicted if self.ppm else self._matched)(bits, out, start, filters):
                pass
        except ArchiveError:
            if len(out) - start < size:
                raise
        if len(out) - start < size:
            raise ArchiveError("truncated", "RAR data")
        made = bytearray(out[start : start + size])
        del out[: max(0, len(out) - WINDOW)]
        for kind, place, n, regs in filters:
            if place + n <= len(made):
                made[place : place + n] = _filtered(kind, made[place : place + n], regs, place)
        return bytes(made)

    def _predicted(self, bits: Msb, out: bytearray, start: int, filters: list) -> bool:
        read = self.model.symbol

        def symbol() -> int:
            s = read()
            if s < 0:
                raise malformed("PPMd data")
            return s

        s = symbol()
        if s != self.escape:
            out.append(s)
            return True
        s = symbol()
        if s == 0:
            self._tables(bits)
        elif s == 2:
            return False
        elif s == 3:
            self._program(symbol, out, start, filters)
        elif s == 4:
            back = symbol() << 16 | symbol() << 8 | symbol()
            copy_back(out, back + 2, symbol() + 32)
        elif s == 5:
            copy_back(out, 1, symbol() + 4)
        else:
            out.append(self.escape)
        return True

    def _matched(self, bits: Msb, out: bytearray, start: int, filters: list) -> bool:
        main, distances, low, repeated = self.codes
        s = main.read(bits)
        if s < 256:
            out.append(s)
            return True
        if s == 256:
            if bits.bits(1):
                self._tables(bits)
                return True
            self.ready = not bits.bits(1)
            return False
        if s == 257:
            self._program(lambda: bits.bits(8), out, start, filters)
            return True
        if s == 258:
            if self.last:
                copy_back(out, self.old[0], self.last)
            return True
        if s < 263:
            back = self.old.pop(s - 259)
            n = _slot(bits, repeated.read(bits), LENGTHS, LENGTH_BITS) + 2
        elif s < 271:
            n, back = 2, _slot(bits, s - 263, SHORT, SHORT_BITS) + 1
        else:
            n = _slot(bits, s - 271, LENGTHS, LENGTH_BITS) + 3
            slot = distances.read(bits)
            back, more = DISTANCES[slot] + 1, DISTANCE_BITS[slot]
            if slot > 9:
                if more > 4:
                    back += bits.bits(more - 4) << 4
                if self.repeat:
                    self.repeat -= 1
                else:
                    k = low.read(bits)
                    if k == 16:
                        self.repeat = 15
                    else:
                        self.low = k
                back += self.low
            elif more:
                back += bits.bits(more)
            n += (back >= 0x2000) + (back >= 0x40000)
        self.old = [back, *self.old[:3]]
        self.last = n
        copy_back(out, back, n)
        return True

    def _program(self, byte: Callable[[], int], out: bytearray, start: int, filters: list) -> None:
        """A filter's program or a reference to an earlier one, with its place, length and registers."""
        flags = byte()
        n = (flags & 7) + 1
        n = byte() + 7 if n == 7 else byte() << 8 | byte() if n == 8 else n
        bits = Msb(bytes(byte() for _ in range(n)))
        if flags & 0x80:
            k = _number(bits)
            if k == 0:
                self.programs, filters[:] = [], []
            else:
                k -= 1
        else:
            k = self.program
        if k > len(self.programs):
            raise malformed("RAR filter")
        self.program = k
        place = len(out) - start + _number(bits) + (258 if flags & 0x40 else 0)
        length = _number(bits) if flags & 0x20 else None
        regs = [0] * 7
        if flags & 0x10:
            mask = bits.bits(7)
            for i in range(7):
                if mask >> i & 1:
                    regs[i] = _number(bits)
        if k == len(self.programs):
            size = _number(bits)
            if not 0 < size < 0x10000:
                raise malformed("RAR filter")
            code = bytes(bits.bits(8) for _ in range(size))
            kind = FILTERS.get((size, zlib.crc32(code)))
            if kind is None:
                raise ArchiveError("unsupportedMethod", "RAR filter program")
            self.programs.append((kind, [0]))
        kind, old = self.programs[k]
        if length is None:
            length = old[0]
        old[0] = length
        filters.append((kind, place, length, regs))


def _number(bits: Msb) -> int:
    kind = bits.bits(2)
    if kind == 0:
        return bits.bits(4)
    if kind == 1:
        v = bits.bits(8)
        return v if v >= 16 else 0xFFFFFF00 | v << 4 | bits.bits(4)
    return bits.bits(16 if kind == 2 else 32)
