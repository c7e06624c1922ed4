"""PPMd variants H (7z, RAR) and I (ZIP): contexts of up to 64 symbols, and the range coders of 7z and RAR.

Contexts and states are objects; only the sizes and places of their blocks are kept as numbers, since running out of the stated memory restarts the model."""

from __future__ import annotations

from collections.abc import Callable

from ...model import ArchiveError, malformed

UNIT, MOST, BINARY_SCALE, PERIOD = 12, 124, 1 << 14, 7
#: Units of the block sizes, first estimates of escapes in binary contexts, and escape frequencies by estimate.
UNITS = [*range(1, 5), *range(6, 13, 2), *range(15, 25, 3), *range(28, 129, 4)]
FIRST_ESCAPES = (0x3CDD, 0x1F3F, 0x59BF, 0x48F3, 0x64A1, 0x5ABC, 0x6632, 0x6051)
ESCAPES = (25, 14, 9, 7, 5, 5, 4, 4, 4, 3, 3, 3, 2, 2, 2, 2)


def _classes() -> tuple[list[int], list[int]]:
    """The block size that holds n units, and the class of a number of symbols in escape estimates."""
    fit = [0] + [next(i for i, u in enumerate(UNITS) if u >= n) for n in range(1, 129)]
    group, own, left = [0, 1, 2], 3, 1
    while len(group) < 256:
        group.append(own)
        left -= 1
        if not left:
            own += 1
            left = own - 2
    return fit, group


FIT, GROUP = _classes()


class Full(Exception):
    """The stated memory is used up."""


class Heap:
    """Places of blocks in the model's memory: text grows up from 0, units lie above it."""

    def __init__(self, size: int):
        self.free: list[list[int]] = [[] for _ in UNITS]
        self.high = size
        self.low = self.start = size - size // 8 // UNIT * 7 * UNIT
        self.glue = 0

    def _put(self, at: int, units: int) -> None:
        """Frees a run of units, in at most two blocks."""
        i = FIT[units]
        if UNITS[i] != units:
            i -= 1
            rest = units - UNITS[i]
            self.free[rest - 1].append(at + UNITS[i] * UNIT)
        self.free[i].append(at)

    def _split(self, at: int, old: int, new: int) -> None:
        self._put(at + UNITS[new] * UNIT, UNITS[old] - UNITS[new])

    def _merge(self) -> None:
        self.glue = 255
        size: dict[int, int] = {}
        for i, blocks in enumerate(self.free):
            for at in reversed(blocks):
                size[at] = UNITS[i]
            blocks.clear()
        gap = self.low if self.low != self.high else None
        order = list(reversed(size))
        for at in order:
            if at not in size:
                continue
            units = size[at]
            while True:
                after = at + units * UNIT
                more = size.get(after)
                if more is None or after == gap or units + more >= 0x10000:
                    break
                del size[after]
                units += more
            size[at] = units
        for at in order:
            units = size.get(at)
            if units is None:
                continue
            while units > 128:
                self.free[-1].append(at)
                at, units = at + 128 * UNIT, units - 128
            self._put(at, units)

    def _rare(self, i: int, text: int) -> int:
        if not self.glue:
            self._merge()
            if self.free[i]:
                return self.free[i].pop()
        for k in range(i + 1, len(UNITS)):
            if self.free[k]:
                at = self.free[k].pop()
                self._split(at, k, i)
                return at
        self.glue -= 1
        n = UNITS[i] * UNIT
        if self.start - text <= n:
            raise Full
        self.start -= n
        return self.start

    def block(self, i: int, text: int) -> int:
        if self.free[i]:
            return self.free[i].pop()
        n = UNITS[i] * UNIT
        if n <= self.high - self.low:
            self.low += n
            return self.low - n
        return self._rare(i, text)

    def context(self, text: int) -> None:
        """Contexts are never freed, so their places do not matter."""
        if self.high != self.low:
            self.high -= UNIT
        elif self.free[0]:
            self.free[0].pop()
        else:
            self._rare(0, text)

    def shrink(self, at: int, old: int, new: int) -> int:
        i, k = FIT[old], FIT[new]
        if i == k:
            return at
        if self.free[k]:
            to = self.free[k].pop()
            self.free[i].append(at)
            return to
        self._split(at, i, k)
        return at


class Context:
    """stats: [symbol, frequency, what follows] each; what follows is a place in the text, a context or 0."""

    __slots__ = ("stats", "total", "at", "suffix", "flags")

    def __init__(self, stats: list[list], suffix: Context | None, flags: int = 0):
        self.stats, self.suffix, self.total, self.at, self.flags = stats, suffix, 0, -1, flags


class SevenZipCoder:
    def __init__(self, byte: Callable[[], int]):
        self.byte, self.range = byte, 0xFFFFFFFF
        if byte():
            raise malformed("PPMd range coder")
        self.code = int.from_bytes(bytes(byte() for _ in range(4)), "big")

    def threshold(self, total: int) -> int:
        self.range //= total
        return self.code // self.range

    def take(self, start: int, size: int) -> None:
        self.code -= start * self.range
        self.range *= size
        while self.range < 1 << 24:
            self.code = (self.code << 8 | self.byte()) & 0xFFFFFFFF
            self.range = self.range << 8 & 0xFFFFFFFF

    def bit(self, zero: int) -> bool:
        bound = (self.range >> 14) * zero
        one = self.code >= bound
        if one:
            self.code -= bound
            self.range -= bound
        else:
            self.range = bound
        while self.range < 1 << 24:
            self.code = (self.code << 8 | self.byte()) & 0xFFFFFFFF
            self.range = self.range << 8 & 0xFFFFFFFF
        return one


class RarCoder:
    def __init__(self, byte: Callable[[], int]):
        self.byte, self.low, self.range = byte, 0, 0xFFFFFFFF
        self.code = int.from_bytes(bytes(byte() for _ in range(4)), "big")

    def threshold(self, total: int) -> int:
        self.range //= total
        return ((self.code - self.low) & 0xFFFFFFFF) // self.range

    def take(self, start: int, size: int) -> None:
        self.low = self.low + start * self.range & 0xFFFFFFFF
        self.range = self.range * size & 0xFFFFFFFF
        while True:
            if (self.low ^ self.low + self.range) & 0xFFFFFFFF >= 1 << 24:
                if self.range >= 1 << 15:
                    return
                self.range = -self.low & 0x7FFF
            self.code = (self.code << 8 | self.byte()) & 0xFFFFFFFF
            self.range = self.range << 8 & 0xFFFFFFFF
            self.low = self.low << 8 & 0xFFFFFFFF

    def bit(self, zero: int) -> bool:
        one = self.threshold(BINARY_SCALE) >= zero
        self.take(*((zero, BINARY_SCALE - zero) if one else (0, zero)))
        return one


class Model:
    """Symbols from a range coder, which may be exchanged between symbols."""

    BINARY_MOST, HEAP, EVEN = 128, Heap, 0

    def __init__(self, order: int, memory: int):
        self.order, self.memory, self.coder = order, memory, None
        self.restart()

    def restart(self) -> None:
        self.heap, self.text, self.end = self.HEAP(self.memory), bytearray(), 0
        self.fall = self.order
        self.run = self.first_run = -min(self.order, 12) - 1
        self.success = 0
        self.heap.high -= UNIT
        root = Context([[s, 1, 0] for s in range(256)], None)
        root.total, root.at = 257, self.heap.low
        self.heap.low += 128 * UNIT
        self.least = self.most = root
        self.found = root.stats[0]
        self.high_bits = 0
        self.escape = 0
        self.binary = [[BINARY_SCALE - FIRST_ESCAPES[k & 7] // (i + 2) for k in range(64)] for i in range(128)]
        self.see = [[[5 * i + 10 << PERIOD - 4, PERIOD - 4, 4] for _ in range(16)] for i in range(25)]
        self.plain = [0, PERIOD, 64]

    def symbol(self) -> int:
        """The next symbol; -1 at the end mark."""
        c, coder = self.least, self.coder
        stats = c.stats
        if len(stats) != 1:
            count = coder.threshold(c.total)
            s = stats[0]
            high = s[1]
            if count < high:
                coder.take(0, high)
                self.found = s
                self.success = int(2 * high + self.EVEN > c.total)
                self.run += self.success
                self._count(c, s)
                self._next()
                return s[0]
            self.success = 0
            for i in range(1, len(stats)):
                s = stats[i]
                high += s[1]
                if high > count:
                    coder.take(high - s[1], s[1])
                    self.found = s
                    if s[1] + 4 > stats[i - 1][1]:
                        stats[i], stats[i - 1] = stats[i - 1], s
                    self._count(c, s)
                    self._next()
                    return s[0]
            if count >= c.total:
                raise malformed("PPMd data")
            self.high_bits = 8 * (self.found[0] >= 64)
            coder.take(high, c.total - high)
            masked = {s[0] for s in stats}
        else:
            s = stats[0]
            n = len(c.suffix.stats) - 1
            row, k = self._binary(c, s)
            k += self.success + (0 if n < 1 else 2 if n < 2 else 4 if n < 11 else 6) + (32 if self.run < 0 else 0)
            chance = row[k]
            mean = chance + 32 >> PERIOD
            if not coder.bit(chance):
                row[k] = chance + 128 - mean
                self.found = s
                s[1] += s[1] < self.BINARY_MOST
                self.success = 1
                self.run += 1
                self._next()
                return s[0]
            row[k] = chance - mean
            self.escape = ESCAPES[row[k] >> 10]
            self.success = 0
            masked = {s[0]}
        while True:
            known = len(c.stats)
            while len(c.stats) == known:
                self.fall += 1
                c = c.suffix
                if c is None:
                    return -1
            self.least = c
            left = [s for s in c.stats if s[0] not in masked]
            high = sum(s[1] for s in left)
            see, total = self._estimate(c, known)
            total += high
            count = coder.threshold(total)
            if count < high:
                at = 0
                for s in left:
                    at += s[1]
                    if at > count:
                        break
                coder.take(at - s[1], s[1])
                if see[1] < PERIOD:
                    see[2] -= 1
                    if not see[2]:
                        see[0] = see[0] << 1 & 0xFFFF
                        see[2] = 3 << see[1] & 0xFF
                        see[1] += 1
                self.found = s
                self._count(c, s)
                self.run = self.first_run
                self._update()
                return s[0]
            if count >= total:
                raise malformed("PPMd data")
            coder.take(high, total - high)
            see[0] = see[0] + total & 0xFFFF
            masked.update(s[0] for s in left)

    def _binary(self, c: Context, s: list) -> tuple[list[int], int]:
        """The row of chances of a binary context, and a part of the place in it."""
        self.high_bits = 8 * (self.found[0] >= 64)
        return self.binary[s[1] - 1], self.high_bits + 16 * (s[0] >= 64)

    def _estimate(self, c: Context, known: int) -> tuple[list[int], int]:
        """An escape's estimate and its frequency."""
        n = len(c.stats)
        if n == 256:
            return self.plain, 1
        left = n - known
        see = self.see[GROUP[left - 1]][(left < len(c.suffix.stats) - n) + 2 * (c.total < 11 * n) + 4 * (known > left) + self.high_bits]
        r = see[0] >> see[1]
        see[0] = see[0] - r & 0xFFFF
        return see, r or 1

    def _count(self, c: Context, s: list) -> None:
        c.total += 4
        s[1] += 4
        if s[1] > MOST:
            self._rescale(c, s)

    def _rescale(self, c: Context, s: list) -> None:
        stats, more = c.stats, int(self.fall != 0)
        n = len(stats)
        at = next(i for i, x in enumerate(stats) if x is s)
        stats.insert(0, stats.pop(at))
        escape = c.total - s[1]
        s[1] = s[1] + 4 + more >> 1
        total = s[1]
        for i in range(1, n):
            x = stats[i]
            escape -= x[1]
            x[1] = x[1] + more >> 1
            total += x[1]
            k = i
            while k and x[1] > stats[k - 1][1]:
                k -= 1
            if k != i:
                stats.insert(k, stats.pop(i))
        gone = 0
        while not stats[-1][1]:
            stats.pop()
            gone += 1
        if gone:
            escape += gone
            if len(stats) == 1:
                one = stats[0]
                self._alone(c, one, escape)
                self.heap.free[FIT[n + 1 >> 1]].append(c.at)
                self.found = one
                return
            old, new = n + 1 >> 1, len(stats) + 1 >> 1
            if old != new:
                c.at = self.heap.shrink(c.at, old, new)
        c.total = total + escape - (escape >> 1) & 0xFFFF
        self._halved(c, gone)
        self.found = stats[0]

    def _alone(self, c: Context, one: list, escape: int) -> None:
        """The frequency of the only symbol left."""
        while True:
            one[1] -= one[1] >> 1
            escape >>= 1
            if escape <= 1:
                return

    def _halved(self, c: Context, gone: int) -> None:
        """What else changes with halved frequencies."""

    def _next(self) -> None:
        to = self.found[2]
        if not self.fall and isinstance(to, Context):
            self.least = self.most = to
        else:
            self._update()

    def _update(self) -> None:
        try:
            self._grow()
        except Full:
            self.restart()

    def _favour(self) -> list | None:
        """The found symbol counts in the next shorter context too; its state there, if so."""
        symbol, freq, _ = self.found
        c = self.least.suffix
        if freq >= MOST // 4 or c is None:
            return None
        if len(c.stats) == 1:
            x = c.stats[0]
            x[1] += x[1] < 32
            return x
        i = next(i for i, x in enumerate(c.stats) if x[0] == symbol)
        x = c.stats[i]
        if i and x[1] >= c.stats[i - 1][1]:
            c.stats[i], c.stats[i - 1] = c.stats[i - 1], x
        if x[1] < MOST - 9:
            x[1] += 2
            c.total += 2
        return x

    def _write(self, symbol: int) -> None:
        if self.end < len(self.text):
            self.text[self.end] = symbol
        else:
            self.text.append(symbol)
        self.end += 1
        if self.end >= self.heap.start:
            raise Full

    def _widen(self, c: Context) -> None:
        """Room for one more state."""
        own = len(c.stats)
        if own == 1:
            c.at = self.heap.block(0, self.end)
            one = c.stats[0]
            one[1] = 2 * one[1] if one[1] < MOST // 4 - 1 else MOST - 4
        elif not own & 1 and (i := FIT[own >> 1]) != FIT[(own >> 1) + 1]:
            at = self.heap.block(i + 1, self.end)
            self.heap.free[i].append(c.at)
            c.at = at

    def _grow(self) -> None:
        found, least = self.found, self.least
        self._favour()
        symbol, freq, to = found
        if not self.fall:
            self.least = self.most = found[2] = self._chain(True)
            return
        self._write(symbol)
        after = self.end
        if to:
            if not isinstance(to, Context):
                to = self._chain(False)
            self.fall -= 1
            if not self.fall:
                after = to
                self.end -= self.most is not least
        else:
            found[2] = after
            to = least
        n = len(least.stats)
        c, others = self.most, least.total - n - (freq - 1)
        while c is not least:
            own = len(c.stats)
            self._widen(c)
            if own != 1:
                c.total += (2 * own < n) + 2 * (4 * own <= n and c.total <= 8 * own)
            else:
                c.total = c.stats[0][1] + self.escape + (n > 3)
            share, whole = 2 * freq * (c.total + 6), others + c.total
            if share < 6 * whole:
                count = 1 + (share > whole) + (share >= 4 * whole)
                c.total += 3
            else:
                count = 4 + (share >= 9 * whole) + (share >= 12 * whole) + (share >= 15 * whole)
                c.total += count
            c.stats.append([symbol, count, after])
            c = c.suffix
        self.least = self.most = to

    def _chain(self, skip: bool) -> Context:
        """Contexts of the symbol that followed the found one, for it and the suffixes that lack one."""
        found, c = self.found, self.least
        symbol, branch = found[0], found[2]
        waiting = [] if skip else [found]
        while c.suffix is not None:
            c = c.suffix
            s = c.stats[0] if len(c.stats) == 1 else next(x for x in c.stats if x[0] == symbol)
            if s[2] != branch:
                if not isinstance(s[2], Context):
                    raise malformed("PPMd data")
                c = s[2]
                if not waiting:
                    return c
                break
            waiting.append(s)
        if not isinstance(branch, int) or not branch < len(self.text):
            raise malformed("PPMd data")
        follows = self.text[branch]
        if len(c.stats) == 1:
            freq = c.stats[0][1]
        else:
            s = next((x for x in c.stats if x[0] == follows), None)
            if s is None:
                raise malformed("PPMd data")
            own = s[1] - 1
            others = c.total - len(c.stats) - own
            freq = 1 + (int(5 * own > others) if 2 * own <= others else (2 * own + 3 * others - 1) // (2 * others)) & 0xFF
        for s in reversed(waiting):
            self.heap.context(self.end)
            c = Context([[follows, freq, branch + 1]], c)
            s[2] = c
        return c


class HeapI(Heap):
    """Blocks are merged in the order of the lists, and more seldom."""

    def _merge(self) -> None:
        self.glue = 1 << 13
        size = {at: UNITS[i] for i, blocks in enumerate(self.free) for at in reversed(blocks)}
        gap = self.low if self.low != self.high else None
        for blocks in self.free:
            blocks.clear()
        order = []
        for at in size:
            if not size[at]:
                continue
            order.append(at)
            while size.get(after := at + size[at] * UNIT) and after != gap:
                size[at] += size[after]
                size[after] = 0
        for at in order:
            units = size[at]
            while units > 128:
                self.free[-1].append(at)
                at, units = at + 128 * UNIT, units - 128
            if units:
                self._put(at, units)


def _groups() -> list[int]:
    group, own, left = list(range(5)), 5, 1
    while len(group) < 260:
        group.append(own)
        left -= 1
        if not left:
            own += 1
            left = own - 4
    return group


GROUP_I = _groups()


class ModelI(Model):
    """Variant I. A context's flags: 4 after halving, 8 for a symbol from 64 up, 16 for such a symbol before it."""

    BINARY_MOST, HEAP, EVEN = 196, HeapI, 1

    def __init__(self, order: int, memory: int, cut: bool = False):
        self.cut = cut
        super().__init__(order, memory)

    def restart(self) -> None:
        super().restart()
        last = lambda m: max(i for i, g in enumerate(GROUP_I) if g == m)
        self.binary = [[BINARY_SCALE - FIRST_ESCAPES[k & 7] // (last(m) + 2) for k in range(64)] for m in range(25)]
        self.see = [[[2 * (last(m) - 2) + 5 << PERIOD - 4, PERIOD - 4, 7] for _ in range(32)] for m in range(3, 27)]

    def _binary(self, c: Context, s: list) -> tuple[list[int], int]:
        return self.binary[GROUP_I[s[1] - 1]], c.flags

    def _estimate(self, c: Context, known: int) -> tuple[list[int], int]:
        n = len(c.stats)
        if n == 256:
            return self.plain, 1
        see = self.see[GROUP_I[n + 1] - 3][(c.total > 11 * n) + 2 * (2 * (n - 1) < len(c.suffix.stats) + known - 2) + c.flags]
        r = see[0] >> see[1]
        see[0] = see[0] - r & 0xFFFF
        return see, r or 1

    def _alone(self, c: Context, one: list, escape: int) -> None:
        one[1] = min((2 * one[1] + escape - 1) // escape, MOST // 3)
        c.flags = c.flags & 16 | 8 * (one[0] >= 64)

    def _halved(self, c: Context, gone: int) -> None:
        if gone:
            c.flags = c.flags & ~8 | 8 * any(s[0] >= 64 for s in c.stats)
        c.flags |= 4

    def _update(self) -> None:
        try:
            self._grow()
        except Full:
            if self.cut:
                raise ArchiveError("unsupportedMethod", "PPMd model cut off") from None
            self.restart()

    def _grow(self) -> None:
        found, least, c = self.found, self.least, self.most
        beside = self._favour()
        symbol, freq, to = found
        if not self.fall and to:
            self.least = self.most = found[2] = self._successors(True, beside, least, found)
            return
        self._write(symbol)
        after = self.end
        if not to:
            to = self._reduced(beside, least)
        elif not isinstance(to, Context):
            to = self._successors(False, beside, least, found)
        self.fall -= 1
        if not self.fall:
            after = to
            self.end -= self.most is not least
        n = len(least.stats) - 1
        others, flag = least.total - n - freq, 8 * (symbol >= 64)
        while c is not least:
            own = len(c.stats) - 1
            self._widen(c)
            if own:
                c.total += 3 * own + 1 < n
            else:
                c.total = c.stats[0][1] + self.escape + (n > 2)
            share, whole = 2 * freq * (c.total + 6), others + c.total
            if share < 6 * whole:
                count = 1 + (share > whole) + (share >= 4 * whole)
                c.total += 4
            else:
                count = 4 + (share > 9 * whole) + (share > 12 * whole) + (share > 15 * whole)
                c.total += count
            c.stats.append([symbol, count, after])
            c.flags |= flag
            c = c.suffix
        self.least = self.most = to

    def _reduced(self, beside: list | None, c: Context) -> Context:
        """A shorter context for a symbol that nothing follows yet."""
        found, first, branch = self.found, c, self.end
        found[2] = branch
        self.fall += 1
        while True:
            if beside is not None:
                c, s, beside = c.suffix, beside, None
            else:
                if c.suffix is None:
                    return c
                c = c.suffix
                if len(c.stats) > 1:
                    s = next(x for x in c.stats if x[0] == found[0])
                    if s[1] < MOST - 9:
                        s[1] += 2
                        c.total += 2
                else:
                    s = c.stats[0]
                    s[1] += s[1] < 32
            if s[2]:
                break
            s[2] = branch
            self.fall += 1
        if not isinstance(s[2], Context):
            s[2] = self._successors(False, None, c, s)
        if self.fall == 1 and first is self.most:
            found[2] = s[2]
            self.end -= 1
        return s[2]

    def _successors(self, skip: bool, beside: list | None, c: Context, found: list) -> Context:
        symbol, branch = found[0], found[2]
        waiting = [] if skip else [found]
        while c.suffix is not None:
            c = c.suffix
            if beside is not None:
                s, beside = beside, None
            elif len(c.stats) > 1:
                s = next(x for x in c.stats if x[0] == symbol)
                if s[1] < MOST - 9:
                    s[1] += 1
                    c.total += 1
            else:
                s = c.stats[0]
                s[1] += len(c.suffix.stats) == 1 and s[1] < 24
            if s[2] != branch:
                if not isinstance(s[2], Context):
                    raise malformed("PPMd data")
                c = s[2]
                if not waiting:
                    return c
                break
            waiting.append(s)
        if not isinstance(branch, int) or not branch < len(self.text):
            raise malformed("PPMd data")
        follows = self.text[branch]
        if len(c.stats) == 1:
            freq = c.stats[0][1]
        else:
            s = next((x for x in c.stats if x[0] == follows), None)
            if s is None:
                raise malformed("PPMd data")
            own = s[1] - 1
            others = c.total - len(c.stats) + 1 - own
            freq = 1 + (int(5 * own > others) if 2 * own <= others else (own + 2 * others - 3) // others) & 0xFF
        for s in reversed(waiting):
            self.heap.context(self.end)
            c = Context([[follows, freq, branch + 1]], c, 16 * (symbol >= 64) | 8 * (follows >= 64))
            s[2] = c
        return c


def reader(data: bytes, at: int = 0) -> Callable[[], int]:
    """Bytes one by one; some zeros follow the end, then an error."""
    stream = iter(memoryview(data)[at:])
    past = 0

    def byte() -> int:
        nonlocal past
        b = next(stream, None)
        if b is None:
            past += 1
            if past > 8:
                raise ArchiveError("truncated", "PPMd data")
            return 0
        return b

    return byte


def ppmd7(data: bytes, order: int, memory: int, size: int) -> bytes:
    """A 7z stream."""
    if not 2 <= order <= 64 or not 1 << 11 <= memory <= 0xFFFFFFFF - 12 * 3:
        raise malformed("PPMd properties")
    if not size:
        return b""
    model = Model(order, memory)
    model.coder = SevenZipCoder(reader(data))
    out = bytearray()
    while len(out) < size:
        s = model.symbol()
        if s < 0:
            break
        out.append(s)
    return bytes(out)


def zip_ppmd(data: bytes, size: int, most: int) -> bytes:
    """A ZIP stream: two bytes of properties, then variant I; most: the memory allowed."""
    if len(data) < 2:
        raise ArchiveError("truncated", "PPMd data")
    props = int.from_bytes(data[:2], "little")
    order, memory, how = (props & 15) + 1, (props >> 4 & 255) + 1 << 20, props >> 12
    if order < 2 or how > 2:
        raise malformed("PPMd properties")
    if how == 2:
        raise ArchiveError("unsupportedMethod", "PPMd model frozen")
    if memory > most:
        raise ArchiveError("limitExceeded", "PPMd memory")
    if not size:
        return b""
    model = ModelI(order, memory, how == 1)
    model.coder = RarCoder(reader(data, 2))
    out = bytearray()
    while len(out) < size and (s := model.symbol()) >= 0:
        out.append(s)
    return bytes(out)
