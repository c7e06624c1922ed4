"""PPMd and RAR 2.9, by writers of their own that follow the formats from the other side."""

import random
import struct
import zlib

import pytest

from stowage.model import ArchiveError, Options
from stowage.sources.codecs import ppmd, rar
from stowage.sources.codecs.crypto import rar_key
from stowage.sources.reader import open_archive, payload


class Writer:
    """A range coder that tells the model which symbol comes and writes down how far it narrows."""

    def __init__(self, model):
        self.model, self.low, self.range, self.cache, self.size, self.out = model, 0, 0xFFFFFFFF, 0, 1, bytearray()
        model.coder = self

    def _shift(self):
        if self.low < 0xFF000000 or self.low >> 32:
            carry = self.low >> 32
            self.out += bytes([self.cache + carry & 255]) + bytes([255 + carry & 255]) * (self.size - 1)
            self.size, self.cache = 0, self.low >> 24 & 255
        self.size += 1
        self.low = self.low << 8 & 0xFFFFFFFF

    def _narrow(self):
        while self.range < 1 << 24:
            self.range = self.range << 8 & 0xFFFFFFFF
            self._shift()

    def threshold(self, total):
        self.range //= total
        at = 0
        for s in self.model.least.stats:
            if s[0] in self.masked:
                continue
            if s[0] == self.wanted:
                return at
            at += s[1]
        self.masked |= {s[0] for s in self.model.least.stats}
        return at

    def take(self, start, size):
        self.low += start * self.range
        self.range *= size
        self._narrow()

    def bit(self, zero):
        bound = (self.range >> 14) * zero
        one = self.model.least.stats[0][0] != self.wanted
        if one:
            self.masked.add(self.model.least.stats[0][0])
            self.low += bound
            self.range -= bound
        else:
            self.range = bound
        self._narrow()
        return one

    def write(self, data):
        for self.wanted in data:
            self.masked = set()
            assert self.model.symbol() == self.wanted
        for _ in range(5):
            self._shift()
        return bytes(self.out)


class Carryless(Writer):
    """The same without carries, as RAR and ZIP have it."""

    def __init__(self, model):
        super().__init__(model)

    def take(self, start, size):
        self.low = self.low + start * self.range & 0xFFFFFFFF
        self.range = self.range * size & 0xFFFFFFFF
        while True:
            if (self.low ^ self.low + self.range) & 0xFFFFFFFF >= 1 << 24:
                if self.range >= 1 << 15:
                    return
                self.range = -self.low & 0x7FFF
            self._shift()
            self.range = self.range << 8 & 0xFFFFFFFF

    def _shift(self):
        self.out.append(self.low >> 24)
        self.low = self.low << 8 & 0xFFFFFFFF

    def bit(self, zero):
        self.range >>= 14
        one = self.model.least.stats[0][0] != self.wanted
        if one:
            self.masked.add(self.model.least.stats[0][0])
        self.take(*((zero, (1 << 14) - zero) if one else (0, zero)))
        return one


def _text(n, seed=1):
    r = random.Random(seed)
    words = [bytes(r.choices(b"abcdefghij", k=r.randint(2, 7))) for _ in range(200)]
    return b" ".join(r.choices(words, k=n // 5))[:n]


@pytest.mark.parametrize("order, memory", [(2, 1 << 20), (6, 1 << 24), (16, 1 << 16), (64, 1 << 15), (4, 1 << 12)])
def test_ppmd_round_trip_also_where_memory_runs_out(order, memory):
    data = _text(30_000) + bytes(random.Random(2).randbytes(3_000)) + b"\xff" * 3_000
    packed = Writer(ppmd.Model(order, memory)).write(data)
    assert ppmd.ppmd7(packed, order, memory, len(data)) == data


@pytest.mark.parametrize("order, megabytes, how", [(2, 1, 0), (8, 1, 0), (16, 1, 0), (6, 4, 1)])
def test_ppmd_in_zip(order, megabytes, how):
    data = _text(20_000, order) + random.Random(4).randbytes(20_000 if order == 16 else 2_000) + bytes(3_000) + "\u00fcber".encode() * 500
    packed = Carryless(ppmd.ModelI(order, megabytes << 20)).write(data)
    props = (order - 1 | megabytes - 1 << 4 | how << 12).to_bytes(2, "little")
    raw = _zip(props + packed, data)
    a = open_archive(raw, "a.zip", Options())
    assert payload(a.entries[0], Options()) == data
    with pytest.raises(ArchiveError):
        payload(open_archive(_zip(props + packed[: len(packed) // 2], data), "a.zip", Options()).entries[0], Options())
    for bad in (b"", b"\0\0abcd", b"\5\x20abcd"):
        with pytest.raises(ArchiveError):
            ppmd.zip_ppmd(bad, 10, 1 << 30)


def test_ppmd_variants_where_memory_runs_out():
    data = _text(20_000) + random.Random(5).randbytes(5_000)
    for model, writer in ((ppmd.Model, Carryless), (ppmd.ModelI, Carryless)):
        packed = writer(model(8, 1 << 15)).write(data)
        again = model(8, 1 << 15)
        again.coder = ppmd.RarCoder(ppmd.reader(packed))
        assert bytes(again.symbol() for _ in data) == data
    cut = ppmd.ModelI(8, 1 << 15, True)
    cut.coder = ppmd.RarCoder(ppmd.reader(packed))
    with pytest.raises(ArchiveError) as e:
        for _ in data:
            cut.symbol()
    assert e.value.code == "unsupportedMethod"


def _zip(packed, data):
    common = struct.pack("<HHHHHIIIHH", 20, 0, 98, 0, 33, zlib.crc32(data), len(packed), len(data), 1, 0)
    local = b"PK\3\4" + common + b"a" + packed
    central = b"PK\1\2" + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, 0) + b"a"
    return local + central + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), len(local), 0)


def test_riscv_branches_become_relative():
    from stowage.sources.codecs.branch import riscv

    r = random.Random(6)
    for _ in range(50):
        at, to = 2 * r.randrange(40), 2 * r.randrange(1 << 19)
        tail, fill = bytes(8), bytes(at)
        v = to + at & 0x1FFFFF
        packed = bytes([0xEF, v >> 13 & 0xF0, v >> 9 & 255, v >> 1 & 255])
        # JAL: bits 20, 10 to 1, 11 and 19 to 12 of the target, from the top
        word = (to >> 20 & 1) << 31 | (to >> 1 & 0x3FF) << 21 | (to >> 11 & 1) << 20 | (to >> 12 & 255) << 12 | 0x6F | 0x80
        assert riscv(fill + packed + tail) == fill + word.to_bytes(4, "little") + tail
    data = bytes(range(256))
    assert riscv(b"") == b"" and len(riscv(data)) == 256


def test_ppmd_odd_inputs():
    assert ppmd.ppmd7(b"", 6, 1 << 20, 0) == b""
    for data in (b"\1\0\0\0\0", b"\0\xff\xff\xff\xff"):
        with pytest.raises(ArchiveError):
            ppmd.ppmd7(data, 6, 1 << 20, 1000)
    with pytest.raises(ArchiveError):
        ppmd.ppmd7(b"\0" * 9, 1, 1 << 20, 9)


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, v, n):
        self.text += f"{v:0{n}b}" if n else ""

    def bytes(self):
        t = self.text + "0" * (-len(self.text) % 8)
        return int(t, 2).to_bytes(len(t) // 8, "big")


def _codes(b):
    """Codes of equal lengths, so a symbol is its own code: 9, 6, 5 and 5 bits."""
    b.put(0, 2)
    for i in range(20):
        b.put(2 if i in (5, 6, 9) else 0, 4)
    for count, code in ((299, 2), (60, 1), (17, 0), (28, 0)):
        for _ in range(count):
            b.put(code, 2)


def _file(name, packed, data, flags=0, method=0x33, salt=b""):
    h = struct.pack("<BHHIIBIIBBHI", 0x74, 0x8000 | flags, 32 + len(name) + len(salt), len(packed), len(data), 3, zlib.crc32(data), 0x58000000, 29, method, len(name), 0o100644) + name + salt
    return struct.pack("<H", zlib.crc32(h) & 0xFFFF) + h + packed


def _archive(*files):
    h = struct.pack("<BHH", 0x73, 0, 13) + bytes(6)
    return b"Rar!\x1a\x07\0" + struct.pack("<H", zlib.crc32(h) & 0xFFFF) + h + b"".join(files)


def test_rar_matches_and_solid_files():
    b = Bits()
    _codes(b)
    for c in b"abcab":
        b.put(c, 9)
    b.put(271 + 2, 9), b.put(2, 6)  # 5 bytes from 3 back
    b.put(259, 9), b.put(1, 5)  # 3 bytes from the last distance
    b.put(263, 9), b.put(0, 2)  # 2 bytes from 1 back
    b.put(258, 9)  # the same once more
    b.put(256, 9), b.put(0, 1), b.put(0, 1)  # end; the codes stay
    one = b"abcab" + b"cabca" + b"bca" + b"aa" + b"aa"
    b2 = Bits()
    b2.put(ord("x"), 9), b2.put(271, 9), b2.put(3, 6), b2.put(256, 9), b2.put(0, 1), b2.put(1, 1)
    two = b"x" + (one + b"x")[-4:-1]
    a = open_archive(_archive(_file(b"1", b.bytes(), one), _file(b"2", b2.bytes(), two, 0x10)), "a.rar", Options())
    assert payload(a.entries[1], Options()) == two
    assert payload(a.entries[0], Options()) == one
    broken = open_archive(_archive(_file(b"1", b.bytes()[:-9], one)), "a.rar", Options())
    with pytest.raises(ArchiveError):
        payload(broken.entries[0], Options())


def test_rar_filters_invert_their_forward_forms():
    r = random.Random(3)
    data = r.randbytes(3 * 40 + 2)
    split = bytearray()
    for c in range(4):
        own = data[c::4]
        split += bytes(a - b & 255 for a, b in zip(b"\0" + own, own))
    assert rar._filtered("delta", split, [4], 0) == data
    code = bytearray(r.randbytes(20) + b"\xe8" + (100).to_bytes(4, "little") + bytes(20))
    made = rar._filtered("e8", bytearray(code), [], 1000)
    at = code.index(0xE8)
    assert int.from_bytes(made[at + 1 : at + 5], "little") == (int.from_bytes(code[at + 1 : at + 5], "little") - (1000 + at + 1)) % (1 << 32)
    with pytest.raises(ArchiveError):
        rar._filtered("delta", bytearray(4), [0], 0)


def test_rar_encrypted_entries():
    np = pytest.importorskip("numpy")
    from stowage.sources.codecs.crypto import aes_encrypt

    salt, data = b"saltsalt", b"0123456789abcdef"
    key, iv = rar_key("pass".encode("utf-16-le"), salt)
    block = np.frombuffer(bytes(x ^ y for x, y in zip(data, iv)), np.uint8).reshape(1, 16)
    packed = aes_encrypt(key, block).astype(np.uint8).tobytes()
    raw = _archive(_file(b"1", packed, data, 0x404, 0x30, salt))
    assert payload(open_archive(raw, "a.rar", Options(password="pass")).entries[0], Options()) == data
    for password, code in ((None, "passwordRequired"), ("other", "wrongPassword")):
        with pytest.raises(ArchiveError) as e:
            payload(open_archive(raw, "a.rar", Options(password=password)).entries[0], Options())
        assert e.value.code == code
