"""Readers on archives made by standard writers, on damaged ones, and names."""

import binascii
import bz2
import gzip
import hashlib
import io
import lzma
import random
import struct
import tarfile
import zipfile
import zlib

import pytest

from stowage.functions import sql as functions
from stowage.model import ArchiveError, Options
from stowage.packing import PACKERS, SEVEN, compress, pack_7z, pack_cpio, pack_tar, pack_zip
from stowage.sources import names
from stowage.sources.codecs import branch, crypto, small
from stowage.sources.detect import detect
from stowage.sources.reader import open_archive, rows
from stowage.sources.volumes import group

ITEMS = [("a/one.txt", "file", b"hello " * 50), ("two", "file", b""), ("b/three.bin", "file", bytes(range(256)) * 40), ("four", "file", b"x")]


def read(name, data, **options):
    return list(rows(name, data, Options(**options), True))


@pytest.mark.parametrize("kind", sorted(PACKERS))
def test_round_trip(kind):
    got = read(f"x.{kind}", PACKERS[kind](ITEMS))
    assert [(r["name"], r["content"], r["error"]) for r in got] == [(n, d, None) for n, _, d in ITEMS]
    assert [r["index"] for r in got] == list(range(len(ITEMS)))


@pytest.mark.parametrize("kind", ["gz", "bz2", "xz", "lzma", "zst", "lz4", "br", "lz", "pbzx"])
def test_streams(kind):
    data = b"some text, some text\n" * 3000
    packed = compress(kind, data)
    got = read(f"dir/n.txt.{kind}", packed)
    assert [(r["name"], r["content"]) for r in got] == [("n.txt", data)]
    cut = read(f"n.txt.{kind}", packed[: len(packed) - 6])
    assert cut[0]["error"] is not None


def test_gzip_name_and_members():
    one = io.BytesIO()
    with gzip.GzipFile("inner.dat", "wb", fileobj=one, mtime=99) as f:
        f.write(b"abc")
    got = read("outer.gz", one.getvalue() + gzip.compress(b"def"))
    assert got[0]["name"] == "inner.dat" and got[0]["content"] == b"abcdef"
    bad = bytearray(gzip.compress(b"abcabc"))
    bad[-6] ^= 1
    assert read("x.gz", bytes(bad))[0]["error"]["code"] == "checksumMismatch"


def test_compress_lzw():
    # 9-bit codes, least bit first: a, b, then the string that starts at code 257
    codes = [97, 98, 257, 259]
    value = 0
    for i, c in enumerate(codes):
        value |= c << 9 * i
    data = b"\x1f\x9d\x90" + value.to_bytes(5, "little")
    assert small.uncompress(data) == b"abababa"


def test_zip_details():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("d/", b"")
        info = zipfile.ZipInfo("link")
        info.external_attr = 0o120777 << 16
        z.writestr(info, b"target")
        z.writestr("日本.txt", b"x", zipfile.ZIP_DEFLATED)
    got = read("x.zip", out.getvalue())
    assert [(r["kind"], r["name"]) for r in got] == [("directory", "d/"), ("symlink", "link"), ("file", "日本.txt")]
    assert got[2]["declared_encoding"] == "utf-8" and got[2]["raw_record"]["payload_end"] <= len(out.getvalue())
    flipped = bytearray(out.getvalue())
    flipped[got[1]["raw_record"]["payload_start"]] ^= 1
    again = read("x.zip", bytes(flipped))
    assert again[1]["error"]["code"] == "checksumMismatch" and again[2]["error"] is None
    lost = out.getvalue()[: out.getvalue().index(b"PK\1\2")]
    assert read("x.zip", lost)[0]["error"]["code"] == "malformed"
    saved = read("x.zip", lost, recover=True)
    assert all(r["is_incomplete"] for r in saved) and saved[1]["content"] == b"target"


def test_zip_overlap_is_malformed():
    data = bytearray(pack_zip(ITEMS))
    first = data.index(b"PK\1\2")
    second = data.index(b"PK\1\2", first + 4)
    data[second + 42 : second + 46] = data[first + 42 : first + 46]
    with pytest.raises(ArchiveError) as e:
        open_archive(bytes(data), "x.zip")
    assert e.value.code == "malformed"


def test_split_zip():
    data = pack_zip(ITEMS)
    plain = open_archive(data, "x.zip").entries
    # the first entry on volume 0, the rest on volume 1, offsets relative to their volume
    cut = plain[1].record[0]
    b = bytearray(data)
    at = b.index(b"PK\1\2")
    for e in plain:
        on = int(e.record[0] >= cut)
        b[at + 34 : at + 36] = on.to_bytes(2, "little")
        b[at + 42 : at + 46] = (e.record[0] - on * cut).to_bytes(4, "little")
        at = b.index(b"PK", at + 46)
    end = b.rindex(b"PK\5\6")
    b[end + 4 : end + 8] = b"\1\0\1\0"
    b[end + 16 : end + 20] = (int.from_bytes(b[end + 16 : end + 20], "little") - cut).to_bytes(4, "little")
    got = read("x.zip", bytes(b), volume_starts=(0, cut))
    assert [(r["name"], r["content"], r["error"]) for r in got] == [(n, d, None) for n, _, d in ITEMS]
    assert read("x.zip", bytes(b), volume_starts=(0, 1, 2))[0]["error"]["code"] == "malformed"


def winzip(data, password, strength=3):
    import hmac

    salt = bytes(range(4 + 4 * strength))
    n = 8 + 8 * strength
    key = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 2 * n + 2)
    body = crypto.aes_ctr_le(key[:n], data)
    return salt + key[-2:] + body + hmac.new(key[n : 2 * n], body, "sha1").digest()[:10]


def test_aes():
    import numpy as np

    key = bytes(range(16))
    block = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8).reshape(1, 16)
    assert crypto.aes_encrypt(key, block).tobytes().hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert (crypto.aes_decrypt(key, crypto.aes_encrypt(bytes(range(16)), block)) == block).all()
    long = bytes(range(32))
    assert crypto.aes_encrypt(long, block).tobytes().hex() == "8ea2b7ca516745bfeafc49904b496089"
    packed = winzip(b"secret text", b"pw")
    assert crypto.winzip_aes(packed, b"pw", 3) == b"secret text"
    with pytest.raises(ArchiveError):
        crypto.winzip_aes(packed, b"no", 3)


def test_tar_names_links_and_sparse():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as t:
        info = tarfile.TarInfo("n" * 150)
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
        info = tarfile.TarInfo("hard")
        info.type, info.linkname = tarfile.LNKTYPE, "n" * 150
        t.addfile(info)
    got = read("x.tar", out.getvalue())
    assert got[0]["name"] == "n" * 150 and got[1]["kind"] == "hardlink" and dict(got[1]["format_specific"])["linkPath"] == "n" * 150
    pax = pack_tar([("é" * 100, "file", b"1"), ("d", "directory", b"")])
    got = read("x.tar", pax)
    assert got[0]["name"] == "é" * 100 and got[0]["declared_encoding"] == "utf-8" and got[1]["kind"] == "directory"
    assert read("x.tar", pax[:700])[0]["error"]["code"] in ("truncated", "malformed")


def test_cpio_hard_links_and_symlinks():
    data = pack_cpio([("a", "file", b"1"), ("b", "symlink", b"a")], lambda n, i: (7, 2))
    got = read("x.cpio", data + data)
    assert len(got) == 4 and dict(got[2]["format_specific"])["hardLinkGroup"] == "1:1:7"
    assert dict(got[1]["format_specific"])["linkPath"] == "a"


def test_detection_order_and_unknown():
    assert detect(b"PK\5\6" + bytes(18)) == "zip"
    assert detect(b"7z\xbc\xaf\x27\x1c" + bytes(30)) == "7z"
    assert detect(b"MSCF" + bytes(21) + b"\1" + bytes(20)) == "cab"
    assert detect(b"\x28\xb5\x2f\xfd" + bytes(20)) == "zstd"
    with pytest.raises(ArchiveError) as e:
        detect(b"plain text, nothing else")
    assert e.value.code == "unsupportedFormat"
    assert detect(pack_tar(ITEMS)) == "tar"


def test_any_damage_is_a_row():
    r = random.Random(7)
    for kind in ("zip", "tar", "cpio", "ar", "tar.gz"):
        data = PACKERS[kind](ITEMS)
        for _ in range(60):
            b = bytearray(data)
            for _ in range(r.randint(1, 4)):
                b[r.randrange(len(b))] = r.randrange(256)
            if r.random() < 0.3:
                b = b[: r.randrange(len(b))]
            for row in read(f"x.{kind}", bytes(b)):
                assert row["error"] is None or row["error"]["code"]


def test_mszip_cabinet():
    files = [(b"a.txt", b"first file " * 20), (b"d\\b.txt", b"second")]
    body = b"".join(d for _, d in files)
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = b"CK" + c.compress(body) + c.flush()
    heads, at = b"", 0
    for n, d in files:
        heads += struct.pack("<IIHHHH", len(d), at, 0, 0x5021, 0, 0x20) + n + b"\0"
        at += len(d)
    start = 36 + 8
    data_at = start + len(heads)
    cab = struct.pack("<4sIIIIIBBHHHHH", b"MSCF", 0, data_at + 8 + len(packed), 0, start, 0, 3, 1, 1, 2, 0, 0, 0) + struct.pack("<IHH", data_at, 1, 1) + heads + struct.pack("<IHH", 0, len(packed), len(body)) + packed
    got = read("x.cab", cab)
    assert [(r["name"], r["content"], r["solid_group"]) for r in got] == [("a.txt", files[0][1], 0), ("d/b.txt", files[1][1], 0)]


def test_lha_stored():
    from stowage.functions.sql import crc16

    data, name = b"stored bytes", b"f.txt"
    body = b"-lh0-" + struct.pack("<IIIBB", len(data), len(data), 0x50210000, 0x20, 0) + bytes([len(name)]) + name + struct.pack("<H", crc16(data))
    head = bytes([len(body), sum(body) & 255]) + body
    got = read("x.lzh", head + data + b"\0")
    assert [(r["name"], r["content"], r["error"]) for r in got] == [("f.txt", data, None)]


def test_branch_filters():
    from stowage.sources.codecs.xz import branch as known

    data = bytes(random.Random(1).randrange(256) for _ in range(4000))
    for kind in (lzma.FILTER_X86, lzma.FILTER_ARM, lzma.FILTER_POWERPC, lzma.FILTER_SPARC):
        raw = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": kind}, {"id": lzma.FILTER_LZMA2}])
        plain = lzma.decompress(raw, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2}])
        assert known(plain, kind) == data
    assert branch.delta(bytes([1, 1, 1, 1]), 1) == bytes([1, 2, 3, 4])
    assert branch.swap(b"abcde", 2) == b"badce"


def test_checksums():
    assert functions.crc16(b"123456789") == 0xBB3D
    assert functions.xmodem(b"123456789") == 0x31C3
    assert functions.crc64(b"123456789") == 0x995DC9BBDF1939FA
    assert functions.same_digest(b"a", b"a") and not functions.same_digest(b"a", b"b")
    assert functions.blake2sp(b"").hex().startswith("dd0e891776933f43")
    assert bz2.decompress(compress("bz2", b"z")) == b"z"


def test_names():
    for charset, words in (("cp932", ["日本語のファイル", "テスト", "写真アルバム"]), ("cp1251", ["Документы", "Привет мир"]), ("euc_kr", ["한국어 문서", "사진첩"])):
        raw = [w.encode(charset) for w in words]
        found = names.detect_archive(raw, language={"cp932": "ja", "cp1251": "ru", "euc_kr": "ko"}[charset])
        assert [names.resolve(b, None, found) for b in raw] == words
    assert names.detect(b"plain")[0] == "utf-8" and names.detect_archive([b"plain", "é".encode()]) is None
    assert names.one_line("a\tb\\\x01‮") == "a\\tb\\\\\\u{1}\\u{202e}"
    assert names.safe_path("a/./b//c") == ["a", "b", "c"] and names.safe_path("a/../b") is None and names.safe_path("/a") is None


def test_volume_sets():
    got = group(["d/x.001", "d/x.002", "d/x.004", "d/y.zip", "d/y.z01", "d/z.part1.rar", "d/z.part2.rar", "d/old.rar", "d/old.r00", "d/one.001", "d/a.txt"])
    assert ["d/x.001", "d/x.002"] in got and ["d/x.004"] in got and ["d/y.z01", "d/y.zip"] in got
    assert ["d/z.part1.rar", "d/z.part2.rar"] in got and ["d/old.rar", "d/old.r00"] in got and ["d/one.001"] in got


class Bits:
    """Bits, most significant first."""

    def __init__(self):
        self.s = ""

    def put(self, v, n):
        self.s += f"{v:0{n}b}" if n else ""

    def bytes(self):
        return int(self.s.ljust(-(-len(self.s) // 8) * 8, "0"), 2).to_bytes(-(-len(self.s) // 8), "big")


def rar5_block(steps, last=True, tables=True):
    """A block whose codes are flat: 9 bits a main symbol, 6 a distance or repeated length, 4 a low distance."""
    b = Bits()
    if tables:
        for i in range(20):
            b.put(2 if i in (4, 6, 9) else 0, 4)
        for length, n in ((9, 306), (6, 64), (4, 16), (6, 44)):
            for _ in range(n):
                b.put({4: 0, 6: 1, 9: 2}[length], 2)
    for step in steps:
        if isinstance(step, bytes):
            for c in step:
                b.put(c, 9)
        elif step[0] == "match":  # slot of the length, distance slot, its bits as (value, width) pairs
            b.put(262 + step[1], 9)
            b.put(step[2], 6)
            for v, n in step[3]:
                b.put(v, n)
        elif step[0] == "again":
            b.put(257, 9)
        elif step[0] == "old":
            b.put(258 + step[1], 9)
            b.put(step[2], 6)
        else:  # filter: start, length, type, channels
            b.put(256, 9)
            for v in step[1:3]:
                b.put(1, 2)
                b.put(v & 255, 8)
                b.put(v >> 8, 8)
            b.put(step[3], 3)
            if step[3] == 0:
                b.put(step[4] - 1, 5)
    body = b.bytes()
    used = len(b.s) - 8 * (len(body) - 1)
    flags = used - 1 | 1 << 3 | (0x40 if last else 0) | (0x80 if tables else 0)
    size = len(body).to_bytes(2, "little")
    return bytes([flags, 0x5A ^ flags ^ size[0] ^ size[1]]) + size + body


def rar5(files):
    vint = lambda v: b"" .join(bytes([v >> 7 * i & 127 | (128 if v >> 7 * (i + 1) else 0)]) for i in range(max(1, -(-v.bit_length() // 7))))

    def block(head):
        whole = vint(len(head)) + head
        return zlib.crc32(whole).to_bytes(4, "little") + whole

    out = b"Rar!\x1a\x07\1\0" + block(vint(1) + vint(0) + vint(0))
    for name, data, packed, method, solid in files:
        info = method << 7 | (64 if solid else 0)
        head = vint(2) + vint(2) + vint(len(packed)) + vint(4) + vint(len(data)) + vint(0o100644) + zlib.crc32(data).to_bytes(4, "little") + vint(info) + vint(1) + vint(len(name)) + name
        out += block(head) + packed
    return out + block(vint(5) + vint(0) + vint(0))


def test_rar5_matches_filters_and_solid_groups():
    one = b"abcdefgh" + b"defgh" * 3 + b"zz" + b"h" * 4
    steps = [b"abcdefgh", ("match", 3, 4, [(0, 1)]), ("again",), ("old", 0, 3), b"zz", b"h", ("match", 1, 0, [])]
    packed = rar5_block(steps[:3], last=False) + rar5_block(steps[3:], tables=False)
    two = b"efgh" + bytes(range(0, 240, 3))  # its start lies in the window of the file before
    plain = two[4:]
    turned = bytes((a - b) & 255 for a, b in zip(b"\0" + plain[:-1], plain))
    back = len(one) - one.index(b"efgh")
    slot = next(s for s in range(4, 20) if 1 + ((2 | s & 1) << (s >> 1) - 1) <= back < 1 + ((2 | s & 1) << (s >> 1) - 1) + (1 << (s >> 1) - 1))
    more = (slot >> 1) - 1
    rest = back - 1 - ((2 | slot & 1) << more)
    place = [(rest, more)] if more < 4 else ([(rest >> 4, more - 4)] if more > 4 else []) + [(rest & 15, 4)]
    packed2 = rar5_block([("match", 2, slot, place), ("filter", 0, len(plain), 0, 1), turned], tables=False)
    made = rar5([(b"one", one, packed, 3, False), (b"two", two, packed2, 3, True), (b"raw", b"stored", b"stored", 0, False)])
    got = {r["name"]: r for r in read("x.rar", made)}
    assert [(got[n]["content"], got[n]["error"]) for n in ("one", "two", "raw")] == [(one, None), (two, None), (b"stored", None)]
    entries = {e.name: e for e in open_archive(made, "x.rar", Options()).entries}
    assert entries["two"].read() == two and entries["one"].read() == one and entries["two"].read() == two
    broken = bytearray(made)
    broken[made.index(packed2) + 10] ^= 8
    assert [r["error"] and r["error"]["code"] for r in read("x.rar", bytes(broken))][1] is not None
    cut = rar5([(b"one", one, packed[:-20], 3, False)])
    assert read("x.rar", cut)[0]["error"]["code"] in ("truncated", "malformed")


def test_rar5_encrypted_data_and_headers_need_the_password():
    import hmac

    salt, iv, power, word = bytes(range(16)), bytes(range(16, 32)), 5, "pass ﾜｰﾄﾞ"
    derived = [hashlib.pbkdf2_hmac("sha256", word.encode(), salt, (1 << power) + k) for k in (0, 16, 32)]
    fold = lambda b, n: bytes(__import__("functools").reduce(lambda x, y: bytes(i ^ j for i, j in zip(x, y)), [b[i : i + n] for i in range(0, 32, n)]))
    lock = {"tied": True, "power": power, "salt": salt, "iv": iv, "check": fold(derived[2], 8)}
    from stowage.sources.formats import rar

    assert rar._key5(lock, Options(password=word)) == derived[0] and rar._key5(lock, Options(password=word), 16) == derived[1]
    for password, code in ((None, "passwordRequired"), ("other", "wrongPassword")):
        with pytest.raises(ArchiveError) as e:
            rar._key5(lock, Options(password=password))
        assert e.value.code == code
    data = b"sixteen bytes !!"
    tied = int.from_bytes(fold(hmac.digest(derived[1], zlib.crc32(crypto.aes_cbc(derived[0], iv, data)).to_bytes(4, "little"), "sha256"), 4), "little")
    assert rar._read5(data, 0, 16, 16, 0, tied, lock, None, None, Options(password=word))() == crypto.aes_cbc(derived[0], iv, data)


@pytest.mark.parametrize("coder", sorted(SEVEN))
def test_seven_zip_coders(coder):
    got = read("x.7z", pack_7z([*ITEMS, ("d", "directory", b"")], coder))
    assert [(r["name"], r["kind"], r["content"], r["error"]) for r in got] == [*[(n, "file", d, None) for n, _, d in ITEMS], ("d", "directory", b"", None)]
    assert [r["bytes"] for r in read("x.7z", pack_7z([("e", "file", b"")], coder))] == [0]
    broken = bytearray(pack_7z(ITEMS, coder))
    broken[40] ^= 16
    assert any(r["error"] for r in read("x.7z", bytes(broken)))
    assert read("x.7z", pack_7z(ITEMS, coder)[:-3])[0]["error"]


def test_mac_wrappers():
    data, fork = b"data fork " * 30, b"resource"
    head = bytearray(128)
    head[1], head[2:6], head[65:69], head[69:73] = 4, b"name", b"TEXT", b"ttxt"
    head[83:87], head[87:91] = len(data).to_bytes(4, "big"), len(fork).to_bytes(4, "big")
    head[122] = head[123] = 129
    head[124:126] = binascii.crc_hqx(bytes(head[:124]), 0).to_bytes(2, "big")
    pad = lambda b: b + bytes(-len(b) % 128)
    got = read("x.bin", bytes(head) + pad(data) + pad(fork))
    assert data in [r["content"] for r in got] and fork in [r["content"] for r in got] and not any(r["error"] for r in got)
    parts = [(3, b"name"), (1, data), (2, fork)]
    at, table, body = 26 + 12 * len(parts), b"", b""
    for tag, raw in parts:
        table += struct.pack(">III", tag, at + len(body), len(raw))
        body += raw
    got = read("x.as", struct.pack(">II16xH", 0x00051600, 0x00020000, len(parts)) + table + body)
    assert data in [r["content"] for r in got] and not any(r["error"] for r in got)
    crc = lambda b: binascii.crc_hqx(b, 0).to_bytes(2, "big")
    inner = b"\4name\0TEXTttxt\0\0" + struct.pack(">II", len(data), len(fork))
    plain = inner + crc(inner) + data + crc(data) + fork + crc(fork)
    packed = plain.replace(b"\x90", b"\x90\0")
    packed += bytes(-len(packed) % 3)
    alphabet = "!\"#$%&'()*+,-012345689@ABCDEFGHIJKLMNPQRSTUVXYZ[`abcdefhijklmpqr"
    chars = "".join(alphabet[int.from_bytes(packed[i : i + 3], "big") >> k & 63] for i in range(0, len(packed), 3) for k in (18, 12, 6, 0))
    text = "(This file must be converted with BinHex 4.0)\n\n:" + "\n".join(chars[i : i + 64] for i in range(0, len(chars), 64)) + ":\n"
    got = read("x.hqx", text.encode())
    assert data in [r["content"] for r in got] and fork in [r["content"] for r in got] and not any(r["error"] for r in got)


def test_xar():
    data = b"in a xar " * 40
    packed = zlib.compress(data)
    sha = lambda b: hashlib.sha1(b).hexdigest()
    toc = f'<?xml version="1.0"?><xar><toc><checksum style="sha1"><offset>0</offset><size>20</size></checksum><file id="1"><name>d</name><type>directory</type><file id="2"><name>f</name><type>file</type><data><offset>20</offset><size>{len(data)}</size><length>{len(packed)}</length><encoding style="application/x-gzip"/><extracted-checksum style="sha1">{sha(data)}</extracted-checksum><archived-checksum style="sha1">{sha(packed)}</archived-checksum></data></file></file></toc></xar>'.encode()
    small = zlib.compress(toc)
    made = struct.pack(">4sHHQQI", b"xar!", 28, 1, len(small), len(toc), 1) + small + hashlib.sha1(small).digest() + packed
    got = read("x.xar", made)
    assert [(r["name"].strip("/"), r["kind"], r["error"]) for r in got] == [("d", "directory", None), ("d/f", "file", None)] and got[1]["content"] == data
    assert read("x.xar", made[:-5])[1]["error"]


def iso(files):
    both = lambda v, n: v.to_bytes(n, "little") + v.to_bytes(n, "big")

    def record(name, at, size, flags):
        body = b"\0" + both(at, 4) + both(size, 4) + bytes([120, 1, 2, 3, 4, 5, 0, flags, 0, 0]) + both(1, 2) + bytes([len(name)]) + name + (b"" if len(name) % 2 else b"\0")
        return bytes([len(body) + 1]) + body

    sector = lambda b: b + bytes(-len(b) % 2048)
    at, rows, body = 19, b"", b""
    for name, data in files:
        rows += record(name, at, len(data), 0)
        body += sector(data)
        at += -(-len(data) // 2048)
    root = record(b"\0", 18, 2048, 2) + record(b"\1", 18, 2048, 2) + rows
    pvd = b"\1CD001\1\0" + b" " * 32 + b"VOLUME".ljust(32) + bytes(8) + both(at, 4) + bytes(32) + both(1, 2) + both(1, 2) + both(2048, 2) + both(10, 4) + bytes(16) + record(b"\0", 18, 2048, 2)
    return bytes(16 * 2048) + sector(pvd) + sector(b"\xffCD001\1") + sector(root) + body


def test_iso():
    files = [(b"A.TXT;1", b"first" * 900), (b"B.BIN;1", b"second")]
    got = [r for r in read("x.iso", iso(files)) if r["kind"] == "file"]
    assert [(r["name"].upper().split(";")[0], r["content"], r["error"]) for r in got] == [(n.decode().split(";")[0], d, None) for n, d in files]
    assert any(r["error"] for r in read("x.iso", iso(files)[:-2100]))


def test_zip_crypto():
    """Encrypted here by the cipher's public description."""
    table = [0] * 256
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table[i] = c
    keys = [0x12345678, 0x23456789, 0x34567890]

    def update(b):
        keys[0] = keys[0] >> 8 ^ table[(keys[0] ^ b) & 255]
        keys[1] = ((keys[1] + (keys[0] & 255)) * 134775813 + 1) & 0xFFFFFFFF
        keys[2] = keys[2] >> 8 ^ table[(keys[2] ^ keys[1] >> 24) & 255]

    def lock(data):
        out = bytearray()
        for b in data:
            k = keys[2] | 2
            out.append(b ^ (k * (k ^ 1) >> 8 & 255))
            update(b)
        return bytes(out)

    for c in b"secret":
        update(c)
    data = b"under lock " * 9
    crc = zlib.crc32(data)
    packed = lock(bytes(11) + bytes([crc >> 24]) + data)
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 20, 1, 0, 0, 0x5021, crc, len(packed), len(data), 1, 0) + b"a"
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 20, 20, 1, 0, 0, 0x5021, crc, len(packed), len(data), 1, 0, 0, 0, 0, 0, 0) + b"a"
    made = local + packed + central + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 1, 1, len(central), len(local) + len(packed), 0)
    assert read("x.zip", made, password="secret")[0]["content"] == data
    assert read("x.zip", made)[0]["error"]["code"] == "passwordRequired"
    assert read("x.zip", made, password="Secret")[0]["error"]["code"] == "wrongPassword"
