"""Format detection: structural signatures in a fixed order, strongest evidence first."""

from __future__ import annotations

import zlib

from ..model import ArchiveError, Options
from .formats import tar

#: What a file may begin with.
ZIP = (b"PK\3\4", b"PK\5\6", b"PK\7\x08", b"PK00")
RAR = (b"Rar!\x1a\x07\x01\0", b"Rar!\x1a\x07\0")
PLAIN = (
    (b"\xfd7zXZ\0", "xz"),
    (b"LZIP", "lzip"),
    (b"pbzx", "pbzx"),
    (b"MSWIM\0\0\0", "wim"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "cfb"),
)
FORMATS = "zip rar 7z lha sit sitx tar cpio ar iso udf wim cfb chm arj dmg macbinary applesingle binhex cab rpm xar gzip bzip2 xz zstd lz4 lzma lzip brotli pbzx compress".split()


def lha_header(b: bytes, length: int) -> bool:
    """Whether a level 0 to 3 header is plausible at the start."""
    if len(b) < 22 or b[2:3] != b"-" or b[6:7] != b"-" or b[3:5] not in (b"lh", b"lz", b"pm"):
        return False
    if not chr(b[5]).isalnum() or b[20] > 3:
        return False
    if b[20] < 2:
        n = b[0]
        return n >= 20 and len(b) >= n + 2 and sum(b[2 : n + 2]) & 255 == b[1]
    size = int.from_bytes(b[0:2], "little") if b[20] == 2 else int.from_bytes(b[24:28], "little")
    return 24 <= size <= length


def arj_main(b: bytes, at: int = 0) -> bool:
    size = int.from_bytes(b[at + 2 : at + 4], "little")
    return b[at : at + 2] == b"\x60\xea" and 0 < size <= 2600 and len(b) >= at + 8 + size and zlib.crc32(b[at + 4 : at + 4 + size]) == int.from_bytes(b[at + 4 + size : at + 8 + size], "little")


def mac_binary(b: bytes, length: int) -> bool:
    """A MacBinary II or III header, its CRC and fork sizes."""
    if len(b) < 128 or b[0] or b[74] or b[82] or not 1 <= b[1] <= 63:
        return False
    data, rsrc = int.from_bytes(b[83:87], "big"), int.from_bytes(b[87:91], "big")
    if data + rsrc == 0 or 128 + data + rsrc > length + 127:
        return False
    import binascii

    return binascii.crc_hqx(b[:124], 0) == int.from_bytes(b[124:126], "big")


def envelope(buf, b: bytes) -> str | None:
    """One of the wrappers around a Mac file."""
    n = len(buf)
    if b[:4] == b"\0\x05\x16\0" and len(b) >= 26:
        return "applesingle"
    if mac_binary(b, n):
        return "macbinary"
    if b[:4] in (b"SIT!", b"ST46", b"ST50", b"ST60", b"ST65", b"STin", b"STi2", b"STi3", b"STi4") and b[10:14] == b"rLau" or b[:16] == b"StuffIt (c)1997-":
        return "sit"
    if b[:8] == b"StuffIt!" or b[:8] == b"StuffIt?":
        return "sitx"
    return None


def _raw_sector(buf) -> bytes | None:
    """Sector 16 of a raw CD image, unwrapped."""
    for size, skip in ((2352, 16), (2352, 24), (2448, 16), (2448, 24), (2336, 8)):
        s = bytes(buf[16 * size + skip : 16 * size + skip + 2048])
        if s[1:6] in (b"CD001", b"BEA01"):
            return s
    return None


def _hfs_plus(head: bytes) -> bool:
    """The header of an HFS+ or HFSX volume: signature, version and block size. The signature alone stands there in one of 32,768 compressed streams."""
    size = int.from_bytes(head[40:44], "big")
    return len(head) == 512 and head[:4] in (b"H+\0\4", b"HX\0\5") and 512 <= size <= 1 << 24 and not size & size - 1


def detect(buf, name: str | None = None, opts: Options | None = None) -> str:
    """The format's name; raises unsupportedFormat."""
    opts = opts or Options()
    n = len(buf)
    b = bytes(buf[:2700])
    if tar.is_header(b[:512]):
        return "tar"
    if (wrapper := envelope(buf, b)) is not None:
        return wrapper
    if b.startswith(ZIP):
        return "zip"
    if b.startswith(b"RE~^") or b.startswith(RAR):
        return "rar"
    if b.startswith(b"7z\xbc\xaf\x27\x1c"):
        return "7z"
    if n >= 512 and bytes(buf[n - 512 : n - 508]) == b"koly" and bytes(buf[n - 504 : n - 500]) == b"\0\0\2\0":  # its own size: the word alone may stand in a stored text
        return "dmg"
    for magic, fmt in PLAIN:
        if b.startswith(magic):
            return fmt
    if b[:4] == b"ITSF" and b[4:8] in (b"\2\0\0\0", b"\3\0\0\0"):
        return "chm"
    if arj_main(b):
        return "arj"
    if b[:4] == b"xar!" and int.from_bytes(b[4:6], "big") >= 28:
        return "xar"
    if b[:4] in (b"\x04\x22\x4d\x18", b"\x02\x21\x4c\x18"):
        return "lz4"
    if b[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd"
    if len(b) >= 4 and b[1:4] == b"\x2a\x4d\x18" and b[0] >> 4 == 5:
        return _after_skippable(buf)
    if b[:4] == b"\xed\xab\xee\xdb":
        return "rpm"
    if b[:4] == b"MSCF" and len(b) > 25 and b[25] == 1:
        return "cab"
    if lha_header(b, n):
        return "lha"
    if b[:2] == b"\x1f\x8b":
        return "gzip"
    if b[:3] == b"BZh" and b[3:4] in b"123456789" and b[4:10] in (b"1AY&SY", b"\x17\x72\x45\x38\x50\x90"):
        return "bzip2"
    if b[:2] == b"\x1f\x9d":
        return "compress"
    if b[:8] in (b"!<arch>\n", b"!<thin>\n"):
        return "ar"
    if b[:6] in (b"070701", b"070702", b"070707"):
        return "cpio"
    if b"(This file must be converted with BinHex" in b[:1024]:  # a sentence that an archive's stored text may hold, so after all signatures at the start
        return "binhex"
    from .formats import zip as zip_

    try:
        _, end = zip_.find_end(buf)
        if end["base"] == 0 and (end["count"] or n == 22):
            return "zip"
    except ArchiveError:
        pass
    if (found := sfx(buf, opts)) is not None:
        return found[0]
    if n >= 34816:
        s = bytes(buf[32768:34816])
        if s[1:6] == b"CD001":
            return "iso"
        if s[1:6] == b"BEA01":
            return "udf"
        raw = _raw_sector(buf)
        if raw is not None:
            return "iso" if raw[1:6] == b"CD001" else "udf"
    if _hfs_plus(b[1024:1536]) or b[512:520] == b"EFI PART" or b[:2] == b"ER" and b[512:514] == b"PM":
        return "dmg"
    ext = (name or "").rsplit(".", 1)[-1] if "." in (name or "") else ""
    low = ext.lower()
    if low == "tar":
        return "tar"
    if ext == "Z" or low == "z":
        return "compress"
    if low in ("lha", "lzh") and b == b"\0":
        return "lha"
    if low in ("lzma", "tlz") and len(b) >= 13 and b[0] < 225 and int.from_bytes(b[1:5], "little") <= opts.limits.max_dictionary:
        return "lzma"
    if low in ("br", "tbr"):
        from .codecs import unbrotli

        try:
            unbrotli(bytes(buf))
            return "brotli"
        except ArchiveError:
            pass
    if b[:2] in (b"\xc7\x71", b"\x71\xc7"):
        return "cpio"
    raise ArchiveError("unsupportedFormat")


def _after_skippable(buf) -> str:
    at = 0
    while at + 8 <= len(buf):
        magic = int.from_bytes(bytes(buf[at : at + 4]), "little")
        if not 0x184D2A50 <= magic <= 0x184D2A5F:
            return "lz4" if magic in (0x184D2204, 0x184C2102) else "zstd"
        at += 8 + int.from_bytes(bytes(buf[at + 4 : at + 8]), "little")
    return "zstd"


def sfx(buf, opts: Options) -> tuple[str, int] | None:
    """(format, offset) of an archive behind an executable's code, by ascending offset."""
    if not opts.scan_sfx:
        return None
    head = bytes(buf[: opts.max_sfx_scan])
    if head[:2] != b"MZ" and head[:4] not in (b"\xcf\xfa\xed\xfe", b"\xce\xfa\xed\xfe", b"\xca\xfe\xba\xbe", b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf", b"\x7fELF"):
        return None
    found = []
    for order, (fmt, magic) in enumerate((("zip", b"PK\3\4"), ("rar", b"Rar!\x1a\x07"), ("7z", b"7z\xbc\xaf\x27\x1c"), ("cab", b"MSCF\0\0\0\0"), ("rar", b"RE~^"))):
        if (at := head.find(magic, 1)) > 0:
            found.append((at, order, fmt))
    if found:
        at, _, fmt = min(found)
        return fmt, at
    at = head.find(b"-lh")
    while at >= 2:
        if lha_header(head[at - 2 : at + 2698], len(buf)):
            return "lha", at - 2
        at = head.find(b"-lh", at + 1)
    at = head.find(b"\x60\xea")
    while at >= 0:
        if arj_main(head, at):
            return "arj", at
        at = head.find(b"\x60\xea", at + 1)
    return None
