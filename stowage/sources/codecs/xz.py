"""xz streams whose filters the library does not know (ARM64, RISC-V): blocks are unpacked with raw LZMA2 and filtered here."""

from __future__ import annotations

import hashlib
import lzma
import zlib

from ...model import ArchiveError, malformed
from . import raw_lzma
from .branch import arm64

_CHECK_SIZE = (0, 4, 4, 4, 8, 8, 8, 16, 16, 16, 32, 32, 32, 64, 64, 64)
_KNOWN = {4: lzma.FILTER_X86, 5: lzma.FILTER_POWERPC, 6: lzma.FILTER_IA64, 7: lzma.FILTER_ARM, 8: lzma.FILTER_ARMTHUMB, 9: lzma.FILTER_SPARC}


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 56:
            raise malformed("xz number")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def decode(data: bytes, limit: int | None = None) -> bytes:
    if data[:6] != b"\xfd7zXZ\0" or len(data) < 12:
        raise malformed("xz header")
    check, at, out = data[7] & 15, 12, []
    while at < len(data) and data[at]:
        start, size = at, (data[at] + 1) * 4
        head = data[at : at + size]
        if len(head) < size:
            raise ArchiveError("truncated")
        if zlib.crc32(head[:-4]) != int.from_bytes(head[-4:], "little"):
            raise malformed("xz block header checksum")
        flags, p = head[1], 2
        for bit in (64, 128):
            if flags & bit:
                _, p = _number(head, p)
        chain = []
        for _ in range((flags & 3) + 1):
            kind, p = _number(head, p)
            n, p = _number(head, p)
            chain.append((kind, head[p : p + n]))
            p += n
        if chain[-1][0] != 0x21:
            raise malformed("xz filter chain")
        d = chain[-1][1][0]
        width = 0xFFFFFFFF if d == 40 else (2 | d & 1) << d // 2 + 11
        unpack = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": min(width, 1 << 30)}])
        try:
            got = unpack.decompress(data[at + size :])
        except lzma.LZMAError as e:
            raise malformed(f"xz: {e}") from None
        if not unpack.eof:
            raise ArchiveError("truncated")
        for kind, props in reversed(chain[:-1]):
            begin = int.from_bytes(props, "little") if kind != 3 else 0
            if kind == 3:
                from .branch import delta

                got = delta(got, props[0] + 1)
            elif kind == 10:
                got = arm64(got, begin)
            elif kind == 11:
                from .branch import riscv

                got = riscv(got, begin)
            elif kind in _KNOWN:
                got = raw_lzma(_stored(got), [{"id": _KNOWN[kind], "start_offset": begin}, {"id": lzma.FILTER_LZMA2, "dict_size": 4096}], len(got))
            else:
                raise ArchiveError("unsupportedMethod", f"xz filter {kind}")
        at = len(data) - len(unpack.unused_data)
        at += -(at - start) % 4
        own = data[at : at + _CHECK_SIZE[check]]
        if check == 1 and own != zlib.crc32(got).to_bytes(4, "little") or check == 10 and own != hashlib.sha256(got).digest():
            raise ArchiveError("checksumMismatch", "xz block")
        at += _CHECK_SIZE[check]
        out.append(got)
        if limit is not None and sum(map(len, out)) > limit:
            raise malformed("more output than declared")
    return b"".join(out)


def _stored(data: bytes) -> bytes:
    """Bytes as uncompressed LZMA2 chunks, to run a branch filter of the library over them."""
    out = bytearray()
    for i in range(0, len(data), 65536):
        part = data[i : i + 65536]
        out += bytes([1 if i == 0 else 2]) + (len(part) - 1).to_bytes(2, "big") + part
    return bytes(out) + b"\0"


def branch(data: bytes, kind: int, start: int = 0) -> bytes:
    """One of the library's branch filters over plain bytes."""
    return raw_lzma(_stored(data), [{"id": kind, "start_offset": start}, {"id": lzma.FILTER_LZMA2, "dict_size": 4096}], len(data))
