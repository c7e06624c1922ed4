"""Compact decoders: UNIX compress, lzip, LZ4, pbzx, RLE90 and the ZIP methods of the first years."""

from __future__ import annotations

import lzma
import zlib

from ...model import ArchiveError, malformed


def uncompress(data: bytes, limit: int | None = None) -> bytes:
    """UNIX compress (.Z): LZW with 9 to 16 bit codes, read least bit first in groups of eight codes."""
    if data[:2] != b"\x1f\x9d" or len(data) < 3:
        raise malformed("compress header")
    most, block = data[2] & 31, data[2] & 0x80
    if not 9 <= most <= 16:
        raise ArchiveError("unsupportedMethod", f"compress with {most} bits")
    table: list[bytes] = [bytes([i]) for i in range(256)] + ([b""] if block else [])
    out = bytearray()
    width, at, group, prev = 9, 3 * 8, 3 * 8, b""
    whole = int.from_bytes(data, "little") if len(data) < 4096 else None
    total = len(data) * 8
    while at + width <= total:
        if whole is not None:
            code = whole >> at & ((1 << width) - 1)
        else:
            code = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << width) - 1)
        at += width
        if code == 256 and block:
            del table[257:]
            at = group + -(-(at - group) // (width * 8)) * width * 8
            group, width, prev = at, 9, b""
            continue
        if not prev:
            if code > 255:
                raise malformed("compress code")
            word = table[code]
        elif code < len(table):
            word = table[code]
        elif code == len(table) and len(table) < 1 << most:
            word = prev + prev[:1]
        else:
            raise malformed("compress code")
        out += word
        if limit is not None and len(out) > limit:
            raise malformed("more output than declared")
        if prev and len(table) < 1 << most:
            table.append(prev + word[:1])
        prev = word
        if len(table) >= 1 << width and width < most:
            at = group + -(-(at - group) // (width * 8)) * width * 8
            group, width = at, width + 1
    return bytes(out)


def unlzip(data: bytes, limit: int | None = None) -> bytes:
    """lzip members, version 1, each with its CRC and sizes verified."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"LZIP":
            if at:
                break  # trailing data
            raise malformed("lzip header")
        if len(data) < at + 6:
            raise ArchiveError("truncated")
        if data[at + 4] != 1:
            raise ArchiveError("unsupportedMethod", f"lzip version {data[at + 4]}")
        ds = data[at + 5]
        size = (1 << (ds & 31)) - (ds >> 5) * ((1 << (ds & 31)) >> 4)
        if not 1 << 12 <= size <= 1 << 29:
            raise malformed("lzip dictionary size")
        d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": size, "lc": 3, "lp": 0, "pb": 2}])
        try:
            got = d.decompress(data[at + 6 :])
        except lzma.LZMAError as e:
            raise malformed(f"lzip: {e}") from None
        if not d.eof:
            raise ArchiveError("truncated")
        end = len(data) - len(d.unused_data)
        if end + 20 > len(data):
            raise ArchiveError("truncated")
        crc, n, member = (int.from_bytes(data[end + a : end + b], "little") for a, b in ((0, 4), (4, 12), (12, 20)))
        if crc != zlib.crc32(got):
            raise ArchiveError("checksumMismatch", "lzip CRC-32")
        if n != len(got) or member != end + 20 - at:
            raise malformed("lzip member size")
        out.append(got)
        at = end + 20
        if limit is not None and sum(map(len, out)) > limit:
            raise malformed("more output than declared")
    return b"".join(out)


def lz4_block(data: bytes, history: bytes = b"", limit: int = 8 << 20) -> bytes:
    """One LZ4 block, matches may reach into history."""
    out = bytearray(history)
    at, n = 0, len(data)
    while at < n:
        token = data[at]
        at += 1
        count = token >> 4
        if count == 15:
            while True:
                if at >= n:
                    raise ArchiveError("truncated")
                count += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        if at + count > n:
            raise ArchiveError("truncated")
        out += data[at : at + count]
        at += count
        if at == n:
            break
        if at + 2 > n:
            raise ArchiveError("truncated")
        back = data[at] | data[at + 1] << 8
        at += 2
        count = token & 15
        if count == 15:
            while True:
                if at >= n:
                    raise ArchiveError("truncated")
                count += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        count += 4
        if not 0 < back <= len(out):
            raise malformed("lz4 offset")
        if len(out) - len(history) + count > limit:
            raise malformed("lz4 block too long")
        start = len(out) - back
        if back >= count:
            out += out[start : start + count]
        else:
            out += (bytes(out[start:]) * (count // back + 1))[:count]
    return bytes(out[len(history) :])


def unlz4(data: bytes, limit: int | None = None) -> bytes:
    """LZ4 frames, modern and legacy, skippable ones skipped, checksums verified."""
    import xxhash

    out, at = bytearray(), 0
    if len(data) < 4:
        raise ArchiveError("truncated")
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if at > len(data):
                raise ArchiveError("truncated")
        elif magic == 0x184C2102:
            at += 4
            while at + 4 <= len(data):
                size = int.from_bytes(data[at : at + 4], "little")
                if size == 0x184C2102 or 0x184D2A50 <= size <= 0x184D2A5F or size == 0x184D2204:
                    break
                at += 4
                if at + size > len(data):
                    raise ArchiveError("truncated")
                out += lz4_block(data[at : at + size])
                at += size
        elif magic == 0x184D2204:
            if at + 7 > len(data):
                raise ArchiveError("truncated")
            flags, bd, start = data[at + 4], data[at + 5], at + 4
            if flags >> 6 != 1:
                raise ArchiveError("unsupportedMethod", f"lz4 version {flags >> 6}")
            if flags & 2 or bd & 0x8F or bd >> 4 < 4:
                raise malformed("lz4 frame descriptor")
            at += 6
            size = None
            if flags & 8:
                size, at = int.from_bytes(data[at : at + 8], "little"), at + 8
            if flags & 1:
                raise ArchiveError("unsupportedMethod", "lz4 dictionary")
            if at >= len(data):
                raise ArchiveError("truncated")
            if data[at] != xxhash.xxh32_intdigest(data[start:at]) >> 8 & 255:
                raise malformed("lz4 header checksum")
            at += 1
            first, most = len(out), 1 << (8 + 2 * (bd >> 4))
            while True:
                if at + 4 > len(data):
                    raise ArchiveError("truncated")
                n = int.from_bytes(data[at : at + 4], "little")
                at += 4
                if not n:
                    break
                raw, n = n >> 31, n & 0x7FFFFFFF
                if n > most:
                    raise malformed("lz4 block size")
                block = data[at : at + n]
                at += n + (4 if flags & 16 else 0)
                if at > len(data):
                    raise ArchiveError("truncated")
                if flags & 16 and int.from_bytes(data[at - 4 : at], "little") != xxhash.xxh32_intdigest(block):
                    raise ArchiveError("checksumMismatch", "lz4 block")
                history = bytes(out[max(first, len(out) - 65536) :]) if not flags & 32 else b""
                out += block if raw else lz4_block(block, history, most)
                if limit is not None and len(out) > limit:
                    raise malformed("more output than declared")
            if flags & 4:
                if at + 4 > len(data):
                    raise ArchiveError("truncated")
                if int.from_bytes(data[at : at + 4], "little") != xxhash.xxh32_intdigest(bytes(out[first:])):
                    raise ArchiveError("checksumMismatch", "lz4 content")
                at += 4
            if size is not None and size != len(out) - first:
                raise malformed("lz4 content size")
        else:
            raise malformed("lz4 frame")
    return bytes(out)


def unpbzx(data: bytes, limit: int | None = None) -> bytes:
    """pbzx: xz or stored chunks up to the end of the data, each behind its size and its length; without chunks, nothing."""
    from . import unxz

    if data[:4] != b"pbzx":
        raise malformed("pbzx header")
    if len(data) < 12:
        raise ArchiveError("truncated")
    most = int.from_bytes(data[4:12], "big")
    if not most:
        raise malformed("pbzx chunk size")
    out, at, made = [], 12, 0
    while at < len(data):
        if at + 16 > len(data):
            raise ArchiveError("truncated")
        size, n = int.from_bytes(data[at : at + 8], "big"), int.from_bytes(data[at + 8 : at + 16], "big")
        if size > most:
            raise malformed("pbzx chunk size")
        chunk = data[at + 16 : at + 16 + n]
        if len(chunk) < n:
            raise ArchiveError("truncated")
        made += size
        if limit is not None and made > limit:
            raise malformed("more output than declared")
        got = unxz(chunk, size) if chunk[:6] == b"\xfd7zXZ\0" else chunk
        if len(got) != size:
            raise malformed("pbzx chunk size")
        out.append(got)
        at += 16 + n
    return b"".join(out)
