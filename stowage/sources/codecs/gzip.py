"""gzip members (RFC 1952)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from ...model import ArchiveError, malformed


def header(data: bytes, at: int = 0) -> tuple[int, dict]:
    """Where the deflate data starts, and name, comment and time of a member."""
    if data[at : at + 2] != b"\x1f\x8b":
        raise malformed("gzip header")
    if at + 10 > len(data):
        raise ArchiveError("truncated")
    if data[at + 2] != 8:
        raise ArchiveError("unsupportedMethod", f"gzip method {data[at + 2]}")
    flags, start = data[at + 3], at
    if flags & 0xE0:
        raise malformed("gzip flags")
    found = {"mtime": int.from_bytes(data[at + 4 : at + 8], "little"), "name": None, "comment": None}
    at += 10
    if flags & 4:
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    for bit, key in ((8, "name"), (16, "comment")):
        if flags & bit:
            end = data.find(b"\0", at)
            if end < 0:
                raise ArchiveError("truncated")
            found[key], at = data[at:end], end + 1
    if flags & 2:
        if int.from_bytes(data[at : at + 2], "little") != zlib.crc32(data[start:at]) & 0xFFFF:
            raise malformed("gzip header checksum")
        at += 2
    if at > len(data):
        raise ArchiveError("truncated")
    return at, found


def members(data: bytes) -> Iterator[bytes]:
    at = 0
    while True:
        at, _ = header(data, at)
        d = zlib.decompressobj(-15)
        try:
            out = d.decompress(data[at:])
        except zlib.error as e:
            raise malformed(f"deflate: {e}") from None
        if not d.eof:
            raise ArchiveError("truncated")
        end = len(data) - len(d.unused_data)
        if end + 8 > len(data):
            raise ArchiveError("truncated")
        if int.from_bytes(data[end : end + 4], "little") != zlib.crc32(out):
            raise ArchiveError("checksumMismatch", "gzip CRC-32")
        if int.from_bytes(data[end + 4 : end + 8], "little") != len(out) & 0xFFFFFFFF:
            raise malformed("gzip length")
        yield out
        at = end + 8
        if data[at : at + 2] != b"\x1f\x8b":
            if data[at:].strip(b"\0"):
                raise malformed("data after the last gzip member")
            return
