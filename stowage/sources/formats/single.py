"""Streams that hold one file, and compressed tar or cpio."""

from __future__ import annotations

from ...model import MICRO, Archive, ArchiveError, Entry, Options
from ..codecs import bunzip2, gunzip, gzip, unbrotli, unlzma, unxz, unzstd
from ..codecs.small import uncompress, unlz4, unlzip, unpbzx

DECODERS = {"gzip": gunzip, "bzip2": bunzip2, "xz": unxz, "zstd": unzstd, "lz4": unlz4, "lzma": unlzma, "lzip": unlzip, "brotli": unbrotli, "pbzx": unpbzx, "compress": uncompress}

#: Name suffixes by stream format; those that stand for a tar or cpio inside.
_ENDINGS = {"gzip": "gz", "bzip2": "bz2 bz", "xz": "xz", "zstd": "zst", "lz4": "lz4", "lzma": "lzma", "lzip": "lz", "brotli": "br", "compress": "z", "pbzx": "pbzx"}
_TAR_SHORT = {"gzip": "tgz", "bzip2": "tbz2 tbz", "xz": "txz", "zstd": "tzst", "lzma": "tlz", "lzip": "tlz", "brotli": "tbr", "compress": "tz taz"}


def inner(name: str | None, fmt: str) -> str | None:
    """tar or cpio if the name says that the stream holds one; pbzx is looked into."""
    if fmt == "pbzx":
        return "auto"
    low = (name or "").lower()
    first = _ENDINGS[fmt].split()[0]
    if low.endswith(f".tar.{first}") or any(low.endswith(f".{s}") for s in _TAR_SHORT.get(fmt, "").split()):
        return "tar"
    if low.endswith(f".cpio.{first}") or fmt == "gzip" and low.endswith(".cpgz"):
        return "cpio"
    return None


def shown_name(name: str | None, fmt: str) -> str:
    """The file's name without its suffix; a tar's short form gets .tar."""
    base = (name or "").rsplit("/", 1)[-1] or "data"
    low = base.lower()
    for s in _TAR_SHORT.get(fmt, "").split():
        if low.endswith(f".{s}"):
            return f"{base[: -len(s) - 1]}.tar" if len(base) > len(s) + 1 else "data"
    for s in _ENDINGS[fmt].split():
        if low.endswith(f".{s}"):
            return base[: -len(s) - 1] or "data"
    return base


def known_size(data: bytes, fmt: str) -> int | None:
    """The decoded size where the stream states it for certain."""
    if fmt == "lzma" and len(data) >= 13:
        n = int.from_bytes(data[5:13], "little")
        return None if n == (1 << 64) - 1 else n
    if fmt == "zstd":
        import zstandard

        try:
            p = zstandard.get_frame_parameters(data[:18])
        except zstandard.ZstdError:
            return None
        one = zstandard.ZstdDecompressor(max_window_size=1 << 30).decompressobj()
        if p.content_size in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR):
            return None
        del one
        return p.content_size
    if fmt == "lz4" and data[:4] == b"\x04\x22\x4d\x18" and len(data) > 14 and data[4] & 8:
        return int.from_bytes(data[6:14], "little")
    if fmt == "lzip" and len(data) >= 26:
        total, end = 0, len(data)
        while end >= 26:
            member = int.from_bytes(data[end - 8 : end], "little")
            if not 26 <= member <= end or data[end - member : end - member + 4] != b"LZIP":
                return None
            total += int.from_bytes(data[end - 16 : end - 8], "little")
            end -= member
        return total if not end else None
    return None


def parse(buf, name: str | None, opts: Options, fmt: str) -> Archive:
    data = bytes(buf)
    if fmt == "lzip" and len(data) > 4 and data[4] != 1:
        raise ArchiveError("unsupportedMethod", f"lzip version {data[4]}")
    stored, mtime = None, None
    if fmt == "gzip":
        _, head = gzip.header(data)
        stored, mtime = head["name"], head["mtime"] * MICRO or None
    raw = stored if stored else shown_name(name, fmt).encode()
    e = Entry(raw, "file", known_size(data, fmt), len(data), mtime, method=fmt, declared=None if stored else "utf-8", extra={"singleFileFormat": fmt})

    def read() -> bytes:
        try:
            return DECODERS[fmt](data, opts.limits.max_entry_size)
        except ArchiveError as err:
            if opts.recover and err.code == "truncated":
                return b""
            raise

    e.read = read
    return Archive(fmt, [e])


def unpack(buf, fmt: str, opts: Options) -> bytes:
    return DECODERS[fmt](bytes(buf), opts.limits.max_entry_size)
