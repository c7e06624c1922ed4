"""Decoders, bytes to bytes."""

from __future__ import annotations

import bz2
import lzma
import zlib

from ...model import ArchiveError, malformed


def _bounded(chunks, limit: int | None) -> bytes:
    out, size = [], 0
    for c in chunks:
        size += len(c)
        if limit is not None and size > limit:
            raise malformed("more output than declared")
        out.append(c)
    return b"".join(out)


def inflate(data: bytes, limit: int | None = None, dictionary: bytes = b"") -> bytes:
    """Raw deflate."""
    d = zlib.decompressobj(-15, zdict=dictionary) if dictionary else zlib.decompressobj(-15)
    try:
        out = d.decompress(data, (limit + 1) if limit is not None else 0)
    except zlib.error as e:
        raise malformed(f"deflate: {e}") from None
    if limit is not None and len(out) > limit:
        raise malformed("more output than declared")
    if not d.eof:
        raise ArchiveError("truncated")
    return out


def gunzip(data: bytes, limit: int | None = None) -> bytes:
    """All members of a gzip stream, headers and trailers verified."""
    from .gzip import members

    return _bounded(members(data), limit)


def bunzip2(data: bytes, limit: int | None = None) -> bytes:
    """Concatenated bzip2 streams; what follows the last one is ignored."""
    def run():
        rest = data
        while rest[:3] == b"BZh":
            d = bz2.BZ2Decompressor()
            try:
                yield d.decompress(rest)
            except OSError as e:
                raise malformed(f"bzip2: {e}") from None
            if not d.eof:
                raise ArchiveError("truncated")
            rest = d.unused_data

    if data[:3] != b"BZh":
        raise malformed("bzip2 header")
    return _bounded(run(), limit)


def unxz(data: bytes, limit: int | None = None) -> bytes:
    try:
        def run():
            rest = data
            while rest:
                d = lzma.LZMADecompressor(lzma.FORMAT_XZ)
                yield d.decompress(rest)
                if not d.eof:
                    raise ArchiveError("truncated")
                rest = d.unused_data
                pad = len(rest) - len(rest.lstrip(b"\0"))
                if pad % 4:
                    raise malformed("xz stream padding")
                rest = rest[pad:]

        return _bounded(run(), limit)
    except lzma.LZMAError as e:
        from . import xz

        if "Unsupported" in str(e):
            return xz.decode(data, limit)
        raise malformed(f"xz: {e}") from None


def raw_lzma(data: bytes, filters: list[dict], size: int | None, ended: bool = False) -> bytes:
    """Raw LZMA1/2 and branch filters as the library knows them."""
    try:
        d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters)
        out = d.decompress(data, size if size is not None else -1)
        while size is not None and len(out) < size and not d.eof:
            more = d.decompress(b"", size - len(out))
            if not more:
                break
            out += more
    except (lzma.LZMAError, ValueError) as e:
        raise malformed(f"lzma: {e}") from None
    except MemoryError:
        raise ArchiveError("limitExceeded", "lzma dictionary") from None
    if size is not None and len(out) < size:
        raise ArchiveError("truncated")
    return out


def lzma_properties(props: bytes) -> dict:
    """The 5 property bytes of LZMA1 as a filter."""
    if len(props) < 5 or props[0] >= 225:
        raise malformed("lzma properties")
    d, size = props[0], max(4096, int.from_bytes(props[1:5], "little"))
    if size > 1 << 30:
        raise ArchiveError("limitExceeded", "lzma dictionary")
    return {"id": lzma.FILTER_LZMA1, "lc": d % 9, "lp": d // 9 % 5, "pb": d // 45, "dict_size": size}


def unlzma(data: bytes, limit: int | None = None) -> bytes:
    """LZMA_Alone."""
    if len(data) < 13:
        raise ArchiveError("truncated")
    size = int.from_bytes(data[5:13], "little")
    known = size != (1 << 64) - 1
    try:
        d = lzma.LZMADecompressor(lzma.FORMAT_ALONE)
        out = d.decompress(data)
    except lzma.LZMAError as e:
        raise malformed(f"lzma: {e}") from None
    if known and len(out) < size or not known and not d.eof:
        raise ArchiveError("truncated")
    return _bounded([out], limit)


def unzstd(data: bytes, limit: int | None = None) -> bytes:
    """All frames, skippable ones skipped."""
    import zstandard

    def run():
        at = 0
        while at < len(data):
            magic = int.from_bytes(data[at : at + 4], "little")
            if 0x184D2A50 <= magic <= 0x184D2A5F:
                if at + 8 > len(data):
                    raise ArchiveError("truncated")
                at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
                if at > len(data):
                    raise ArchiveError("truncated")
                continue
            if magic != 0xFD2FB528:
                raise malformed("zstd frame")
            try:
                if zstandard.get_frame_parameters(data[at : at + 18]).dict_id:
                    raise ArchiveError("unsupportedMethod", "zstd dictionary")
                d = zstandard.ZstdDecompressor(max_window_size=1 << 30).decompressobj()
                yield d.decompress(data[at:])
            except zstandard.ZstdError as e:
                raise malformed(f"zstd: {e}") from None
            if not d.eof:
                raise ArchiveError("truncated")
            at = len(data) - len(d.unused_data)

    return _bounded(run(), limit)


def unbrotli(data: bytes, limit: int | None = None) -> bytes:
    import pyarrow as pa

    try:
        return _bounded([pa.CompressedInputStream(pa.BufferReader(data), "brotli").read()], limit)
    except (OSError, pa.ArrowException) as e:
        raise malformed(f"brotli: {e}") from None
