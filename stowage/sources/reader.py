"""Opening archives from bytes: detection, unwrapping, names, limits, rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from ..model import MICRO, Archive, ArchiveError, Entry, Options, malformed
from . import detect as detection
from . import names
from .formats import single, tar, unix
from .formats import zip as zip_


def _lazy(module: str, function: str = "parse") -> Callable:
    def call(buf, name, opts):
        import importlib

        return getattr(importlib.import_module(f"stowage.sources.formats.{module}"), function)(buf, name, opts)

    return call


PARSERS: dict[str, Callable] = {
    "zip": zip_.parse,
    "tar": tar.parse,
    "cpio": unix.parse_cpio,
    "ar": unix.parse_ar,
    "cab": _lazy("cab"),
    "rpm": _lazy("rpm"),
    "xar": _lazy("xar"),
    "7z": _lazy("sevenzip"),
    "iso": _lazy("iso"),
    "udf": _lazy("udf"),
    "cfb": _lazy("cfb"),
    "wim": _lazy("wim"),
    "chm": _lazy("chm"),
    "lha": _lazy("lha"),
    "arj": _lazy("arj"),
    "rar": _lazy("rar"),
    "macbinary": _lazy("mac", "parse_macbinary"),
    "applesingle": _lazy("mac", "parse_applesingle"),
    "binhex": _lazy("mac", "parse_binhex"),
}


def _resolve(archive: Archive, opts: Options) -> Archive:
    """Indices and names, with one charset for all undeclared ones."""
    undeclared = [e.raw_name for e in archive.entries if not e.declared and e.name is None]
    undeclared += [v for e in archive.entries if not e.declared for v in e.links.values()]
    archive.name_encoding = names.detect_archive(undeclared, opts.encoding, opts.language) or archive.name_encoding
    for i, e in enumerate(archive.entries):
        e.index = i
        if e.name is None:
            e.name = names.resolve(e.raw_name, e.declared, archive.name_encoding, opts.encoding, opts.language)
        for key, raw in e.links.items():
            e.extra[key] = names.resolve(raw, e.declared, archive.name_encoding, opts.encoding, opts.language)
        if len(names.components(e.name)) > opts.limits.max_components:
            raise ArchiveError("limitExceeded", "path component count")
    if sum(e.size or 0 for e in archive.entries) > opts.limits.max_total_size:
        raise ArchiveError("limitExceeded", "total uncompressed size")
    return archive


def open_archive(buf, name: str | None = None, opts: Options | None = None) -> Archive:
    """The listing of an archive in a buffer; raises ArchiveError if it does not open."""
    opts = opts or Options()
    fmt = detection.detect(buf, name, opts)
    try:
        if fmt in single.DECODERS:
            kind = single.inner(name, fmt)
            if kind:
                inside = single.unpack(buf, fmt, opts)
                if kind == "auto":
                    kind = "cpio" if unix.is_cpio(inside) else None
                if kind:
                    return _resolve(PARSERS[kind](inside, name, opts), opts)
            return _resolve(single.parse(buf, name, opts, fmt), opts)
        if fmt not in PARSERS:
            raise ArchiveError("unsupportedFormat", fmt)
        if (found := detection.sfx(buf, opts)) is not None and found[0] == fmt and fmt != "zip":
            buf = memoryview(buf)[found[1] :] if not isinstance(buf, memoryview) else buf[found[1] :]
        return _resolve(PARSERS[fmt](buf, name, opts), opts)
    except (IndexError, ValueError, KeyError, OverflowError, RecursionError, UnicodeError) as e:
        raise malformed(f"{fmt}: {e!r}") from None
    except MemoryError:
        raise ArchiveError("limitExceeded", fmt) from None
    except ArchiveError:
        raise
    except Exception as e:  # a row, whatever it is
        raise malformed(f"{fmt}: {e!r}") from None


def payload(e: Entry, opts: Options) -> bytes:
    """An entry's verified bytes; raises ArchiveError."""
    if e.kind == "directory" or e.read is None:
        return b""
    if e.size is not None and e.size > opts.limits.max_in_memory:
        raise ArchiveError("limitExceeded", "entry size")
    try:
        out = e.read()
    except (IndexError, ValueError, KeyError, OverflowError, RecursionError) as err:
        raise malformed(repr(err)) from None
    except MemoryError:
        raise ArchiveError("limitExceeded", "memory") from None
    except ArchiveError:
        raise
    except Exception as err:  # a row, whatever it is
        raise malformed(repr(err)) from None
    if len(out) > opts.limits.max_in_memory:
        raise ArchiveError("limitExceeded", "entry size")
    return out


def error_of(e: ArchiveError) -> dict[str, str]:
    return {"code": e.code, "detail": e.detail}


def entry_row(path: str | None, fmt: str, e: Entry) -> dict:
    from datetime import UTC, datetime, timedelta

    when = None
    if e.mtime is not None:
        try:
            when = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=e.mtime)
        except OverflowError:
            when = None
    record = dict(zip(("record_start", "record_end", "payload_start", "payload_end"), e.record)) if e.record else None
    return {
        "archive_path": path, "format": fmt, "index": e.index, "raw_name": e.raw_name, "declared_encoding": e.declared, "is_directory_hint": e.dir_hint,
        "name": e.name.encode("utf-8", "replace").decode(), "path_components": names.components(e.name.encode("utf-8", "replace").decode()), "kind": e.kind, "uncompressed_size": e.size, "compressed_size": e.packed,
        "modification_date": when, "posix_permissions": e.mode, "is_encrypted": e.encrypted, "is_incomplete": e.incomplete, "solid_group": e.solid, "crc32": e.crc,
        "method_description": e.method, "format_specific": list(e.extra.items()), "raw_record": record, "error": None,
    }


def rows(path: str | None, buf, opts: Options, content: bool = False, wanted: Callable[[dict], bool] = lambda row: True) -> Iterator[dict]:
    """Listing rows, with payloads on request, read only where wanted; what fails is a row with an error, never an exception."""
    try:
        archive = open_archive(buf, path, opts)
    except ArchiveError as e:
        yield {"archive_path": path, "error": error_of(e)}
        return
    produced = 0
    for e in archive.entries:
        row = entry_row(path, archive.format, e)
        if content and wanted(row):
            try:
                data = payload(e, opts)
                produced += len(data) if e.size is None else e.size
                if produced > opts.limits.max_total_size:
                    raise ArchiveError("limitExceeded", "total uncompressed size")
                row |= {"bytes": len(data), "content": data}
            except ArchiveError as err:
                row["error"] = error_of(err)
        yield row


def digest_rows(path: str | None, buf, opts: Options) -> Iterator[dict]:
    """Rows with byte counts and SHA-256 made at the worker, for payloads too large for a cell.

    Entries that can be read in pieces are, at any size up to max_entry_size; others within max_in_memory.
    """
    try:
        archive = open_archive(buf, path, opts)
    except ArchiveError as e:
        yield {"archive_path": path, "error": error_of(e)}
        return
    produced = 0
    for e in archive.entries:
        row = entry_row(path, archive.format, e)
        try:
            size, sha = 0, hashlib.sha256()
            for piece in _pieces(e, opts):
                size += len(piece)
                sha.update(piece)
            produced += size if e.size is None else e.size
            if produced > opts.limits.max_total_size:
                raise ArchiveError("limitExceeded", "total uncompressed size")
            row |= {"bytes": size, "sha256": sha.hexdigest()}
        except ArchiveError as err:
            row["error"] = error_of(err)
        yield row


def _pieces(e: Entry, opts: Options) -> Iterator[bytes]:
    """An entry's bytes; what is wrong with them is raised as ArchiveError, at the end at the latest."""
    if e.kind == "directory" or e.stream is None:
        yield payload(e, opts)
        return
    if e.size is not None and e.size > opts.limits.max_entry_size:
        raise ArchiveError("limitExceeded", "entry size")
    try:
        yield from e.stream()
    except ArchiveError:
        raise
    except MemoryError:
        raise ArchiveError("limitExceeded", "memory") from None
    except Exception as err:
        raise malformed(repr(err)) from None


__all__ = ["MICRO", "digest_rows", "entry_row", "error_of", "open_archive", "payload", "rows"]
