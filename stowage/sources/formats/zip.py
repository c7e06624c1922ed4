"""ZIP and ZIP64: entries in the order of the central directory."""

from __future__ import annotations

import bz2
import zlib

from ...model import MICRO, Archive, ArchiveError, Entry, Options, malformed
from ..codecs import bunzip2, inflate, lzma_properties, raw_lzma, unxz, unzstd
from ..codecs.crypto import winzip_aes, zipcrypto
from ..fields import dos_time, filetime, le, take

#: Method numbers and their names.
METHODS = {0: "stored", 1: "shrink", 2: "reduce1", 3: "reduce2", 4: "reduce3", 5: "reduce4", 6: "implode", 8: "deflate", 9: "deflate64", 12: "bzip2", 14: "lzma", 20: "zstd", 93: "zstd", 95: "xz", 96: "jpeg", 98: "ppmd"}


def find_end(buf, starts: tuple[int, ...] = ()) -> tuple[int, dict]:
    """Place and fields of the end record, ZIP64 values in place; `base` is the length of a foreign prefix.

    starts are the places of the volumes of a split archive, to which its offsets are relative.
    """
    n = len(buf)
    tail = bytes(buf[max(0, n - 65557) :])
    first = n - len(tail)
    at = tail.rfind(b"PK\5\6")
    while at >= 0:
        if at + 22 <= len(tail) and at + 22 + le(tail, at + 20, 2) <= len(tail):
            break
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise malformed("no ZIP end record")
    end = {"disk": le(tail, at + 4, 2), "cd_disk": le(tail, at + 6, 2), "count": le(tail, at + 10, 2), "size": le(tail, at + 12, 4), "offset": le(tail, at + 16, 4), "comment": tail[at + 22 : at + 22 + le(tail, at + 20, 2)]}
    place = stop = first + at
    if place >= 20 and bytes(buf[place - 20 : place - 16]) == b"PK\6\7":
        where = le(take(buf, place - 20, 20), 8, 8)
        # the 64-bit record stands right before its locator, whatever prefix there is
        for start in (where, place - 20 - 56):
            if 0 <= start <= place - 76 and bytes(buf[start : start + 4]) == b"PK\6\6":
                r = take(buf, start, 56)
                end |= {"count": le(r, 32, 8), "size": le(r, 40, 8), "offset": le(r, 48, 8)}
                stop = start
                break
        else:
            raise malformed("ZIP64 end record")
    if len(starts) > 1 and end["disk"]:
        if end["disk"] + 1 != len(starts) or end["cd_disk"] >= len(starts):
            raise malformed(f"ZIP volume count {end['disk'] + 1}")
        end["offset"] += starts[end["cd_disk"]]
    end["base"] = stop - end["size"] - end["offset"]
    if end["base"] < 0:
        raise malformed("central directory outside the file")
    return place, end


def extras(data: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at + 4 <= len(data):
        kind, n = le(data, at, 2), le(data, at + 2, 2)
        if at + 4 + n > len(data):
            break
        out.append((kind, data[at + 4 : at + 4 + n]))
        at += 4 + n
    return out


def _modified(fields: list[tuple[int, bytes]], date: int, time: int, zone: str) -> int | None:
    """Extended timestamp, then NTFS, then DOS."""
    for kind, v in fields:
        if kind == 0x5455 and len(v) >= 5 and v[0] & 1:
            return int.from_bytes(v[1:5], "little", signed=True) * MICRO
    for kind, v in fields:
        if kind == 0x000A:
            for tag, t in extras(v[4:]):
                if tag == 1 and len(t) >= 8 and (ticks := le(t, 0, 8)):
                    return filetime(ticks)
    return dos_time(date, time, zone)


def _entry(r: bytes, name: bytes, extra: bytes, opts: Options) -> tuple[Entry, dict]:
    made, flags, method, time, date = le(r, 4, 2), le(r, 8, 2), le(r, 10, 2), le(r, 12, 2), le(r, 14, 2)
    crc, packed, size, offset, disk, external = le(r, 16, 4), le(r, 20, 4), le(r, 24, 4), le(r, 42, 4), le(r, 34, 2), le(r, 38, 4)
    fields = extras(extra)
    wide = next((v for k, v in fields if k == 1), b"")
    at = 0
    full = []
    for v, mark in ((size, 0xFFFFFFFF), (packed, 0xFFFFFFFF), (offset, 0xFFFFFFFF)):
        if v == mark and at + 8 <= len(wide):
            v, at = le(wide, at, 8), at + 8
        elif v == mark and wide:
            raise malformed("ZIP64 field too short")
        full.append(v)
    size, packed, offset = full
    if max(size, packed) > opts.limits.max_entry_size:
        raise ArchiveError("limitExceeded", "ZIP entry size")
    aes = next((v for k, v in fields if k == 0x9901), None)
    cipher = "ZipCrypto" if flags & 1 else "none"
    strength = vendor = 0
    if method == 99:
        if aes is None or len(aes) < 7 or not 1 <= aes[4] <= 3:
            raise malformed("WinZip AES field")
        vendor, strength, method = le(aes, 0, 2), aes[4], le(aes, 5, 2)
        cipher = f"AES-{64 + 64 * strength}"
    mode = external >> 16
    link = mode & 0o170000 == 0o120000
    declared = "utf-8" if flags & 0x800 else None
    shown = name
    for k, v in fields:
        if k == 0x7075 and not declared and len(v) > 5 and v[0] == 1 and le(v, 1, 4) == zlib.crc32(name):
            shown, declared = v[5:], "utf-8"
    extra_values = {"method": str(method), "versionMadeBy": str(made), "flags": f"0x{flags:04x}", "hostOS": str(made >> 8), "encryption": cipher}
    if link:
        extra_values["linkTargetStoredAsData"] = "true"
    folder = shown.endswith(b"/") or bool(external & 16) and size == 0
    e = Entry(name, "symlink" if link else "directory" if folder else "file", size, packed, _modified(fields, date, time, opts.timezone), mode & 0o7777 if mode else None, cipher != "none", crc=crc, method=METHODS.get(method, f"method {method}"), declared=declared, dir_hint=shown.endswith(b"/"), extra=extra_values)
    if shown is not name:
        e.name = shown.decode("utf-8", "replace")
    return e, {"offset": offset, "method": method, "flags": flags, "time": time, "strength": strength, "vendor": vendor, "cipher": cipher, "disk": disk}


def decode(method: int, data: bytes, size: int, flags: int, opts: Options) -> bytes:
    if method == 0:
        return data
    if method == 8:
        return inflate(data, size)
    if method == 9:
        from ..codecs.deflate64 import inflate64

        return inflate64(data, size)
    if method == 12:
        return bunzip2(data, size)
    if method == 14:
        if len(data) < 9:
            raise ArchiveError("truncated")
        n = le(data, 2, 2)
        return raw_lzma(data[4 + n :], [lzma_properties(data[4 : 4 + n])], size)
    if method in (20, 93):
        return unzstd(data, size)
    if method == 95:
        return unxz(data, size)
    if method == 98:
        from ..codecs.ppmd import zip_ppmd

        return zip_ppmd(data, size, opts.limits.max_dictionary)
    if method in (1, 2, 3, 4, 5, 6):
        from ..codecs.ziplegacy import explode, reduce, unshrink

        return unshrink(data, size) if method == 1 else explode(data, size, flags) if method == 6 else reduce(data, size, method - 1)
    raise ArchiveError("unsupportedMethod", METHODS.get(method, f"method {method}"))


#: Bytes decoded at once where an entry is read in pieces.
PIECE = 1 << 20


def _streamer(buf, base: int, e: Entry, how: dict):
    """Stored, deflate and bzip2 entries in pieces of bounded size, verified at the end."""

    def decoded(at: int):
        d = zlib.decompressobj(-15) if how["method"] == 8 else bz2.BZ2Decompressor() if how["method"] == 12 else None
        for k in range(at, at + e.packed, PIECE):
            piece = bytes(take(buf, k, min(PIECE, at + e.packed - k)))
            if d is None:
                yield piece
                continue
            while not d.eof:
                out = d.decompress(piece, PIECE)
                piece = d.unconsumed_tail if how["method"] == 8 else b""
                yield out
                if not piece and (how["method"] == 8 and len(out) < PIECE or how["method"] == 12 and d.needs_input):
                    break
        if d is not None and not d.eof:
            raise ArchiveError("truncated")

    def stream():
        start = base + how["offset"]
        head = take(buf, start, 30)
        if head[:4] != b"PK\3\4":
            raise malformed("local header")
        crc = size = 0
        try:
            for out in decoded(start + 30 + le(head, 26, 2) + le(head, 28, 2)):
                crc, size = zlib.crc32(out, crc), size + len(out)
                if size > e.size:
                    raise malformed("more output than declared")
                yield out
        except (zlib.error, OSError) as err:
            raise malformed(repr(err)) from None
        if size < e.size:
            raise ArchiveError("truncated")
        if crc != e.crc:
            raise ArchiveError("checksumMismatch", "CRC-32")

    return stream


def _reader(buf, base: int, e: Entry, how: dict, opts: Options):
    def read() -> bytes:
        start = base + how["offset"]
        head = take(buf, start, 30)
        if head[:4] != b"PK\3\4":
            raise malformed("local header")
        at = start + 30 + le(head, 26, 2) + le(head, 28, 2)
        data = take(buf, at, e.packed)
        e.record = (start, at + e.packed, at, at + e.packed)
        if how["cipher"] != "none":
            if how["method"] not in METHODS:
                raise ArchiveError("unsupportedMethod", e.method)
            if opts.password is None:
                raise ArchiveError("passwordRequired")
            secret = opts.password.encode()
            if how["strength"]:
                data = winzip_aes(data, secret, how["strength"])
            else:
                data = zipcrypto(data, secret, how["time"] >> 8 if how["flags"] & 8 else e.crc >> 24)
        out = decode(how["method"], data, e.size, how["flags"], opts)
        if len(out) != e.size:
            raise ArchiveError("truncated") if len(out) < e.size else malformed("more output than declared")
        if how["vendor"] != 2 and zlib.crc32(out) != e.crc:
            raise ArchiveError("wrongPassword") if how["cipher"] == "ZipCrypto" else ArchiveError("checksumMismatch", "CRC-32")
        return out

    return read


def parse(buf, name: str | None, opts: Options) -> Archive:
    try:
        _, end = find_end(buf, opts.volume_starts)
        if end["count"] > opts.limits.max_entries:
            raise ArchiveError("limitExceeded", "ZIP entry count")
        return _listed(buf, end, opts)
    except ArchiveError:
        if not opts.recover:
            raise
        return recover(buf, opts)


def _listed(buf, end: dict, opts: Options) -> Archive:
    at, stop = end["base"] + end["offset"], end["base"] + end["offset"] + end["size"]
    entries, spans = [], []
    for _ in range(end["count"]):
        r = take(buf, at, 46)
        if r[:4] != b"PK\1\2":
            raise malformed("central directory record")
        n, x, c = le(r, 28, 2), le(r, 30, 2), le(r, 32, 2)
        body = take(buf, at + 46, n + x + c)
        e, how = _entry(r, body[:n], body[n : n + x], opts)
        if len(opts.volume_starts) > 1:
            if how["disk"] >= len(opts.volume_starts):
                raise malformed("ZIP volume number")
            how["offset"] += opts.volume_starts[how["disk"]]
        e.read = _reader(buf, end["base"], e, how, opts)
        if how["cipher"] == "none" and how["method"] in (0, 8, 12):
            e.stream = _streamer(buf, end["base"], e, how)
        e.record = _record(buf, end["base"] + how["offset"], e.packed)
        entries.append(e)
        spans.append((how["offset"], e.packed))
        at += 46 + n + x + c
        if at > stop:
            raise malformed("central directory size")
    if at != stop:
        raise malformed("central directory size")
    spans.sort()
    for (a, size), (b, _) in zip(spans, spans[1:]):
        if a + 30 + size > b:
            raise malformed("entries overlap")
    return Archive("zip", entries)


def _record(buf, start: int, packed: int) -> tuple[int, int, int, int] | None:
    head = bytes(buf[start : start + 30])
    if len(head) < 30 or head[:4] != b"PK\3\4":
        return None
    at = start + 30 + le(head, 26, 2) + le(head, 28, 2)
    return start, at + packed, at, at + packed


def recover(buf, opts: Options) -> Archive:
    """Local headers alone, of an archive that lost its directory; nothing is verified."""
    data, at, entries = bytes(buf), 0, []
    while (at := data.find(b"PK\3\4", at)) >= 0 and at + 30 <= len(data):
        flags, method, time, date, crc, packed, size, n, x = le(data, at + 6, 2), le(data, at + 8, 2), le(data, at + 10, 2), le(data, at + 12, 2), le(data, at + 14, 4), le(data, at + 18, 4), le(data, at + 22, 4), le(data, at + 26, 2), le(data, at + 28, 2)
        raw, start = data[at + 30 : at + 30 + n], at + 30 + n + x
        if not n or start > len(data):
            at += 4
            continue
        if flags & 8 and not packed:
            nxt = data.find(b"PK\3\4", start)
            stop = nxt if nxt >= 0 else len(data)
            mark = data.find(b"PK\7\x08", start, stop)
            stop = mark if mark >= 0 else stop
            known = False
        else:
            stop, known = min(start + packed, len(data)), start + packed <= len(data)
        folder = raw.endswith(b"/")
        e = Entry(raw, "directory" if folder else "file", None if not known else size, stop - start, _modified(extras(data[at + 30 + n : start]), date, time, opts.timezone), None, bool(flags & 1), incomplete=True, method=METHODS.get(method, f"method {method}"), declared="utf-8" if flags & 0x800 else None, dir_hint=folder, extra={"method": str(method), "flags": f"0x{flags:04x}", "encryption": "ZipCrypto" if flags & 1 else "none"})
        e.read = _salvage(data[start:stop], method, size if known else None, flags, opts)
        entries.append(e)
        at = max(stop, at + 4)
    if not entries:
        raise malformed("no ZIP entry to recover")
    return Archive("zip", entries)


def _salvage(data: bytes, method: int, size: int | None, flags: int, opts: Options):
    def read() -> bytes:
        if flags & 1:
            raise ArchiveError("unsupportedMethod", "recovery of encrypted entries")
        if method == 8:
            return zlib.decompressobj(-15).decompress(data)
        if method == 0:
            return data
        return decode(method, data, size if size is not None else opts.limits.max_in_memory, flags, opts)

    return read
