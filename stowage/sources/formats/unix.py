"""cpio in its variants, and ar."""

from __future__ import annotations

from ...model import MICRO, Archive, ArchiveError, Entry, Options, malformed
from ..fields import take


def _pad(n: int, to: int) -> int:
    return -(-n // to) * to


def cpio_header(buf, at: int) -> dict | None:
    """Fields of the record at a place, with name, data and next record; None if there is none."""
    magic = bytes(buf[at : at + 6])
    if magic in (b"070701", b"070702"):
        text = take(buf, at + 6, 104)
        try:
            v = [int(text[i : i + 8], 16) for i in range(0, 104, 8)]
        except ValueError:
            raise malformed("cpio header") from None
        h = dict(zip(("ino", "mode", "uid", "gid", "nlink", "mtime", "size", "devmajor", "devminor", "rdevmajor", "rdevminor", "namesize", "check"), v))
        h |= {"variant": "newc" if magic == b"070701" else "crc", "dev": h["devmajor"] << 32 | h["devminor"], "rdev": text[72:88], "head": 110, "pad": 4}
    elif magic == b"070707":
        text = take(buf, at + 6, 70)
        cuts = (("dev", 6), ("ino", 6), ("mode", 6), ("uid", 6), ("gid", 6), ("nlink", 6), ("rdev", 6), ("mtime", 11), ("namesize", 6), ("size", 11))
        h, p = {"variant": "odc", "head": 76, "pad": 1}, 0
        for key, n in cuts:
            try:
                h[key] = int(text[p : p + n], 8) if key != "rdev" else text[p : p + n]
            except ValueError:
                raise malformed("cpio header") from None
            p += n
    elif magic[:2] in (b"\xc7\x71", b"\x71\xc7"):
        order = "little" if magic[:2] == b"\xc7\x71" else "big"
        raw = take(buf, at, 26)
        w = [int.from_bytes(raw[i : i + 2], order) for i in range(0, 26, 2)]
        h = {"variant": f"bin-{order[0]}e", "dev": w[1], "ino": w[2], "mode": w[3], "uid": w[4], "gid": w[5], "nlink": w[6], "rdev": raw[14:16], "mtime": w[8] << 16 | w[9], "namesize": w[10], "size": w[11] << 16 | w[12], "head": 26, "pad": 2}
    else:
        return None
    if not h["namesize"]:
        raise malformed("cpio name size")
    h["name"] = take(buf, at + h["head"], h["namesize"])
    if h["name"][-1:] != b"\0":
        raise malformed("cpio name")
    h["name"] = h["name"].rstrip(b"\0")
    h["data"] = at + _pad(h["head"] + h["namesize"], h["pad"]) if h["pad"] > 1 else at + h["head"] + h["namesize"]
    h["next"] = h["data"] + _pad(h["size"], h["pad"]) if h["pad"] > 1 else h["data"] + h["size"]
    return h


def is_cpio(data: bytes) -> bool:
    """Whether a whole record of text digits stands at the start: a text may begin with the six digits too."""
    if data[:6] not in (b"070701", b"070702", b"070707"):
        return False
    try:
        h = cpio_header(data, 0)
    except ArchiveError:
        return False
    kinds = (0, 0o010000, 0o020000, 0o040000, 0o060000, 0o100000, 0o120000, 0o140000)
    return h["mode"] & 0o170000 in kinds and bool(h["name"]) and b"\0" not in h["name"] and h["next"] <= len(data)


def parse_cpio(buf, name: str | None, opts: Options) -> Archive:
    entries, at, part, ended, marks = [], 0, 0, False, []
    try:
        while at < len(buf):
            if ended:
                while at < len(buf) and not buf[at]:
                    at += 1
                if at >= len(buf):
                    break
            h = cpio_header(buf, at)
            if h is None:
                if ended:
                    break
                raise malformed("cpio header")
            if ended:
                part, ended = part + 1, False
            if h["name"] == b"TRAILER!!!":
                ended, at = True, h["next"]
                continue
            if len(entries) >= opts.limits.max_entries:
                raise ArchiveError("limitExceeded", "cpio entry count")
            if h["size"] > opts.limits.max_entry_size:
                raise ArchiveError("limitExceeded", "cpio entry size")
            short = h["next"] > len(buf) and h["data"] + h["size"] > len(buf)
            if short and not opts.recover:
                raise ArchiveError("truncated")
            stored = min(h["size"], len(buf) - h["data"])
            kind = {0o100000: "file", 0o040000: "directory", 0o120000: "symlink"}.get(h["mode"] & 0o170000, "other")
            size = stored if kind in ("file", "symlink") else 0
            extra = {"variant": h["variant"], **{k: str(h[k]) for k in ("uid", "gid", "nlink", "ino", "dev")}}
            if h["variant"] == "crc":
                extra["check"] = f"{h['check']:08x}"
            if h["nlink"] > 1 and kind in ("file", "symlink"):
                extra["hardLinkGroup"] = f"{part}:{h['dev']}:{h['ino']}"
            if kind == "other":
                extra["rdev"] = h["rdev"].hex()
            e = Entry(h["name"], kind, size, size, h["mtime"] * MICRO, h["mode"] & 0o7777, incomplete=short, method="cpio (stored)", dir_hint=kind == "directory", extra=extra)
            if kind == "symlink":
                if stored:
                    target = take(buf, h["data"], stored)
                    if b"\0" in target:
                        raise malformed("cpio symlink target contains NUL")
                    e.links["linkPath"] = target
                elif h["nlink"] <= 1 and not short:
                    raise malformed("cpio symlink without target")
            e.read = _cpio_reader(buf, h, size, kind, short)
            entries.append(e)
            marks.append(part)
            at = h["next"]
            if short:
                break
        else:
            if not ended and not opts.recover and not entries:
                raise ArchiveError("truncated")
    except ArchiveError as e:
        if not opts.recover or e.code not in ("truncated", "malformed"):
            raise
    if part:
        for e, m in zip(entries, marks):
            e.extra["archiveIndex"] = str(m)
    return Archive("cpio", entries)


def _cpio_reader(buf, h: dict, size: int, kind: str, short: bool):
    def read() -> bytes:
        data = take(buf, h["data"], size)
        if h["variant"] == "crc" and kind == "file" and size and not short and sum(data) & 0xFFFFFFFF != h["check"]:
            raise malformed("cpio checksum mismatch")
        return data

    return read


def _decimal(field: bytes, base: int = 10) -> int | None:
    text = field.strip()
    if not text:
        return None
    try:
        return int(text, base)
    except ValueError:
        raise malformed("ar number") from None


def parse_ar(buf, name: str | None, opts: Options) -> Archive:
    if bytes(buf[:8]) == b"!<thin>\n":
        raise ArchiveError("unsupportedMethod", "thin ar archive")
    at, table, entries = 8, None, []
    while at < len(buf):
        head = bytes(buf[at : at + 60])
        if len(head) < 60:
            if opts.recover:
                break
            raise ArchiveError("truncated")
        if head[58:60] != b"`\n":
            raise malformed("ar header")
        size = _decimal(head[48:58])
        if size is None:
            raise malformed("ar size")
        if size > opts.limits.max_entry_size:
            raise ArchiveError("limitExceeded", "ar entry size")
        data, stop = at + 60, at + 60 + size
        field = head[:16].rstrip(b" ")
        form, hidden = "plain", False
        short = stop > len(buf)
        if field.startswith(b"#1/"):
            n = _decimal(field[3:]) or 0
            if not 0 < n <= size:
                raise malformed("ar extended name length")
            shown, data, form = take(buf, data, n).rstrip(b"\0"), data + n, "bsd-extended"
        elif field == b"//":
            if table is not None:
                raise malformed("duplicate ar string table")
            table, hidden, shown = take(buf, data, size), True, b""
        elif field in (b"/", b"/SYM64/"):
            shown = field
        elif field[:1] == b"/" and field[1:].isdigit():
            if table is None:
                raise malformed("ar string table missing")
            start = int(field[1:])
            if start >= len(table):
                raise malformed("ar string table offset")
            stops = [p for p in (table.find(b"\n", start), table.find(b"\0", start)) if p >= 0]
            shown, form = table[start : min(stops, default=len(table))].removesuffix(b"/"), "string-table"
        else:
            shown = field.removesuffix(b"/")
        if short and not opts.recover:
            raise ArchiveError("truncated")
        if not hidden:
            if not shown or b"\0" in shown:
                raise malformed("ar member name")
            extra = {"nameForm": form, "headerOffset": str(at)}
            for key, part in (("uid", head[28:34]), ("gid", head[34:40])):
                if (v := _decimal(part)) is not None:
                    extra[key] = str(v)
            n = min(stop, len(buf)) - data
            mode, mtime = _decimal(head[40:48], 8), _decimal(head[16:28])
            entries.append(Entry(shown, "file", n, n, mtime * MICRO if mtime is not None else None, mode & 0o7777 if mode is not None else None, incomplete=short, method="ar (stored)", extra=extra, read=lambda a=data, b=n: take(buf, a, b)))
        at = stop + (stop - at) % 2
        if short:
            break
    return Archive("ar", entries)
