"""tar: ustar, pax, GNU long names and sparse files."""

from __future__ import annotations

from ...model import MICRO, Archive, ArchiveError, Entry, Options, malformed
from ..fields import take, zero_ended

BLOCK = 512


def number(field: bytes) -> int:
    """Octal text, or base 256 if the first bit is set."""
    if field and field[0] & 0x80:
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big") if not field[0] & 0x40 else int.from_bytes(field, "big", signed=True)
    text = field.replace(b"\0", b" ").strip()
    if not text:
        return 0
    try:
        return int(text, 8)
    except ValueError:
        raise malformed("tar number") from None


def is_header(block: bytes) -> bool:
    """Whether the checksum of a non-zero block holds."""
    if len(block) < BLOCK or not block[0]:
        return False
    try:
        want = number(block[148:156])
    except ArchiveError:
        return False
    rest = block[:148] + b" " * 8 + block[156:BLOCK]
    return want in (sum(rest), sum(x - 256 if x > 127 else x for x in rest)) and want > 256


def pax_records(data: bytes) -> dict[str, bytes]:
    out, at = {}, 0
    while at < len(data):
        blank = data.find(b" ", at, at + 20)
        if blank < 0 or not data[at:blank].isdigit():
            raise malformed("pax record length")
        end = at + int(data[at:blank])
        if end > len(data) or data[end - 1 : end] != b"\n" or (eq := data.find(b"=", blank, end)) < 0:
            raise malformed("pax record")
        out[data[blank + 1 : eq].decode("utf-8", "replace")] = data[eq + 1 : end - 1]
        at = end
    return out


def _pax_time(v: bytes) -> int:
    try:
        whole, _, part = v.decode().partition(".")
        micro = int((part + "000000")[:6] or 0)
        return int(whole) * MICRO + (-micro if whole.startswith("-") else micro)
    except ValueError:
        raise malformed("pax time") from None


def _sparse_map(pairs: list[int]) -> list[tuple[int, int]]:
    if len(pairs) % 2:
        raise malformed("sparse map")
    return [(a, n) for a, n in zip(pairs[::2], pairs[1::2])]


def _sparse(buf, head: bytes, pax: dict[str, bytes], data: int, size: int, kind: str) -> tuple[str, list[tuple[int, int]], int, int, int] | None:
    """(version, map, real size, data start, next header's place less the data) of a sparse member."""
    text = {k: v for k, v in pax.items() if k.startswith("GNU.sparse.")}
    try:
        if text.get("GNU.sparse.major") == b"1":
            lines, at = [], data
            want = None
            while want is None or len(lines) < want:
                block = take(buf, at, BLOCK)
                at += BLOCK
                pending = block if not lines and want is None and at == data + BLOCK else rest + block
                *done, rest = pending.split(b"\n")
                lines += [int(x) for x in done]
                if want is None and lines:
                    want = 1 + 2 * lines[0]
            return "1.0", _sparse_map(lines[1:want]), int(text["GNU.sparse.realsize"]), at, size
        if "GNU.sparse.map" in text:
            return "0.1", _sparse_map([int(x) for x in text["GNU.sparse.map"].split(b",") if x]), int(text["GNU.sparse.size"]), data, size
        if "GNU.sparse.offset" in text and kind != "S":
            raise ArchiveError("unsupportedMethod", "tar sparse 0.0 without a map")
    except (ValueError, KeyError):
        raise malformed("sparse map") from None
    if kind == "S":
        found, more, at = [], head[482], data
        fields = [head[386 + 12 * i : 398 + 12 * i] for i in range(8)]
        while True:
            found += [number(f) for f in fields if f.strip(b"\0 ")]
            if not more:
                break
            block = take(buf, at, BLOCK)
            at += BLOCK
            fields, more = [block[12 * i : 12 * i + 12] for i in range(42)], block[504]
        return "old-gnu", _sparse_map(found), number(head[483:495]), at, size + at - data
    return None


def parse(buf, name: str | None, opts: Options) -> Archive:
    entries: list[Entry] = []
    common: dict[str, bytes] = {}
    own: dict[str, bytes] = {}
    long_name = long_link = None
    at, n = 0, len(buf)
    while at < n:
        head = bytes(buf[at : at + BLOCK])
        if len(head) < BLOCK:
            if opts.recover:
                break
            raise ArchiveError("truncated")
        if not any(head):
            break
        if not is_header(head):
            if opts.recover and entries:
                break
            raise malformed("tar header checksum")
        data, kind = at + BLOCK, chr(head[156]) if head[156] else "\0"
        size = number(head[124:136])
        if size < 0:
            raise malformed("tar size")
        if kind in "xgLK":
            if size > opts.limits.max_metadata:
                raise ArchiveError("limitExceeded", "tar metadata")
            body = take(buf, data, size)
            if kind == "x":
                own |= pax_records(body)
            elif kind == "g":
                common |= pax_records(body)
            elif kind == "L":
                long_name = zero_ended(body)
            else:
                long_link = zero_ended(body)
            at = data + -(-size // BLOCK) * BLOCK
            continue
        pax = common | own
        stored = int(pax["size"]) if "size" in pax and pax["size"].isdigit() else size
        if stored > opts.limits.max_entry_size:
            raise ArchiveError("limitExceeded", "tar entry size")
        if len(entries) >= opts.limits.max_entries:
            raise ArchiveError("limitExceeded", "tar entry count")
        sparse = _sparse(buf, head, pax, data, stored, kind)
        what = {"5": "directory", "D": "directory", "2": "symlink", "1": "hardlink"}.get(kind, "file" if kind in "07\0S" or kind not in "346VMNA" else "other")
        after = data + (sparse[4] if sparse else 0 if what in ("directory", "symlink") and kind != "D" and not stored else stored)
        cut_short = after > n
        if cut_short and not opts.recover:
            raise ArchiveError("truncated")
        prefix = zero_ended(head[345:500]) if head[257:263] == b"ustar\0" else b""
        ustar = (prefix + b"/" if prefix else b"") + zero_ended(head[:100])
        if sparse and "GNU.sparse.name" in pax:
            shown, is_pax = pax["GNU.sparse.name"], True
        elif "path" in pax:
            if long_name is not None:
                raise malformed("conflicting pax and GNU tar names")
            shown, is_pax = pax["path"], True
        else:
            shown, is_pax = long_name if long_name is not None else ustar, False
        if not shown or b"\0" in shown:
            raise malformed("tar entry has an empty or NUL-containing name")
        if "linkpath" in pax and long_link is not None:
            raise malformed("conflicting pax and GNU tar links")
        link, link_pax = (pax["linkpath"], True) if "linkpath" in pax else (long_link, False) if long_link is not None else (zero_ended(head[157:257]), False)
        binary = pax.get("hdrcharset", b"").upper() == b"BINARY"
        for given, is_text in ((shown, is_pax), (link, link_pax)):
            if is_text and not binary:
                try:
                    given.decode()
                except UnicodeDecodeError:
                    raise malformed("pax path is not valid UTF-8") from None
        if what == "file" and kind in "0\0" and shown.endswith(b"/"):
            what = "directory"
        extra = {"typeFlag": "NUL" if kind == "\0" else kind if " " <= kind <= "~" else f"0x{ord(kind):02x}", "uid": pax["uid"].decode() if "uid" in pax else str(number(head[108:116])), "gid": pax["gid"].decode() if "gid" in pax else str(number(head[116:124]))}
        if sparse:
            extra |= {"sparse": sparse[0], "sparseFragmentCount": str(len(sparse[1]))}
        if "hdrcharset" in pax:
            extra["hdrcharset"] = pax["hdrcharset"].decode("utf-8", "replace")
        size_now = sparse[2] if sparse else stored if what in ("file", "other", "hardlink") else 0
        mtime = _pax_time(pax["mtime"]) if "mtime" in pax else number(head[136:148]) * MICRO
        e = Entry(shown, what, size_now, stored, mtime, number(head[100:108]) & 0o7777, incomplete=cut_short, method="tar (sparse)" if sparse else "tar (stored)", declared="utf-8" if is_pax and not binary else None, dir_hint=shown.endswith(b"/"), extra=extra)
        if link:
            if b"\0" in link:
                raise malformed("tar link contains NUL")
            e.links["linkPath"] = link
        e.record = (at, data + -(-(after - data) // BLOCK) * BLOCK, data, after)
        e.read = _reader(buf, sparse, data, size_now, cut_short)
        entries.append(e)
        own, long_name, long_link = {}, None, None
        at = data + -(-(after - data) // BLOCK) * BLOCK
        if cut_short:
            break
    return Archive("tar", entries)


def _reader(buf, sparse, data: int, size: int, short: bool):
    def read() -> bytes:
        if short:
            return bytes(buf[data : data + size])
        if not sparse:
            return take(buf, data, size)
        _, pieces, real, at, _ = sparse
        out, end = bytearray(real), 0
        for start, n in pieces:
            if start < end or start + n > real:
                raise malformed("sparse map")
            out[start : start + n] = take(buf, at, n)
            at, end = at + n, start + n
        return bytes(out)

    return read
