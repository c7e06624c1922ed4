"""RAR: listings of all generations; compressed entries from 2.0 on are read, encrypted ones from 2.9 on, others are reported as unsupported."""

from __future__ import annotations

import hashlib
import hmac
import zlib

from ...model import MICRO, Archive, ArchiveError, Entry, Options, malformed
from ..codecs.crypto import aes_cbc, rar_key
from ..codecs.rar import Unpacker20, Unpacker29
from ..codecs.rar5 import Solid, Unpacker
from ..fields import dos_time, filetime, le, take

#: RAR 4 and 5 host systems and methods.
_HOSTS4 = {0: "MS-DOS", 1: "OS/2", 2: "Windows", 3: "Unix", 4: "Mac OS", 5: "BeOS"}
_METHODS = ("store", "fastest", "fast", "normal", "good", "best")


def parse(buf, name: str | None, opts: Options) -> Archive:
    head = bytes(buf[:8])
    if head.startswith(b"RE~^"):
        return Archive("rar", _rar13(buf, opts))
    if head == b"Rar!\x1a\x07\1\0":
        return Archive("rar", _islands(_rar5(buf, opts)))
    if head[:7] == b"Rar!\x1a\x07\0":
        return Archive("rar", _islands(_rar4(buf, opts)))
    raise malformed("RAR signature")


def _islands(found: list[tuple[Entry, bool]]) -> list[Entry]:
    """Runs led by a non-solid file share a group if longer than one; directories play no part."""
    lead, runs = None, {}
    for i, (e, solid) in enumerate(found):
        if e.kind == "directory":
            continue
        if not solid:
            lead = i
        if lead is not None:
            runs.setdefault(lead, []).append(e)
    for lead, own in runs.items():
        if len(own) > 1:
            for e in own:
                e.solid = lead
    return [e for e, _ in found]


def _stored(buf, at: int, packed: int, size: int, method: int, crc: int | None, locked: bool, split: bool, digest: bytes | None = None):
    def read() -> bytes:
        if locked:
            raise ArchiveError("unsupportedMethod", "encrypted RAR entry")
        if split:
            raise ArchiveError("unsupportedMethod", "entry continues in another volume")
        if method != 0:
            raise ArchiveError("unsupportedMethod", "RAR compression")
        out = take(buf, at, packed)
        if len(out) != size:
            raise malformed("stored size")
        if crc is not None and zlib.crc32(out) != crc:
            raise ArchiveError("checksumMismatch", "CRC-32")
        if digest is not None:
            from ...functions.sql import blake2sp

            if blake2sp(out) != digest:
                raise ArchiveError("checksumMismatch", "BLAKE2sp")
        return out

    return read


def _rar13(buf, opts: Options) -> list[Entry]:
    at = le(take(buf, 4, 2), 0, 2)
    out = []
    while at < len(buf):
        h = take(buf, at, 21)
        packed, size, crc, head, stamp, attr, flags, version, n, method = le(h, 0, 4), le(h, 4, 4), le(h, 8, 2), le(h, 10, 2), le(h, 12, 4), h[16], h[17], h[18], h[19], h[20]
        if head < 21 + n:
            raise malformed("RAR header size")
        raw = take(buf, at + 21 + (2 + le(take(buf, at + 21, 2), 0, 2) if flags & 8 else 0), n).replace(b"\\", b"/")
        folder = bool(attr & 16)
        extra = {"container": "RAR1.3", "unpackVersion": str(version), "crc16": f"0x{crc:04x}"}
        out.append(Entry(raw, "directory" if folder else "file", 0 if folder else size, packed, dos_time(stamp >> 16, stamp & 0xFFFF, opts.timezone), encrypted=bool(flags & 4), method="RAR1.3 stored" if method == 0 else "RAR1.3 normal", extra=extra, dir_hint=folder, read=_stored(buf, at + head, packed, size, method, None, bool(flags & 4), bool(flags & 3))))
        at += head + packed
    return out


def _unicode_name(ascii_part: bytes, packed: bytes) -> str:
    """RAR 4's packed UTF-16 names: two-bit flags choose how each unit is formed."""
    if not packed:
        return ascii_part.decode("utf-8", "replace")
    high, at, out = packed[0], 1, []
    flags = left = 0
    while at < len(packed):
        if not left:
            flags, at, left = packed[at], at + 1, 4
            if at > len(packed):
                break
        mode, flags, left = flags >> 6, flags << 2 & 255, left - 1
        if mode == 0 and at < len(packed):
            out.append(packed[at])
            at += 1
        elif mode == 1 and at < len(packed):
            out.append(packed[at] | high << 8)
            at += 1
        elif mode == 2 and at + 1 < len(packed):
            out.append(packed[at] | packed[at + 1] << 8)
            at += 2
        elif mode == 3 and at < len(packed):
            n = packed[at]
            at += 1
            if n & 128 and at < len(packed):
                fix, at = packed[at], at + 1
                for _ in range((n & 127) + 2):
                    if len(out) < len(ascii_part):
                        out.append((ascii_part[len(out)] + fix & 255) | high << 8)
            else:
                for _ in range((n & 127) + 2):
                    if len(out) < len(ascii_part):
                        out.append(ascii_part[len(out)])
    return b"".join(u.to_bytes(2, "little") for u in out).decode("utf-16-le", "replace")


def _rar4(buf, opts: Options) -> list[tuple[Entry, bool]]:
    at, out, main, chain, keys = 7, [], 0, [], {}
    while at + 7 <= len(buf):
        salt = None
        if main & 0x80:
            if at + 24 > len(buf):
                break
            salt = bytes(take(buf, at, 8))
            if len(keys) == 0:
                _locked4(salt, opts, keys, take(buf, at + 8, 16))
            key, iv = _key4(salt, opts, keys)
            at += 8
            h = aes_cbc(key, iv, take(buf, at, 16))
        else:
            h = take(buf, at, 7)
        kind, flags, size = h[2], le(h, 3, 2), le(h, 5, 2)
        if size < 7:
            raise ArchiveError("wrongPassword") if salt else malformed("RAR header size")
        if salt is None:
            body = take(buf, at, size)
        else:
            padded = -(-size // 16) * 16
            if at + padded > len(buf):
                raise ArchiveError("wrongPassword")
            body = aes_cbc(key, iv, take(buf, at, padded))[:size]
            at += padded - size
            if zlib.crc32(body[2:]) & 0xFFFF != le(h, 0, 2):
                raise ArchiveError("wrongPassword")
        if kind in (0x73, 0x74) and zlib.crc32(body[2:]) & 0xFFFF != le(h, 0, 2):
            if not (kind == 0x73 and flags & 2):
                raise malformed("RAR header checksum")
        add = le(body, 7, 4) if flags & 0x8000 or kind in (0x74, 0x7A) else 0
        if kind == 0x73:
            main = flags
            if flags & 0x80 and opts.password is None:
                raise ArchiveError("passwordRequired", "encrypted RAR headers")
        elif kind == 0x74:
            packed, full, host, crc, stamp, version, method, n, attr = le(body, 7, 4), le(body, 11, 4), body[15], le(body, 16, 4), le(body, 20, 4), body[24], body[25], le(body, 26, 2), le(body, 28, 4)
            p = 32
            if flags & 0x100:
                packed |= le(body, 32, 4) << 32
                full |= le(body, 36, 4) << 32
                p, add = 40, packed
            raw = body[p : p + n]
            shown = None
            if flags & 0x200:
                plain, _, tail = raw.partition(b"\0")
                shown = _unicode_name(plain, tail) if tail else plain.decode("utf-8", "replace")
                raw = plain
            folder = flags & 0xE0 == 0xE0
            unix = attr & 0xFFFF if host == 3 else 0
            kind_name = "directory" if folder else "symlink" if unix & 0o170000 == 0o120000 else "file"
            before, after = bool(flags & 1), bool(flags & 2)
            solid = bool(flags & 0x10) or (version < 20 and main & 8 and bool(out))
            extra = {"attributes": f"0x{attr:08x}", "dictionarySize": str(65536 << (flags >> 5 & 7)) if not folder else "0", "flags": f"0x{flags:04x}", "hostOS": _HOSTS4.get(host, str(host)), "method": f"0x{method:02x}", "unpackVersion": str(version)}
            if before:
                extra["splitBefore"] = "true"
            if after:
                extra["splitAfter"] = "true"
            e = Entry(raw.replace(b"\\", b"/"), kind_name, 0 if folder else full, packed, dos_time(stamp >> 16, stamp & 0xFFFF, opts.timezone), unix & 0o7777 if unix else None, bool(flags & 4), crc=None if folder else crc, method=_METHODS[method - 0x30] if 0x30 <= method <= 0x35 else f"method {method}", declared="utf-8" if shown is not None else None, dir_hint=folder, extra=extra)
            if shown is not None:
                e.name = shown.replace("\\", "/")
            own = bytes(body[p + n : p + n + 8]) if flags & 0x400 else None
            locked = bool(flags & 4)
            if folder:
                e.read = lambda: b""
            elif before or after or not 0x30 <= method <= 0x35 or method > 0x30 and version not in _UNPACK4 or locked and (own is None or len(own) < 8):
                e.read = _stored(buf, at + size, packed, full, method - 0x30, crc, locked, before or after)
            else:
                if method > 0x30 and not (solid and chain):
                    chain[:] = [Solid((lambda most=opts.limits.max_dictionary: Unpacker29(most)) if version > 26 else Unpacker20)]
                e.read = _read4(buf, at + size, packed, full, crc, own if locked else None, chain[0] if method > 0x30 else None, opts, keys)
            if not before:
                out.append((e, solid))
        elif kind == 0x7B:
            break
        at += size + add
        if at > len(buf) and not opts.recover:
            raise ArchiveError("truncated")
    return out


#: Fixed value: versions of the formats 2.0 and 2.9.
_UNPACK4 = (20, 26, 29, 36)


def _key4(salt: bytes, opts: Options, keys: dict) -> tuple[bytes, bytes]:
    """Key and initial vector; keys: those already derived, and under "form" the form of the password to take."""
    if opts.password is None:
        raise ArchiveError("passwordRequired")
    raw = _forms4(opts.password)[keys.setdefault("form", 0)]
    if (salt, raw) not in keys:
        keys[salt, raw] = rar_key(raw, salt)
    return keys[salt, raw]


def _forms4(password: str) -> list[bytes]:
    """UTF-16; writers with wide characters of 32 bits kept only the low half of those beyond 16."""
    password = password[:_PASSWORD]
    forms = [password.encode("utf-16-le", "surrogatepass"), b"".join((ord(c) & 0xFFFF).to_bytes(2, "little") for c in password)]
    return list(dict.fromkeys(forms))


def _locked4(salt: bytes, opts: Options, keys: dict, block: bytes) -> None:
    """Chooses the form of the password under which an encrypted header starts with a known type."""
    for keys["form"] in range(len(_forms4(opts.password or ""))):
        if 0x72 <= aes_cbc(*_key4(salt, opts, keys), block)[2] <= 0x7B:
            return
    keys["form"] = 0


def _read4(buf, at: int, packed: int, size: int, crc: int, salt: bytes | None, solid, opts: Options, keys: dict):
    """Reads one RAR 2 to 4 file; solid: the files that are unpacked in turn, None for a stored one."""
    def data() -> bytes:
        raw = bytes(take(buf, at, packed))
        return raw if salt is None else aes_cbc(*_key4(salt, opts, keys), raw[: packed // 16 * 16])

    unpacked = solid.add(data, size) if solid else lambda: data()[:size]

    def read() -> bytes:
        if salt is not None and opts.password is None:
            raise ArchiveError("passwordRequired")
        if salt is None:
            return checked()
        first = keys.setdefault("form", 0)
        for form in range(len(_forms4(opts.password))):
            keys["form"] = (first + form) % len(_forms4(opts.password))
            try:
                return checked()
            except ArchiveError as e:
                if e.code not in ("malformed", "truncated", "checksumMismatch"):
                    raise
                if solid:
                    solid.state = None
        keys["form"] = first
        raise ArchiveError("wrongPassword")

    def checked() -> bytes:
        out = unpacked()
        if len(out) != size:
            raise malformed("stored size")
        if zlib.crc32(out) != crc:
            raise ArchiveError("checksumMismatch", "CRC-32")
        return out

    return read


def _vint(b: bytes, at: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        if at >= len(b) or shift > 63:
            raise malformed("RAR number")
        v |= (b[at] & 127) << shift
        at += 1
        if b[at - 1] < 128:
            return v, at
        shift += 7


def _rar5(buf, opts: Options) -> list[tuple[Entry, bool]]:
    at, out, chain, key = 8, [], [], None
    while at + 7 <= len(buf):
        start = at
        first = bytes(buf[at : at + 14])
        if key is not None:
            first = aes_cbc(key, take(buf, at, 16), take(buf, at + 16, 16))
        crc = le(first, 0, 4)
        n, p = _vint(first[:14], 4)
        whole = p + n
        if key is None:
            head = take(buf, at + 4, whole - 4)
            at += whole
        else:
            padded = -(-whole // 16) * 16
            head = aes_cbc(key, take(buf, at, 16), take(buf, at + 16, padded))[4:whole]
            at += 16 + padded
        p -= 4
        if zlib.crc32(head) != crc:
            if opts.recover and out:
                break
            raise malformed("RAR header checksum")
        kind, q = _vint(head, p)
        flags, q = _vint(head, q)
        extra_n = data_n = 0
        if flags & 1:
            extra_n, q = _vint(head, q)
        if flags & 2:
            data_n, q = _vint(head, q)
        if kind == 4:
            if opts.password is None:
                raise ArchiveError("passwordRequired", "encrypted RAR headers")
            version, q = _vint(head, q)
            how, q = _vint(head, q)
            if version:
                raise ArchiveError("unsupportedMethod", "RAR encryption")
            lock = {"power": head[q], "salt": head[q + 1 : q + 17], "check": head[q + 17 : q + 25] if how & 1 else None}
            key = _key5(lock, opts)
            continue
        if kind == 2:
            out.append(_file5(buf, head, q, len(head) - extra_n, flags, at, data_n, opts, chain))
        if kind == 5:
            break
        at += data_n
        if at > len(buf):
            if opts.recover:
                break
            raise ArchiveError("truncated")
        if at <= start:
            raise malformed("RAR header does not advance")
    found = [x for x in out if x is not None]
    _links5([e for e, _ in found])
    return found


def _file5(buf, h: bytes, q: int, end: int, flags: int, data: int, packed: int, opts: Options, chain: list) -> tuple[Entry, bool] | None:
    """chain: the solid group in progress, if any."""
    own, q = _vint(h, q)
    size, q = _vint(h, q)
    attr, q = _vint(h, q)
    mtime = crc = None
    if own & 2:
        mtime, q = le(h, q, 4) * MICRO, q + 4
    if own & 4:
        crc, q = le(h, q, 4), q + 4
    info, q = _vint(h, q)
    host, q = _vint(h, q)
    n, q = _vint(h, q)
    raw = h[q : q + n]
    folder, method = bool(own & 1), info >> 7 & 7
    extra = {"rarVersion": "5", "compressionInfo": f"0x{info:x}", "method": str(method), "dictionarySize": str(131072 << (info >> 10 & 15)), "hostOS": {0: "Windows", 1: "Unix"}.get(host, str(host)), "attributes": f"0x{attr:x}", "solid": str(bool(info & 64)).lower()}
    kind, locked, digest, link, lock = "directory" if folder else "file", False, None, None, None
    p = end
    while p < len(h):
        n, p = _vint(h, p)
        stop = p + n
        tag, r = _vint(h, p)
        if tag == 1:
            locked = True
            version, r = _vint(h, r)
            how, r = _vint(h, r)
            if version == 0:
                lock = {"tied": bool(how & 2), "power": h[r], "salt": h[r + 1 : r + 17], "iv": h[r + 17 : r + 33], "check": h[r + 33 : r + 41] if how & 1 else None}
        elif tag == 2:
            which, r = _vint(h, r)
            if which == 0:
                digest = h[r : r + 32]
                extra |= {"hashType": "BLAKE2sp", "hash": digest.hex()}
        elif tag == 3:
            bits, r = _vint(h, r)
            if bits & 2:
                mtime = le(h, r, 4) * MICRO if bits & 1 else filetime(le(h, r, 8))
        elif tag == 5:
            what, r = _vint(h, r)
            _, r = _vint(h, r)
            m, r = _vint(h, r)
            link = h[r : r + m]
            extra["redirectionType"] = str(what)
            kind = {1: "symlink", 2: "symlink", 3: "symlink", 4: "hardlink", 5: "file"}.get(what, kind)
            extra["copyPath" if what == 5 else "linkPath"] = link.decode("utf-8", "replace")
        p = stop
    split = flags & 0x18
    if flags & 0x08:
        extra["splitBefore"] = "true"
        return None
    if flags & 0x10:
        extra["splitAfter"] = "true"
    extra["encryption"] = "AES-256" if locked else "none"
    unix = attr if host == 1 else 0
    if unix & 0o170000 == 0o120000:
        kind = "symlink"
    e = Entry(raw, kind, None if own & 8 else 0 if folder else size, packed, mtime, unix & 0o7777 if unix else None, locked, crc=crc, method=_METHODS[method] if method < 6 else f"method {method}", declared="utf-8", dir_hint=folder, extra=extra)
    if folder or link is not None and kind != "file":
        e.read = lambda: b""
    elif split or info & 63 or method > 5 or own & 8 or locked and lock is None:
        e.read = _stored(buf, data, packed, size, method or 1, crc, locked, bool(split), digest)
    else:
        if method and not (info & 64 and chain):
            window = 131072 << (info >> 10 & 15)
            if window > opts.limits.max_dictionary:
                raise ArchiveError("limitExceeded", "RAR dictionary")
            chain[:] = [Solid(lambda: Unpacker(window))]
        e.read = _read5(buf, data, packed, size, method, crc, lock, digest, chain[0] if method else None, opts)
    return e, bool(info & 64)


def _fold(b: bytes, n: int) -> bytes:
    """32 bytes as n, by exclusive or."""
    out = 0
    for i in range(0, len(b), n):
        out ^= int.from_bytes(b[i : i + n], "little")
    return out.to_bytes(n, "little")


#: Fixed value: characters of a password that count.
_PASSWORD = 127


def _key5(lock: dict, opts: Options, more: int = 0) -> bytes:
    """A key derived from the password, which is checked where that is possible; more: rounds beyond those of the data's key."""
    if opts.password is None:
        raise ArchiveError("passwordRequired")
    if lock["power"] > opts.limits.max_kdf_power:
        raise ArchiveError("limitExceeded", "key derivation")
    derived = lambda k: hashlib.pbkdf2_hmac("sha256", opts.password[:_PASSWORD].encode(), lock["salt"], (1 << lock["power"]) + k)
    if lock["check"] is not None and _fold(derived(32), 8) != lock["check"]:
        raise ArchiveError("wrongPassword")
    return derived(more)


def _read5(buf, at: int, packed: int, size: int, method: int, crc: int | None, lock: dict | None, digest: bytes | None, solid, opts: Options):
    """Reads one RAR 5 file; solid: the files that are unpacked in turn."""
    def data() -> bytes:
        raw = bytes(take(buf, at, packed))
        return raw if lock is None else aes_cbc(_key5(lock, opts), lock["iv"], raw[: packed // 16 * 16])

    unpacked = solid.add(data, size) if method else lambda: data()[:size]

    def read() -> bytes:
        if lock is not None and opts.password is None:
            raise ArchiveError("passwordRequired")
        out = unpacked()
        if len(out) != size:
            raise malformed("stored size")
        key = _key5(lock, opts, 16) if lock is not None and lock["tied"] else None
        if crc is not None:
            got = zlib.crc32(out)
            if key is not None:
                got = int.from_bytes(_fold(hmac.digest(key, got.to_bytes(4, "little"), "sha256"), 4), "little")
            if got != crc:
                raise ArchiveError("checksumMismatch", "CRC-32")
        if digest is not None:
            from ...functions.sql import blake2sp

            got = blake2sp(out)
            if (hmac.digest(key, got, "sha256") if key is not None else got) != digest:
                raise ArchiveError("checksumMismatch", "BLAKE2sp")
        return out

    return read


def _links5(entries: list[Entry]) -> None:
    """Reading a hard link or a copy reads the earlier entry that it names."""
    last: dict[str, Entry] = {}
    for e in entries:
        to = e.extra.get("copyPath") or (e.extra.get("linkPath") if e.kind == "hardlink" else None)
        if to is not None and (t := last.get(to.strip("/"))) is not None and t.kind == "file" and ("copyPath" not in e.extra or t.size == e.size and "copyPath" not in t.extra):
            e.read = t.read
        last[e.raw_name.decode("utf-8", "replace").strip("/")] = e
