"""Grouping of split volumes into sets."""

from __future__ import annotations

import re
from collections.abc import Iterable

_BYTES = re.compile(r"^(.+)\.(\d{3,})$")
_ZIP = re.compile(r"^(.+)\.(z|zx)(\d{2,})$", re.I)
_RAR_OLD = re.compile(r"^(.+)\.([r-z])(\d\d)$", re.I)
_RAR_NEW = re.compile(r"^(.+)\.part(\d+)\.rar$", re.I)


def group(paths: Iterable[str], most: int = 128) -> list[list[str]]:
    """Paths as sets in volume order, each behind the path that opens it; a gap ends a set.

    `.001` sets are joined bytes from 1 on. `.z01 ... .zip` sets end with the directory's volume. RAR
    sets follow `.rar, .r00 ...` or `.partN.rar`. Other volumes of a set are no archives of their own.
    """
    paths = sorted(paths)
    there, taken, out = set(paths), set(), []
    low = {p.lower(): p for p in paths}

    def run(first: str, following: Iterable[str]) -> list[str]:
        found = [first]
        for p in following:
            if (q := p if p in there else low.get(p.lower())) is None or len(found) >= most:
                break
            found.append(q)
        return found

    for p in paths:
        if (m := _BYTES.match(p)) and int(m[2]) == 1:
            s = run(p, (f"{m[1]}.{i:0{len(m[2])}d}" for i in range(2, most + 2)))
            if len(s) > 1:
                out.append(s)
                taken.update(s)
        elif p.lower().endswith((".zip", ".zipx")) and (low.get(f"{p.rpartition('.')[0].lower()}.z01") or low.get(f"{p.rpartition('.')[0].lower()}.zx01")):
            stem, _, ext = p.rpartition(".")
            mark = "zx" if ext.lower() == "zipx" else "z"
            first = low.get(f"{stem}.{mark}01".lower())
            if first:
                s = run(first, (f"{stem}.{mark}{i:02d}" for i in range(2, most + 2)))
                out.append([*s, p])
                taken.update([*s, p])
        elif (m := _RAR_NEW.match(p)) and int(m[2]) == 1:
            s = run(p, (f"{m[1]}.part{i:0{len(m[2])}d}.rar" for i in range(2, most + 2)))
            out.append(s)
            taken.update(s)
        elif p.lower().endswith(".rar") and not _RAR_NEW.match(p):
            stem = p[:-4]
            s = run(p, (f"{stem}.{chr(ord('r') + i // 100)}{i % 100:02d}" for i in range(0, most)))
            out.append(s)
            taken.update(s)
    return sorted([*out, *[[p] for p in paths if p not in taken]])
