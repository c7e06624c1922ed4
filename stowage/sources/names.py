"""File-name charsets: strict UTF-8 first, then one charset for all names of an archive.

Candidates that decode every name strictly are scored by how natural the decoded letters are (script of
the charset's language, case, controls, rare symbols) with a prior for the likely language.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable

#: Candidate charsets and their languages.
CANDIDATES = (
    ("cp932", "ja"), ("euc_jp", "ja"), ("gb18030", "zh"), ("big5", "zh"), ("cp950", "zh"), ("euc_kr", "ko"), ("cp949", "ko"), ("johab", "ko"),
    ("cp1252", "west"), ("cp850", "west"), ("cp437", "west"), ("mac_roman", "west"), ("iso8859_15", "west"), ("cp858", "west"), ("cp865", "north"), ("cp1250", "east"), ("cp852", "east"), ("iso8859_2", "east"), ("mac_latin2", "east"),
    ("cp1251", "ru"), ("cp866", "ru"), ("koi8_r", "ru"), ("koi8_u", "ru"), ("iso8859_5", "ru"), ("mac_cyrillic", "ru"), ("cp855", "ru"),
    ("cp1253", "el"), ("cp737", "el"), ("iso8859_7", "el"), ("mac_greek", "el"), ("cp869", "el"), ("cp1254", "tr"), ("cp857", "tr"), ("iso8859_9", "tr"), ("mac_turkish", "tr"),
    ("cp1255", "he"), ("cp862", "he"), ("iso8859_8", "he"), ("cp1256", "ar"), ("cp720", "ar"), ("cp864", "ar"), ("iso8859_6", "ar"), ("mac_arabic", "ar"),
    ("cp1257", "balt"), ("cp775", "balt"), ("iso8859_4", "balt"), ("iso8859_13", "balt"), ("cp1258", "vi"), ("cp874", "th"), ("tis_620", "th"), ("iso8859_10", "north"), ("cp861", "north"), ("iso8859_3", "west"), ("cp860", "west"),
)
#: Names and bytes looked at for an archive.
NAMES, NAME_BYTES = 512, 256 << 10

_SCRIPTS = {"ja": ("HIRAGANA", "KATAKANA", "CJK", "IDEOGRAPHIC", "FULLWIDTH"), "zh": ("CJK", "IDEOGRAPHIC", "FULLWIDTH"), "ko": ("HANGUL",), "ru": ("CYRILLIC",), "el": ("GREEK",), "he": ("HEBREW",), "ar": ("ARABIC",), "th": ("THAI",)}
_kept: dict[tuple[str, str], float] = {}


def is_utf8(b: bytes) -> bool:
    try:
        b.decode("utf-8")
        return True
    except UnicodeDecodeError:
        return False


def decode(b: bytes, charset: str) -> str | None:
    """Strictly, or None."""
    try:
        return b.decode(charset)
    except (UnicodeDecodeError, LookupError):
        return None


def _worth(c: str, language: str) -> float:
    """How much a decoded non-ASCII character speaks for a language, -2 to 2."""
    if (known := _kept.get((c, language))) is not None:
        return known
    kind, name = unicodedata.category(c), unicodedata.name(c, "")
    own = _SCRIPTS.get(language)
    if kind in ("Cc", "Cn", "Co", "Cs"):
        v = -2.0
    elif own:
        if name.startswith(own):
            v = 2.0 if language != "zh" and not name.startswith("CJK") or ord(c) in range(0x4E00, 0x9FA6) else 0.5
            if language == "ja" and name.startswith("HALFWIDTH"):
                v = 0.25
        elif name.startswith("HALFWIDTH KATAKANA") and language == "ja":
            v = 0.25
        else:
            v = -0.5 if kind[0] in "LM" else -0.25
    elif name.startswith("LATIN"):
        v = 1.25 if kind == "Ll" else 0.75
    else:
        v = -1.5 if kind[0] == "L" else -1.0
    _kept[c, language] = v
    return v


def score(text: str, language: str) -> float:
    """Mean worth of the non-ASCII characters; odd neighbours cost."""
    total, n, before = 0.0, 0, ""
    for c in text:
        if ord(c) > 127:
            n += 1
            total += _worth(c, language)
            if c.isupper() and before.islower():
                total -= 1.5
            if before and before.isascii() and before.isalpha() and not unicodedata.name(c, "").startswith("LATIN") and c.isalpha():
                total -= 0.75
        before = c
    return total / n if n else 0.0


def _ranked(names: list[tuple[bytes, int]], language: str | None) -> tuple[str, float] | None:
    found = []
    for order, (charset, lang) in enumerate(CANDIDATES):
        texts = []
        for b, weight in names:
            t = decode(b, charset)
            if t is None:
                break
            texts.append((t, weight))
        else:
            value = sum(score(t, lang) * w for t, w in texts) / max(1, sum(w for _, w in texts))
            size = sum(sum(ord(c) > 127 for c in t) for t, _ in texts)
            value = value * size / (size + 2.0) + (0.6 if language and lang == language else 0.0)
            found.append((value, -order, charset))
    if not found:
        return None
    found.sort(reverse=True)
    gap = found[0][0] - (found[1][0] if len(found) > 1 else 0)
    return found[0][2], 0.5 + 0.45 * max(0.0, min(1.0, gap))


def detect(b: bytes, encoding: str = "auto", language: str | None = "ja") -> tuple[str, str, float]:
    """(charset, text, confidence) of one name."""
    if encoding not in ("auto", "utf8Only"):
        t = decode(b, encoding)
        return (encoding, t, 1.0) if t is not None else ("latin-1", b.decode("latin-1"), 0.2)
    if is_utf8(b):
        return "utf-8", b.decode(), 1.0
    best = _ranked([(b, 1)], language) if encoding == "auto" else None
    if best is None:
        return "latin-1", b.decode("latin-1"), 0.2
    return best[0], b.decode(best[0]), best[1]


def detect_archive(names: Iterable[bytes], encoding: str = "auto", language: str | None = "ja") -> str | None:
    """The charset for an archive's undeclared names; None if all are UTF-8. The order of names plays no part."""
    if encoding not in ("auto", "utf8Only"):
        return encoding
    odd = Counter(b for b in names if not is_utf8(b))
    if not odd or encoding == "utf8Only":
        return None
    sample, size = [], 0
    for b in sorted(odd, key=lambda b: (zlib.crc32(b), b)):
        if len(sample) >= NAMES or size + len(b) > NAME_BYTES and sample:
            break
        sample.append((b, odd[b]))
        size += len(b)
    best = _ranked(sample, language)
    return best[0] if best else None


def resolve(b: bytes, declared: str | None, archive: str | None, encoding: str = "auto", language: str | None = "ja") -> str:
    """A name's text: as declared, strict UTF-8, the archive's charset, else on its own."""
    if declared:
        t = decode(b, declared)
        if t is not None:
            return t
    if encoding in ("auto", "utf8Only") and is_utf8(b):
        return b.decode()
    if archive and (t := decode(b, archive)) is not None:
        return t
    return detect(b, encoding, language)[1]


def components(name: str) -> list[str]:
    return [p for p in name.split("/") if p]


def safe_path(name: str) -> list[str] | None:
    """Components that are safe to extract to, None if the path is empty, absolute or climbs."""
    if not name or name.startswith("/") or "\0" in name:
        return None
    parts = [p for p in name.split("/") if p and p != "."]
    return None if not parts or ".." in parts else parts


def one_line(text: str) -> str:
    """Text for one TSV field: controls, bidirectional marks and line separators escaped."""
    out = []
    for c in text:
        if c in "\\\t\n\r":
            out.append({"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"}[c])
        elif ord(c) < 32 or 127 <= ord(c) < 160 or c in "  ‎‏؜" or "‪" <= c <= "‮" or "⁦" <= c <= "⁩":
            out.append(f"\\u{{{ord(c):x}}}")
        else:
            out.append(c)
    return "".join(out)
