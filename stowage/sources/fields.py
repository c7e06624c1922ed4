"""Byte fields, dates and buffers shared by the parsers."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from ..model import MICRO, ArchiveError, malformed


def take(buf, start: int, count: int) -> bytes:
    """Bytes of a buffer, all of them or an error."""
    if start < 0 or count < 0 or start + count > len(buf):
        raise ArchiveError("truncated")
    return bytes(buf[start : start + count])


def le(b: bytes, at: int, size: int) -> int:
    if at + size > len(b):
        raise ArchiveError("truncated")
    return int.from_bytes(b[at : at + size], "little")


def be(b: bytes, at: int, size: int) -> int:
    if at + size > len(b):
        raise ArchiveError("truncated")
    return int.from_bytes(b[at : at + size], "big")


def dos_time(date: int, time: int, zone: str) -> int | None:
    """MS-DOS date and time in local time; None if no such moment exists."""
    try:
        when = datetime(1980 + (date >> 9), (date >> 5) & 15, date & 31, time >> 11, (time >> 5) & 63, (time & 31) * 2, tzinfo=ZoneInfo(zone))
    except ValueError:
        return None
    return int(when.timestamp()) * MICRO


def filetime(ticks: int) -> int:
    """100 ns since 1601."""
    return ticks // 10 - 11_644_473_600 * MICRO


def mac_time(seconds: int) -> int | None:
    """Seconds since 1904; 0 means none."""
    return (seconds - 2_082_844_800) * MICRO if seconds else None


def zero_ended(b: bytes) -> bytes:
    return b.split(b"\0", 1)[0]


class Walk:
    """A forward reader of little-endian fields over bytes."""

    def __init__(self, data: bytes, at: int = 0, what: str = "record"):
        self.data, self.at, self.what = data, at, what

    def bytes(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise malformed(f"{self.what} ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def int(self, size: int) -> int:
        return int.from_bytes(self.bytes(size), "little")

    def left(self) -> int:
        return len(self.data) - self.at
