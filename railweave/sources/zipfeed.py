"""A feed's files out of a zip, within limits.

One feed is one archive of bounded size; its members are read on the driver, since
neither zip nor exact line numbers split.  Everything behind the rows is DataFrames.
"""

from __future__ import annotations

import csv
import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from ..errors import FeedError, LimitError


@dataclass(frozen=True)
class Limits:
    compressed: int = 512 << 20
    uncompressed: int = 4 << 30
    entries: int = 1000
    line: int = 64 << 10
    rows: int = 100_000_000


def declared_entries(data: bytes) -> int:
    """Number of entries that the end of the archive declares (zip64 too)."""
    at = data.rfind(b"PK\x05\x06", max(0, len(data) - 65_557))
    if at < 0 or at + 22 > len(data):
        raise FeedError("feed.zip", None, "not a zip archive")
    n = struct.unpack_from("<H", data, at + 10)[0]
    if n == 0xFFFF and at >= 20 and data[at - 20 : at - 16] == b"PK\x06\x07":
        big = struct.unpack_from("<Q", data, at - 12)[0]
        if big + 40 <= len(data) and data[big : big + 4] == b"PK\x06\x06":
            n = struct.unpack_from("<Q", data, big + 32)[0]
    return n


class Archive:
    """Members at the root, or else in the one folder below it."""

    def __init__(self, data: bytes, limits: Limits | None = None):
        self.limits = limits or Limits()
        if len(data) > self.limits.compressed:
            raise LimitError("feed.zip", None, f"larger than {self.limits.compressed} bytes")
        if declared_entries(data) > self.limits.entries:
            raise LimitError("feed.zip", None, f"more than {self.limits.entries} entries")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise FeedError("feed.zip", None, str(e)) from e
        names = [n for n in self.zip.namelist() if not n.endswith("/")]
        flat = [n for n in names if "/" not in n]
        nested = [n for n in names if n.count("/") == 1]
        chosen = flat if any(n.endswith(".txt") for n in flat) else nested
        self.members: dict[str, str] = {}
        for n in chosen:
            short = n.rsplit("/", 1)[-1]
            if short in self.members:
                raise FeedError(short, None, "occurs twice")
            self.members[short] = n
        self.left = self.limits.uncompressed

    def __contains__(self, name: str) -> bool:
        return name in self.members

    def lines(self, name: str) -> Iterator[str]:
        """Decoded lines; the budget of uncompressed bytes is shared by all members."""
        with self.zip.open(self.members[name]) as f:
            n = 0
            while line := f.readline(self.limits.line + 2):
                n += 1
                self.left -= len(line)
                if self.left < 0:
                    raise LimitError(name, n, f"more than {self.limits.uncompressed} bytes in all")
                if len(line.rstrip(b"\r\n")) > self.limits.line:
                    raise LimitError(name, n, f"line over {self.limits.line} bytes")
                try:
                    yield line.decode("utf-8-sig" if n == 1 else "utf-8")
                except UnicodeDecodeError as e:
                    raise FeedError(name, n, "not UTF-8") from e

    def rows(self, name: str, required: tuple[str, ...] = ()) -> Iterator[tuple[int, dict[str, str]]]:
        """(line, row by column name); values are trimmed, missing ones empty, unknown columns kept."""
        reader = csv.reader(self.lines(name), strict=False)
        try:
            head = [c.strip() for c in next(reader, [])]
            for c in required:
                if c not in head:
                    raise FeedError(name, 1, f"no column {c}")
            for n, row in enumerate(reader):
                if n >= self.limits.rows:
                    raise LimitError(name, reader.line_num, f"more than {self.limits.rows} rows")
                if row:
                    yield reader.line_num, {c: v.strip() for c, v in zip(head, row + [""] * (len(head) - len(row)), strict=False)}
        except csv.Error as e:
            raise FeedError(name, reader.line_num, str(e)) from e
