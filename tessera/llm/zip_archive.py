"""Reading members of ZIP files in place: end record, ZIP64 records, central directory, and ranges of stored members."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyarrow import fs

_END, _END64, _LOCATOR64, _CENTRAL, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Any store that Arrow reads: file, hdfs, s3, gs, or a plain path."""
    return fs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


class Archive:
    """``handle``: a seekable binary file.  Only the directory is read until members are asked for."""

    def __init__(self, handle, size: int):
        self.handle, self.size = handle, size
        self.members = {m.name: m for m in self._directory()}

    def _at(self, offset: int, length: int) -> bytes:
        self.handle.seek(offset)
        out = self.handle.read(length)
        if len(out) != length:
            raise ValueError(f"the archive ends before {offset + length}")
        return out

    def _directory(self) -> list[Member]:
        tail_at = max(0, self.size - (1 << 16) - 22)
        tail = self._at(tail_at, self.size - tail_at)
        at = tail.rfind(_END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(_END, 0, at)  # the bytes may occur in a comment
        if at < 0:
            raise ValueError("no end of a central directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = self._at(tail_at + at - 20, 20)
            if locator[:4] != _LOCATOR64:
                raise ValueError("no ZIP64 locator")
            record = self._at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != _END64:
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        raw, out, at = self._at(start, length), [], 0
        for _ in range(count):
            if raw[at : at + 4] != _CENTRAL:
                raise ValueError(f"no directory entry at {at}")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            crc, packed, size, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", raw, at + 16)
            header = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, k = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while k + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, k)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                    size, packed, header = (next(wide) if x == 0xFFFFFFFF else x for x in (size, packed, header))
                k += 4 + n
            out.append(Member(name, method, crc, packed, size, header))
            at += 46 + n_name + n_extra + n_comment
        return out

    def start(self, member: Member) -> int:
        """Where a stored member's bytes begin."""
        if member.method != 0:
            raise ValueError(f"{member.name} isn't stored")
        local = self._at(member.header, 30)
        if local[:4] != _LOCAL:
            raise ValueError(f"no local header for {member.name}")
        return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))

    def range(self, member: Member, offset: int, length: int, start: int | None = None) -> bytes:
        """A range of a stored member, without reading the rest."""
        if offset < 0 or length < 0 or offset + length > member.size:
            raise ValueError(f"the range leaves {member.name}")
        return self._at((self.start(member) if start is None else start) + offset, length)

    def read(self, name: str) -> bytes:
        return self.range(self.members[name], 0, self.members[name].size)
