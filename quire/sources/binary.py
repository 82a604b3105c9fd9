"""Byte-level readers: a cursor, tagged records, and OLE2 compound files."""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

from ..model import DocumentError


class Cursor:
    """Reads little-endian values; an overrun raises IndexError."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n < 0 or n > self.left:
            raise IndexError(f"{n} bytes at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def _value(self, kind: str):
        return struct.unpack("<" + kind, self.take(struct.calcsize(kind)))[0]

    def u8(self) -> int:
        return self._value("B")

    def u16(self) -> int:
        return self._value("H")

    def u32(self) -> int:
        return self._value("I")

    def i16(self) -> int:
        return self._value("h")

    def i32(self) -> int:
        return self._value("i")

    def text(self, units: int | None = None) -> str:
        """UTF-16 of so many units, or of the number before it."""
        return utf16(self.take(2 * (self.u16() if units is None else units)))

    def optional_text(self) -> str | None:
        if self.left < 2 or self.left < 2 + 2 * struct.unpack_from("<H", self.data, self.at)[0]:
            return None
        return self.text()


def utf16(raw: bytes) -> str:
    return raw.decode("utf-16-le", "replace")


@dataclass
class Record:
    tag: int
    level: int
    data: bytes


def records(data: bytes) -> list[Record]:
    """All records of a stream; up to three bytes at its end are ignored, a record cut short fails."""
    out, at = [], 0
    while len(data) - at >= 4:
        word = struct.unpack_from("<I", data, at)[0]
        at += 4
        size = word >> 20
        if size == 4095:
            if len(data) - at < 4:
                raise DocumentError("invalid_record", "the size of a long record is cut short")
            size = struct.unpack_from("<I", data, at)[0]
            at += 4
        if len(data) - at < size:
            raise DocumentError("invalid_record", f"a record of {size} bytes is cut short")
        out.append(Record(word & 1023, word >> 10 & 1023, data[at : at + size]))
        at += size
    return out


def inflate(data: bytes) -> bytes:
    """Raw deflate without a head; empty stays empty."""
    if not data:
        return b""
    try:
        return zlib.decompressobj(-15).decompress(data)
    except zlib.error as e:
        raise DocumentError("invalid_container", f"inflate: {e}") from e


class CompoundFile:
    """The streams of an OLE2 compound file, by path from the root ("/BodyText/Section0")."""

    END, FREE = 0xFFFFFFFE, 0xFFFFFFFF

    def __init__(self, data: bytes):
        if len(data) < 512 or data[:8] != bytes.fromhex("D0CF11E0A1B11AE1"):
            raise DocumentError("invalid_container", "not a compound file")
        self.data = data
        try:
            self._load()
        except (struct.error, IndexError, ValueError) as e:
            raise DocumentError("invalid_container", f"a damaged compound file: {e}") from e

    def _load(self) -> None:
        shift, mini_shift = struct.unpack_from("<HH", self.data, 30)
        if not 7 <= shift <= 16 or mini_shift > shift:
            raise ValueError("sector sizes")
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        fats, directory, self.cutoff, mini_fat, _, difat, _ = struct.unpack_from("<IIxxxxIIIII", self.data, 44)
        sectors = [s for s in struct.unpack_from("<109I", self.data, 76) if s < self.END]
        seen = set()
        while difat < self.END and difat not in seen:
            seen.add(difat)
            entries = struct.unpack(f"<{self.size // 4}I", self._sector(difat))
            sectors += [s for s in entries[:-1] if s < self.END]
            difat = entries[-1]
        self.fat = [x for s in sectors[:fats] for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        raw = self._chain(directory)
        self.entries = [self._entry(raw, k) for k in range(0, len(raw) - 127, 128)]
        if not self.entries or self.entries[0]["type"] != 5:
            raise ValueError("no root")
        mini = self._chain(mini_fat) if mini_fat < self.END else b""
        self.mini_fat = list(struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4]))
        root = self.entries[0]
        self.mini = self._chain(root["start"])[: root["bytes"]] if root["start"] < self.END else b""
        self.paths: dict[str, dict] = {}
        self._walk(root["child"], "", set())

    def _sector(self, s: int) -> bytes:
        a = (s + 1) * self.size
        raw = self.data[a : a + self.size]
        if not raw:
            raise ValueError(f"sector {s}")
        return raw.ljust(self.size, b"\0")

    def _chain(self, s: int) -> bytes:
        out, steps = [], 0
        while s < self.END:
            out.append(self._sector(s))
            s = self.fat[s]
            if (steps := steps + 1) > len(self.fat):
                raise ValueError("a loop of sectors")
        return b"".join(out)

    @staticmethod
    def _entry(raw: bytes, k: int) -> dict:
        length = struct.unpack_from("<H", raw, k + 64)[0]
        left, right, child = struct.unpack_from("<III", raw, k + 68)
        start, size = struct.unpack_from("<IQ", raw, k + 116)
        return {"name": utf16(raw[k : k + max(0, min(64, length) - 2)]), "type": raw[k + 66], "left": left, "right": right, "child": child, "start": start, "bytes": size}

    def _walk(self, first: int, above: str, seen: set) -> None:
        todo = [(first, above)]
        while todo:
            k, path = todo.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            e = self.entries[k]
            own = f"{path}/{e['name']}"
            self.paths[own] = e
            todo += [(e["right"], path), (e["left"], path)]
            if e["type"] in (1, 5):
                todo.append((e["child"], own))

    def streams(self) -> list[str]:
        return sorted(p for p, e in self.paths.items() if e["type"] == 2)

    def read(self, path: str) -> bytes | None:
        """A stream's bytes; None where there is no stream of this path."""
        e = self.paths.get(path if path.startswith("/") else "/" + path)
        if not e or e["type"] != 2:
            return None
        n, s = e["bytes"], e["start"]
        if n >= self.cutoff:
            return self._chain(s)[:n]
        out, steps = [], 0
        while s < self.END and steps * self.mini_size < n:
            if s >= len(self.mini_fat):
                raise DocumentError("invalid_container", "a damaged short stream")
            out.append(self.mini[s * self.mini_size : (s + 1) * self.mini_size])
            s, steps = self.mini_fat[s], steps + 1
        return b"".join(out)[:n]

    def section_count(self) -> int:
        return sum(bool(re.search(r"(?:^|/)BodyText/Section\d+$", p)) for p in self.paths)

    def binary_streams(self) -> list[tuple[str, int, str]]:
        """(path, storage id, extension) of embedded files."""
        found = ((p, re.search(r"BinData/BIN([0-9A-F]{4})\.(\w+)$", p, re.I)) for p in self.streams())
        return [(p, int(m[1], 16), m[2].lower()) for p, m in found if m]
