"""A small PDF object model: read well-formed files, edit the Info dictionary and the XMP packet, write the file anew.

Objects are found by one pass over the file, later definitions first, object
streams included, so neither cross-reference tables nor streams are needed.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone


class Name(str):
    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int = 0


class Raw(str):
    """Numbers, booleans, null: kept as written."""

    __slots__ = ()


@dataclass
class Stream:
    entries: dict
    data: bytes

    def decode(self) -> bytes:
        filters = self.entries.get("Filter")
        data = self.data
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if f not in ("FlateDecode", "Fl"):
                raise ValueError(f"unsupported filter {f}")
            data = zlib.decompressobj().decompress(data)
        return data


_SPACE = b"\x00\t\n\x0c\r "
_STOP = _SPACE + b"()<>[]{}/%"
_OBJECT = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj")
_REF = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![A-Za-z0-9])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class _Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        data, n = self.data, len(self.data)
        while self.at < n:
            c = data[self.at]
            if c in _SPACE:
                self.at += 1
            elif c == 37:
                while self.at < n and data[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def value(self, depth: int = 0):
        self.skip()
        data, at = self.data, self.at
        if depth > 200 or at >= len(data):
            raise ValueError("a value is missing")
        if data.startswith(b"<<", at):
            self.at += 2
            out: dict = {}
            while True:
                self.skip()
                if self.data.startswith(b">>", self.at):
                    self.at += 2
                    return out
                key = self.value(depth + 1)
                if not isinstance(key, Name):
                    raise ValueError("a dictionary's key is no name")
                out[str(key)] = self.value(depth + 1)
        c = data[at : at + 1]
        if c == b"[":
            self.at += 1
            items = []
            while True:
                self.skip()
                if self.data[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return items
                items.append(self.value(depth + 1))
        if c == b"(":
            return self._literal()
        if c == b"<":
            end = data.index(b">", at)
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"/":
            end = self._end(at + 1)
            self.at = end
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), data[at + 1 : end]).decode("latin-1"))
        if ref := _REF.match(data, at):
            self.at = ref.end()
            return Ref(int(ref[1]), int(ref[2]))
        end = self._end(at)
        if end == at:
            raise ValueError(f"unexpected {c!r}")
        self.at = end
        return Raw(data[at:end].decode("latin-1"))

    def _end(self, at: int) -> int:
        while at < len(self.data) and self.data[at] not in _STOP:
            at += 1
        return at

    def _literal(self) -> bytes:
        out, level, at, data = bytearray(), 1, self.at + 1, self.data
        while level:
            c = data[at : at + 1]
            if not c:
                raise ValueError("a string has no end")
            if c == b"\\":
                digits = re.match(rb"[0-7]{1,3}", data[at + 1 : at + 4])
                if digits:
                    out.append(int(digits[0], 8) & 255)
                    at += 1 + digits.end()
                    continue
                after = data[at + 1 : at + 2]
                if after == b"\r" and data[at + 2 : at + 3] == b"\n":
                    at += 1
                elif after not in (b"\r", b"\n"):
                    out += _ESCAPES.get(after, after)
                at += 2
                continue
            level += (c == b"(") - (c == b")")
            if level:
                out += c
            at += 1
        self.at = at
        return bytes(out)


def text_of(value) -> str:
    """A text string's characters."""
    if not isinstance(value, bytes):
        return str(value) if isinstance(value, Name) else ""
    if value[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return value.decode("utf-16", "replace")
    return value[3:].decode("utf-8", "replace") if value[:3] == b"\xef\xbb\xbf" else value.decode("latin-1")


def text_string(value: str) -> bytes:
    return value.encode("ascii") if value.isascii() else b"\xfe\xff" + value.encode("utf-16-be")


def date_of(value) -> str:
    """The ISO time of a PDF date, empty if it is none."""
    found = re.match(r"(?:D:)?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:([Zz+\-])(?:(\d\d)'?(\d\d)?'?)?)?", text_of(value))
    if not found:
        return ""
    y, mo, d, h, mi, s, sign, oh, om = found.groups()
    try:
        when = datetime(int(y), int(mo or 1), int(d or 1), int(h or 0), int(mi or 0), int(s or 0), tzinfo=timezone.utc)
    except ValueError:
        return ""
    shift = timedelta(hours=int(oh or 0), minutes=int(om or 0))
    when = when - shift if sign == "+" else when + shift if sign == "-" else when
    return when.strftime("%Y-%m-%dT%H:%M:%S.000Z")


def date_string(iso: str) -> bytes:
    """A PDF date of an ISO time; ValueError if it is none."""
    when = datetime.fromisoformat(iso.replace("Z", "+00:00"))
    when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    return when.astimezone(timezone.utc).strftime("D:%Y%m%d%H%M%SZ").encode()


class Document:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("no PDF header")
        self.header = re.search(rb"%PDF-[^\r\n]*", data)[0]
        self.objects: dict[int, object] = {}
        self.trailer: dict = {}
        self._scan(data)
        if not isinstance(self.trailer.get("Root"), Ref):
            root = next((n for n, o in self.objects.items() if isinstance(o, dict) and o.get("Type") == "Catalog"), None)
            if root is None:
                raise ValueError("no catalog")
            self.trailer["Root"] = Ref(root)

    def _scan(self, data: bytes) -> None:
        at, packed = 0, []
        step = re.compile(rb"(?<![0-9])(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj|trailer")
        while found := step.search(data, at):
            reader = _Reader(data, found.end())
            at = found.end()
            try:
                value = reader.value()
            except (ValueError, IndexError):
                continue
            reader.skip()
            at = reader.at
            if found[0] == b"trailer":
                if isinstance(value, dict):
                    self.trailer |= value
                continue
            if isinstance(value, dict) and data.startswith(b"stream", at):
                start = at + 6
                start += 2 if data.startswith(b"\r\n", start) else 1 if data[start : start + 1] in (b"\n", b"\r") else 0
                length = value.get("Length")
                end = start + int(length) if isinstance(length, Raw) and length.isdigit() else -1
                if end < 0 or not data[end : end + 12].lstrip(b"\r\n ").startswith(b"endstream"):
                    end = data.find(b"endstream", start)
                    end = len(data) if end < 0 else end
                    trimmed = data[start:end]
                    end -= 2 if trimmed.endswith(b"\r\n") else 1 if trimmed.endswith((b"\n", b"\r")) else 0
                value, at = Stream(value, data[start:end]), end
                kind = value.entries.get("Type")
                if kind == "XRef":
                    self.trailer |= {k: v for k, v in value.entries.items() if k in ("Root", "Info", "ID", "Encrypt")}
                    continue
                if kind == "ObjStm":
                    packed.append(value)
                    continue
            self.objects[int(found[1])] = value
        for stream in packed:
            try:
                self._unpack(stream)
            except (ValueError, zlib.error, KeyError):
                continue

    def _unpack(self, stream: Stream) -> None:
        data, first = stream.decode(), int(stream.entries["First"])
        numbers = [int(x) for x in data[:first].split()]
        for number, offset in zip(numbers[::2], numbers[1::2], strict=False):
            if number not in self.objects:
                self.objects[number] = _Reader(data, first + offset).value()

    def get(self, value):
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.number)
        return None

    @property
    def encrypted(self) -> bool:
        return "Encrypt" in self.trailer

    @property
    def info(self) -> dict:
        own = self.get(self.trailer.get("Info"))
        return own if isinstance(own, dict) else {}

    @property
    def catalog(self) -> dict:
        own = self.get(self.trailer["Root"])
        if not isinstance(own, dict):
            raise ValueError("no catalog")
        return own

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with resources as inherited."""
        out, seen = [], set()
        stack = [(self.catalog.get("Pages"), {})]
        while stack:
            ref, above = stack.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            own = above | ({"Resources": node["Resources"]} if "Resources" in node else {})
            if isinstance(kids := self.get(node.get("Kids")), list):
                stack += [(k, own) for k in reversed(kids)]
            else:
                out.append(own | node)
        return out

    def content(self, value) -> str:
        value = self.get(value)
        if isinstance(value, list):
            return "".join(map(self.content, value))
        if not isinstance(value, Stream):
            return ""
        try:
            return value.decode().decode("latin-1")
        except (ValueError, zlib.error):
            return value.data.decode("latin-1")

    def has_image(self, page: dict) -> bool:
        resources = self.get(page.get("Resources"))
        images = self.get(resources.get("XObject")) if isinstance(resources, dict) else None
        return isinstance(images, dict) and any(isinstance(o := self.get(v), Stream) and o.entries.get("Subtype") == "Image" for v in images.values())

    def xmp(self) -> bytes | None:
        """The packet; None without one, ValueError if it can't be read."""
        if "Metadata" not in self.catalog:
            return None
        stream = self.get(self.catalog["Metadata"])
        if not isinstance(stream, Stream):
            raise ValueError("the metadata is no stream")
        try:
            return stream.decode()
        except zlib.error as error:
            raise ValueError(str(error)) from error

    # -- changes ------------------------------------------------------------

    def add(self, value) -> Ref:
        number = max(self.objects, default=0) + 1
        self.objects[number] = value
        return Ref(number)

    def edit_info(self) -> dict:
        if not self.info:
            self.trailer["Info"] = self.add({})
        return self.info

    def set_xmp(self, packet: bytes | None) -> None:
        old = self.catalog.pop("Metadata", None)
        if isinstance(old, Ref):
            self.objects.pop(old.number, None)
        if packet is not None:
            data = zlib.compress(packet)
            self.catalog["Metadata"] = self.add(Stream({"Type": Name("Metadata"), "Subtype": Name("XML"), "Filter": Name("FlateDecode"), "Length": Raw(len(data))}, data))

    def save(self) -> bytes:
        out, places = bytearray(self.header + b"\n%\xe2\xe3\xcf\xd3\n"), {}
        for number in sorted(self.objects):
            places[number] = len(out)
            out += b"%d 0 obj\n" % number + serialise(self.objects[number]) + b"\nendobj\n"
        start, size = len(out), max(self.objects, default=0) + 1
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size
        for number in range(1, size):
            out += b"%010d 00000 n \n" % places[number] if number in places else b"0000000000 65535 f \n"
        trailer = {k: v for k, v in self.trailer.items() if k in ("Root", "Info", "ID")} | {"Size": Raw(size)}
        return bytes(out + b"trailer\n" + serialise(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def serialise(value) -> bytes:
    if isinstance(value, Stream):
        return serialise(value.entries | {"Length": Raw(len(value.data))}) + b"\nstream\n" + value.data + b"\nendstream"
    if isinstance(value, dict):
        return b"<< " + b" ".join(serialise(Name(k)) + b" " + serialise(v) for k, v in value.items()) + b" >>"
    if isinstance(value, list):
        return b"[ " + b" ".join(map(serialise, value)) + b" ]"
    if isinstance(value, Ref):
        return b"%d 0 R" % value.number
    if isinstance(value, Name):
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"()<>[]{}/%#" else b"#%02X" % c for c in value.encode("latin-1", "replace"))
    if isinstance(value, bytes):
        return b"<" + value.hex().upper().encode() + b">"
    return str(value).encode("latin-1")
