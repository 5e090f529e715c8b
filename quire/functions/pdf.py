"""Text and information tags of PDF files, read without a library.

Objects are found by their headers, so files with a broken cross-reference table can be read too;
of an object that is defined twice the last definition counts. Plain and Flate streams are read,
each up to ``MOST`` bytes. Encrypted or unreadable files give empty results, as do glyphs of
two-byte fonts that name no characters.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cached_property

MOST = 16 << 20
_DEPTH = 64
_TOKEN = re.compile(rb"(?:[\x00\t\n\x0c\r ]++|%[^\r\n]*+)*+(<<|>>|[\[\](){}]|<[0-9A-Fa-f\x00\t\n\x0c\r ]*>|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)")
_HEADER = re.compile(rb"(?<![0-9])(\d{1,9})\s+\d{1,5}\s+obj\b")
_PACKED = re.compile(rb"\s*<<(?:(?!endobj).){0,1000}?/ObjStm", re.DOTALL)
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_STRING_STOP = re.compile(rb"[()\\]")
_OCTAL = re.compile(rb"[0-7]{1,3}")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b""}
_FAULTS = (ValueError, KeyError, IndexError, TypeError, AttributeError, OverflowError, zlib.error)


class Name(str):
    """A name such as /Type, without its slash."""


class Word(str):
    """An operator or keyword."""


class Ref(int):
    """A reference to an object by its number."""


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose opening bracket stands before ``at``, and the place after it."""
    out, depth = bytearray(), 1
    while found := _STRING_STOP.search(data, at):
        out += data[at : found.start()]
        at = found.end()
        if found[0] == b"\\":
            if octal := _OCTAL.match(data, at):
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
            else:
                out += _ESCAPES.get(data[at : at + 1], data[at : at + 1])
                at += 2 if data[at : at + 2] == b"\r\n" else 1
            continue
        depth += 1 if found[0] == b"(" else -1
        if not depth:
            return bytes(out), at
        out += found[0]
    raise ValueError("open string")


def items(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Values and operators from ``at`` on, each with the place after it."""
    stack: list[list] = [[]]
    while found := _TOKEN.match(data, at):
        token, at = found[1], found.end()
        if token in (b"<<", b"["):
            if len(stack) > _DEPTH:
                raise ValueError("too deep")
            stack.append([])
            continue
        if token in (b">>", b"]"):
            if len(stack) < 2:
                continue
            inside = stack.pop()
            value = inside if token == b"]" else {k: v for k, v in zip(inside[::2], inside[1::2], strict=False) if isinstance(k, Name)}
        elif token == b"(":
            value, at = _literal(data, at)
        elif token[:1] == b"<":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif token[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), token[1:]).decode("latin-1"))
        elif _NUMBER.fullmatch(token):
            value = float(token) if b"." in token else int(token)
        elif token == b"R" and len(stack[-1]) > 1 and isinstance(stack[-1][-2], int):
            stack[-1].pop()
            value = Ref(stack[-1].pop())
        else:
            value = Word(token.decode("latin-1"))
        if len(stack) > 1:
            stack[-1].append(value)
        else:
            yield value, at


def _string(value: object) -> str:
    if not isinstance(value, bytes):
        return ""
    for mark, code in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"), (b"\xef\xbb\xbf", "utf-8")):
        if value.startswith(mark):
            return value[len(mark) :].decode(code, "ignore")
    return value.decode("latin-1")


class Document:
    """Objects of a file, read as they are asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.places = {int(m[1]): m.end() for m in _HEADER.finditer(raw)}
        self.known: dict[int, tuple[object, int]] = {}
        self.closed = re.search(rb"/Encrypt\s*(?:\d|<<)", raw) is not None

    def _read(self, number: int) -> tuple[object, int]:
        if number not in self.known:
            found = next(items(self.raw, self.places[number])) if number in self.places else (self.packed.get(number), 0)
            self.known[number] = found
        return self.known[number]

    def value(self, x: object) -> object:
        for _ in range(_DEPTH):
            if not isinstance(x, Ref):
                return x
            x = self._read(int(x))[0]
        raise ValueError("references in a circle")

    def entry(self, where: object, key: str) -> object:
        where = self.value(where)
        return self.value(where.get(key)) if isinstance(where, dict) else None

    def stream(self, number: int) -> bytes:
        head, at = self._read(number)
        begin = re.compile(rb"\s*stream\r?\n?").match(self.raw, at)
        if not isinstance(head, dict) or not begin:
            return b""
        size = self.value(head.get("Length"))
        stop = begin.end() + size if isinstance(size, int) else -1
        if not 0 <= stop <= len(self.raw) or not re.compile(rb"\s*endstream").match(self.raw, stop):
            stop = self.raw.find(b"endstream", begin.end())
            stop = len(self.raw) if stop < 0 else stop
        body = self.raw[begin.end() : stop]
        filters = self.value(head.get("Filter"))
        for name in filters if isinstance(filters, list) else [filters] if filters else []:
            if self.value(name) not in ("FlateDecode", "Fl"):
                return b""
            body = zlib.decompressobj().decompress(body, MOST)
        return body[:MOST]

    @cached_property
    def packed(self) -> dict[int, object]:
        """Objects that stand in object streams."""
        out = {}
        for number, at in self.places.items():
            if not _PACKED.match(self.raw, at):
                continue
            head = self._read(number)[0]
            if not isinstance(head, dict) or head.get("Type") != "ObjStm":
                continue
            first, body = self.value(head["First"]), self.stream(number)
            numbers = [x for x, _ in items(body[:first])]
            for k, place in zip(numbers[::2], numbers[1::2], strict=False):
                if found := next(items(body, first + place), None):
                    out[k] = found[0]
        return out

    def _named(self, key: bytes) -> object:
        """Value of the last trailer's reference ``key``."""
        found = re.findall(rb"/" + key + rb"\s+(\d{1,9})\s+\d{1,5}\s+R", self.raw)
        return self.value(Ref(found[-1])) if found else None

    def tags(self) -> dict[str, str]:
        info = self._named(b"Info")
        return {k: _string(self.entry(info, tag)) for k, tag in (("title", "Title"), ("author", "Author"), ("genre", "Subject"))}

    def pages(self) -> Iterator[tuple[dict, object]]:
        """(page, its resources) in the order of the page tree."""
        root, seen = self._named(b"Root"), set()
        todo = [(root.get("Pages"), None)] if isinstance(root, dict) else []
        while todo:
            ref, resources = todo.pop()
            if isinstance(ref, Ref):
                if ref in seen:
                    continue
                seen.add(ref)
            page = self.value(ref)
            if not isinstance(page, dict):
                continue
            resources = page.get("Resources", resources)
            kids = self.value(page.get("Kids"))
            if isinstance(kids, list):
                todo += [(k, resources) for k in reversed(kids)]
            else:
                yield page, resources

    def _characters(self, font: object) -> tuple[int, dict[bytes, str] | None]:
        """(bytes of a code, characters by code) of a font; no table means its codes are characters."""
        ref = self.value(font).get("ToUnicode") if isinstance(self.value(font), dict) else None
        wide = 2 if self.entry(font, "Subtype") == "Type0" else 1
        if not isinstance(ref, Ref):
            return wide, {} if wide == 2 else None
        out: dict[bytes, str] = {}
        held: list = []
        put = lambda code, target: out.__setitem__(code, target.decode("utf-16-be", "ignore"))
        for x, _ in items(self.stream(int(ref))):
            if x in ("beginbfchar", "beginbfrange"):
                held = []
            elif x == "endbfchar":
                for code, target in zip(held[::2], held[1::2], strict=False):
                    put(code, target)
            elif x == "endbfrange":
                for low, high, target in zip(held[::3], held[1::3], held[2::3], strict=False):
                    start = int.from_bytes(low, "big")
                    for k in range(min(int.from_bytes(high, "big") - start, 0xFFFF) + 1):
                        last = target[k] if isinstance(target, list) else target[:-2] + ((int.from_bytes(target[-2:], "big") + k) & 0xFFFF).to_bytes(2, "big")
                        put((start + k).to_bytes(len(low), "big"), last)
            else:
                held.append(x)
        return (len(next(iter(out))) if out else wide), out

    def page_text(self, page: dict, resources: object) -> str:
        fonts, known = self.entry(resources, "Font"), {}
        parts = page.get("Contents")
        parts = self.value(parts) if isinstance(self.value(parts), list) else [parts]
        body = b"\n".join(self.stream(int(p)) for p in parts if isinstance(p, Ref))
        out: list[str] = []
        held: list = []
        wide, table = 1, None

        def show(codes: object) -> None:
            if isinstance(codes, bytes):
                out.append(codes.decode("cp1252", "ignore") if table is None else "".join(table.get(codes[k : k + wide], "") for k in range(0, len(codes), wide)))

        for x, _ in items(body):
            if not isinstance(x, Word):
                held.append(x)
                continue
            if x == "Tf" and held and isinstance(fonts, dict):
                name = held[0]
                if name not in known:
                    known[name] = self._characters(fonts.get(name))
                wide, table = known[name]
            elif x in ("Td", "TD", "Tm", "T*", "ET", "'", '"'):
                out.append("\n")
            if x in ("Tj", "'", '"') and held:
                show(held[-1])
            elif x == "TJ" and held and isinstance(held[-1], list):
                for piece in held[-1]:
                    if isinstance(piece, int | float) and piece < -200:
                        out.append(" ")
                    show(piece)
            held = []
        return "".join(out)


def text(raw: bytes, most: int, whole: bool = False) -> str:
    """Text of the first page, or of as many pages as hold ``most`` characters."""
    try:
        doc, out, size = Document(raw), [], 0
        for page, resources in doc.pages() if not doc.closed else ():
            out.append(doc.page_text(page, resources))
            size += len(out[-1])
            if not whole or size >= most:
                break
        return "\n".join(out)
    except _FAULTS:
        return ""


def tags(raw: bytes) -> dict[str, str]:
    """title, author and genre (the subject) of the information dictionary."""
    try:
        doc = Document(raw)
        return doc.tags() if not doc.closed else {}
    except _FAULTS:
        return {}
