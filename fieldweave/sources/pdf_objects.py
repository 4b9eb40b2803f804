"""The objects of a PDF file: a recursive-descent reader, the cross-reference chain, the page tree, and incremental updates.

Objects are found through the chain of cross-reference tables and streams, newest first, so what a later revision deleted or replaced isn't seen.
Where the chain is missing or damaged, the file is searched for objects and the last one of each number counts.
Names are ``Name``, strings ``bytes``, references ``Ref``, null ``None``, the rest Python's numbers, booleans, lists and dicts.
What can't be read raises ValueError.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any, NamedTuple

#: White space and delimiters of the syntax, escapes of strings, and what the text encoding has where Latin-1 has controls.
SPACE, DELIMITERS = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
AT_18, AT_80 = "˘ˇˆ˙˝˛˚˜", "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž�€"
DEEPEST = 100

_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*")
_WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]*")
_REFERENCE = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_OBJECT = re.compile(rb"(?<!\d)(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj\b")
_PLAIN = re.compile(rb"[^()\\\r]*")
_DECODING = str.maketrans(dict(zip(range(0x18, 0x20), AT_18)) | dict(zip(range(0x80, 0xA1), AT_80)))


@contextmanager
def parsing() -> Iterator[None]:
    """What a file of the wrong shape makes code raise, as ValueError."""
    try:
        yield
    except (KeyError, TypeError, IndexError, AttributeError, OverflowError, RecursionError, MemoryError) as e:
        raise ValueError(f"the file can't be read: {type(e).__name__} {e}") from e


class Name(str):
    """A name without its slash."""


class Ref(NamedTuple):
    number: int
    generation: int


class Stream(NamedTuple):
    head: dict
    start: int


class Reader:
    """Reads one object at a time from ``data``; ``at`` is the place behind the last one."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def taken(self, word: bytes) -> bool:
        self.skip()
        if self.data.startswith(word, self.at):
            self.at += len(word)
            return True
        return False

    def read(self, depth: int = 0) -> Any:
        if depth > DEEPEST:
            raise ValueError("objects are nested too deep")
        self.skip()
        first = self.data[self.at : self.at + 1]
        if self.taken(b"<<"):
            return self._dictionary(depth)
        if first == b"[":
            self.at += 1
            out = []
            while not self.taken(b"]"):
                out.append(self.read(depth + 1))
            return out
        if first == b"(":
            return self._literal()
        if first == b"<":
            return self._hexadecimal()
        if first == b"/":
            return self._name()
        if m := _REFERENCE.match(self.data, self.at):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        word = _WORD.match(self.data, self.at)[0]
        if not word:
            raise ValueError(f"no object at {self.at}")
        self.at += len(word)
        if word in (b"true", b"false", b"null"):
            return {b"true": True, b"false": False, b"null": None}[word]
        try:
            return float(word) if b"." in word else int(word)
        except ValueError:
            raise ValueError(f"no object but {word[:20]!r} at {self.at - len(word)}") from None

    def _dictionary(self, depth: int) -> dict:
        out: dict[str, Any] = {}
        while not self.taken(b">>"):
            if self.data[self.at : self.at + 1] != b"/":
                raise ValueError(f"a dictionary's key is no name at {self.at}")
            key = self._name()
            out[key] = self.read(depth + 1)
        return out

    def _name(self) -> Name:
        raw = _WORD.match(self.data, self.at + 1)[0]
        self.at += 1 + len(raw)
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), raw).decode("latin-1"))

    def _hexadecimal(self) -> bytes:
        end = self.data.find(b">", self.at)
        digits = re.sub(rb"[\x00\t\n\x0c\r ]", b"", self.data[self.at + 1 : end])
        if end < 0 or not re.fullmatch(rb"[0-9A-Fa-f]*", digits):
            raise ValueError(f"a string in hexadecimal isn't one at {self.at}")
        self.at = end + 1
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def _literal(self) -> bytes:
        """Brackets may nest, line ends are one byte, and a backslash at a line's end joins it to the next."""
        out, depth = bytearray(), 0
        while True:
            m = _PLAIN.match(self.data, self.at)
            out += m[0]
            sign = self.data[m.end() : m.end() + 1]
            self.at = m.end() + 1
            if not sign:
                raise ValueError("a string isn't closed")
            if sign == b"(":
                depth += 1
                out += sign if depth > 1 else b""
            elif sign == b")":
                depth -= 1
                if not depth:
                    return bytes(out)
                out += sign
            elif sign == b"\r":
                self.at += self.data[self.at : self.at + 1] == b"\n"
                out += b"\n"
            else:
                self._escape(out)

    def _escape(self, out: bytearray) -> None:
        if m := re.compile(rb"[0-7]{1,3}").match(self.data, self.at):
            out.append(int(m[0], 8) & 255)
            self.at = m.end()
        elif m := re.compile(rb"\r\n?|\n").match(self.data, self.at):
            self.at = m.end()
        else:
            sign = self.data[self.at : self.at + 1]
            out += ESCAPES.get(sign, sign)
            self.at += 1

    def indirect(self) -> tuple[int, Any]:
        """(number, object) of the indirect object here; a ``Stream`` has its dictionary and where its bytes begin."""
        self.skip()
        if not (m := _OBJECT.match(self.data, self.at)):
            raise ValueError(f"no indirect object at {self.at}")
        self.at = m.end()
        value = self.read()
        if isinstance(value, dict) and self.taken(b"stream"):
            start = re.compile(rb"\r?\n|\r").match(self.data, self.at)
            return int(m[1]), Stream(value, start.end() if start else self.at)
        return int(m[1]), value


def text_of(value: Any) -> str | None:
    """A text string: UTF-16 or UTF-8 with its mark, else the format's own encoding; other values as they are written; null for null."""
    if value is None:
        return None
    if not isinstance(value, bytes):
        return f"/{value}" if isinstance(value, Name) else str(value)
    if value[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return value[2:].decode("utf-16-be" if value[0] == 0xFE else "utf-16-le", "replace")
    return value[3:].decode("utf-8", "replace") if value.startswith(b"\xef\xbb\xbf") else value.decode("latin-1").translate(_DECODING)


def written(value: Any) -> bytes:
    """The object as it stands in a file; strings in hexadecimal."""
    if isinstance(value, dict):
        return b"<< " + b" ".join(written(Name(k)) + b" " + written(v) for k, v in value.items()) + b" >>"
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, list):
        return b"[" + b" ".join(map(written, value)) + b"]"
    if isinstance(value, bytes):
        return b"<" + value.hex().upper().encode() + b">"
    if isinstance(value, Name):
        return b"/" + b"".join(b"#%02X" % c if c <= 32 or c >= 127 or c in DELIMITERS + b"#" else bytes([c]) for c in value.encode("latin-1"))
    if isinstance(value, bool) or value is None:
        return {True: b"true", False: b"false", None: b"null"}[value]
    return (f"{value:f}".rstrip("0") if isinstance(value, float) else str(value)).encode()


def unpredicted(data: bytes, predictor: int, columns: int, colors: int = 1, bits: int = 8) -> bytes:
    """Rows as they were before prediction: by the pixel to the left (2), or as each row's first byte says (10 and above)."""
    if predictor < 2:
        return data
    step, width = max(1, colors * bits // 8), (columns * colors * bits + 7) // 8
    if predictor == 2 and bits != 8:
        raise ValueError("a prediction of other than bytes can't be read")
    out, above = bytearray(), bytearray(width)
    for at in range(0, len(data), width + (predictor > 2)):
        kind = data[at] if predictor > 2 else 1
        row = bytearray(data[at + (predictor > 2) : at + (predictor > 2) + width])
        for i in range(len(row)):
            left, up, corner = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            if kind == 1:
                row[i] = row[i] + left & 255
            elif kind == 2:
                row[i] = row[i] + up & 255
            elif kind == 3:
                row[i] = row[i] + (left + up) // 2 & 255
            elif kind == 4:
                near = left + up - corner
                row[i] = row[i] + min((left, up, corner), key=lambda x: abs(near - x)) & 255
        out += row
        above = row + bytearray(width - len(row))
    return bytes(out)


class Entry(NamedTuple):
    """Where an object is: in the file at ``place``, or with ``stream`` the ``place``-th of that object stream; a free one is at -1."""

    place: int
    stream: int | None = None


class Document:
    """A file's objects by number."""

    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise ValueError("no readable page: the file is no PDF")
        self.data, self.entries, self.trailer = data, {}, {}
        self.rebuilt, self.by_stream, self.start = False, False, None
        self.loaded: dict[int, Any] = {}
        self.packs: dict[int, list[tuple[int, Any]]] = {}
        found = re.findall(rb"startxref[\x00\t\n\x0c\r ]+(\d+)", data)
        try:
            with parsing():
                self.start = int(found[-1]) if found else None
                self._chain()
        except ValueError:
            with parsing():
                self._rebuild()
        if "Encrypt" in self.trailer:
            raise ValueError("the file is encrypted")

    # the cross-reference chain, newest section first

    def _chain(self) -> None:
        if self.start is None:
            raise ValueError("no cross-reference section")
        todo, seen = [self.start], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            reader = Reader(self.data, at)
            if reader.taken(b"xref"):
                trailer = self._table(reader)
                todo[:0] = [trailer["XRefStm"]] if "XRefStm" in trailer else []
            else:
                trailer = self._section(reader)
                self.by_stream |= at == self.start
            self.trailer = trailer | self.trailer if self.trailer else trailer
            if trailer.get("Prev") is not None:
                todo.append(trailer["Prev"])
        if not isinstance(self.trailer.get("Root"), Ref) or not isinstance(self.get(self.trailer["Root"]), dict):
            raise ValueError("the chain leads to no catalog")

    def _table(self, reader: Reader) -> dict:
        while not reader.taken(b"trailer"):
            first, n = reader.read(), reader.read()
            for k in range(n):
                place, _ = reader.read(), reader.read()
                reader.skip()
                kind = _WORD.match(reader.data, reader.at)[0]
                reader.at += len(kind)
                if kind not in (b"n", b"f"):
                    raise ValueError("a cross-reference table has other entries")
                self.entries.setdefault(first + k, Entry(place if kind == b"n" else -1))
        trailer = reader.read()
        if not isinstance(trailer, dict):
            raise ValueError("a trailer is no dictionary")
        return trailer

    def _section(self, reader: Reader) -> dict:
        _, stream = reader.indirect()
        if not isinstance(stream, Stream) or stream.head.get("Type") != "XRef":
            raise ValueError("no cross-reference section")
        head, body = stream.head, self.body(stream)
        widths = head["W"]
        numbers = head.get("Index") or [0, head["Size"]]
        size, at = sum(widths), 0
        for first, n in zip(numbers[::2], numbers[1::2]):
            for k in range(n):
                fields, begin = [], at
                for i, w in enumerate(widths):
                    fields.append(int.from_bytes(body[begin : begin + w], "big") if w else int(i == 0))
                    begin += w
                if begin > len(body):
                    raise ValueError("a cross-reference stream is cut short")
                at += size
                kind, x, y = fields
                self.entries.setdefault(first + k, Entry(-1) if kind == 0 else Entry(x) if kind == 1 else Entry(y, x))
        return head

    def _rebuild(self) -> None:
        """Entries from all objects that stand in the file; those in object streams count where the file has none of that number."""
        self.entries, self.loaded, self.packs, self.rebuilt, self.by_stream = {}, {}, {}, True, False
        packed: dict[int, Entry] = {}
        for m in _OBJECT.finditer(self.data):
            self.entries[int(m[1])] = Entry(m.start())
        for number in list(self.entries):
            try:
                with parsing():
                    value = self.get(Ref(number, 0))
                    if isinstance(value, Stream) and value.head.get("Type") == "ObjStm":
                        packed |= {n: Entry(k, number) for k, (n, _) in enumerate(self._pack(number))}
            except ValueError:
                continue
        self.entries = packed | self.entries
        self.trailer = {}
        for m in re.finditer(rb"\btrailer\b", self.data):
            try:
                trailer = Reader(self.data, m.end()).read()
            except ValueError:
                continue
            self.trailer |= trailer if isinstance(trailer, dict) else {}
        if not isinstance(self.trailer.get("Root"), Ref):
            roots = [n for n in self.entries if isinstance(x := self._try(n), dict) and x.get("Type") == "Catalog"]
            if not roots:
                raise ValueError("no readable page: the file has no catalog")
            self.trailer["Root"] = Ref(roots[-1], 0)

    def _try(self, number: int) -> Any:
        try:
            with parsing():
                return self.get(Ref(number, 0))
        except ValueError:
            return None

    # objects

    def get(self, value: Any) -> Any:
        """What a reference leads to; anything else is itself."""
        for _ in range(DEEPEST):
            if not isinstance(value, Ref):
                return value
            value = self._load(value.number)
        raise ValueError("references go in a circle")

    def _load(self, number: int) -> Any:
        if number not in self.loaded:
            entry = self.entries.get(number, Entry(-1))
            if entry.stream is not None:
                pack = self._pack(entry.stream)
                if entry.place >= len(pack) or pack[entry.place][0] != number:
                    raise ValueError(f"object {number} isn't where it should be")
                self.loaded[number] = pack[entry.place][1]
            elif entry.place < 0:
                self.loaded[number] = None
            else:
                own, value = Reader(self.data, entry.place).indirect()
                if own != number:
                    raise ValueError(f"object {number} isn't where it should be")
                self.loaded[number] = value
        return self.loaded[number]

    def _pack(self, number: int) -> list[tuple[int, Any]]:
        if number not in self.packs:
            stream = self.get(Ref(number, 0))
            if not isinstance(stream, Stream):
                raise ValueError(f"object {number} is no object stream")
            data, first = self.body(stream), self.get(stream.head["First"])
            numbers = [int(x) for x in data[:first].split()[: 2 * self.get(stream.head["N"])]]
            self.packs[number] = [(n, Reader(data, first + at).read()) for n, at in zip(numbers[::2], numbers[1::2])]
        return self.packs[number]

    def body(self, stream: Stream) -> bytes:
        """A stream's bytes, decoded."""
        length = self.get(stream.head.get("Length"))
        end = stream.start + length if isinstance(length, int) else -1
        if end < stream.start or not re.compile(rb"[\x00\t\n\x0c\r ]*endstream").match(self.data, end):
            end = self.data.find(b"endstream", stream.start)
            end = len(self.data) if end < 0 else end
        data = self.data[stream.start : end]
        filters, parameters = ([] if x is None else x if isinstance(x, list) else [x] for x in (self.get(stream.head.get("Filter")), self.get(stream.head.get("DecodeParms"))))
        for k, kind in enumerate(filters):
            if self.get(kind) not in ("FlateDecode", "Fl"):
                raise ValueError(f"streams by {kind} can't be read")
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error as e:
                raise ValueError("a stream can't be read") from e
            own = (self.get(parameters[k]) if k < len(parameters) else None) or {}
            data = unpredicted(data, self.get(own.get("Predictor", 1)), self.get(own.get("Columns", 1)), self.get(own.get("Colors", 1)), self.get(own.get("BitsPerComponent", 8)))
        return data

    # pages

    def pages(self) -> Iterator[tuple[Any, dict]]:
        """(its reference, page) of each page, depth first through the tree; a node that is met again is left out."""
        catalog = self.get(self.trailer["Root"])
        if not isinstance(catalog, dict):
            raise ValueError("no readable page: the catalog can't be read")
        stack, seen = [catalog.get("Pages")], set()
        while stack:
            at = stack.pop()
            if at in seen if isinstance(at, Ref) else False:
                continue
            seen |= {at} if isinstance(at, Ref) else set()
            node = self.get(at)
            if not isinstance(node, dict):
                continue
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                stack += reversed(kids)
            else:
                yield at, node

    def annotations(self) -> Iterator[tuple[int, int, dict, Ref | None, Any]]:
        """(page, place, annotation, number and object in which it stands) in page order; one that stands in its page's own list belongs to the list or page."""
        n = 0
        for page, (ref, node) in enumerate(self.pages()):
            n += 1
            listed = node.get("Annots")
            items = self.get(listed)
            for k, item in enumerate(items if isinstance(items, list) else []):
                found = self.get(item)
                owner = (item, found) if isinstance(item, Ref) else (listed, items) if isinstance(listed, Ref) else (ref if isinstance(ref, Ref) else None, node)
                yield page, k, found if isinstance(found, dict) else {}, *owner
        if not n:
            raise ValueError("no readable page")

    # updates

    def updated(self, changed: dict[int, Any]) -> bytes:
        """The file with these objects anew: they follow what is there, with a cross-reference section of the kind that the file has."""
        if self.start is None or not isinstance(self.trailer.get("Size"), int):
            raise ValueError("no cross-reference section to go on from")
        out, places = bytearray(self.data if self.data.endswith(b"\n") else self.data + b"\n"), {}
        for number, value in changed.items():
            places[number] = len(out)
            out += b"%d 0 obj\n%s\nendobj\n" % (number, written(value))
        at, size = len(out), self.trailer["Size"]
        kept = {k: self.trailer[k] for k in ("Root", "Info", "ID") if k in self.trailer}
        if self.by_stream:
            entries = {n: Entry(place) for n, place in places.items()} | {size: Entry(at)}
            out += _section(size, entries, {"Size": size + 1, **kept, "Prev": self.start})
        else:
            out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, place) for n, place in sorted(places.items()))
            out += b"trailer\n%s\n" % written({"Size": size, **kept, "Prev": self.start})
        return bytes(out + b"startxref\n%d\n%%%%EOF\n" % at)


def _section(number: int, entries: dict[int, Entry], trailer: dict) -> bytes:
    """A cross-reference stream of these entries as object ``number``."""
    order = sorted(entries)
    rows = b"".join((b"\x01" + e.place.to_bytes(8, "big") + b"\x00\x00" if e.stream is None else b"\x02" + e.stream.to_bytes(8, "big") + e.place.to_bytes(2, "big")) for e in (entries[n] for n in order))
    body = zlib.compress(_predicted(rows, 11))
    head = {"Type": Name("XRef"), **trailer, "W": [1, 8, 2], "Index": [x for n in order for x in (n, 1)], "Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 11}, "Length": len(body)}
    return b"%d 0 obj\n%s\nstream\n%s\nendstream\nendobj\n" % (number, written(head), body)


def new_file(objects: dict[int, Any], packed: bool = False, root: int = 1, pack_size: int = 200) -> bytes:
    """A file of these objects, in the file with a cross-reference table, or ``packed`` into object streams with a cross-reference stream."""
    out, entries, size = bytearray(b"%PDF-1.5\n"), {}, max(objects) + 1
    order = list(objects)
    if not packed:
        for n in order:
            entries[n] = Entry(len(out))
            out += b"%d 0 obj\n%s\nendobj\n" % (n, written(objects[n]))
        at = len(out)
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, e.place) for n, e in sorted(entries.items()))
        out += b"trailer\n%s\n" % written({"Size": size, "Root": Ref(root, 0)})
        return bytes(out + b"startxref\n%d\n%%%%EOF\n" % at)
    for first in range(0, len(order), pack_size):
        own, number = order[first : first + pack_size], size
        parts = [written(objects[n]) + b"\n" for n in own]
        head = b" ".join(b"%d %d" % (n, sum(map(len, parts[:k]))) for k, n in enumerate(own)) + b"\n"
        body = zlib.compress(head + b"".join(parts))
        entries |= {n: Entry(k, number) for k, n in enumerate(own)} | {number: Entry(len(out))}
        stream = {"Type": Name("ObjStm"), "N": len(own), "First": len(head), "Filter": Name("FlateDecode"), "Length": len(body)}
        out += b"%d 0 obj\n%s\nstream\n%s\nendstream\nendobj\n" % (number, written(stream), body)
        size += 1
    at = len(out)
    out += _section(size, entries | {size: Entry(at)}, {"Size": size + 1, "Root": Ref(root, 0)})
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % at)


def _predicted(data: bytes, width: int) -> bytes:
    """Each row as what it differs by from the row above."""
    out, above = bytearray(), bytes(width)
    for at in range(0, len(data), width):
        row = data[at : at + width]
        out += b"\x02" + bytes(a - b & 255 for a, b in zip(row, above))
        above = row
    return bytes(out)
