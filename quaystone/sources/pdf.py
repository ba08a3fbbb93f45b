"""The text layer of a PDF file's first page, for files in a column: objects, streams and text operators are read where the file lies."""

from __future__ import annotations

import binascii
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most bytes that one stream may grow to, and the deepest that objects may lie in each other.
LARGEST, DEEPEST = 32 << 20, 40

OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")
TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]{}]|/[^\x00\t\n\f\r ()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\s]*>|[^\x00\t\n\f\r ()<>\[\]{}/%]+")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Unreadable(ValueError):
    """What keeps the text of a file from being read."""


class Name(bytes):
    """A name, as /Type; other words are operators and plain bytes are strings."""


class Word(bytes):
    """A word outside names and strings: an operator, true, false, null, R."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in brackets from after its first one, and the place after its last one."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
                continue
            n = data[at + 1 : at + 2]
            out += b"" if n in b"\r\n" else ESCAPES.get(n, n)
            at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            return bytes(out), at
        out += c
    raise Unreadable("a string without an end")


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Numbers, strings, names, words and brackets, each with the place after it."""
    while m := TOKEN.search(data, at):
        t, at = m[0], m.end()
        if t[:1] == b"%":
            continue
        if t == b"(":
            t, at = _string(data, at)
            yield t, at
        elif t[:1] == b"<" and t != b"<<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            yield binascii.unhexlify(digits + b"0" * (len(digits) % 2)), at
        elif t[:1] == b"/":
            yield Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: binascii.unhexlify(x[1]), t[1:])), at
        else:
            try:
                yield (float(t) if b"." in t else int(t)), at
            except ValueError:
                yield Word(t), at


def value(data: bytes, at: int) -> tuple[object, int]:
    """The first value from a place: a dictionary as dict, an array as list, a reference as ("ref", number)."""
    stack: list[list] = [[]]
    for t, end in tokens(data, at):
        if isinstance(t, Word) and t in (b"<<", b"["):
            if len(stack) > DEEPEST:
                raise Unreadable("objects too deep in each other")
            stack.append([t])
        elif isinstance(t, Word) and t in (b">>", b"]"):
            if len(stack) == 1:
                raise Unreadable("a bracket without its other")
            made = stack.pop()
            if t == b"]":
                stack[-1].append(made[1:])
            else:
                stack[-1].append({k: v for k, v in zip(made[1::2], made[2::2], strict=False) if isinstance(k, Name)})
        elif isinstance(t, Word) and t == b"R" and len(stack[-1]) > 1 and isinstance(stack[-1][-2], int):
            stack[-1][-2:] = [("ref", stack[-1][-2])]
        elif isinstance(t, Word) and t in (b"endobj", b"stream", b"obj"):
            break
        else:
            stack[-1].append(t)
        if len(stack) == 1 and isinstance(stack[0][0], (dict, list)):
            return stack[0][0], end
        at = end
    return (stack[0][0] if stack[0] else None), at


def inflated(raw: bytes, filters: list) -> bytes:
    for f in filters:
        if f in (b"FlateDecode", b"Fl"):
            made = zlib.decompressobj()
            try:
                raw = made.decompress(raw, LARGEST)
            except zlib.error as e:
                raise Unreadable("a stream that cannot be inflated") from e
            if made.unconsumed_tail:
                raise Unreadable("a stream beyond the bound")
        elif f in (b"ASCIIHexDecode", b"AHx"):
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw.split(b">")[0])
            raw = binascii.unhexlify(digits + b"0" * (len(digits) % 2))
        else:
            raise Unreadable(f"a stream coded by {bytes(f).decode('latin-1')}" if isinstance(f, bytes) else "a stream coded by an unknown filter")
    return raw


class File:
    """The objects of a file by number, the last one of each; no cross-reference table is needed, so a file that was cut may still be read."""

    def __init__(self, data: bytes):
        self.data = data
        self.places = {int(m[1]): m.end() for m in OBJECT.finditer(data)}
        self.inner: dict[int, object] = {}
        self.known: dict[int, tuple[object, int]] = {}
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise Unreadable("an encrypted file")
        for n in list(self.places):
            if b"/ObjStm" in data[self.places[n] : self.places[n] + 400]:
                head = value(data, self.places[n])[0]
                if isinstance(head, dict) and head.get(b"Type") == b"ObjStm":
                    head, body = self.stream(("ref", n))
                    first, count = self.got(head.get(b"First")), self.got(head.get(b"N"))
                    numbers = [int(x) for x in body[:first].split()[: 2 * count]]
                    for k, at in zip(numbers[::2], numbers[1::2], strict=False):
                        if k not in self.places:
                            self.inner[k] = value(body, first + at)[0]

    def read(self, n: int) -> tuple[object, int]:
        """The value of an object, read once however often it is referred to, and the place after it."""
        if n not in self.known:
            self.known[n] = value(self.data, self.places[n])
        return self.known[n]

    def got(self, x: object) -> object:
        """A value, or what a reference points at."""
        for _ in range(DEEPEST):
            if not (isinstance(x, tuple) and x[0] == "ref"):
                return x
            x = self.read(x[1])[0] if x[1] in self.places else self.inner.get(x[1])
        raise Unreadable("references in a circle")

    def stream(self, ref: object) -> tuple[dict, bytes]:
        if not (isinstance(ref, tuple) and ref[1] in self.places):
            raise Unreadable("a stream that is not there")
        head, at = self.read(ref[1])
        begin = re.compile(rb"\s*stream\r?\n").match(self.data, at)
        if not isinstance(head, dict) or not begin:
            raise Unreadable("an object without its stream")
        length = self.got(head.get(b"Length"))
        end = begin.end() + length if isinstance(length, int) else -1
        if not re.compile(rb"\s*endstream").match(self.data, end if end > 0 else len(self.data)):
            end = self.data.find(b"endstream", begin.end())
        if end < 0:
            raise Unreadable("a stream without an end")
        filters = self.got(head.get(b"Filter"))
        return head, inflated(self.data[begin.end() : end], [self.got(f) for f in filters] if isinstance(filters, list) else [filters] if filters else [])

    def all(self) -> Iterator[object]:
        for n in sorted({*self.places, *self.inner}):
            yield self.got(("ref", n))

    def page(self) -> dict:
        """The first page by the page tree, with what it inherits; without a tree, the first object that says it is one."""
        node = next((self.got(o.get(b"Pages")) for o in self.all() if isinstance(o, dict) and o.get(b"Type") == b"Catalog"), None)
        held: dict = {}
        for _ in range(DEEPEST):
            if not isinstance(node, dict):
                break
            held |= {k: v for k, v in node.items() if k in (b"Resources", b"Contents")}
            kids = self.got(node.get(b"Kids"))
            if not isinstance(kids, list):
                return held
            node = next((k for k in map(self.got, kids) if isinstance(k, dict)), None)
        found = next((o for o in self.all() if isinstance(o, dict) and o.get(b"Type") == b"Page"), None)
        if found is None:
            raise Unreadable("no page")
        return found


def unicode_map(body: bytes) -> tuple[int, dict[bytes, str]]:
    """(bytes of a code, text by code) of a font's ToUnicode map."""
    text = lambda b: b.decode("utf-16-be", "replace")
    out: dict[bytes, str] = {}
    width, held, kind = 1, [], b""
    for t, _ in tokens(body):
        if isinstance(t, Word) and t.startswith(b"begin"):
            kind, held = t[5:], []
        elif isinstance(t, Word) and t.startswith(b"end"):
            kind = b""
        elif kind == b"codespacerange" and isinstance(t, bytes):
            width = max(1, len(t))
        elif kind in (b"bfchar", b"bfrange") and not isinstance(t, Name):
            held.append(t)
            if kind == b"bfchar" and len(held) == 2:
                if all(type(x) is bytes for x in held):
                    out[held[0]] = text(held[1])
                held = []
            elif kind == b"bfrange" and (not isinstance(held[2], Word) if len(held) == 3 else len(held) > 3 and isinstance(t, Word)):
                lo, hi = (int.from_bytes(x, "big") for x in held[:2])
                for k in range(min(hi - lo + 1, 1 << 16)):
                    code = (lo + k).to_bytes(len(held[0]), "big")
                    if isinstance(held[2], Word):
                        out[code] = text(held[3 + k]) if type(held[3 + k]) is bytes else ""
                    elif type(held[2]) is bytes:
                        last = int.from_bytes(held[2], "big") + k
                        out[code] = text(last.to_bytes(len(held[2]), "big"))
                held = []
    return width, out


def shown(body: bytes, fonts: dict[bytes, tuple[int, dict[bytes, str]]]) -> str:
    """The text that a page's operators show; a new line where they move to another one, a blank where a gap is wider than a fifth of the size."""
    out: list[str] = []
    held: list = []
    array: list | None = None
    font: tuple[int, dict[bytes, str]] = (1, {})

    def put(raw: object) -> None:
        if type(raw) is bytes:
            width, table = font
            if table:
                out.extend(table.get(raw[i : i + width], "") for i in range(0, len(raw), width))
            else:
                out.append(raw.decode("cp1252", "replace"))

    def line() -> None:
        if out and out[-1] != "\n":
            out.append("\n")

    for t, _ in tokens(body):
        if isinstance(t, Word) and t == b"[":
            array = []
        elif isinstance(t, Word) and t == b"]":
            held, array = [array or []], None
        elif array is not None:
            array.append(t)
        elif not isinstance(t, Word):
            held.append(t)
        else:
            if t == b"Tf" and len(held) > 1:
                font = fonts.get(bytes(held[-2]) if isinstance(held[-2], bytes) else b"", (1, {}))
            elif t in (b"'", b'"', b"T*"):
                line()
            elif t in (b"Td", b"TD") and len(held) > 1 and held[-1] != 0 or t in (b"Tm", b"ET"):
                line()
            if t in (b"Tj", b"'", b'"') and held:
                put(held[-1])
            elif t == b"TJ" and held and isinstance(held[-1], list):
                for x in held[-1]:
                    put(x)
                    if isinstance(x, (int, float)) and x < -200:
                        out.append(" ")
            held = []
    return "".join(out).strip("\n")


def text_layer(data: bytes | None) -> tuple[str, str]:
    """(text, why there is none) of the first page."""
    try:
        if not data or not data[:1024].lstrip().startswith(b"%PDF-"):
            raise Unreadable("no PDF file")
        file = File(data)
        page = file.page()
        contents = page.get(b"Contents")
        if not (isinstance(contents, tuple) and isinstance(file.got(contents), dict)):
            contents = file.got(contents)
        parts = contents if isinstance(contents, list) else [contents] if contents else []
        body = b"\n".join(file.stream(p)[1] for p in parts)
        resources = file.got(page.get(b"Resources"))
        listed = file.got(resources.get(b"Font")) if isinstance(resources, dict) else None
        fonts = {}
        for name, ref in (listed or {}).items():
            known = file.got(ref)
            if isinstance(known, dict) and b"ToUnicode" in known:
                fonts[bytes(name)] = unicode_map(file.stream(known[b"ToUnicode"])[1])
        return shown(body, fonts), ""
    except Unreadable as e:
        return "", str(e)
    except (KeyError, IndexError, TypeError, ValueError, AttributeError, OverflowError) as e:  # a file may be broken in any way
        return "", f"a broken file ({type(e).__name__})"


def layer(content: Column) -> Column:
    """struct(text, reason) of files in a binary column: the first page's text, '' with a reason where none can be read. Null is no file."""
    def read(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_layer(bytes(f) if f is not None else None) for f in files], columns=["text", "reason"])

    return F.pandas_udf(read, "text string, reason string")(content)
