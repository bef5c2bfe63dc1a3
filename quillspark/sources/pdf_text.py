"""The text of PDF pages, without a PDF library: objects, Flate streams, the page tree, text operators and fonts' maps to Unicode.

Encrypted files and other filters than Flate and ASCIIHex aren't read; a PDF library does better and goes to files.load() as an extractor."""

from __future__ import annotations

import re
import zlib

_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|\{|\}|\((?:\\.|[^\\()])*\)|\(|<[0-9A-Fa-f\s]*>|/[^\s<>\[\](){}/%]*|[^\s<>\[\](){}/%]+", re.S)
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Ref(int):
    """The number of an object."""


class Name(str):
    """A name, without its slash."""


class _Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self) -> bytes | None:
        while m := _TOKEN.search(self.data, self.at):
            self.at = m.end()
            t = m.group()
            if t == b"(":  # brackets within: to the one that closes it
                depth, i = 1, self.at
                while depth and i < len(self.data):
                    c = self.data[i : i + 1]
                    i += 2 if c == b"\\" else 1
                    depth += (c == b"(") - (c == b")")
                t, self.at = self.data[m.start() : i], i
            if not t.startswith(b"%"):
                return t
        return None

    def value(self, t: bytes | None = None):
        t = self.token() if t is None else t
        if t is None:
            raise ValueError("the file ends early")
        if t == b"<<":
            out = {}
            while (k := self.token()) not in (b">>", None):
                out[k[1:].decode("latin-1")] = self.value()
            return out
        if t == b"[":
            out = []
            while (k := self.token()) not in (b"]", None):
                out.append(self.value(k))
            return out
        if t.startswith(b"/"):
            return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m.group(1), 16)), t[1:].decode("latin-1")))
        if t.startswith(b"("):
            return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", _unescape, t[1:-1], flags=re.S)
        if t.startswith(b"<"):
            digits = re.sub(rb"\s", b"", t[1:-1])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if re.fullmatch(rb"\d+", t) and (m := re.compile(rb"\s+\d+\s+R(?![A-Za-z])").match(self.data, self.at)):
            self.at = m.end()
            return Ref(t)
        if re.fullmatch(rb"[+-]?\d*\.?\d*", t) and re.search(rb"\d", t):
            return float(t)
        return t


def _unescape(m: re.Match[bytes]) -> bytes:
    x = m.group(1)
    return bytes([int(x, 8) & 255]) if x[:1].isdigit() and x[:1] < b"8" else _ESCAPES.get(x, b"" if x in (b"\n", b"\r", b"\r\n") else x)


class Pdf:
    def __init__(self, data: bytes):
        self.data, self.objects = data, {}
        if b"/Encrypt" in data:
            raise ValueError("encrypted")
        for m in _OBJECT.finditer(data):
            self.objects[int(m.group(1))] = m.end()
        for n in list(self.objects):
            o = self.get(Ref(n))
            if isinstance(o, tuple) and o[0].get("Type") == "ObjStm":
                self._unpack(*o)

    def _unpack(self, about: dict, raw: bytes) -> None:
        body, first = self.decoded(about, raw), int(self.get(about["First"]))
        numbers = [int(x) for x in body[:first].split()]
        for n, offset in zip(numbers[::2], numbers[1::2], strict=False):
            self.objects.setdefault(n, _Reader(body, first + offset).value())

    def get(self, x):
        """A value; an object with a stream is the pair of both."""
        seen = 0
        while isinstance(x, Ref):
            x = self.objects.get(int(x))
            if isinstance(x, int) and not isinstance(x, Ref):
                r = _Reader(self.data, x)
                x = r.value()
                m = re.compile(rb"\s*stream(\r\n|\n|\r)").match(self.data, r.at)
                if isinstance(x, dict) and m:
                    n = self.get(x.get("Length"))
                    end = m.end() + int(n) if isinstance(n, float) else -1
                    if end < 0 or not re.compile(rb"\s*endstream").match(self.data, end):
                        end = self.data.find(b"endstream", m.end())
                    x = (x, self.data[m.end() : end])
            seen += 1
            if seen > 50:
                raise ValueError("references go round")
        return x

    def decoded(self, about: dict, raw: bytes) -> bytes:
        filters = self.get(about.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f == "FlateDecode":
                raw = zlib.decompressobj().decompress(raw)
            elif f == "ASCIIHexDecode":
                raw = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", raw).decode())
            else:
                raise ValueError(f"unknown filter {f}")
        return raw

    def dict(self, x) -> dict:
        x = self.get(x)
        return x[0] if isinstance(x, tuple) else x if isinstance(x, dict) else {}

    def pages(self) -> list[dict]:
        """The pages in the order of the tree, with what they inherit."""
        roots = [d for n in self.objects if (d := self.dict(Ref(n))).get("Type") == "Catalog"]
        out: list[dict] = []

        def walk(x, inherited: dict, depth: int) -> None:
            node = self.dict(x)
            here = {**inherited, **{k: node[k] for k in ("Resources",) if k in node}}
            if "Kids" in node and depth < 100:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, here, depth + 1)
            elif node:
                out.append({**here, **node})

        if roots:
            walk(roots[-1].get("Pages"), {}, 0)
        return out

    def text(self, page: dict) -> str:
        parts = self.get(page.get("Contents"))
        streams = [self.get(p) for p in parts] if isinstance(parts, list) else [parts]
        body = b"\n".join(self.decoded(*s) for s in streams if isinstance(s, tuple))
        fonts = self.dict(self.dict(page.get("Resources")).get("Font"))
        maps = {k: self._to_unicode(self.dict(v)) for k, v in fonts.items()}
        return _shown(body, maps)

    def _to_unicode(self, font: dict):
        stream = self.get(font.get("ToUnicode"))
        table: dict[int, str] = {}
        if isinstance(stream, tuple):
            body = self.decoded(*stream)
            for block in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
                codes = re.findall(rb"<([0-9A-Fa-f\s]+)>", block)
                table.update({int(a, 16): _utf16(b) for a, b in zip(codes[::2], codes[1::2], strict=False)})
            for block in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
                for lo, hi, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
                    targets = [_utf16(x) for x in re.findall(rb"<([0-9A-Fa-f]+)>", many)] if many else None
                    for i in range(min(int(hi, 16) - int(lo, 16) + 1, 65536)):
                        to = targets[i] if targets and i < len(targets) else _utf16(one) if one else ""
                        table[int(lo, 16) + i] = to if targets or not to else to[:-1] + chr(ord(to[-1]) + i)
        wide = font.get("Subtype") == "Type0"

        def decode(raw: bytes) -> str:
            if wide:
                codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)]
                return "".join(table.get(c, "") for c in codes)
            return "".join(table.get(c) or bytes([c]).decode("cp1252", "replace") for c in raw)

        return decode


def _utf16(digits: bytes) -> str:
    digits = re.sub(rb"\s", b"", digits)
    return bytes.fromhex(digits.decode()).decode("utf-16-be", "replace") if len(digits) > 2 else chr(int(digits, 16))


def _shown(body: bytes, fonts: dict) -> str:
    """The text that a content stream shows: a new line where the vertical place changes, a blank where a gap is wide."""
    out: list[str] = []
    args: list = []
    decode = lambda raw: raw.decode("cp1252", "replace")
    reader, y, leading = _Reader(body), 0.0, 0.0

    def moved(to: float) -> None:
        nonlocal y
        if out and abs(to - y) > 0.5 and out[-1] != "\n":
            out.append("\n")
        elif out and out[-1] not in ("\n", " "):
            out.append(" ")
        y = to

    while (t := reader.token()) is not None:
        if t[:1] in b"(</[" or re.fullmatch(rb"[+-]?\d*\.?\d+|[+-]?\d+\.", t):
            args.append(reader.value(t))
            continue
        nums = [a for a in args if isinstance(a, float)]
        if t == b"Tf" and args and isinstance(args[0], Name):
            decode = fonts.get(str(args[0]), decode)
        elif t == b"TL" and nums:
            leading = nums[-1]
        elif t in (b"Td", b"TD") and len(nums) > 1:
            leading = -nums[1] if t == b"TD" else leading
            moved(y + nums[1])
        elif t == b"Tm" and len(nums) > 5:
            moved(nums[5])
        elif t in (b"T*", b"'", b'"'):
            moved(y - (leading or 1.0))
        if t in (b"Tj", b"'", b'"') and args and isinstance(args[-1], bytes):
            out.append(decode(args[-1]))
        elif t == b"TJ" and args and isinstance(args[-1], list):
            out.append("".join(decode(a) if isinstance(a, bytes) else " " if isinstance(a, float) and a < -200 else "" for a in args[-1]))
        elif t == b"ID":  # an image among the text
            end = body.find(b"EI", reader.at)
            reader.at = len(body) if end < 0 else end + 2
        args = []
    return re.sub(r" *\n *", "\n", re.sub(r" {2,}", " ", "".join(out))).strip()


def pages(data: bytes) -> list[tuple[str, dict[str, str]]]:
    """The text of each page and its number, from 0."""
    pdf = Pdf(data)
    return [(pdf.text(p), {"page": str(i)}) for i, p in enumerate(pdf.pages())]
