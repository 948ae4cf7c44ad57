"""A small PDF writer: pages of text in a TrueType font, of which the glyphs that are used are embedded, or in Helvetica.

With a TrueType font every character of a document gets a number of its own, which a table maps back to the character,
so text can be taken out again as it was; a character that the font does not have is drawn as a question mark.
Helvetica has the characters of Windows code page 1252; others become question marks.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

#: A4 in points, margins, and widths of Helvetica's printable ASCII in 1/1000 em. Fixed values of the font's metrics.
WIDTH, HEIGHT, MARGIN = 595, 842, 40
_ASCII = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
#: Where systems keep a font of many scripts, in the order in which they are looked for.
FONT_PATHS = (
    "/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf",
    "/usr/share/fonts/dejavu-sans-fonts/DejaVuSans.ttf",
    "/usr/share/fonts/TTF/DejaVuSans.ttf",
    "/usr/share/fonts/truetype/freefont/FreeSans.ttf",
    "/Library/Fonts/Arial.ttf",
    "/System/Library/Fonts/Supplemental/Arial.ttf",
    r"C:\Windows\Fonts\arial.ttf",
    r"C:\Windows\Fonts\calibri.ttf",
)
#: Bytes a font file may have.
LARGEST_FONT = 32 << 20


def find_font() -> bytes | None:
    """The first font of FONT_PATHS on this machine, which must be a TrueType file of bounded size."""
    for path in FONT_PATHS:
        try:
            with open(path, "rb") as f:
                raw = f.read(LARGEST_FONT + 1)
        except OSError:
            continue
        if len(raw) <= LARGEST_FONT and raw[:4] in (b"\0\1\0\0", b"true"):
            return raw
    return None


class TrueType:
    """Glyph numbers, widths and outlines of a TrueType file."""

    def __init__(self, raw: bytes):
        self.tables = {}
        for i in range(struct.unpack(">H", raw[4:6])[0]):
            tag, _, start, length = struct.unpack(">4sLLL", raw[12 + 16 * i : 28 + 16 * i])
            self.tables[tag.decode("latin-1")] = raw[start : start + length]
        head, hhea = self.tables["head"], self.tables["hhea"]
        self.em = struct.unpack(">H", head[18:20])[0]
        self.box = [self._scaled(v) for v in struct.unpack(">4h", head[36:44])]
        self.ascent, self.descent = (self._scaled(v) for v in struct.unpack(">2h", hhea[4:8]))
        n, wide = struct.unpack(">H", self.tables["maxp"][4:6])[0], struct.unpack(">H", hhea[34:36])[0]
        self.advance = [self._scaled(v) for v in struct.unpack(f">{2 * wide}H", self.tables["hmtx"][: 4 * wide])[::2]]
        long = struct.unpack(">h", head[50:52])[0]
        self.places = struct.unpack(f">{n + 1}L", self.tables["loca"][: 4 * n + 4]) if long else [2 * v for v in struct.unpack(f">{n + 1}H", self.tables["loca"][: 2 * n + 2])]
        self.glyph = self._characters()

    def _scaled(self, v: int) -> int:
        return round(v * 1000 / self.em)

    def width(self, glyph: int) -> int:
        return self.advance[min(glyph, len(self.advance) - 1)]

    def _characters(self) -> dict[int, int]:
        """Glyph by code point, of the widest Unicode table."""
        cmap, found = self.tables["cmap"], {}
        for i in range(struct.unpack(">H", cmap[2:4])[0]):
            platform, encoding, at = struct.unpack(">HHL", cmap[4 + 8 * i : 12 + 8 * i])
            kind = struct.unpack(">H", cmap[at : at + 2])[0]
            if (platform == 0 or platform == 3 and encoding in (1, 10)) and kind in (4, 12):
                found[kind] = at
        if 12 in found:
            at = found[12]
            groups = struct.unpack(">L", cmap[at + 12 : at + 16])[0]
            return {c: g + c - a for a, b, g in struct.iter_unpack(">3L", cmap[at + 16 : at + 16 + 12 * groups]) for c in range(a, b + 1)}
        if 4 not in found:
            return {}
        at = found[4]
        n = struct.unpack(">H", cmap[at + 6 : at + 8])[0] // 2
        column = lambda k, kind="H": struct.unpack(f">{n}{kind}", cmap[at + k : at + k + 2 * n])
        ends, starts, deltas, offsets = column(14), column(16 + 2 * n), column(16 + 4 * n), column(16 + 6 * n)
        out = {}
        for i, (a, b, delta, offset) in enumerate(zip(starts, ends, deltas, offsets)):
            for c in range(a, min(b, 0xFFFE) + 1):
                if not offset:
                    out[c] = (c + delta) & 0xFFFF
                else:
                    spot = at + 16 + 6 * n + 2 * i + offset + 2 * (c - a)
                    g = struct.unpack(">H", cmap[spot : spot + 2])[0]
                    out[c] = (g + delta) & 0xFFFF if g else 0
        return {c: g for c, g in out.items() if g}

    def _outline(self, glyph: int) -> bytes:
        return self.tables["glyf"][self.places[glyph] : self.places[glyph + 1]]

    def _with_parts(self, glyphs: set[int]) -> set[int]:
        """And the glyphs that composite ones are put together from."""
        todo, done = list(glyphs | {0}), set()
        while todo:
            g = todo.pop()
            if g in done:
                continue
            done.add(g)
            data = self._outline(g)
            at, more = 10, len(data) >= 10 and struct.unpack(">h", data[:2])[0] < 0
            while more:
                flags, part = struct.unpack(">HH", data[at : at + 4])
                todo.append(part)
                at += 4 + (4 if flags & 1 else 2) + (2 if flags & 8 else 4 if flags & 64 else 8 if flags & 128 else 0)
                more = bool(flags & 32)
        return done

    def subset(self, glyphs: set[int]) -> bytes:
        """A font file in which other glyphs have no outlines; numbers stay."""
        kept, outlines, places = self._with_parts(glyphs), [], [0]
        for g in range(len(self.places) - 1):
            data = self._outline(g) if g in kept else b""
            outlines.append(data + b"\0" * (-len(data) % 4))
            places.append(places[-1] + len(outlines[-1]))
        head = bytearray(self.tables["head"])
        head[8:12], head[50:52] = b"\0\0\0\0", b"\0\1"
        tables = {k: self.tables[k] for k in ("cvt ", "fpgm", "hhea", "hmtx", "maxp", "prep") if k in self.tables}
        tables |= {"glyf": b"".join(outlines), "head": bytes(head), "loca": struct.pack(f">{len(places)}L", *places)}
        power = len(tables).bit_length() - 1
        out, at, bodies = struct.pack(">4s4H", b"\0\1\0\0", len(tables), 16 << power, power, 16 * len(tables) - (16 << power)), 12 + 16 * len(tables), b""
        for tag in sorted(tables):
            data = tables[tag]
            padded = data + b"\0" * (-len(data) % 4)
            total = sum(struct.unpack(f">{len(padded) // 4}L", padded)) & 0xFFFFFFFF
            out += struct.pack(">4sLLL", tag.encode(), total, at + len(bodies), len(data))
            bodies += padded
        return out + bodies


@lru_cache(maxsize=2)
def true_type(raw: bytes) -> TrueType:
    return TrueType(raw)


class _Helvetica:
    def codes(self, text: str) -> list[int]:
        return [b if b >= 32 else 32 for b in text.encode("cp1252", "replace")]

    def width(self, code: int) -> int:
        return _ASCII[code - 32] if 32 <= code < 127 else 556

    def shown(self, codes: list[int]) -> bytes:
        return b"(" + re.sub(rb"([\\()])", rb"\\\1", bytes(codes)) + b")"

    def objects(self, at: int) -> list[bytes]:
        return [b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]


class _Embedded:
    """Numbers of a document's characters, from 1 on: those of alphabet, then others in order of first use."""

    def __init__(self, font: TrueType, alphabet: str = ""):
        self.font, self.number, self.glyphs, self.widths = font, {}, [0], [font.width(0)]
        self.codes(alphabet)

    def codes(self, text: str) -> list[int]:
        out = []
        for c in text:
            k = self.number.get(c)
            if k is None:
                k = self.number[c] = len(self.number) + 1
                glyph = self.font.glyph.get(ord(c), self.font.glyph.get(63, 0))
                self.glyphs.append(glyph)
                self.widths.append(self.font.width(glyph))
            out.append(k)
        return out

    def width(self, code: int) -> int:
        return self.widths[code]

    def shown(self, codes: list[int]) -> bytes:
        return b"<" + struct.pack(f">{len(codes)}H", *codes).hex().encode() + b">"

    def objects(self, at: int) -> list[bytes]:
        """Type 0 font, its descendant, descriptor, file, glyphs by number and characters by number, from object at on."""
        characters = [b"<%04x> <%s>" % (k, c.encode("utf-16-be", "surrogatepass").hex().encode()) for c, k in self.number.items()]
        listed = b"\n".join(b"%d beginbfchar\n%s\nendbfchar" % (len(part), b"\n".join(part)) for i in range(0, len(characters), 100) if (part := characters[i : i + 100]))
        table = b"/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CMapName /Own def\n/CMapType 2 def\n1 begincodespacerange\n<0000> <ffff>\nendcodespacerange\n" + listed + b"\nendcmap\nend\nend"
        f = self.font
        return [
            b"<< /Type /Font /Subtype /Type0 /BaseFont /Body /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (at + 1, at + 5),
            b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Body /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /FontDescriptor %d 0 R /CIDToGIDMap %d 0 R /W [0 [%s]] >>"
            % (at + 2, at + 4, b" ".join(b"%d" % w for w in self.widths)),
            b"<< /Type /FontDescriptor /FontName /Body /Flags 4 /FontBBox [%d %d %d %d] /ItalicAngle 0 /Ascent %d /Descent %d /CapHeight %d /StemV 80 /FontFile2 %d 0 R >>" % (*f.box, f.ascent, f.descent, f.ascent, at + 3),
            _stream(f.subset(set(self.glyphs))),
            _stream(struct.pack(f">{len(self.glyphs)}H", *self.glyphs)),
            _stream(table),
        ]


def _stream(data: bytes) -> bytes:
    packed = zlib.compress(data)
    return b"<< /Length %d /Length1 %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), len(data), packed)


def _wrap(text: str, size: float, face: _Helvetica | _Embedded) -> list[list[int]]:
    """Lines of codes; a word longer than a line is cut where the line is full."""
    room = (WIDTH - 2 * MARGIN) * 1000 / size
    (blank,) = face.codes(" ")
    out: list[list[int]] = []
    for line in text.split("\n"):
        now, used = [], 0
        for word in line.split(" "):
            codes = face.codes(word)
            wide = sum(map(face.width, codes))
            if now and used + face.width(blank) + wide <= room:
                now += [blank, *codes]
                used += face.width(blank) + wide
                continue
            if now:
                out.append(now)
            now, used = codes, wide
            if wide > room:
                now, used = [], 0
                for c in codes:
                    if now and used + face.width(c) > room:
                        out.append(now)
                        now, used = [], 0
                    now.append(c)
                    used += face.width(c)
        out.append(now)
    return out


def typeface(font: bytes | None, alphabet: str = "") -> _Helvetica | _Embedded:
    """What text is drawn in. alphabet: characters that are numbered first, so that pages drawn apart agree."""
    return _Embedded(true_type(font), alphabet) if font else _Helvetica()


def sheets(part: list[tuple[str, float, float]], face: _Helvetica | _Embedded) -> Iterator[bytes]:
    """The pages of one of the documents of document(), each packed when it is full."""
    lines: list[bytes] = []
    y = HEIGHT - MARGIN
    for text, size, grey in part:
        for codes in _wrap(text, size, face):
            if y - size * 1.4 < MARGIN:
                yield _stream(b"\n".join(lines))
                lines = []
                y = HEIGHT - MARGIN
            y -= size * 1.4
            lines.append(b"BT /F1 %g Tf %g g %d %g Td %s Tj ET" % (size, grey, MARGIN, y, face.shown(codes)))
        y -= size * 0.5
    yield _stream(b"\n".join(lines))


def _written(drawn: Iterable[bytes], fonts: list[bytes]) -> Iterator[bytes]:
    """A file of packed pages: first all of the font, then a page at a time, then the tree of pages and the places of objects."""
    places = array("Q", [0, 0, 0])
    first = b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"
    places[1] = len(first)
    first += b"1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"
    for body in fonts:
        places.append(len(first))
        first += b"%d 0 obj\n%s\nendobj\n" % (len(places) - 1, body)
    yield first
    at, start = len(first), len(places)
    for stream in drawn:
        k = len(places)
        one = b"%d 0 obj\n%s\nendobj\n" % (k, stream)
        two = b"%d 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>\nendobj\n" % (k + 1, WIDTH, HEIGHT, k)
        places.extend((at, at + len(one)))
        at += len(one) + len(two)
        yield one + two
    places[2], n = at, len(places)
    for kids in chain([b"2 0 obj\n<< /Type /Pages /Kids ["], (b" %d 0 R" % k for k in range(start + 1, n, 2)), [b"] /Count %d >>\nendobj\n" % ((n - start) // 2)]):
        at += len(kids)
        yield kids
    yield b"xref\n0 %d\n0000000000 65535 f \n" % n
    for i in range(1, n):
        yield b"%010d 00000 n \n" % places[i]
    yield b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (n, at)


#: Bytes of a piece of a file.
PIECE = 1 << 16


def pieces(drawn: Iterable[bytes], fonts: list[bytes], most: int = PIECE) -> Iterator[bytes]:
    """A file of sheets() in pieces, cut where one has reached most bytes. No page is cut, and the first piece has all of the font.

    Beyond a piece only the places of objects are held. fonts: objects(3) of the face.
    """
    out = bytearray()
    for chunk in _written(drawn, fonts):
        out += chunk
        if len(out) >= most:
            yield bytes(out)
            out.clear()
    if out:
        yield bytes(out)


def document(parts: Iterable[list[tuple[str, float, float]]], font: bytes | None = None) -> bytes:
    """PDF of documents, each on new pages. A document is a list of (text, size, grey 0 to 1). font: a TrueType file.

    parts may be an iterator. A page is packed when it is full, so only one is held as it is drawn.
    """
    face = typeface(font)
    drawn = [s for part in parts for s in sheets(part, face)]
    return b"".join(_written(drawn or [_stream(b"")], face.objects(3)))


def _streams(raw: bytes) -> Iterator[bytes]:
    for packed in re.finditer(rb"(?s)/FlateDecode >>\nstream\n(.*?)\nendstream\nendobj", raw):
        yield zlib.decompress(packed[1])


def _characters(table: bytes) -> str:
    return "".join(bytes.fromhex(m[1].decode()).decode("utf-16-be", "surrogatepass") for m in re.finditer(rb"<(?!0000)[0-9a-f]{4}> <([0-9a-f]+)>\n", table))


def alphabet(raw: bytes) -> str:
    """The characters of a document, or of its first piece, by number from 1 on; empty in Helvetica."""
    return next((_characters(s) for s in _streams(raw) if s.startswith(b"/CIDInit")), "")


def text(raw: bytes, known: str = "") -> str:
    """The lines of a document that document() wrote, or of a piece of it, in order. known: the document's alphabet(), for a piece."""
    numbered = lambda known: {b"%04x" % k: c for k, c in enumerate(known, 1)}
    characters, out = numbered(known), []
    for s in _streams(raw):  # one at a time; the table comes first
        if s.startswith(b"/CIDInit") and not characters:
            characters = numbered(_characters(s))
        for m in re.finditer(rb"Td (?:<([0-9a-f]*)>|\(((?:[^\\()]|\\.)*)\)) Tj", s) if s.startswith(b"BT ") else ():
            out.append("".join(characters[m[1][i : i + 4]] for i in range(0, len(m[1]), 4)) if m[1] is not None else re.sub(rb"\\(.)", rb"\1", m[2]).decode("cp1252"))
    return "\n".join(out)


def page(title: str, url: str, scraped_at: str, breadcrumb: list[str], plain: str, title_size: float = 18) -> list[tuple[str, float, float]]:
    """One document's lines: title, breadcrumb, source, time, paragraphs."""
    out = [(title, title_size, 0.0)]
    if breadcrumb:
        out.append((" > ".join(breadcrumb), 9, 0.55))
    if url:
        out.append((f"Source: {url}", 9, 0.47))
    if scraped_at:
        out.append((f"Scraped: {scraped_at}", 9, 0.47))
    return out + [(p, 11, 0.0) for p in (p.strip(" \t\n\r\f\v") for p in plain.split("\n\n")) if p]
