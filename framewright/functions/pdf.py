"""A small PDF writer: pages with one picture and a few lines of text, byte for byte the same for the same pages."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field


@dataclass
class Text:
    """Lines in a box, from the top-left corner of the page; ``align`` is LEFT, CENTER or RIGHT, ``place`` TOP, CENTER or BOTTOM."""

    text: str
    x: float
    y: float
    width: float
    height: float
    size: float
    align: str = "LEFT"
    place: str = "CENTER"


@dataclass
class Page:
    """``pixels`` are RGB bytes of ``columns`` by ``rows``, or a JPEG file of that size; the box is from the top-left corner."""

    width: float
    height: float
    pixels: bytes
    columns: int
    rows: int
    box: tuple[float, float, float, float]
    texts: list[Text] = field(default_factory=list)


def text_width(text: str, size: float) -> float:
    """About the width of a line: half the size a character, more for capitals and less for thin letters."""
    return size * sum(0.28 if c in "iljt.,:;'| " else 0.72 if c.isupper() else 0.53 for c in text)


def _shown(line: str) -> bytes:
    raw = line.encode("cp1252", "replace")
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj"


def _drawn(page: Page, text: Text) -> list[bytes]:
    lines = text.text.splitlines()
    step = text.size * 1.2
    spare = max(0.0, text.height - step * len(lines))
    top = text.y + {"TOP": 0.0, "CENTER": spare / 2, "BOTTOM": spare}[text.place]
    out = []
    for k, line in enumerate(lines):
        free = text.width - text_width(line, text.size)
        x = text.x + {"LEFT": 0.0, "CENTER": free / 2, "RIGHT": free}[text.align]
        y = page.height - top - text.size - k * step
        out.append(b"BT /F1 %.2f Tf %.2f %.2f Td " % (text.size, x, y) + _shown(line) + b" ET")
    return out


def _image(page: Page) -> bytes:
    head = b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter " % (page.columns, page.rows)
    if page.pixels[:2] == b"\xff\xd8":
        return head + b"/DCTDecode /Length %d >>\nstream\n" % len(page.pixels) + page.pixels + b"\nendstream"
    if len(page.pixels) != page.columns * page.rows * 3:
        raise ValueError("a picture's bytes do not fit its size")
    packed = zlib.compress(page.pixels, 6)
    return head + b"/FlateDecode /Length %d >>\nstream\n" % len(packed) + packed + b"\nendstream"


def write(pages: list[Page], title: str = "") -> bytes:
    """The file; a document without pages is an error."""
    if not pages:
        raise ValueError("no pages")
    font, info = 3, 4
    kids = [5 + 3 * k for k in range(len(pages))]
    name = title.encode("utf-16-be").hex().upper().encode()
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % k for k in kids)),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
        b"<< /Title <FEFF" + name + b"> >>",
    ]
    for k, p in zip(kids, pages, strict=True):
        x, y, w, h = p.box
        draw = b"\n".join([b"q %.4f 0 0 %.4f %.4f %.4f cm /Im Do Q" % (w, h, x, p.height - y - h), *(line for t in p.texts for line in _drawn(p, t))])
        packed = zlib.compress(draw, 6)
        use = b"/Resources << /Font << /F1 %d 0 R >> /XObject << /Im %d 0 R >> >>" % (font, k + 2)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.4f %.4f] " % (p.width, p.height) + use + b" /Contents %d 0 R >>" % (k + 1))
        objects.append(b"<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(packed) + packed + b"\nendstream")
        objects.append(_image(p))
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % at for at in places)
    out += b"trailer\n<< /Size %d /Root 1 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, info, start)
    return bytes(out)


def page_count(data: bytes) -> int:
    """How many pages a file written here has."""
    return data.count(b"/Type /Page ")
