"""Text and images of PDF files with the standard library alone.

Read are classic objects and object streams, Flate-coded or plain, and the page tree in order; text
comes from the operators Tj, TJ, ' and " on pages and in the form objects they draw. A font's ToUnicode
map says what its codes, of one or two bytes, stand for; without one, codes are Latin-1. Not read:
encrypted files, composite fonts without such a map. Images keep their pixels: JPEG data as it is,
other ones as PNG, as there is no WebP encoder here.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, word_count
from ..operators.chunking import fixed_windows
from .storage import small_batches

#: Images of fewer bytes are dropped.
LEAST_IMAGE = 10 * 1024
PAGES = "path string, page_number long, text string"
IMAGES = "path string, page_number long, image_index int, width int, height int, format string, data binary"


class Pdf:
    """Objects by number: (dictionary text, stream bytes or None)."""

    def __init__(self, data: bytes):
        self.objects: dict[int, tuple[bytes, bytes | None]] = {}
        for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S):
            head, mark, rest = m[2].partition(b"stream")
            body = re.sub(rb"^\r?\n", b"", rest.rpartition(b"endstream")[0]) if mark else None
            if body is not None:
                size = re.search(rb"/Length\s+(\d+)\b(?!\s+\d+\s+R)", head)
                body = body[: int(size[1])] if size else re.sub(rb"\r?\n$", b"", body)
            self.objects[int(m[1])] = (head, body)
        for head, _ in list(self.objects.values()):
            if b"/ObjStm" in head:
                self._unpack(head, self.stream_of(head, _))

    def _unpack(self, head: bytes, body: bytes) -> None:
        n, first = (int(re.search(rb"/%s\s+(\d+)" % k, head)[1]) for k in (b"N", b"First"))
        numbers = [int(x) for x in body[:first].split()[: 2 * n]]
        places = [*numbers[1::2], len(body) - first]
        for k, (number, at) in enumerate(zip(numbers[::2], numbers[1::2])):
            self.objects.setdefault(number, (body[first + at : first + places[k + 1]], None))

    @staticmethod
    def stream_of(head: bytes, body: bytes | None) -> bytes:
        if body is None:
            return b""
        return zlib.decompressobj().decompress(body) if b"/FlateDecode" in head else body

    def refs(self, head: bytes, key: bytes) -> list[int]:
        """Numbers that a key refers to, one or an array."""
        m = re.search(rb"/%s\s*(\[[^\]]*\]|\d+\s+\d+\s+R)" % key, head)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def pages(self) -> list[bytes]:
        root = next((h for h, _ in self.objects.values() if re.search(rb"/Type\s*/Catalog", h)), b"")
        out, todo = [], self.refs(root, b"Pages")
        while todo:
            head = self.objects.get(todo.pop(0), (b"", None))[0]
            kids = self.refs(head, b"Kids")
            if kids:
                todo = kids + todo
            elif re.search(rb"/Type\s*/Page\b", head):
                out.append(head)
        return out

    def resources(self, head: bytes) -> bytes:
        """The resources of a page or form, its own or of the tree above it."""
        for _ in range(50):
            if r := self.refs(head, b"Resources"):
                return self.objects.get(r[0], (b"", None))[0]
            if b"/Resources" in head:
                return head
            if not (r := self.refs(head, b"Parent")):
                break
            head = self.objects.get(r[0], (b"", None))[0]
        return b""

    def named(self, resources: bytes, kind: bytes) -> dict[bytes, int]:
        """Objects that the resources name: fonts or XObjects."""
        if r := re.search(rb"/%s\s+(\d+)\s+\d+\s+R" % kind, resources):
            inside = self.objects.get(int(r[1]), (b"", None))[0]
        else:
            r = re.search(rb"/%s\s*<<(.*?)>>" % kind, resources, re.S)
            inside = r[1] if r else b""
        return {name: int(n) for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", inside)}

    def fonts(self, resources: bytes) -> dict[bytes, "CodeMap"]:
        """Code maps of the fonts that have one."""
        out = {}
        for name, n in self.named(resources, b"Font").items():
            for m in self.refs(self.objects.get(n, (b"", None))[0], b"ToUnicode"):
                if m in self.objects:
                    out[name] = CodeMap(self.stream_of(*self.objects[m]))
        return out

    def text(self, page: bytes) -> str:
        parts = [self.stream_of(*self.objects[n]) for n in self.refs(page, b"Contents") if n in self.objects]
        return self._drawn(b"\n".join(parts), self.resources(page), ())

    def _drawn(self, content: bytes, resources: bytes, within: tuple[int, ...]) -> str:
        def form(name: bytes) -> str:
            n = self.named(resources, b"XObject").get(name)
            head, body = self.objects.get(n, (b"", None))
            if body is None or n in within or len(within) > 20 or not re.search(rb"/Subtype\s*/Form\b", head):
                return ""
            return self._drawn(self.stream_of(head, body), self.resources(head) or resources, (*within, n))

        return show_text(content, self.fonts(resources), form)

    def images(self, page: bytes) -> list[tuple[int, int, str, bytes]]:
        """width, height, format and data of grey and RGB images, CMYK ones left out."""
        out = []
        for n in self.named(self.resources(page), b"XObject").values():
            head, body = self.objects.get(n, (b"", None))
            if body is None or not re.search(rb"/Subtype\s*/Image", head) or b"/DeviceCMYK" in head:
                continue
            width, height = (int(re.search(rb"/%s\s+(\d+)" % k, head)[1]) for k in (b"Width", b"Height"))
            if b"/DCTDecode" in head:
                out.append((width, height, "jpeg", body))
            else:
                out.append((width, height, "png", png(width, height, 1 if b"/DeviceGray" in head else 3, self.stream_of(head, body))))
        return out


def png(width: int, height: int, channels: int, pixels: bytes) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    row = width * channels
    lines = b"".join(b"\0" + pixels[i * row : (i + 1) * row] for i in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


STRING = rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>"
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class CodeMap:
    """What the codes of a font stand for, by its ToUnicode map."""

    def __init__(self, cmap: bytes):
        span = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", cmap)
        self.width = len(span[1]) // 2 if span else 2
        self.texts: dict[int, str] = {}
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
            for code, text in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]*)>", part):
                self.texts[int(code, 16)] = self._utf16(text)
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
            for low, high, start, each in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f\s]+)>|\[(.*?)\])", part, re.S):
                codes = range(int(low, 16), min(int(high, 16), int(low, 16) + 0xFFFF) + 1)
                if start:
                    first = self._utf16(start)
                    self.texts |= {c: first[:-1] + chr(ord(first[-1]) + i) for i, c in enumerate(codes)} if first else {}
                else:
                    self.texts |= {c: self._utf16(t) for c, t in zip(codes, re.findall(rb"<([0-9A-Fa-f\s]*)>", each))}

    @staticmethod
    def _utf16(digits: bytes) -> str:
        return bytes.fromhex(re.sub(rb"\s", b"", digits).decode()).decode("utf-16-be", "replace")

    def read(self, codes: bytes) -> str:
        w = self.width
        return "".join(self.texts.get(int.from_bytes(codes[i : i + w], "big"), "") for i in range(0, len(codes), w))


def _codes(token: bytes) -> bytes:
    """The bytes of a string in parentheses or of hexadecimal digits."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        c = m[1]
        if re.match(rb"[0-7]", c):
            return bytes([int(c, 8) & 255])
        return b"" if c in (b"\n", b"\r\n") else ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S)


DRAWING = re.compile(rb"(%s)\s*(Tj|'|\")|\[((?:%s|[^\]()<>])*)\]\s*TJ|(T\*|\bTd\b|\bTD\b|\bTm\b|\bET\b)|/([^\s/<>\[\]()]+)\s+(?:(Do)\b|-?[\d.]+\s+Tf\b)" % (STRING, STRING), re.S)


def show_text(content: bytes, fonts: dict[bytes, CodeMap] | None = None, form=None) -> str:
    """Text in drawing order; a move to another line is a newline. form: the text of a form object by its name."""
    out, font = [], None
    read = lambda token: font.read(_codes(token)) if font is not None else _codes(token).decode("latin-1")
    for m in DRAWING.finditer(content):
        if m[5]:
            if not m[6]:
                font = (fonts or {}).get(m[5])
            elif form is not None:
                out.append(form(m[5]))
        elif m[4]:
            out.append("\n")
        elif m[1]:
            out.append(("" if m[2] == b"Tj" else "\n") + read(m[1]))
        else:
            for piece in re.findall(rb"(%s)|(-?\d+\.?\d*)" % STRING, m[3]):
                out.append(read(piece[0]) if piece[0] else " " if float(piece[1]) < -200 else "")
    return "".join(out)


def tables_of(rows: Iterator[tuple], columns: list[str], most: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Rows as tables of some `most` bytes of text and data, so what a task holds doesn't grow with its batch."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if size >= most:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _files_in(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Pdf]]:
    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            yield path, Pdf(content)


def _page_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = ((path, i, pdf.text(page)) for path, pdf in _files_in(batches) for i, page in enumerate(pdf.pages(), 1))
    return tables_of(rows, ["path", "page_number", "text"])


def _image_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = ((path, i, k, *image) for path, pdf in _files_in(batches) for i, page in enumerate(pdf.pages(), 1) for k, image in enumerate(pdf.images(page)) if len(image[3]) >= LEAST_IMAGE)
    return tables_of(rows, ["path", "page_number", "image_index", "width", "height", "format", "data"])


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """path and content of PDF files below a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select("path", "content")


def pdf_pages(files: DataFrame) -> DataFrame:
    """path, page_number (from 1), text of pages that aren't blank."""
    small_batches(files.sparkSession)
    return files.mapInPandas(_page_rows, PAGES).filter(strip(F.col("text")) != "")


def pdf_images(files: DataFrame) -> DataFrame:
    small_batches(files.sparkSession)
    return files.mapInPandas(_image_rows, IMAGES)


def pdf_chunks(files: DataFrame) -> DataFrame:
    """Word windows of every page: path, page_number, content, word_count, char_count."""
    rows = pdf_pages(files).select("path", "page_number", F.explode(fixed_windows(F.col("text"))).alias("content"))
    return rows.withColumn("word_count", word_count(F.col("content"))).withColumn("char_count", F.length("content"))


def write_pdf(pages: list[str], images: list[tuple[int, int, bytes]] = ()) -> bytes:
    """A plain PDF of text pages, with RGB images on the first one; for tests and round trips."""
    body: list[bytes] = []
    kids = " ".join(f"{3 + 2 * i} 0 R" for i in range(len(pages)))
    first_image = 3 + 2 * len(pages)
    objects = ["<< /Type /Catalog /Pages 2 0 R >>".encode(), f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode()]
    for i, page in enumerate(pages):
        named = " ".join(f"/I{k} {first_image + k} 0 R" for k in range(len(images))) if i == 0 else ""
        objects.append(f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R /Resources << /XObject << {named} >> >> >>".encode())
        lines = []
        for line in page.split("\n"):
            safe = re.sub(rb"([\\()])", rb"\\\1", line.encode("latin-1", "replace"))
            lines.append(b"(" + safe + b") Tj T*")
        data = zlib.compress(b"BT\n" + b"\n".join(lines) + b"\nET")
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream")
    for width, height, pixels in images:
        data = zlib.compress(pixels)
        objects.append(b"<< /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Length %d /Filter /FlateDecode >>\nstream\n" % (width, height, len(data)) + data + b"\nendstream")
    out = b"%PDF-1.4\n"
    for n, o in enumerate(objects):
        body.append(b"%d 0 obj\n" % (n + 1) + o + b"\nendobj\n")
    return out + b"".join(body) + b"trailer << /Root 1 0 R >>\n%%EOF"
