"""File contents to text: TXT, XLSX, DOCX, PPTX and, with a library, PDF."""

from __future__ import annotations

import io
import math
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterable
from decimal import Decimal
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ..errors import ExtractError

#: Encodings tried after byte order marks and UTF-8.
LEGACY = "cp949"


def text_of_txt(content: bytes) -> str:
    """By byte order mark, as UTF-8 if it is, else in the legacy encoding with replacements."""
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(encoding, "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode(LEGACY, "replace")


def _events(xml: bytes, start: Callable, end: Callable, text: Callable) -> None:
    """Feeds local names and text to the handlers; malformed XML ends the reading, quietly."""
    parser = expat.ParserCreate()
    parser.StartElementHandler = lambda name, attributes: start(name.rpartition(":")[2], attributes)
    parser.EndElementHandler = lambda name: end(name.rpartition(":")[2])
    parser.CharacterDataHandler = text
    try:
        parser.Parse(xml, True)
    except expat.ExpatError:
        pass


def paragraphs(xml: bytes) -> str:
    """Text of ``t`` elements, a line for each ``p`` that has any; what was read before an error counts."""
    out, line, depth = [], [], 0

    def start(name, _):
        nonlocal depth
        depth += name == "t"

    def flush():
        if line:
            out.append("".join(line) + "\n")
            line.clear()

    def end(name):
        nonlocal depth
        depth -= name == "t"
        if name == "p":
            flush()

    _events(xml, start, end, lambda data: line.append(data) if depth else None)
    flush()
    return "".join(out)


def _archive(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError) as problem:
        raise ExtractError("parse", str(problem)) from problem


def _entry(archive: zipfile.ZipFile, name: str) -> bytes:
    try:
        return archive.read(name)
    except (KeyError, zipfile.BadZipFile, OSError, RuntimeError) as problem:
        raise ExtractError("parse", f"{name}: {problem}") from problem


def text_of_docx(content: bytes) -> str:
    return paragraphs(_entry(_archive(content), "word/document.xml"))


def text_of_pptx(content: bytes) -> str:
    """Slides by their numbers."""
    archive = _archive(content)
    slides = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    return "".join(paragraphs(_entry(archive, n)) for _, n in slides)


def _shared_strings(xml: bytes) -> list[str]:
    """Each entry's text, without the readings (``rPh``) that stand beside it."""
    out: list[str] = []
    inside = reading = 0

    def start(name, _):
        nonlocal inside, reading
        if name == "si":
            out.append("")
        inside += name == "t"
        reading += name == "rPh"

    def end(name):
        nonlocal inside, reading
        inside -= name == "t"
        reading -= name == "rPh"

    def text(data):
        if inside and not reading and out:
            out[-1] += data

    _events(xml, start, end, text)
    return out


def _number(value: str) -> str:
    """A number without exponent and superfluous zeros; what is none as it stands."""
    try:
        found = float(value)
    except ValueError:
        return value
    if not math.isfinite(found):
        return value
    shown = format(Decimal(repr(found)), "f")
    return shown.rstrip("0").rstrip(".") if "." in shown else shown


def _sheets(archive: zipfile.ZipFile) -> list[str]:
    """Names of the worksheets' parts, in the workbook's order; by number where it doesn't say."""
    names = set(archive.namelist())
    targets: dict[str, str] = {}
    order: list[str] = []

    def relation(name, attributes):
        if name == "Relationship" and attributes.get("Type", "").endswith("/worksheet"):
            target = attributes.get("Target", "")
            targets[attributes.get("Id", "")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")

    def sheet(name, attributes):
        if name == "sheet":
            order.extend(v for k, v in attributes.items() if k.rpartition(":")[2] == "id" and ":" in k)

    nothing = lambda *_: None
    for part, handler in (("xl/_rels/workbook.xml.rels", relation), ("xl/workbook.xml", sheet)):
        if part in names:
            _events(_entry(archive, part), handler, nothing, nothing)
    found = [targets[i] for i in order if targets.get(i) in names]
    numbered = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
    return found or [n for _, n in numbered]


def _sheet(xml: bytes, shared: list[str]) -> str:
    rows: list[str] = []
    cells: list[str] = []
    kind, value, inside = "", "", False

    def start(name, attributes):
        nonlocal kind, value, inside
        if name == "row":
            cells.clear()
        elif name == "c":
            kind, value = attributes.get("t", "n"), ""
        inside = name in ("v", "t")

    def text(data):
        nonlocal value
        if inside:
            value += data

    def end(name):
        nonlocal inside
        if name in ("v", "t"):
            inside = False
        elif name == "c":
            shown = value
            if kind == "s" and value.strip().isdigit():
                shown = shared[int(value)] if int(value) < len(shared) else ""
            elif kind == "b":
                shown = {"1": "true", "0": "false"}.get(value.strip(), value)
            elif kind == "n":
                shown = _number(value)
            if shown:
                cells.append(shown)
        elif name == "row" and cells:
            rows.append(" ".join(cells) + "\n")
            cells.clear()

    _events(xml, start, end, text)
    return "".join(rows)


def text_of_xlsx(content: bytes) -> str:
    """A line for each row with cells, sheet by sheet; names of sheets aren't part of it."""
    archive = _archive(content)
    sheets = _sheets(archive)
    if not sheets:
        raise ExtractError("parse", "no worksheets")
    shared = _shared_strings(_entry(archive, "xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in archive.namelist() else []
    return "".join(_sheet(_entry(archive, n), shared) for n in sheets)


def text_of_pdf(content: bytes) -> str:
    try:
        import pypdf
    except ImportError as problem:
        raise ExtractError("parse", "no PDF library") from problem
    try:
        return "".join((page.extract_text() or "") + "\n" for page in pypdf.PdfReader(io.BytesIO(content)).pages)
    except Exception as problem:
        raise ExtractError("parse", str(problem)) from problem


Extractor = Callable[[bytes], str]
#: Extractors by extension; callers may give others.
EXTRACTORS: dict[str, Extractor] = {"txt": text_of_txt, "xlsx": text_of_xlsx, "docx": text_of_docx, "pptx": text_of_pptx, "pdf": text_of_pdf}


def extract(extension: str, content: bytes | None, extractors: dict[str, Extractor] = EXTRACTORS) -> tuple[str | None, str | None]:
    """``(body, None)`` or ``(None, error)``."""
    reader = extractors.get(extension.lower())
    if reader is None:
        return None, "unsupported"
    if content is None:
        return None, "io: no content"
    try:
        return reader(content), None
    except ExtractError as problem:
        return None, f"{problem.kind}: {problem}"
    except Exception as problem:
        return None, f"parse: {problem}"


def with_bodies(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """``body`` and ``error`` in place of ``content``, for files with ``extension``; problems are data."""
    chosen = extractors or EXTRACTORS
    schema = StructType([*(f for f in files.schema.fields if f.name != "content"), StructField("body", StringType()), StructField("error", StringType())])
    at, ext = files.columns.index("content"), files.columns.index("extension")

    def work(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            found = [extract(e or "", c, chosen) for e, c in zip(batch.column(ext).to_pylist(), batch.column(at).to_pylist(), strict=True)]
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([b for b, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=schema.names)

    return files.mapInArrow(work, schema)
