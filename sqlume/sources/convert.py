"""Documents as text: .docx, .xlsx, .pptx, .pdf and .eml for read, grep and search; .docx and .xlsx made from text."""

from __future__ import annotations

import csv
import io
import posixpath
import quopri
import re
import shutil
import subprocess
import zipfile
from pathlib import Path
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from sqlume.errors import SqlError

READ = ("docx", "xlsx", "pptx", "pdf", "eml")
WRITTEN = ("docx", "xlsx")


def kind_of(path: Path) -> str:
    return path.suffix.lower().lstrip(".")


def text_of(path: Path) -> str:
    """The text of a document of a known kind."""
    kind = kind_of(path)
    if kind == "eml":
        return email_text(path.read_bytes())
    if kind == "pdf":
        return _pdf(path)
    try:
        with zipfile.ZipFile(path) as z:
            return {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx}[kind](z)
    except (zipfile.BadZipFile, ET.ParseError, KeyError) as e:
        raise SqlError(f"{path.name}: not an Office file: {e}") from e


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _tree(z: zipfile.ZipFile, part: str) -> ET.Element | None:
    return ET.fromstring(z.read(part)) if part in z.namelist() else None


def _runs(e: ET.Element) -> str:
    """Texts, tabs and breaks below an element."""
    return "".join({"t": x.text or "", "tab": "\t", "br": "\n", "cr": "\n"}.get(_name(x), "") for x in e.iter())


def word_text(body: ET.Element) -> str:
    """A line for each paragraph, and for each table row its cells between bars."""
    lines: list[str] = []

    def walk(e: ET.Element) -> None:
        for x in e:
            if _name(x) == "p":
                lines.append(_runs(x).rstrip())
            elif _name(x) == "tr":
                lines.append(" | ".join(" ".join(_runs(p) for p in c.iter() if _name(p) == "p").strip() for c in x if _name(c) == "tc"))
            else:
                walk(x)

    walk(body)
    return "".join(f"{line}\n" for line in lines)


def _docx(z: zipfile.ZipFile) -> str:
    body, notes = _tree(z, "word/document.xml"), _tree(z, "word/comments.xml")
    if body is None:
        raise KeyError("no word/document.xml")
    margin = word_text(notes) if notes is not None else ""
    return word_text(body) + (f"\n## Comments\n{margin}" if margin.strip() else "")


def _pptx(z: zipfile.ZipFile) -> str:
    found = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    slides = []
    for k, name in found:
        lines = [t for p in _tree(z, name).iter() if _name(p) == "p" and (t := _runs(p).rstrip())]
        slides.append("".join(f"{x}\n" for x in [f"## Slide {k}", *lines]) + "\n")
    return "".join(slides)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Za-z]*", ref)[0].upper():
        n = 26 * n + ord(c) - 64
    return n - 1


def _sheet(sheet: ET.Element, shared: list[str]) -> str:
    out = io.StringIO()
    rows = csv.writer(out, lineterminator="\n")
    for row in (x for x in sheet.iter() if _name(x) == "row"):
        cells: list[str] = []
        for c in (x for x in row if _name(x) == "c"):
            at = _column(c.get("r", "")) if c.get("r") else len(cells)
            cells += [""] * (at + 1 - len(cells))
            value = next((x.text or "" for x in c if _name(x) == "v"), "")
            kind = c.get("t")
            cells[at] = shared[int(value)] if kind == "s" else _runs(c) if kind == "inlineStr" else {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else value
        rows.writerow(cells)
    return out.getvalue()


def _xlsx(z: zipfile.ZipFile) -> str:
    strings, book, links = _tree(z, "xl/sharedStrings.xml"), _tree(z, "xl/workbook.xml"), _tree(z, "xl/_rels/workbook.xml.rels")
    shared = [_runs(s) for s in strings if _name(s) == "si"] if strings is not None else []
    target = {r.get("Id"): posixpath.normpath(posixpath.join("/xl", r.get("Target", "")))[1:] for r in links} if links is not None else {}
    named = [(s.get("name"), target.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), None))) for s in book.iter() if _name(s) == "sheet"] if book is not None else []
    named = [x for x in named if x[1] in z.namelist()] or [(n, n) for n in sorted(z.namelist()) if n.startswith("xl/worksheets/")]
    return "".join(f"## Sheet: {name}\n{_sheet(_tree(z, part), shared)}\n" for name, part in named)


def _pdf(path: Path) -> str:
    for command in (["pdftotext", "-layout", str(path), "-"], ["pandoc", str(path), "-t", "plain"]):
        if shutil.which(command[0]):
            done = subprocess.run(command, capture_output=True, timeout=120, check=False)
            if done.returncode:
                raise SqlError(f"{command[0]} failed on {path.name}: {done.stderr.decode('utf-8', 'replace').strip()}")
            return done.stdout.decode("utf-8", "replace")
    raise SqlError("no PDF converter is installed: pdftotext or pandoc")


def email_text(raw: bytes) -> str:
    """Headers and body; quoted-printable is decoded, also that of a message inside the message."""
    raw = raw.replace(b"\r\n", b"\n")
    for _ in range(2):
        if b"content-transfer-encoding: quoted-printable" not in raw.partition(b"\n\n")[0].lower():
            break
        raw = quopri.decodestring(raw)
    return raw.decode("utf-8", "replace")


# documents made from text

_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_DOC_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def _package(path: Path, main: str, kind: str, parts: dict[str, str]) -> None:
    base = f"application/vnd.openxmlformats-officedocument.{kind}"
    own = {"xl/worksheets/sheet1.xml": f"{base}.worksheet+xml"}
    types = "".join(f'<Override PartName="/{n}" ContentType="{own.get(n, base + ("" if kind.startswith("w") else ".sheet") + ".main+xml")}"/>' for n in parts if not n.endswith(".rels"))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_DOC_REL}/officeDocument" Target="{main}"/></Relationships>')
        for name, body in parts.items():
            z.writestr(name, _HEAD + body)


def write_docx(path: Path, text: str) -> None:
    """A paragraph for each line of Markdown that isn't blank; headings bold, marks of emphasis and rules of tables gone."""
    paras = []
    for line in text.split("\n"):
        if not line.strip() or re.fullmatch(r"\s*\|?[\s:|-]*-[\s:|-]*\|?\s*", line):
            continue
        head = re.match(r"#{1,6}\s+", line)
        body = escape(re.sub(r"(\*\*|__)(.+?)\1", r"\2", line[head.end() :] if head else line))
        paras.append(f'<w:p><w:r>{"<w:rPr><w:b/></w:rPr>" if head else ""}<w:t xml:space="preserve">{body}</w:t></w:r></w:p>')
    _package(path, "word/document.xml", "wordprocessingml.document", {"word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{"".join(paras)}</w:body></w:document>'})


def write_xlsx(path: Path, text: str) -> None:
    """One sheet from CSV; numbers are numbers, other fields text."""
    rows = []
    for i, fields in enumerate(csv.reader(io.StringIO(text)), 1):
        cells = "".join(f"<c><v>{f}</v></c>" if re.fullmatch(r"-?\d+(\.\d+)?", f) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(f)}</t></is></c>' for f in fields)
        rows.append(f'<row r="{i}">{cells}</row>')
    _package(path, "xl/workbook.xml", "spreadsheetml", {
        "xl/workbook.xml": f'<workbook xmlns="{_SHEET}" xmlns:r="{_DOC_REL}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_DOC_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_SHEET}"><sheetData>{"".join(rows)}</sheetData></worksheet>',
    })
