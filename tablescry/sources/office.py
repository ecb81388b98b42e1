"""Office files by the standard library: workbooks in and out, slides, documents and chart data."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

from .binary import zip_declared
from .files import Summary, parser

BUDGET = 1 << 30
#: Number formats that show dates.
DATE_FORMATS = {*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)}


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def opened(data: bytes) -> zipfile.ZipFile:
    if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("password-required or legacy binary format")
    if zip_declared(data)[0] not in (float("inf"),) and zip_declared(data)[0] > BUDGET:
        raise ValueError("decompressed size exceeds the budget")
    return zipfile.ZipFile(io.BytesIO(data))


def relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relationship ids of a part to the names of their targets."""
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    out = {}
    for r in ET.fromstring(z.read(path)):
        target = r.get("Target", "")
        parts = target.lstrip("/").split("/") if target.startswith("/") else [*folder.split("/"), *target.split("/")]
        clean: list[str] = []
        for p in parts:
            clean = clean[:-1] if p == ".." else [*clean, p] if p not in (".", "") else clean
        out[r.get("Id")] = "/".join(clean)
    return out


def cell_place(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref)
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def column_name(c: int) -> str:
    out = ""
    c += 1
    while c:
        c, r = divmod(c - 1, 26)
        out = chr(65 + r) + out
    return out


def iso(serial: float, from_1904: bool) -> str:
    """The date of a serial number: the date alone at midnight."""
    import datetime

    base = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30)
    t = base + datetime.timedelta(milliseconds=round(serial * 86_400_000))
    return t.strftime("%Y-%m-%d") if t.time() == datetime.time() else t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"


def workbook(data: bytes) -> tuple[list[dict], bool]:
    """Sheets as {name, cells: [(r, c, type, value, shown)], merges: [(r0, c0, r1, c1)], hidden}, cells row by row; and whether dates count from 1904."""
    with opened(data) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        rels = relations(z, "xl/workbook.xml")
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ET.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")) for f in styles.iter() if local(f.tag) == "numFmt"}
            xfs = next((x for x in styles if local(x.tag) == "cellXfs"), [])
            dates = [(n := int(x.get("numFmtId", 0))) in DATE_FORMATS or bool(re.search("[ymdhs]", own.get(n, ""), re.I)) for x in xfs]
        from_1904 = any(local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
        out = []
        for sheet in (e for e in book.iter() if local(e.tag) == "sheet"):
            rid = next(v for k, v in sheet.attrib.items() if local(k) == "id")
            root = ET.fromstring(z.read(rels[rid]))
            cells = []
            for e in (x for x in root.iter() if local(x.tag) == "c"):
                value = next((x.text for x in e if local(x.tag) == "v"), None)
                kind = e.get("t", "n")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in e.iter() if local(t.tag) == "t")
                if value is None:
                    continue
                r, c = cell_place(e.get("r"))
                style = int(e.get("s", 0))
                if kind == "s":
                    row = (r, c, "text", shared[int(value)], shared[int(value)])
                elif kind == "b":
                    row = (r, c, "boolean", value, "TRUE" if value == "1" else "FALSE")
                elif kind == "e":
                    row = (r, c, "error", value, value)
                elif kind in ("str", "inlineStr"):
                    row = (r, c, "text", value, value)
                elif style < len(dates) and dates[style]:
                    row = (r, c, "date", iso(float(value), from_1904), iso(float(value), from_1904))
                else:
                    row = (r, c, "number", value, value)
                cells.append(row)
            merges = []
            for e in (x for x in root.iter() if local(x.tag) == "mergeCell"):
                a, _, b = e.get("ref").partition(":")
                merges.append((*cell_place(a), *cell_place(b or a)))
            out.append({"name": sheet.get("name"), "cells": sorted(cells), "merges": merges, "hidden": sheet.get("state") in ("hidden", "veryHidden")})
        return out, from_1904


@parser("xlsx", "xlsm")
def xlsx(data: bytes) -> Summary:
    sheets, from_1904 = workbook(data)
    s = Summary("EXCEL", "Workbook", [("Sheets", len(sheets)), ("1904 dates", from_1904)])
    s.add("Cells", ["sheet", "r", "c", "t", "v", "w"], [[x["name"], *c] for x in sheets for c in x["cells"]])
    return s.add("Merges", ["sheet", "r0", "c0", "r1", "c1"], [[x["name"], *m] for x in sheets for m in x["merges"]])


def write_workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of rows that keeps numbers, booleans and text apart; for tables that fit a file."""
    from xml.sax.saxutils import escape

    out = io.BytesIO()
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(r: int, c: int, v) -> str:
        ref = f"{column_name(c)}{r + 1}"
        if v is None or v == "":
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = range(1, len(sheets) + 1)
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {main} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(n, sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        for i, rows in zip(n, sheets.values()):
            body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet {main}><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def chart_points(xml: bytes) -> list[list]:
    """[category, series, value, idx] of a chart part."""
    root, out = ET.fromstring(xml), []

    def points(e) -> dict[int, str]:
        return {int(p.get("idx", 0)): next((v.text or "" for v in p if local(v.tag) == "v"), "") for p in (e.iter() if e is not None else ()) if local(p.tag) == "pt"}

    for n, ser in enumerate(x for x in root.iter() if local(x.tag) == "ser"):
        part = lambda *names: next((c for c in ser if local(c.tag) in names), None)  # noqa: E731, B023
        name = next(iter(points(part("tx")).values()), f"Series {n + 1}")
        cats, vals = points(part("cat", "xVal")), points(part("val", "yVal"))
        out += [[cats.get(i, str(i + 1)), name, float(vals[i]) if re.fullmatch(r"-?[\d.]+([eE][+-]?\d+)?", vals[i]) else 0.0, i] for i in sorted(vals)]
    return out


@parser("pptx")
def pptx(data: bytes) -> Summary:
    """Paragraphs, tables and chart points by slide."""
    s = Summary("PPTX", "Slides")
    texts, cells, points = [], [], []
    with opened(data) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        for i, name in enumerate(slides, 1):
            root = ET.fromstring(z.read(name))
            in_tables = {p for t in root.iter() if local(t.tag) == "tbl" for p in t.iter()}
            for p in (e for e in root.iter() if local(e.tag) == "p" and e not in in_tables):
                if text := "".join(t.text or "" for t in p.iter() if local(t.tag) == "t"):
                    texts.append([i, len(texts), text])
            for n, t in enumerate(e for e in root.iter() if local(e.tag) == "tbl"):
                for r, tr in enumerate(e for e in t if local(e.tag) == "tr"):
                    cells += [[i, n, r, c, "".join(x.text or "" for x in tc.iter() if local(x.tag) == "t")] for c, tc in enumerate(e for e in tr if local(e.tag) == "tc")]
            for target in relations(z, name).values():
                if "/charts/chart" in target and target in z.namelist():
                    points += [[i, *p] for p in chart_points(z.read(target))]
    s.facts = [("Slides", len(slides))]
    s.add("Paragraphs", ["slide", "n", "text"], texts).add("Table cells", ["slide", "table", "r", "c", "text"], cells)
    return s.add("Chart points", ["slide", "category", "series", "value", "idx"], points)


@parser("docx")
def docx(data: bytes) -> Summary:
    """Paragraphs with their style, and table cells."""
    s, texts, cells = Summary("DOCX", "Document"), [], []
    with opened(data) as z:
        root = ET.fromstring(z.read("word/document.xml"))
        in_tables = {p for t in root.iter() if local(t.tag) == "tbl" for p in t.iter()}
        join = lambda e: "".join(t.text or "" for t in e.iter() if local(t.tag) == "t")
        for p in (e for e in root.iter() if local(e.tag) == "p" and e not in in_tables):
            style = next((v for e in p.iter() if local(e.tag) == "pStyle" for k, v in e.attrib.items() if local(k) == "val"), "-")
            texts.append([len(texts), style, join(p)])
        for n, t in enumerate(e for e in root.iter() if local(e.tag) == "tbl"):
            for r, tr in enumerate(e for e in t if local(e.tag) == "tr"):
                cells += [[n, r, c, join(tc)] for c, tc in enumerate(e for e in tr if local(e.tag) == "tc")]
        points = [p for n in z.namelist() if re.match(r"word/charts/chart\d*\.xml", n) for p in chart_points(z.read(n))]
    s.add("Paragraphs", ["n", "style", "text"], texts).add("Table cells", ["table", "r", "c", "text"], cells)
    return s.add("Chart points", ["category", "series", "value", "idx"], points)


@parser("doc", "ppt")
def ole_text(data: bytes) -> Summary:
    """Runs of readable text of a legacy file: of UTF-16 and code page 1252 the one that reads better; no layout."""
    s = Summary("OLE", "Legacy document")
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        s.warnings.append("No OLE signature.")
    wide = [m.decode("utf-16-le", "replace") for m in re.findall(rb"(?:[\x09\x0d\x20-\x7e\xa0-\xff]\x00|[\x00-\xff][\x01-\x06\x30\x4e-\x9f\xac-\xd7]){12,}", data)]
    narrow = [m.decode("cp1252", "replace") for m in re.findall(rb"[\x09\x0d\x20-\x7e\xa0-\xff]{24,}", data)]
    best = max((wide, narrow), key=lambda runs: sum(len(r) * sum(c.isalnum() or c.isspace() for c in r) / len(r) for r in runs) if runs else 0)
    return s.add("Text", ["n", "text"], [[i, r] for i, r in enumerate(x for run in best for x in re.split(r"\r", run) if x.strip())])
