"""Office files with values replaced: text documents across runs, tables with the formulas that depend on masked cells."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import REL, S, W, _column

#: What a formula that would show a masked value is replaced by.
FORMULA_MARKER = "[ФОРМУЛА]"
#: A reference to a cell, a range, or whole columns or rows, of another sheet where one is named; and a defined name.
_SHEET = r"(?:'((?:[^']|'')+)'|([^\W\d][\w.]*))!"
_REF = re.compile(rf"(?:{_SHEET})?(?:\$?([A-Z]{{1,3}})\$?(\d+)(?::\$?([A-Z]{{1,3}})\$?(\d+))?|\$?([A-Z]{{1,3}}):\$?([A-Z]{{1,3}})|\$?(\d+):\$?(\d+))(?![\w(!])")
_NAME = re.compile(r"[^\W\d][\w.]*(?![\w.]*\s*[(!])")
#: (sheet, first row, first column, last row, last column)
Box = tuple[str, int, int, int, int]


def _parse(data: bytes) -> ET.Element:
    """The tree of a part; its prefixes stay as they are when it is written."""
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(data), ["start-ns"]):
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    return ET.fromstring(data)


def _repacked(data: bytes, change: Callable[[str, bytes], bytes]) -> bytes:
    """The container with each part changed; core properties are emptied."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for name in z.namelist():
            part = z.read(name)
            if name in ("docProps/core.xml", "docProps/custom.xml"):
                root = _parse(part)
                for e in list(root):
                    root.remove(e)
                part = ET.tostring(root)
            else:
                part = change(name, part)
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))  # equal inputs give equal bytes
            info.compress_type = zipfile.ZIP_DEFLATED
            to.writestr(info, part)
    return out.getvalue()


def _replace_in_paragraph(p: ET.Element, spans: list[tuple[int, int, str]]) -> None:
    """Spans (start, end, marker) of a paragraph's text: the marker goes into the first run, what else the span covers goes."""
    parents = {c: e for e in p.iter() for c in e}
    places, at = [], 0
    for e in p.iter():
        n = len(e.text or "") if e.tag == f"{W}t" else 1 if e.tag in (f"{W}tab", f"{W}br", f"{W}cr") and parents.get(e) is not None and parents[e].tag == f"{W}r" else 0
        if n:
            places.append((e, at, at + n))
            at += n
    for start, end, marker in sorted(spans, reverse=True):
        held = [(e, a, b) for e, a, b in places if a < end and start < b]
        first = next((e for e, _, _ in held if e.tag == f"{W}t"), None)
        for e, a, _ in held:
            if e.tag != f"{W}t":
                if e in parents[e]:
                    parents[e].remove(e)
                continue
            text = e.text or ""
            e.text = text[: max(0, start - a)] + (marker if e is first else "") + text[max(0, end - a) :]
            e.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def redact_docx(data: bytes, spans: list[dict]) -> bytes:
    """spans: kind ('body' or 'table'), tbl, row, cell, para, start, end, marker, as the reader's anchors name paragraphs."""
    by_place: dict[tuple, list] = {}
    for s in spans:
        by_place.setdefault((s["tbl"], s["row"], s["cell"], s["para"]), []).append((s["start"], s["end"], s["marker"]))

    def change(name: str, part: bytes) -> bytes:
        if name != "word/document.xml":
            return part
        root = _parse(part)
        body, n_par, n_tbl = root.find(f"{W}body"), 0, 0
        for e in list(body):
            if e.tag == f"{W}p":
                if own := by_place.get((None, None, None, n_par)):
                    _replace_in_paragraph(e, own)
                n_par += 1
            elif e.tag == f"{W}tbl":
                for r, row in enumerate(e.findall(f"{W}tr")):
                    for c, cell in enumerate(row.findall(f"{W}tc")):
                        for k, p in enumerate(cell.findall(f"{W}p")):
                            if own := by_place.get((n_tbl, r, c, k)):
                                _replace_in_paragraph(p, own)
                n_tbl += 1
        return ET.tostring(root, encoding="UTF-8", xml_declaration=True)

    return _repacked(data, change)


def references(formula: str, sheet: str, names: dict[str, str], seen: frozenset[str] = frozenset()) -> list[Box]:
    """The boxes of cells that a formula of a sheet reads, by itself or through defined names."""
    out: list[Box] = []
    text = re.sub(r'"[^"]*"', " ", formula)
    for m in _REF.finditer(text):
        own = (m[1] or "").replace("''", "'") or m[2] or sheet
        if m[3]:
            a, b = (int(m[4]), _column(m[3])), (int(m[6] or m[4]), _column(m[5] or m[3]))
        elif m[7]:
            a, b = (1, _column(m[7])), (1 << 20, _column(m[8]))
        else:
            a, b = (int(m[9]), 1), (int(m[10]), 1 << 14)
        out.append((own, min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])))
    for m in _NAME.finditer(_REF.sub(" ", text)):
        name = m[0].lower()
        if name in names and name not in seen:
            out += references(names[name], sheet, names, seen | {name})
    return out


def dependent_formulas(formulas: dict[tuple[str, int, int], str], masked: set[tuple[str, int, int]], names: dict[str, str]) -> set[tuple[str, int, int]]:
    """Formula cells that read a masked cell, or one that does, to any depth."""
    reads = {at: references(f, at[0], names) for at, f in formulas.items() if at not in masked}
    by_sheet: dict[str, list[tuple[Box, tuple]]] = {}
    for at, boxes in reads.items():
        for box in boxes:
            by_sheet.setdefault(box[0], []).append((box, at))
    hit: set[tuple[str, int, int]] = set()
    todo = list(masked)
    while todo:
        sheet, row, col = todo.pop()
        for (_, r1, c1, r2, c2), at in by_sheet.get(sheet, ()):
            if at not in hit and r1 <= row <= r2 and c1 <= col <= c2:
                hit.add(at)
                todo.append(at)
    return hit


def _set_text(c: ET.Element, text: str) -> None:
    for e in list(c):
        c.remove(e)
    c.set("t", "inlineStr")
    t = ET.SubElement(ET.SubElement(c, f"{S}is"), f"{S}t")
    t.text = text
    t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def redact_xlsx(data: bytes, cells: dict[tuple[str, int, int], str]) -> bytes:
    """cells: the new text of each masked (sheet, row, column). Formulas that depend on one show FORMULA_MARKER. A workbook with
    pivot tables is refused, as their caches hold the values."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if any(n.startswith(("xl/pivotTables/", "xl/pivotCache/")) for n in names):
            raise ValueError("a workbook with pivot tables can't be masked: their caches hold the values")
        book = ET.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {}
        for s in book.iter(f"{S}sheet"):
            target = targets[s.get(f"{REL}id")]
            sheets[target if target.startswith("xl/") else f"xl/{target}"] = s.get("name")
        defined = {d.get("name", "").lower(): d.text or "" for d in book.iter(f"{S}definedName")}
        roots = {part: _parse(z.read(part)) for part in sheets}
        strings = _parse(z.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else None
    formulas, shared = {}, {}
    at = {}
    for part, root in roots.items():
        for c in root.iter(f"{S}c"):
            ref = c.get("r", "")
            place = (sheets[part], int(re.search(r"\d+", ref)[0]), _column(ref))
            at[place] = c
            f = c.find(f"{S}f")
            if f is not None:
                if f.get("t") == "shared":
                    shared.setdefault((part, f.get("si")), []).append(place)
                formulas[place] = f.text or ""
    hit = dependent_formulas(formulas, set(cells), defined)
    # cells of a shared formula go together, as only one of them holds its text
    for places in shared.values():
        if any(p in hit or p in cells for p in places):
            more = {p for p in places if p not in cells}
            hit |= more | dependent_formulas(formulas, more, defined)
    used: dict[int, int] = {}
    for place, c in at.items():
        if place in cells:
            _set_text(c, cells[place])
        elif place in hit:
            _set_text(c, FORMULA_MARKER)
        elif c.get("t") == "s":
            used[int(c.find(f"{S}v").text)] = 1
    if strings is not None:
        # texts that no cell shows any more
        for i, si in enumerate(strings.findall(f"{S}si")):
            if i not in used:
                for e in list(si):
                    si.remove(e)
                ET.SubElement(si, f"{S}t").text = ""

    def change(name: str, part: bytes) -> bytes:
        if name in roots:
            return ET.tostring(roots[name], encoding="UTF-8", xml_declaration=True)
        if name == "xl/sharedStrings.xml":
            return ET.tostring(strings, encoding="UTF-8", xml_declaration=True)
        return part

    return _repacked(data, change)


def redacted_files(spark: SparkSession, path: str, kind: str, replacements: DataFrame) -> DataFrame:
    """path, content, error: the files of a kind below a path with their replacements (path, the reader's anchors, text of the
    segment, start, end, marker). A file's replacements are gathered on its row; a file without any comes back repacked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{kind},{kind.upper()}}}").option("recursiveFileLookup", "true").load(path).select("path", "content")
    own = F.struct("sheet", "row", "col", "tbl", "cell", "para", "text", "start", "end", "marker")
    per = replacements.groupBy("path").agg(F.collect_list(own).alias("spans"))
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def one(data: bytes, spans: list[dict]) -> bytes:
        if kind == "docx":
            return redact_docx(data, spans)
        cells: dict[tuple, list[dict]] = {}
        for s in spans:
            cells.setdefault((s["sheet"], s["row"], s["col"]), []).append(s)
        new = {}
        for place, own in cells.items():
            text = own[0]["text"]
            for s in sorted(own, key=lambda s: -s["start"]):
                text = text[: s["start"]] + s["marker"] + text[s["end"] :]
            new[place] = text
        return redact_xlsx(data, new)

    def run(batches):
        for b in batches:
            rows = []
            for p, data, spans in zip(*(b.column(c).to_pylist() for c in ("path", "content", "spans"))):
                try:
                    rows.append((p, one(data, spans or []), None))
                except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError) as e:
                    rows.append((p, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return files.join(per, "path", "left").mapInArrow(run, "path string, content binary, error string")
