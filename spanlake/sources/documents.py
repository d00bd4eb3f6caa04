"""Readers: office files, text, label and OCR side files to segments and entities.

Files come through Spark's own `binaryFile` and `json` readers, so any store that Spark reads
works; containers are opened on the executors, one file per row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_DDL = "path string, seg_order int, kind string, sheet string, row int, col int, tbl int, cell int, para int, text string"
_SCHEMA = pa.schema([("path", pa.string()), ("seg_order", pa.int32()), ("kind", pa.string()), ("sheet", pa.string()), *((k, pa.int32()) for k in ("row", "col", "tbl", "cell", "para")), ("text", pa.string())])
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def text_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, seg_order, text: the lines of a text table that are not blank, in order; null texts have none."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("seg_order", "text"))
    return lines.filter(F.col("text").rlike(r"(?U)\S"))


def _paragraph(p: ET.Element) -> str:
    out = []
    for e in p.iter():
        if e.tag == f"{W}t":
            out.append(e.text or "")
        elif e.tag == f"{W}tab":
            out.append("\t")
        elif e.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def _runs(p: ET.Element) -> Iterator[tuple[int, str]]:
    """(offset, text) of a paragraph's runs, those of hyperlinks too, offsets by the lengths so far."""
    at = 0
    for r in p.iter(f"{W}r"):
        text = _paragraph(r)
        yield at, text
        at += len(text)


def docx_runs(data: bytes) -> Iterator[tuple]:
    """(para, run, start, end, text) of the body paragraphs' runs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
    for n, p in enumerate(body.findall(f"{W}p") if body is not None else ()):
        for k, (at, text) in enumerate(_runs(p)):
            yield n, k, at, at + len(text), text


def docx_rows(data: bytes) -> Iterator[tuple]:
    """(kind, sheet, row, col, tbl, cell, para, text) of body paragraphs and top-level table cells, in reading order; blank ones are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
    n_par = n_tbl = 0
    for e in body if body is not None else ():
        if e.tag == f"{W}p":
            if (text := _paragraph(e)).strip():
                yield "body", None, None, None, None, None, n_par, text
            n_par += 1
        elif e.tag == f"{W}tbl":
            for r, row in enumerate(e.findall(f"{W}tr")):
                for c, cell in enumerate(row.findall(f"{W}tc")):
                    for k, p in enumerate(cell.findall(f"{W}p")):
                        if (text := _paragraph(p)).strip():
                            yield "table", None, r, None, n_tbl, c, k, text
            n_tbl += 1


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n


#: Built-in number formats that show a date.
DATE_FORMATS = frozenset((*range(14, 23), *range(45, 48)))


def _date_styles(styles: bytes) -> set[int]:
    """Cell styles whose number format shows a date."""
    root = ET.fromstring(styles)
    own = {int(f.get("numFmtId")) for f in root.iter(f"{S}numFmt") if re.search("[dmy]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\\\.', "", f.get("formatCode", "")), re.IGNORECASE)}
    cells = root.find(f"{S}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def _date_text(serial: float) -> str:
    """A serial number of days as dd.mm.yyyy; of the year 1900 the day that was none is left out."""
    import datetime

    return (datetime.date(1899, 12, 30) + datetime.timedelta(days=int(serial) + (serial < 60))).strftime("%d.%m.%Y")


def xlsx_rows(data: bytes) -> Iterator[tuple]:
    """The same tuple for every cell that is not blank: cached values of formulas, whole numbers without a fraction, booleans as words."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si")]
        dated = _date_styles(z.read("xl/styles.xml")) if "xl/styles.xml" in names else set()
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"):
            target = rels[sheet.get(f"{REL}id")].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            for c in ET.fromstring(z.read(part)).iter(f"{S}c"):
                kind, v, ref = c.get("t", "n"), c.find(f"{S}v"), c.get("r", "")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{S}t"))
                elif v is None or v.text is None:
                    continue
                elif kind == "s":
                    text = strings[int(v.text)]
                elif kind == "b":
                    text = "ИСТИНА" if v.text == "1" else "ЛОЖЬ"
                elif kind == "n" and int(c.get("s", 0)) in dated:
                    text = _date_text(float(v.text))
                elif kind == "n" and re.fullmatch(r"-?\d+\.0+", v.text):
                    text = v.text.partition(".")[0]
                else:
                    text = v.text
                if text.strip():
                    yield "cell", sheet.get("name"), int(re.search(r"\d+", ref)[0]), _column(ref), None, None, None, text


READERS = {"docx": docx_rows, "xlsx": xlsx_rows}


def read_office(spark: SparkSession, path: str, kind: str, *, errors: bool = False) -> DataFrame:
    """Segments of all files of a kind ('docx' or 'xlsx') below a path, with their anchors. An unknown kind is an error. A damaged
    file gives no segment; with errors, one row whose `error` says why."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}; there are {sorted(READERS)}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{kind},{kind.upper()}}}").option("recursiveFileLookup", "true").load(path).select("path", "content")
    reader = READERS[kind]
    schema = _SCHEMA.append(pa.field("error", pa.string()))

    def run(batches):
        for b in batches:
            rows = []
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(p, i, *row, None) for i, row in enumerate(list(reader(data)))]
                except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, IndexError) as e:
                    rows.append((p, None, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    out = files.mapInArrow(run, f"{SEGMENT_DDL}, error string")
    return out if errors else out.filter("error IS NULL").drop("error")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Segments of all office and text files below a path by their suffix, in any case; a file of another kind is an error that
    names it. Columns as read_office."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    other = names.filter(~suffix.isin(*READERS, "txt", "json")).limit(1).collect()
    if other:
        raise ValueError(f"no reader for {other[0]['path']!r}; there are {sorted((*READERS, 'txt'))}")
    texts = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.{txt,TXT}").option("recursiveFileLookup", "true").load(path).select(F.input_file_name().alias("path"), "value")
    lines = texts.select("path", F.posexplode(F.split("value", "\r?\n", -1)).alias("seg_order", "text")).filter(F.col("text").rlike(r"(?U)\S"))
    none = {"sheet": "string", "row": "int", "col": "int", "tbl": "int", "cell": "int"}
    plain = lines.select("path", "seg_order", F.lit("body").alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()), F.col("seg_order").alias("para"), "text")
    out = plain
    for kind in READERS:
        out = out.unionByName(read_office(spark, path, kind))
    return out


def document_metadata(spark: SparkSession, path: str, glob: str = "*.{docx,xlsx}") -> DataFrame:
    """path, meta: the core properties of office files that are not empty, as a map of names to values."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    schema = pa.schema([("path", pa.string()), ("meta", pa.map_(pa.string(), pa.string()))])

    def run(batches):
        for b in batches:
            rows = []
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    core = ET.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else ()
                rows.append((p, [(e.tag.rpartition("}")[2], e.text.strip()) for e in core if (e.text or "").strip()]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return files.mapInArrow(run, "path string, meta map<string,string>")


def container_parts(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """path, part, n_bytes, text: every part of the containers, XML parts with their text without tags."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches):
        for b in batches:
            rows = []
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in z.namelist():
                        raw = z.read(name)
                        text = "".join(ET.fromstring(raw).itertext()) if name.endswith((".xml", ".rels")) else None
                        rows.append((p, name, len(raw), text))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], names=["path", "part", "n_bytes", "text"])

    return files.mapInArrow(run, "path string, part string, n_bytes long, text string")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Gold entities of `*.labels.json` files: doc (the file's stem), type, text, party; types of the file's own too."""
    schema = "entities array<struct<type string, text string, party string>>"
    files = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.labels.json").json(path)
    doc = F.regexp_extract(F.input_file_name(), r"([^/]+)\.labels\.json$", 1)
    return files.select(doc.alias("doc"), F.explode("entities").alias("e")).select("doc", "e.*")


def read_ocr(spark: SparkSession, path: str, glob: str = "*.fake_ocr.json") -> DataFrame:
    """Recognised lines of OCR side files: doc, page, line, text, bbox, confidence."""
    pages = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", glob).load(path)
    parsed = pages.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^/]*$", 1).alias("doc"), F.from_json("value", "array<struct<width_px:int,height_px:int,lines:array<struct<text:string,bbox:array<double>,polygon:array<array<double>>,confidence:double>>>>").alias("pages"))
    out = parsed.select("doc", F.posexplode("pages").alias("page", "p")).select("doc", "page", F.posexplode("p.lines").alias("line", "l"))
    return out.select("doc", "page", "line", "l.text", "l.bbox", "l.confidence")
