"""Readers, writers and streams."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from spanlake.sources import documents, sinks
from spanlake.streaming import events as ev

DATA = "/root/testdata/sf0.001"
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def packed(path, parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    path.write_bytes(data.getvalue())


def test_office_files(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    packed(tmp_path / "a.docx", {"word/document.xml": f"<w:document {W}><w:body>{p('Привет')}{p(' ')}<w:tbl><w:tr><w:tc>{p('ИНН')}</w:tc><w:tc>{p('3662103003')}</w:tc></w:tr></w:tbl>{p('Конец')}</w:body></w:document>"})
    got = documents.read_office(spark, str(tmp_path), "docx").orderBy("seg_order").collect()
    assert [(r.seg_order, r.kind, r.cell, r.text) for r in got] == [(0, "body", None, "Привет"), (1, "table", 0, "ИНН"), (2, "table", 1, "3662103003"), (3, "body", None, "Конец")]
    packed(tmp_path / "b.xlsx", {
        "xl/workbook.xml": f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Лист" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>БИК</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>42.0</v></c><c r="C1" t="b"><v>1</v></c><c r="AA1" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
    })
    got = documents.read_office(spark, str(tmp_path), "xlsx").orderBy("seg_order").collect()
    assert [(r.sheet, r.row, r.col, r.text) for r in got] == [("Лист", 1, 1, "БИК"), ("Лист", 1, 2, "42"), ("Лист", 1, 3, "ИСТИНА"), ("Лист", 1, 27, "x")]
    parts = documents.container_parts(spark, str(tmp_path)).collect()
    assert [(r.part, r.text) for r in parts] == [("word/document.xml", "Привет ИНН3662103003Конец")]


def test_side_files_and_text(spark, tmp_path):
    (tmp_path / "c1.labels.json").write_text(json.dumps({"entities": [{"type": "inn", "text": "1", "party": "p"}, {"type": "date", "text": "2"}]}))
    assert sorted(map(tuple, documents.read_labels(spark, str(tmp_path)).collect())) == [("c1", "date", "2", None), ("c1", "inn", "1", "p")]
    (tmp_path / "s.fake_ocr.json").write_text(json.dumps([{"width_px": 1, "height_px": 2, "lines": [{"text": "т", "bbox": [0, 0, 1, 1], "confidence": 0.5}]}]))
    assert [(r.doc, r.page, r.line, r.text, r.confidence) for r in documents.read_ocr(spark, str(tmp_path)).collect()] == [("s", 0, 0, "т", 0.5)]
    df = spark.createDataFrame([(1, "a\n\n b \n"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, documents.text_segments(df).collect())) == [(1, 0, "a"), (1, 2, " b ")]


def test_publish_replaces_a_revision(spark, tmp_path):
    for n in (3, 2):
        at = sinks.publish(spark.range(n), str(tmp_path), "r", 1)
    assert spark.read.parquet(at).count() == 2


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    source = lambda: ev.stream(spark, str(tmp_path / "in"), events)
    for name, op in (("t", ev.tumbling), ("w", ev.sliding), ("s", ev.sessions)):
        # rows arrive in any order, so nothing may count as late here
        ev.run_to_table(op(ev.timed(source(), "60 days")), str(tmp_path / name), str(tmp_path / f"{name}c"))
        closed = {tuple(r) for r in spark.read.schema(op(ev.timed(events)).schema).parquet(str(tmp_path / name)).collect()}
        assert closed <= {tuple(r) for r in op(ev.timed(events)).collect()}
    ev.run_to_table(ev.numbered(source()), str(tmp_path / "n"), str(tmp_path / "nc"))
    got = spark.read.parquet(str(tmp_path / "n"))
    per = got.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("m"), F.countDistinct("seq").alias("d")).collect()
    assert got.count() == events.count() and all(r.n == r.m == r.d for r in per)
    ev.mask_incrementally(source(), lambda b: b.select("event_id"), str(tmp_path / "m"), str(tmp_path / "mc"))
    assert spark.read.parquet(str(tmp_path / "m")).select("event_id").distinct().count() == events.count()
