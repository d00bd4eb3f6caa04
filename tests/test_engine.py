"""The engine from files to masked files, parties in markers, edits of office files, repairs and fixpoints."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from spanlake import engine
from spanlake.__main__ import main
from spanlake.operators import filters, frontier, planning, quality, rules, texts
from spanlake.sources import documents, redact, sinks
from spanlake.streaming import events as ev
from tests.test_io import S, W, packed

R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def segments(spark, *docs):
    return spark.createDataFrame([(d, i, t) for d, lines in enumerate(docs, 1) for i, t in enumerate(lines)], "doc_id long, seg_order int, text string")


CONTRACT = (
    "ООО «Альфа», именуемое в дальнейшем «Поставщик», и АО \"Бета\", именуемое в дальнейшем «Заказчик»", "Поставщик: ИНН 3662103003, почта a@b.ru", "Заказчик: ИНН 7707083893, почта c@d.ru, телефон +7 (473) 250-10-10",
    "Цена договора 1 000 000 руб.", "поставка в течение 30 рабочих дней", "Закон № 44-ФЗ, код ABC-77, снова a@b.ru",
)


def test_mask_in_one_call(spark):
    r = engine.mask(segments(spark, CONTRACT, ("нет ничего",)), custom=(rules.CustomType("code", literals=("abc-77",)),), manual=spark.createDataFrame([(1, "person", "Закон"), (1, "nothing", "x")], "doc_id long, type string, value string"))
    got = {(x.doc_id, x.seg_order): x.masked for x in r.masked.collect()}
    assert got[1, 1] == "Поставщик: ИНН [ПОСТАВЩИК-ИНН-1], почта [ПОСТАВЩИК-ПОЧТА-1]"
    assert got[1, 2] == "Заказчик: ИНН [ЗАКАЗЧИК-ИНН-1], почта [ЗАКАЗЧИК-ПОЧТА-1], телефон [ЗАКАЗЧИК-ТЕЛЕФОН-1]"
    assert got[1, 3] == "Цена договора [СУММА-ДОГОВОРА]" and got[1, 4] == CONTRACT[4] and got[2, 0] == "нет ничего"
    assert got[1, 5] == "[ЗАКАЗЧИК-ФИО-1] № 44-ФЗ, код [ЗАКАЗЧИК-CODE-1], снова [ЗАКАЗЧИК-ПОЧТА-2]"  # the block goes on; another party's value
    assert r.leaks.count() == 0 and r.report.count() == 2 and {x.reason for x in r.skipped.collect()} == {"visible_contract_term"}
    assert sinks.records(r.spans).filter("type = 'inn'").select("title", "critical", "length").distinct().collect() == [("ИНН", True, 10)]
    with pytest.raises(ValueError, match="unknown types"):
        engine.mask(segments(spark, CONTRACT), types=("no_type",))


def test_markers_tell_subjects_apart(spark):
    rows = [(1, 0, 0, 6, "Иванов", "person"), (1, 1, 0, 19, "Иванов Иван Иваныч", "person"), (1, 2, 0, 11, "Иванов И.И.", "person"), (1, 3, 0, 7, "Сидоров", "person"), (1, 4, 0, 10, "3662103003", "inn"), (1, 5, 0, 10, "01.01.2024", "date"), (1, 6, 0, 10, "02.01.2024", "date")]
    s = spark.createDataFrame([(*r, 0.9) for r in rows], "doc_id long, seg_order int, start int, end int, text string, type string, confidence double")
    profiles = spark.createDataFrame([(1, f"E{i}", "P2" if i < 5 else "P1", "поставщик") for i in range(1, 6)], "doc_id long, ref string, profile_id string, label string")
    repl, groups, _ = planning.plan(s, None, profiles)
    got = {x.text: x.marker for x in repl.collect()}
    # one party's number is in all its markers; another person of the party gets the next free number
    assert got["Иванов Иван Иваныч"] == got["Иванов И.И."] and got["3662103003"] == "[ПОСТАВЩИК-ИНН-1]"
    assert got["Иванов"] == "[ПОСТАВЩИК-ФИО-2]" and len({got["Иванов"], got["Иванов И.И."], got["Сидоров"]}) == 3
    assert (got["01.01.2024"], got["02.01.2024"]) == ("[ДАТА-1]", "[ДАТА-2]")
    assert {x.canonical_label for x in groups.filter("type = 'inn'").collect()} == {"[Поставщик ИНН 1]"}
    two = spark.createDataFrame([(1, "E5", "P1", "поставщик"), (1, "E6", "P2", "заказчик"), (1, "E7", "P3", "заказчик")], profiles.schema)
    repl = planning.plan(s, ("inn", "date"), two)[0]
    assert {x.marker for x in repl.collect()} == {"[ПОСТАВЩИК-ИНН-1]", "[ДАТА-1]", "[ДАТА-2]"}  # dates are the document's


def docx(*paragraphs):
    run = lambda t: f'<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{t}</w:t></w:r>'
    return f"<w:document {W}><w:body>{''.join('<w:p>' + ''.join(map(run, p)) + '</w:p>' for p in paragraphs)}</w:body></w:document>"


CORE = '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Иванов</dc:creator><dc:title> </dc:title></cp:coreProperties>'


def book(sheets, names=""):
    parts = {"xl/workbook.xml": f'<workbook {S} {R}><sheets>{"".join(f"<sheet name={chr(34)}{n}{chr(34)} r:id={chr(34)}r{i}{chr(34)}/>" for i, n in enumerate(sheets))}</sheets><definedNames>{names}</definedNames></workbook>', "xl/_rels/workbook.xml.rels": f'<Relationships>{"".join(f"<Relationship Id={chr(34)}r{i}{chr(34)} Target={chr(34)}worksheets/sheet{i}.xml{chr(34)}/>" for i in range(len(sheets)))}</Relationships>'}
    for i, cells in enumerate(sheets.values()):
        own = "".join(f'<c r="{ref}">{v}</c>' if v.startswith("<") else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' for ref, v in cells.items())
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet {S}><sheetData><row r="1">{own}</row></sheetData></worksheet>'
    return parts


def test_files_are_masked(spark, tmp_path):
    packed(tmp_path / "a.docx", {"word/document.xml": docx(["Почта a@", "b.ru, ИНН 36621", "03003 тут"], ["чисто"]), "docProps/core.xml": CORE})
    packed(tmp_path / "B.XLSX", book({"Лист": {"A1": "ИНН 3662103003", "B1": "<f>A1</f><v>3662103003</v>"}}))
    (tmp_path / "c.txt").write_text("строка\n\nпочта x@y.ru\n")
    (tmp_path / "bad.docx").write_bytes(b"not a container")
    assert [r.error is not None for r in documents.read_office(spark, str(tmp_path), "docx", errors=True).orderBy("path", "seg_order").collect()] == [False, False, True]
    meta = {r.path.rpartition("/")[2]: r.meta for r in documents.document_metadata(spark, str(tmp_path), "[aB]*").collect()}
    assert meta == {"a.docx": {"creator": "Иванов"}, "B.XLSX": {}}
    result, files = engine.mask_files(spark, str(tmp_path))
    assert sorted(r.masked for r in result.masked.collect()) == sorted(["Почта [ПОЧТА], ИНН [ИНН] тут", "чисто", "ИНН [ИНН]", "3662103003".replace("3662103003", "[ИНН]"), "строка", "почта [ПОЧТА]"])
    out = {r.path.rpartition("/")[2]: r for r in files.collect()}
    assert out["bad.docx"].content is None and "BadZipFile" in out["bad.docx"].error
    assert [x[-1] for x in documents.docx_rows(out["a.docx"].content)] == ["Почта [ПОЧТА], ИНН [ИНН] тут", "чисто"]
    with zipfile.ZipFile(io.BytesIO(out["a.docx"].content)) as z:
        assert "Иванов" not in z.read("docProps/core.xml").decode() and b"<w:b" in z.read("word/document.xml")
    assert "3662103003" not in "".join(x[-1] for x in documents.xlsx_rows(out["B.XLSX"].content))
    assert main([str(tmp_path), "--out", str(tmp_path / "out"), "--types", "email", "--quiet"]) == 0
    assert spark.read.parquet(str(tmp_path / "out/segments")).filter("masked LIKE '%3662103003%'").count() > 0
    (tmp_path / "d.pdf").write_bytes(b"x")
    with pytest.raises(ValueError, match="no reader"):
        documents.read_documents(spark, str(tmp_path))


def test_formulas_that_depend_on_masked_cells():
    f = lambda x: f"<f>{x}</f><v>1</v>"
    sheets = {
        "Лист 1": {"A1": "секрет", "B1": f("A1&amp;1"), "C1": f("SUM(B1:B2)"), "D1": f("SUM($D$5:D9)"), "E1": f("ИТОГ*2"), "F1": f("IF(1,&quot;A1&quot;,2)"), "G1": f("AA1+A10"), "H1": f("СУММ(A:A)"), "I1": f("LOG10(5)")},
        "Two": {"A1": f("'Лист 1'!A1"), "B1": f("A1+1"), "C1": f("Two!D7"), "D1": '<f t="shared" si="0" ref="D1:D2">$A$1</f><v>2</v>', "D2": '<f t="shared" si="0"/><v>2</v>'},
    }
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for n, t in book(sheets, "<definedName name='ИТОГ'>'Лист 1'!$A$1:$A$3</definedName>").items():
            z.writestr(n, t)
    out = redact.redact_xlsx(data.getvalue(), {("Лист 1", 1, 1): "[X]"})
    got = {(sheet, row, col): text for _, sheet, row, col, *_, text in documents.xlsx_rows(out)}
    marked = {k for k, v in got.items() if v == redact.FORMULA_MARKER}
    assert got["Лист 1", 1, 1] == "[X]"
    assert marked == {("Лист 1", 1, c) for c in (2, 3, 5, 8)} | {("Two", 1, 1), ("Two", 1, 2), ("Two", 1, 4), ("Two", 2, 4)}
    assert redact.redact_xlsx(data.getvalue(), {}) == redact.redact_xlsx(data.getvalue(), {})
    with zipfile.ZipFile(data, "a") as z:
        z.writestr("xl/pivotTables/pivotTable1.xml", "<x/>")
    with pytest.raises(ValueError, match="pivot"):
        redact.redact_xlsx(data.getvalue(), {})


def test_dates_of_tables_and_runs_of_texts():
    styles = f'<styleSheet {S}><numFmts><numFmt numFmtId="170" formatCode="dd.mm.yyyy"/><numFmt numFmtId="171" formatCode="0.00&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
    parts = book({"s": {"A1": "x"}}) | {"xl/styles.xml": styles}
    parts["xl/worksheets/sheet0.xml"] = f'<worksheet {S}><sheetData><row r="1"><c r="A1" s="1"><v>45327</v></c><c r="B1" s="2"><v>45327.5</v></c><c r="C1" s="3"><v>45327.0</v></c><c r="D1" s="1"><v>1</v></c></row></sheetData></worksheet>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    assert [x[-1] for x in documents.xlsx_rows(data.getvalue())] == ["05.02.2024", "05.02.2024", "45327", "01.01.1900"]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", docx(["аб", "", "в"], ["г"]))
    assert list(documents.docx_runs(data.getvalue())) == [(0, 0, 0, 2, "аб"), (0, 1, 2, 2, ""), (0, 2, 2, 3, "в"), (1, 0, 0, 1, "г")]


def test_layout_repairs_keep_the_map():
    cases = {
        "Р а с ч е т н ы й с ч е т " + "4" * 40: "Расчетныйсчет " + "4" * 20 + " " + "4" * 20,
        "т е л е ф о н ы 8 - 9 1 0 - 3 4 7 - 5 1 - 0 789103475108": "телефоны 8-910-347-51-07,89103475108",
        "т е л е ф о н ы 8 - 9 f - 2": "телефоны 8-91-2", "ИНН / КПП 0554010010545011628": "ИНН / КПП 055401001 0545011628", "0554010010545011628": "0554010010545011628",
        "БИК 042007681044525225": "БИК 042007681 БИК 044525225", "БИК 042007681944525225": "БИК 042007681944525225", "E - m a i l a b ®, m a i l . r u c d ® m a i l . r u": "E-mail ab@mail.ru cd@mail.ru",
        "М а г о м е д о в А б д у р а х м а н": "Магомедов Абдурахман", "обычный текст 1 2": "обычный текст 1 2", "(ИНН3662103003)": "(ИНН 3662103003)", "кoд": "код",
    }
    for raw, want in cases.items():
        fixed, at = texts.repair_layout(raw)
        assert fixed == want and len(at) == len(fixed) + 1 and at[-1] == len(raw) and all(a <= b for a, b in zip(at, at[1:])), (raw, fixed)
    rng = random.Random(2)
    for _ in range(300):
        raw = "".join(rng.choices("ИНКП бик®.- 04f7телфон­ \nAB@", k=rng.randrange(60)))
        fixed, at = texts.repair_layout(raw)
        assert len(at) == len(fixed) + 1 and at[-1] == len(raw)


def test_unsafe_patterns():
    for bad in ("(a|aa)+$", "(a+)+", "a*", r"(a)\1", "((ab|b)c)*d", "(?m)a", "(", "a" * 201, "(?:a+)?b"):
        with pytest.raises(ValueError):
            rules.CustomType("own", bad)
    for good in (r"\+1 \(\d{3}\) \d{3}-\d{4}", "(?i)abc", "(a|b)c+"):
        rules.CustomType("own", good)
    for bad in ({"pattern": "a", "literals": ("b",)}, {}, {"literals": (" ",)}):
        with pytest.raises(ValueError):
            rules.CustomType("own", **bad)


def test_fixpoint_has_no_depth(spark):
    deep = 150
    edges = spark.createDataFrame([(i, i + 1) for i in range(deep)] + [(deep, 0), (900, 901), (5, 5), (3, 70)], "src long, dst long")
    got = {r.node for r in frontier.grow(spark.createDataFrame([(0,), (0,), (None,)], "node long"), edges, steps=16).collect()}
    assert got == set(range(deep + 1))


def test_windows_close(spark, tmp_path):
    """Windows behind the watermark are written once the stream has gone past them, equal to the batch's."""
    t = lambda day, h: f"2024-01-{day:02d} {h:02d}:00:00"
    rows = [(i, t(1 + i // 4, i % 24), i % 3, "ab"[i % 2], float(i)) for i in range(40)]
    schema = "event_id long, ts string, user_id long, event_type string, value double"
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for k in range(4):
        batch.filter((F.col("event_id") >= k * 10) & (F.col("event_id") < k * 10 + 10)).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    source = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for name, op in (("t", ev.tumbling), ("w", ev.sliding), ("s", ev.sessions)):
        ev.run_to_table(op(ev.timed(source(), "1 hour")), str(tmp_path / name), str(tmp_path / f"{name}c"))
        whole = {tuple(r) for r in op(ev.timed(batch)).collect()}
        closed = [tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect()]
        last = max(r[1] if name != "s" else r[2] for r in whole)
        end = (lambda r: r[1]) if name != "s" else (lambda r: r[2])
        must = {r for r in whole if (last - end(r)).days >= 3}
        assert must and must <= set(closed) <= whole and len(closed) == len(set(closed))


def test_measures_and_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("абв", "абв"), ("аб вг", "аб вд"), ("", "x"), ("x", ""), (None, None)], "hypothesis string, reference string")
    assert [(r.cer, r.wer) for r in texts.with_error_rates(pairs).collect()] == [(0.0, 0.0), (0.2, 0.5), (1.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    leaked = quality.masked_values(spark.createDataFrame([(1, '{"a":["ИНН 12","12"]}'), (2, "12")], "doc_id long, text string"), spark.createDataFrame([(1, "12", "[A]"), (1, "ИНН 12", "[B]"), (1, "", "[C]")], "doc_id long, value string, marker string"))
    assert sorted(map(tuple, leaked.collect())) == [(1, '{"a":["[B]","[A]"]}', False), (2, "12", False)]
    for n in (3, 2):
        sinks.publish(spark.range(n), str(tmp_path / "p"), "r", 1)
    assert sinks.published(spark, str(tmp_path / "p"), "r", 1).count() == 2
    calls = spark.createDataFrame([("a", 1, "role", "q", "x"), ("a", 2, "role", "q2", "y")], "run_id string, n int, node string, request string, response string")
    sinks.write_traces(calls, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t/jsonl")).count() == 2 and "## 2. role" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "t/md")).collect())
    m = sinks.metrics_companion(spark.createDataFrame([("a", "x", 5.0), ("a", "x", 2.0)], "run_id string, stage string, ms double")).first()
    assert m.metrics == '{"total_ms":7.0,"stages":[{"stage":"x","ms":7.0,"n":2}]}'
    with pytest.raises(ValueError, match="known are"):
        filters.of_types(calls.withColumn("type", F.lit("a")), ("b",), ("a",))
