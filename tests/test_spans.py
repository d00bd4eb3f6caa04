"""Spans, rules, folds and texts on small fixtures."""

import re

import pytest
from pyspark.sql import functions as F

from spanlake.functions import checksums as cs
from spanlake.functions import normalize as nz
from spanlake.functions.spans import free_parts, greedy, replace_spans, spans
from spanlake.operators import folds, planning, quality, rules, texts


def sql(spark, expr):
    return spark.sql(f"SELECT {expr} AS x").first().x


def found(spark, lines, detect=rules.detect_rules):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, seg_order int, text string")
    return sorted((r.seg_order, r.start, r.end, r.type, r.text, r.confidence) for r in detect(df).collect())


def kinds(spark, *lines, detect=rules.detect_rules):
    return [(r[3], r[4]) for r in found(spark, lines, detect)]


def test_offsets_are_code_points(spark):
    texts_ = ["", "нет", "😀a@b.ru, ещё x.y@z-1.com.", "a@b.ru\na@b.ru", "@@", "é😀é q@w.e"]
    df = spark.createDataFrame([(t,) for t in texts_], "text string").select("text", F.expr(spans("text", rules.EMAIL)).alias("x"))
    for r in df.collect():
        assert [(x.start, x.end, x.text) for x in r.x] == [(*m.span(), m[0]) for m in re.finditer(r"[\w.+-]+@[\w-]+\.[\w]+(?:\.[\w]+)*", r.text)]


@pytest.mark.parametrize("value,good", [("3662103003", True), ("7707083893", True), ("500100732259", True), ("3662103004", False), ("500100732258", False), ("12", False)])
def test_inn(spark, value, good):
    assert sql(spark, cs.inn(f"'{value}'")) is good


def test_other_checksums(spark):
    assert sql(spark, cs.ogrn("'1023601546902'")) and sql(spark, cs.ogrn("'1027700132195'")) and not sql(spark, cs.ogrn("'1023601546903'"))
    assert sql(spark, cs.snils("'11223344595'")) and not sql(spark, cs.snils("'11223344596'"))
    assert [sql(spark, cs.bik(f"'{b}'")) for b in ("042007681", "016577551", "024501901", "142007681", "996577551")] == [True] * 3 + [False] * 2
    account = "'40702810100000000002'"
    assert sql(spark, cs.account(account, "'042007681'")) and not sql(spark, cs.account(account, "'044525225'")) and sql(spark, cs.account("'30101810400000000225'", "'044525225'"))
    assert [sql(spark, cs.public_ipv4(f"'{i}'")) for i in ("8.8.8.8", "10.0.0.1", "172.31.1.1", "300.1.1.1", "192.168.0.1")] == [True] + [False] * 4
    assert [sql(spark, cs.calendar_date(*d)) for d in (("29", "2", "2000"), ("29", "2", "1900"), ("31", "4", "2001"), ("1", "1", "2101"))] == [True, False, False, False]


def test_accounts_and_bank_codes(spark):
    assert found(spark, ["БИК: 042007681", "Расчётный счёт: 40702810100000000002"]) == [(0, 5, 14, "bik", "042007681", 1.0), (1, 16, 36, "bank_account", "40702810100000000002", 1.0)]
    far = ["БИК: 042007681", "a", "b", "c", "Расчётный счёт: 40702810100000000002"]
    assert found(spark, far)[-1][-1] == 0.75 and found(spark, far[:1] + far[2:])[-1][-1] == 1.0
    assert kinds(spark, "р/с 40702810100000012345 в банке, БИК 044525225") == [("bank_account", "40702810100000012345"), ("bik", "044525225")]
    assert kinds(spark, "л/с 39062000144") == [("bank_account", "39062000144")] and kinds(spark, "код 39062000144") == []


def test_context_rules(spark):
    assert kinds(spark, "Накладная № 3662103004 на 101260292") == []
    assert kinds(spark, "КПП: 668601001") == [("kpp", "668601001")] and ("kpp", "668601001") in kinds(spark, "6663057404 668601001")
    assert [k for k, _ in kinds(spark, "7(814)259-09-61, +7 (473) 250-10-10, 8-910-347-51-07; Код поставки: 1234567890")] == ["phone"] * 3
    assert kinds(spark, "Протокол закупки №  32515504247-01") == [("contract_number", "32515504247-01")] and kinds(spark, "гимназия № 32515504247-01") == []
    assert kinds(spark, "Контактный телефон 9103475107") == [("phone", "9103475107")]
    assert kinds(spark, "сайт https://a.ru/x. и https://tcpdf.org") == [("site", "https://a.ru/x")]
    assert kinds(spark, "версия 8.8.8.8") == [] and kinds(spark, "IP 8.8.8.8") == [("ip_address", "8.8.8.8")]


def test_dates_money_terms(spark):
    got = found(spark, ["14.10.1986 г.р.", "дата рождения 1986-10-14", "«7» февраля 2024", "31.02.2020 и 1.1.1899", "Федеральный закон от 05.04.2013 № 44-ФЗ"], rules.detect_dates)
    assert [(g[0], g[3]) for g in got] == [(0, "birth_date"), (1, "birth_date"), (2, "date")]
    assert kinds(spark, "Цена договора 13 439 891 (Тринадцать) рублей 28 копеек", detect=rules.detect_money) == [("contract_amount", "13 439 891 (Тринадцать) рублей 28 копеек"), ("money", "13 439 891 (Тринадцать) рублей 28 копеек")]
    assert kinds(spark, "штраф 1000 рублей, если цена договора высока; да", detect=rules.detect_money) == []
    assert kinds(spark, "поставка в течение 30 рабочих дней с даты", detect=rules.detect_terms) == [("delivery_period", "в течение 30 рабочих дней")]
    assert ("payment_terms", "аванс 50%") in kinds(spark, "Условия оплаты: аванс 50%", detect=rules.detect_terms)


def test_custom_types(spark):
    us = rules.CustomType("us_phone", r"\+1 \(\d{3}\) \d{3}-\d{4}", ("call",))
    assert kinds(spark, "please call +1 (807) 555-6237", "+1 (807) 555-6237", detect=lambda s: rules.detect_custom(s, (us,))) == [("us_phone", "+1 (807) 555-6237")]
    for bad in (("Bad", "a"), ("ok_id", "(a+)+"), ("ok_id", "a*"), ("ok_id", r"(a)\1")):
        with pytest.raises(ValueError):
            rules.CustomType(*bad)


def test_span_algebra(spark):
    span = lambda s, e: f"named_struct('start', {s}, 'end', {e})"
    assert [tuple(x) for x in sql(spark, free_parts(span(0, 20), f"array({span(3, 5)}, {span(4, 9)}, {span(15, 30)})"))] == [(0, 3), (9, 15)]
    kept = greedy(f"array({span(0, 5)}, {span(4, 6)}, {span(5, 8)})", "array<struct<start:int,end:int>>")
    assert [tuple(x) for x in sql(spark, kept)] == [(0, 5), (5, 8)]
    marks = "array(named_struct('start', 1, 'end', 3, 'marker', '[A]'), named_struct('start', 2, 'end', 4, 'marker', '[B]'), named_struct('start', 5, 'end', 6, 'marker', '[C]'))"
    assert sql(spark, replace_spans("'0123456'", marks)) == "0[A][B]4[C]6"


def test_keys_and_markers(spark):
    key = lambda f, v: sql(spark, f(f"'{v}'"))
    assert key(nz.person, "Иванова Ивана Ивановича") == key(nz.person, "Иванов Иван Иванович")
    assert key(nz.person, "Атараев Б.М") == key(nz.person, "Б. М. Атараев") and key(nz.person, "Петров Б.М") != key(nz.person, "Атараев Б.М")
    assert key(nz.org, "ООО «Ёлка  плюс»") == "елка плюс" and key(nz.org, "ООО") == ""
    assert sql(spark, nz.group_key("'org_name'", "'ООО'")) == "org_name:~ооо"
    assert sql(spark, nz.marker("'ПОСТАВЩИК'", "'ИНН'", "1")) == "[ПОСТАВЩИК-ИНН-1]" and sql(spark, nz.marker("''", "'ДАТА'", "CAST(NULL AS INT)")) == "[ДАТА]"


def test_masking_leaves_nothing(spark):
    df = spark.createDataFrame([(1, 0, "ИНН 3662103003, a@b.ru и c@d.ru"), (1, 1, "снова A@B.ru, поставка в течение 30 рабочих дней"), (2, 0, "a@b.ru")], "doc_id long, seg_order int, text string")
    cols = ("doc_id", "seg_order", "start", "end", "text", "type", "confidence")
    spans_ = rules.detect_rules(df).select(*cols).unionByName(rules.detect_terms(df).select(*cols))
    repl, groups, skipped = planning.plan(spans_)
    masked = planning.masked(df, repl)
    assert {(r.doc_id, r.seg_order): r.masked for r in masked.collect()} == {(1, 0): "ИНН [ИНН], [ПОЧТА-1] и [ПОЧТА-2]", (1, 1): "снова [ПОЧТА-1], поставка в течение 30 рабочих дней", (2, 0): "[ПОЧТА]"}
    assert planning.leaks(masked, repl).count() == 0 and [r.reason for r in skipped.collect()] == ["visible_contract_term"]
    assert planning.leaks(df.withColumnRenamed("text", "masked"), repl).count() == 5
    only = planning.plan(spans_, ("inn",))
    assert only[0].count() == 1 and {r.reason for r in only[2].collect()} == {"type_not_requested"}
    assert planning.annotated(df, spans_.filter("type = 'inn'")).filter("doc_id = 1 AND seg_order = 0").first().annotated.startswith("ИНН ⟦INN:3662103003⟧")


def test_folds():
    one = lambda s, e, t, p=50, src="ner", d="n": {"start": s, "end": e, "text": "абвгдежзик"[s:e], "type": t, "priority": p, "confidence": 0.9, "source": src, "detector": d}
    got = folds.resolve_detectors([one(0, 6, "person"), one(2, 4, "inn", 100, "rule", "r"), one(3, 8, "money", 84, "rule", "r")])
    assert [(s["start"], s["end"], s["type"]) for s in got] == [(0, 2, "person"), (2, 4, "inn"), (4, 6, "person")]
    pair = folds.resolve_detectors([one(0, 5, "money", 84, "rule"), one(0, 5, "contract_amount", 85, "rule")])
    assert [s["type"] for s in pair] == ["contract_amount", "money"]
    assert [s["type"] for s in folds.resolve_detectors([one(0, 5, "date", 94, "rule"), one(1, 5, "ship_date", 90, "rule")])] == ["ship_date"]
    assert folds.chunk(150, [(10, 20)]) == [(0, 150, 1)] and folds.chunk(5000, [(100, 110), (130, 140), (4000, 4010)]) == [(0, 300, 2), (3855, 4155, 1)]
    assert folds.cluster(["a", None, "b", "a", None], [{"x"}, {"x", "y"}, {"y"}, set(), {"z"}]) == [0, 0, 2, 0, 4]
    assert folds.keep_best([(0, 0, 2, 2, 0.5), (0, 0, 2, 2, 0.9), (5, 5, 6, 6, 0.1)]) == [1, 2]


def test_layout_repair():
    raw = "36\u00a003, Дo\u00adгoвop ИНН3662103003  Н . Г . Ива"
    fixed, at = texts.repair_layout(raw)
    assert fixed == "3603, Договор ИНН 3662103003 Н.Г. Ива" and at[0] == 0 and len(at) == len(fixed) + 1 and at[-1] == len(raw)
    assert texts.repair_layout("два\u00a0слова")[0] == "два слова"


def test_row_order_does_not_matter(spark):
    df = spark.createDataFrame([(d, i, t) for d in range(4) for i, t in enumerate(["ИНН 3662103003 и a@b.ru", "b@b.ru a@b.ru", "№ 44-ФЗ"])], "doc_id long, seg_order int, text string")
    a, b = (planning.masked(x, planning.plan(rules.detect_rules(x))[0]) for x in (df, df.orderBy(F.desc("seg_order")).repartition(3)))
    assert sorted(a.collect()) == sorted(b.collect())


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin"), plan.count("SortMergeJoin")


def test_propagate_broadcasts_no_side(spark):
    segments = spark.sql("SELECT * FROM VALUES (1L, 0, 'г. Воронеж'), (1L, 1, 'и г. Воронеж') AS t(doc_id, seg_order, text)")
    small = spark.sql("SELECT * FROM VALUES (1L, 0, 0, 10, 'г. Воронеж', 'address') AS t(doc_id, seg_order, start, end, text, type)")
    got = texts.propagate(segments, small)
    assert joins(got) == (0, 2)
    assert [(r.seg_order, r.start, r.text) for r in got.collect()] == [(1, 2, "г. Воронеж")]


def test_sweep_broadcasts_no_side(spark):
    segments = spark.sql("SELECT * FROM VALUES (1L, 0, 'ДП-12345/2024'), (1L, 1, 'и ДП-12345/2024') AS t(doc_id, seg_order, text)")
    small = spark.sql("SELECT * FROM VALUES (1L, 0, 0, 13, 'ДП-12345/2024', 'contract_number', 0.9D) AS t(doc_id, seg_order, start, end, text, type, confidence)")
    got = texts.sweep(segments, small)
    assert joins(got) == (0, 2)
    assert [(r.seg_order, r.start, r.text) for r in got.collect()] == [(1, 2, "ДП-12345/2024")]


def test_similar_images_match_brute_force(spark):
    import random

    rng = random.Random(3)
    wide = [rng.getrandbits(64) - (1 << 63) for _ in range(150)]
    near = [h ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 4))) for h in wide[:100]]
    for hashes in (wide + near + [-1, 0, 0, -(1 << 63), None], [3 * i for i in range(200)], [7, 7, 7], [5], [None]):
        df = spark.createDataFrame(list(enumerate(hashes)), "image long, h long").repartition(3)
        for most in (0, 1, 3):
            want = [(a, b, n) for a, x in enumerate(hashes) for b, y in enumerate(hashes[:]) if a < b and None not in (x, y) and (n := ((x ^ y) & (1 << 64) - 1).bit_count()) <= most]
            assert sorted(map(tuple, quality.similar_images(df, most).collect())) == sorted(want)


def test_similar_hashes_fill_no_bucket():
    # hashes of few varying bits: keys and comparisons stay far below the pairs
    masks, reach = quality.bands((1 << 22) - 1, 900_000, 1)
    width = max(m.bit_count() for m in masks)
    assert sum(masks) == (1 << 22) - 1 and (reach + 1) * len(masks) > 1
    assert len(masks) * (1 + reach * width) * 900_000 / 2**width < 30


def test_a_labelled_address_is_no_insurance_number(spark):
    assert kinds(spark, "IP-адрес: 10.104.120.248 узла") == []
    assert kinds(spark, "СНИЛС 112.233.445.95", "IP 8.8.8.8, СНИЛС 112-233-445 95") == [("snils", "112.233.445.95"), ("ip_address", "8.8.8.8"), ("snils", "112-233-445 95")]


def test_leaks_tell_values_from_parts_of_numbers(spark):
    masked = spark.createDataFrame([(1, 0, "Накладная № 3662103004"), (1, 1, "КПП 366210300, 3662103004"), (1, 2, "x366210300y"), (1, 3, "a\\\\Eb  7")], "doc_id long, seg_order int, masked string")
    repl = spark.createDataFrame([(1, "366210300"), (1, "a\\\\Eb 7"), (1, "4")], "doc_id long, text string")
    got = sorted((r.seg_order, r.value, r.in_number) for r in planning.leaks(masked, repl).collect())
    assert got == [(0, "366210300", True), (0, "4", True), (1, "366210300", False), (1, "4", True), (2, "366210300", False), (3, "a\\\\Eb 7", False)]
