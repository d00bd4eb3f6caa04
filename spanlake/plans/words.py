"""Queries of validators, party detectors, sweep, layout repair, cards, folds and gates, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions import checksums as cs
from spanlake.operators import analytics, folds, planning, quality, rules, texts
from spanlake.operators.store import written

from . import contracts
from .analysis import SPANS, spans
from .detection import SPAN_COLS, contract_segments
from .registry import query, read

K = "s_suppkey"
#: Digit strings derived from supplier keys: a few of each kind pass their check.
NUMBERS = {
    "inn10": f"lpad(CAST({K} * 7919 + 3600000000 AS STRING), 10, '0')",
    "inn12": f"lpad(CAST({K} * 104729 + 360000000000 AS STRING), 12, '0')",
    "ogrn13": f"lpad(CAST({K} * 104729 + 1020000000000 AS STRING), 13, '0')",
    "ogrn15": f"lpad(CAST({K} * 1299709 + 304000000000000 AS STRING), 15, '0')",
    "snils": f"lpad(CAST({K} * 7919 + 11200000000 AS STRING), 11, '0')",
    "bik": f"'0' || CAST({K} % 10 AS STRING) || lpad(CAST({K} * 7919 % 10000000 AS STRING), 7, '0')",
    "account": f"'40702810' || lpad(CAST({K} * 31 AS STRING), 12, '0')",
    "kpp": f"lpad(CAST({K} % 10000 AS STRING), 4, '0') || CASE WHEN {K} % 3 = 0 THEN 'AZ' WHEN {K} % 3 = 1 THEN '01' ELSE 'DB' END || '001'",
    "ip": f"CAST({K} % 260 AS STRING) || '.' || CAST({K} * 7 % 256 AS STRING) || '.' || CAST({K} * 13 % 256 AS STRING) || '.1'",
}
CHECKS = {
    "inn10_ok": lambda: cs.inn("inn10"), "inn12_ok": lambda: cs.inn("inn12"), "ogrn13_ok": lambda: cs.ogrn("ogrn13"), "ogrn15_ok": lambda: cs.ogrn("ogrn15"),
    "snils_ok": lambda: cs.snils("snils"), "bik_ok": lambda: cs.bik("bik"), "account_ok": lambda: cs.account("account", "bik"), "kpp_ok": lambda: cs.kpp("kpp"), "ip_ok": lambda: cs.public_ipv4("ip"),
    "date_ok": lambda: cs.calendar_date(f"CAST({K} % 33 AS INT)", f"CAST({K} % 14 AS INT)", f"CAST(1895 + {K} % 210 AS INT)"),
    "length_ok": lambda: cs.complete("CASE WHEN s_suppkey % 2 = 0 THEN 'inn' ELSE 'bik' END", "inn10"),
}


def _plain_checks() -> str:
    """The checks with their sums written out."""
    short, cs.weighted = cs.weighted, cs.weighted_plain
    try:
        return ", ".join(f"{f()} AS {k}" for k, f in CHECKS.items())
    finally:
        cs.weighted = short


@query(f"SELECT {K}, {_plain_checks()} FROM (SELECT {K}, {', '.join(f'{v} AS {k}' for k, v in NUMBERS.items())} FROM supplier)")
def v1_v9_validators(spark, sf_dir):
    numbers = read(spark, sf_dir, "supplier").selectExpr(K, *(f"{v} AS {k}" for k, v in NUMBERS.items()))
    return numbers.selectExpr(K, *(f"{f()} AS {k}" for k, f in CHECKS.items()))


def party_segments(spark, sf_dir):
    return contracts.segments(read(spark, sf_dir, "customer").select("c_custkey"), contracts.PARTIES)


@query(contracts.expected_sql(("org_name",), contracts.PARTIES))
def d8_organisations(spark, sf_dir):
    return texts.detect_orgs(party_segments(spark, sf_dir)).select(*SPAN_COLS)


@query(contracts.expected_sql(("address",), contracts.PARTIES))
def d2_addresses(spark, sf_dir):
    return texts.detect_addresses(party_segments(spark, sf_dir)).select(*SPAN_COLS)


@query(f"SELECT doc_id, seg_order, \"start\", 'заказчик' AS role FROM ({contracts.expected_sql(('role',), contracts.PARTIES)}) UNION ALL SELECT doc_id, seg_order, \"end\" + 2, 'поставщик' FROM ({contracts.expected_sql(('org_name',), contracts.PARTIES)}) WHERE \"start\" = 0")
def g2_role_labels(spark, sf_dir):
    return texts.role_labels(party_segments(spark, sf_dir))


@query(f"SELECT * REPLACE ('contract_number' AS type) FROM ({contracts.expected_sql(('again',), contracts.PARTIES)})")
def d15_sweep(spark, sf_dir):
    segments = party_segments(spark, sf_dir)
    return texts.sweep(segments, written(rules.detect_rules(segments))).select(*SPAN_COLS)


@query("SELECT c_custkey AS doc_id, 'ДП-' || CAST(10000 + c_custkey AS VARCHAR) || '/2024' AS number, CAST(1000 + c_custkey AS VARCHAR) || ' 000 руб. 50 коп.' AS price, 'ambiguous' AS price_status, '№ ' || CAST(1 + c_custkey % 399 AS VARCHAR) || '-ФЗ' AS laws, 'в течение ' || CAST(5 + c_custkey % 40 AS VARCHAR) || ' рабочих дней' AS delivery, 'поставщик' AS roles FROM customer")
def g14_contract_card(spark, sf_dir):
    s = contract_segments(spark, sf_dir)
    cols = ("doc_id", "seg_order", "start", "end", "text", "type", "confidence")
    found = rules.detect_rules(s).select(*cols).unionByName(rules.detect_money(s).select(*cols)).unionByName(rules.detect_terms(s).select(*cols))
    return texts.contract_card(s, found)


@query("SELECT c_custkey AS doc_id, 'ИНН ' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') || ' Договор Н.Г. Иванов' AS norm FROM customer")
def p1_layout_repair(spark, sf_dir):
    raw = "concat('ИНН', substring(lpad(c_custkey, 10, '0'), 1, 4), '\\u00a0', substring(lpad(c_custkey, 10, '0'), 5), '  Дo\\u00adговор Н . Г . \\n Иванов')"
    s = read(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", "0 AS seg_order", f"{raw} AS text")
    return texts.repaired(s).select("doc_id", "norm")


_variant = "SELECT c_custkey, 'Клиент ' || CAST(c_custkey AS VARCHAR) AS value FROM customer"


@query(f"""WITH v AS ({_variant}) SELECT c_custkey, category, CASE category WHEN 'plain' THEN value WHEN 'spaced' THEN regexp_replace(value, '(.)', '\\1 ', 'g') WHEN 'nbsp' THEN replace(value, ' ', chr(160))
WHEN 'soft_hyphen' THEN substring(value, 1, 3) || chr(173) || substring(value, 4) WHEN 'line_break' THEN substring(value, 1, 4) || chr(10) || substring(value, 5) ELSE '(' || value || ')' END AS variant
FROM v, unnest(['plain', 'spaced', 'nbsp', 'soft_hyphen', 'line_break', 'parens']) AS t(category)""")
def g19_variants(spark, sf_dir):
    values = read(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('Клиент ', c_custkey) AS value")
    return texts.variants(values).select("c_custkey", "category", "variant")


@query("WITH m AS (SELECT avg(quality) AS q, avg(toxic) AS t FROM labels) SELECT 'quality' AS metric, q AS value, '>=' AS op, 0.5::DOUBLE AS threshold, q >= 0.5 AS ok FROM m UNION ALL SELECT 'toxic', t, '<=', 0.01, t <= 0.01 FROM m UNION ALL SELECT 'missing', NULL, '>=', 1.0, false")
def g18_gate(spark, sf_dir):
    m = read(spark, sf_dir, "labels").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
    metrics = m.unpivot([], ["quality", "toxic"], "metric", "value")
    return analytics.gate(metrics, {"quality": (">=", 0.5), "toxic": ("<=", 0.01), "missing": (">=", 1.0)})


def typed_spans(spark, sf_dir):
    s = spans(spark, sf_dir)
    priority = F.when(F.col("type") == "inn", 100).when(F.col("type") == "money", 84).otherwise(50)
    return s.select("doc_id", "seg_order", "start", "end", F.expr("repeat('x', end - start)").alias("text"), "type", F.lit(0.9).alias("confidence"), F.when(F.col("type") == "person", "ner").otherwise("rule").alias("source"), "detector", priority.alias("priority"))


@query()
def o2_cross_detector_resolution(spark, sf_dir):
    return folds.cross_resolve(typed_spans(spark, sf_dir))


@query(f"SELECT doc_id, seg_order, CAST(0 AS INT) AS \"start\", CAST(60 AS INT) AS \"end\", count(*) AS n_spans FROM (SELECT DISTINCT doc_id, seg_order, \"start\", \"end\" FROM ({SPANS})) GROUP BY 1, 2")
def o9_chunks(spark, sf_dir):
    s = spans(spark, sf_dir)
    segments = s.select("doc_id", "seg_order").distinct().withColumn("text", F.expr("repeat('y', 60)"))
    return folds.chunks(segments, s).select("doc_id", "seg_order", "start", "end", F.col("n_spans").cast("long").alias("n_spans"))


@query()
def g1_o6_o7_profiles(spark, sf_dir):
    s = spans(spark, sf_dir)
    label = F.when(F.col("supp") % 17 == 0, "поставщик").when(F.col("supp") % 19 == 0, "заказчик")
    own = s.select("doc_id", "seg_order", "start", "end", "type", F.col("supp").cast("string").alias("normalized"), label.alias("label"), F.lit("body").alias("kind"))
    return folds.profiles(planning.with_refs(own).drop("ref_n"))


@query(f"SELECT doc_id, type, n, CASE WHEN type = 'inn' THEN 'confirmed' WHEN type = 'person' AND n % 2 = 0 THEN 'possible' ELSE 'probable' END AS level FROM ({SPANS})")
def a3_levels(spark, sf_dir):
    s = spans(spark, sf_dir).withColumn("text", F.when(F.col("n") % 2 == 0, "Иванов").otherwise("заказчик")).withColumn("confidence", F.lit(0.9))
    return planning.with_level(s).select("doc_id", "type", "n", "level")


PAY_ROWS = (
    ("Условия оплаты",),
    ("1. ", contracts.Value("payment_terms", "('аванс ' || CAST(10 + c_custkey % 50 AS STRING) || '%')"), "; далее ", contracts.Value("payment_terms", "('оплата в течение ' || CAST(5 + c_custkey % 20 AS STRING) || ' банковских дней')"), "."),
    ("2. Счёт ", contracts.Value("payment_terms", "('не позднее ' || CAST(3 + c_custkey % 9 AS STRING) || ' рабочих дней')"), ", акт ", contracts.Value("payment_terms", "('в течение ' || CAST(2 + c_custkey % 9 AS STRING) || ' (двух) рабочих дней со дня подписания')"), " акта"),
    ("Предмет",), ("Стороны",), ("Прочее: постоплата не названа",),
)


@query(contracts.expected_sql(("payment_terms",), PAY_ROWS))
def d7_payment_terms(spark, sf_dir):
    s = contracts.segments(read(spark, sf_dir, "customer").select("c_custkey"), PAY_ROWS)
    return rules.detect_terms(s).filter("type = 'payment_terms'").select(*SPAN_COLS)


_lines = "SELECT doc_id, i AS seg_order, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"


def document_lines(spark, sf_dir):
    from spanlake.sources import documents

    return documents.text_segments(read(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, seg_order, CAST(len(regexp_extract_all(' ' || regexp_replace(line, '([^A-Za-z0-9])', ' \\1 ', 'g') || ' ', '(?i) (general +public +license|license) ')) AS BIGINT) AS n FROM ({_lines}) WHERE regexp_matches(line, '(?i)license') AND NOT regexp_matches(line, '[^ -~]') AND n > 0")
def d11_custom_literals(spark, sf_dir):
    """Literals as whole words in any case, the longest first, in lines of ASCII."""
    lines = document_lines(spark, sf_dir).filter("NOT text RLIKE '[^ -~]'")
    found = rules.detect_custom(lines, (rules.CustomType("licence", literals=("License", "general public license")),))
    return found.groupBy("doc_id", F.col("seg_order").cast("long").alias("seg_order")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, seg_order, CAST((length(line) - length(replace(line, 'the ', ''))) / 4 AS BIGINT) AS n, CAST(instr(line, 'the ') - 1 AS INT) AS first FROM ({_lines}) WHERE doc_id % 2 = 0 AND contains(line, 'the ')")
def d18_manual_spans(spark, sf_dir):
    """A value that an operator added to some documents, one of an unknown type, and one that is nowhere."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    manual = d.filter("doc_id % 2 = 0").selectExpr("doc_id", "inline(array(named_struct('type', 'person', 'value', 'the '), named_struct('type', 'no_type', 'value', 'of'), named_struct('type', 'person', 'value', '\\\\E nowhere')))")
    found = rules.manual_spans(document_lines(spark, sf_dir), manual, ("person", "org_name"))
    return found.groupBy("doc_id", F.col("seg_order").cast("long").alias("seg_order")).agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"))


@query(f"SELECT doc_id, n, CASE WHEN n % 5 = 0 THEN 'unknown_type' WHEN n % 5 = 1 THEN 'no_segment' WHEN n % 5 = 2 THEN 'bounds' ELSE 'text' END AS why FROM ({SPANS}) WHERE n % 5 <> 4")
def v13_broken_spans(spark, sf_dir):
    s = spans(spark, sf_dir).withColumn("text", F.when(F.col("n") % 5 == 3, "other").otherwise(F.expr("substring(repeat('0123456789', 9), start + 1, end - start)")))
    s = s.withColumn("type", F.when(F.col("n") % 5 == 0, "no_type").otherwise(F.col("type"))).withColumn("seg_order", F.when(F.col("n") % 5 == 1, 99).otherwise(F.col("seg_order"))).withColumn("end", F.when(F.col("n") % 5 == 2, 999).otherwise(F.col("end")))
    segments = spans(spark, sf_dir).select("doc_id", "seg_order").distinct().withColumn("text", F.expr("repeat('0123456789', 9)"))
    return rules.broken_spans(segments, s, ("inn", "person", "money")).select("doc_id", "n", "why")


ADDRESS_ROWS = (
    ("Адрес: ", contracts.Value("a", "'394000, г. Воронеж'"), contracts.Value("comma", "CASE WHEN c_custkey % 3 = 0 THEN '.' ELSE ',' END")),
    ("", contracts.Value("b", "('ул. Ленина, д. ' || CAST(1 + c_custkey % 90 AS STRING))")),
    ("Вновь г. Воронеж и 394000, г. Воронеж, 5 мая; 394000, г. Воронежец",),
)


def address_spans(spark, sf_dir):
    s = contracts.segments(read(spark, sf_dir, "customer").select("c_custkey"), ADDRESS_ROWS)
    found = contracts.with_values(read(spark, sf_dir, "customer").select("c_custkey")).selectExpr("c_custkey AS doc_id", "inline(array(named_struct('seg_order', 0, 'start', 7, 'end', 26, 'text', '394000, г. Воронеж'), named_struct('seg_order', 1, 'start', 0, 'end', CAST(length(concat('ул. Ленина, д. ', 1 + c_custkey % 90)) AS INT), 'text', concat('ул. Ленина, д. ', 1 + c_custkey % 90))))", "'address' AS type")
    found = found.withColumn("end", F.col("start") + F.length("text"))
    return s, found


@query("""WITH c AS (SELECT c_custkey AS doc_id, 'ул. ленина, д. ' || CAST(1 + c_custkey % 90 AS VARCHAR) AS tail FROM customer)
SELECT doc_id, 0 AS seg_order, '394000, г. воронеж' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' ' || tail END AS normalized FROM c UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '394000, г. воронеж ' END || tail FROM c""")
def d2a_linked_addresses(spark, sf_dir):
    return texts.link_split_addresses(*address_spans(spark, sf_dir)).select("doc_id", "seg_order", "normalized")


@query("SELECT c_custkey AS doc_id, 2 AS seg_order, unnest([19, 46]) AS \"start\", '394000, г. Воронеж' AS text FROM customer")
def d2b_propagated_addresses(spark, sf_dir):
    return texts.propagate(*address_spans(spark, sf_dir)).select("doc_id", "seg_order", "start", "text")


_sparse = "CASE c_custkey % 4 WHEN 0 THEN concat('Р а с ч е т н ы й с ч е т ', {a}, {a}) WHEN 1 THEN concat('БИК ', {b}, {b}) WHEN 2 THEN concat('т е л е ф о н ы 8 - 9 1 0 - 3 4 7 - ', {p}) ELSE concat('E - m a i l a', c_custkey, ' ®, m a i l . r u') END"


@query("""SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'Расчетныйсчет ' || lpad(CAST(c_custkey AS VARCHAR), 20, '4') || ' ' || lpad(CAST(c_custkey AS VARCHAR), 20, '4')
WHEN 1 THEN 'БИК ' || '04' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') || ' БИК ' || '04' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')
WHEN 2 THEN 'телефоны 8-910-347-' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') ELSE 'E-mail a' || CAST(c_custkey AS VARCHAR) || '@mail.ru' END AS norm FROM customer""")
def p1_sparse_repairs(spark, sf_dir):
    """Spaced-out segments: accounts, bank codes and phones written as one, and a broken address."""
    raw = _sparse.format(a="lpad(c_custkey, 20, '4')", b="concat('04', lpad(c_custkey, 7, '0'))", p="lpad(c_custkey, 4, '0')")
    s = read(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", "0 AS seg_order", f"{raw} AS text")
    return texts.repaired(s).select("doc_id", "norm")


LABEL_ROWS = (
    ("Доверенность от ", contracts.Value("d1", "'05.02.2024'")), ("срок лицензии до ", contracts.Value("d2", "'05.02.2024'")), ("Договор от ", contracts.Value("d3", "'05.02.2024'")), ("дано ", contracts.Value("d4", "'05.02.2024'")),
    ("ОКПО 1, ОКТМО ", contracts.Value("k1", "'12345678'")), ("ИНН ", contracts.Value("i1", "'3662103003'")),
)


@query(f"SELECT doc_id, seg_order, CASE type WHEN 'd1' THEN 'Дата доверенности' WHEN 'd2' THEN 'Срок действия лицензии' WHEN 'd3' THEN 'Дата договора' WHEN 'd4' THEN 'Дата' WHEN 'k1' THEN 'ОКТМО' ELSE 'ИНН' END AS label FROM ({contracts.expected_sql(None, LABEL_ROWS)})")
def p10_contextual_labels(spark, sf_dir):
    s = contracts.segments(read(spark, sf_dir, "customer").select("c_custkey"), LABEL_ROWS)
    s = s.withColumnRenamed("text", "whole").withColumn("start", F.length("whole") - F.length(F.regexp_extract("whole", r"([0-9.]{8,})$", 1))).withColumn("end", F.length("whole"))
    s = s.withColumn("type", F.expr("CASE WHEN seg_order < 4 THEN 'date' WHEN seg_order = 4 THEN 'registry_key' ELSE 'inn' END"))
    return s.select("doc_id", "seg_order", F.expr(texts.contextual_label()).alias("label"))


PRICE_ROWS = (
    ("Цена договора составляет ", contracts.Value("price", "(CAST(1000 + c_custkey AS STRING) || ' руб.')"), ", в том числе НДС ", contracts.Value("vat", "'20 руб.'"), ", аванс ", contracts.Value("advance", "'30 руб.'")),
    ("Прочее: ", contracts.Value("other", "CASE WHEN c_custkey % 2 = 0 THEN '7 руб.' ELSE '8 руб.' END")),
)


@query("SELECT c_custkey AS doc_id, CAST(1000 + c_custkey AS VARCHAR) || ' руб.' AS price, 'contract_price' AS purpose, 'found' AS status FROM customer")
def t3_j18_price(spark, sf_dir):
    """The contract's price among amounts of other purposes."""
    s = contracts.segments(read(spark, sf_dir, "customer").select("c_custkey"), PRICE_ROWS)
    return texts.best_price(texts.amount_purposes(rules.detect_money(s).filter("type = 'money'"), s))


@query(f"SELECT doc_id, seg_order, CAST(0 AS INT) AS \"start\", 3 AS \"end\", 'abc' AS text, least(0.6, 0.1 * min(n))::DOUBLE AS confidence FROM ({SPANS}) s WHERE NOT EXISTS (SELECT 1 FROM ({SPANS}) k WHERE k.doc_id = s.doc_id AND k.seg_order = s.seg_order AND k.type = 'inn' AND k.\"start\" < 3) GROUP BY 1, 2")
def g4_model_candidates(spark, sf_dir):
    """Candidates that all stand at the beginning of their segment: the first is taken where no known span is."""
    s = spans(spark, sf_dir)
    segments = s.select("doc_id", "seg_order").distinct().withColumn("text", F.lit("abc def"))
    claims = s.select("doc_id", "n", "seg_order", F.lit("person").alias("type"), F.lit("abc").alias("text"), (F.col("n") * 0.1).alias("confidence"))
    claims = claims.unionByName(claims.withColumn("text", F.lit("not there"))).unionByName(claims.withColumn("type", F.lit("no_type")))
    return planning.accepted_candidates(claims, segments, s.filter("type = 'inn'"), ("person",)).drop("type")


@query("SELECT doc_id, trim(regexp_replace(replace(replace(replace(text, chr(10), ' '), '…', '...'), '  ', ' '), ' +', ' ', 'g')) AS norm FROM documents WHERE NOT regexp_matches(text, '[\r«»“”„‟‘’–—―]')")
def p11_ocr_text(spark, sf_dir):
    d = read(spark, sf_dir, "documents").filter("NOT text RLIKE '[\\r«»“”„‟‘’–—―]'")
    return d.select("doc_id", texts.ocr_text(F.col("text")).alias("norm"))


@query("SELECT a.c_custkey AS a, b.c_custkey AS b, CAST(bit_count(xor(a.c_custkey * 3, b.c_custkey * 3)) AS INT) AS bits FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey WHERE bit_count(xor(a.c_custkey * 3, b.c_custkey * 3)) <= 1")
def fn_bit_similar_images(spark, sf_dir):
    h = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image"), (F.col("c_custkey") * 3).alias("h"))
    return quality.similar_images(h, 1)


