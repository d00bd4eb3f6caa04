"""Queries of mask planning: markers, replacements, masked text, leaks, answers and decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions import normalize as nz
from spanlake.functions.spans import quote, spans as span_sql
from spanlake.operators import planning, rules
from spanlake.operators.store import written

from . import contracts
from .detection import contract_segments
from .registry import query, read

PLAN_TYPES = (*contracts.RULE_TYPES, "delivery_period")


def contract_spans(spark, sf_dir):
    s = contract_segments(spark, sf_dir)
    found = rules.detect_rules(s).unionByName(rules.detect_terms(s).select("doc_id", "seg_order", "start", "end", "text", "type", "confidence"))
    return written(found)  # plans read the spans several times


_expected = contracts.expected_sql(PLAN_TYPES)
_key = "CASE WHEN type IN ('inn', 'kpp', 'ogrn', 'snils', 'bank_account', 'bik', 'passport', 'phone', 'registry_key') THEN regexp_replace(text, '[\\s-]', '', 'g') WHEN type = 'federal_law' THEN lower(replace(text, '№ ', '')) ELSE lower(text) END"
_label = "CASE type " + " ".join(f"WHEN '{t[0]}' THEN '{t[2]}'" for t in nz.TYPES) + " END"
_plan = f"""
e AS ({_expected}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_order, "start", "end", type) AS ref_n, {_key} AS key FROM e),
p AS (SELECT * FROM r WHERE type NOT IN ('delivery_period', 'payment_terms')),
g AS (SELECT doc_id, type, key, min(ref_n) AS first_n, count(*) AS n_refs, arg_min(text, ref_n) AS sample FROM p GROUP BY 1, 2, 3),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY first_n) AS number, count(*) OVER (PARTITION BY doc_id, type) AS in_type,
      'G' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_n) AS VARCHAR) AS group_id FROM g),
k AS (SELECT *, '[' || {_label} || CASE WHEN in_type > 1 THEN '-' || CAST(number AS VARCHAR) ELSE '' END || ']' AS marker FROM m)"""


@query(f"WITH {_plan} SELECT doc_id, group_id, type, key AS value_key, marker, n_refs, sample FROM k")
def g10_a4_mask_groups(spark, sf_dir):
    _, groups, _ = planning.plan(contract_spans(spark, sf_dir))
    return groups.select("doc_id", "group_id", "type", F.expr("substring(key, length(type) + 2)").alias("value_key"), "marker", "n_refs", "sample")


@query(f"WITH {_plan} SELECT doc_id, 'E' || CAST(ref_n AS VARCHAR) AS ref, type, 'visible_contract_term' AS reason FROM r WHERE type IN ('delivery_period', 'payment_terms')")
def g10_a6_skipped(spark, sf_dir):
    return planning.plan(contract_spans(spark, sf_dir))[2]


_pieces = []
for _i, _row in enumerate(contracts.CONTRACT):
    _text = []
    for _j, _p in enumerate(_row):
        if isinstance(_p, str):
            _text.append(f"'{_p}'")
        elif _p.type in contracts.RULE_TYPES:
            _at = f"(SELECT k.marker FROM p JOIN k USING (doc_id, type, key) WHERE p.doc_id = c_custkey AND p.seg_order = {_i} AND p.type = '{_p.type}' AND p.\"text\" = {_p.sql} LIMIT 1)"
            _text.append(f"coalesce({_at}, {_p.sql})")
        else:
            _text.append(_p.sql)
    _pieces.append(f"SELECT c_custkey AS doc_id, {_i} AS seg_order, {' || '.join(_text)} AS masked FROM contract_values")


@query(f"WITH {_plan}, contract_values AS MATERIALIZED ({contracts.values_sql()}), t AS ({' UNION ALL '.join(_pieces)}) SELECT doc_id, seg_order, masked FROM t")
def r1_masked_text(spark, sf_dir):
    replacements, _, _ = planning.plan(contract_spans(spark, sf_dir))
    return planning.masked(contract_segments(spark, sf_dir), replacements).select("doc_id", "seg_order", "masked")


@query(f"WITH v AS ({contracts.values_sql()}) SELECT c_custkey AS doc_id, 6 AS seg_order, unnest([{', '.join(p.sql for p in contracts.CONTRACT[6] if not isinstance(p, str))}]) AS value FROM v WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 8, {contracts.CONTRACT[8][1].sql} FROM v WHERE c_custkey % 7 = 1")
def g11_o14_leaks(spark, sf_dir):
    """Values that a faulty masking left: a segment of some contracts as it was, and in others a value broken by white space. A value
    that only stands inside a longer number of the text is none of these."""
    replacements, _, _ = planning.plan(contract_spans(spark, sf_dir))
    masked = planning.masked(contract_segments(spark, sf_dir), replacements)
    raw = F.when((F.col("doc_id") % 7 == 0) & (F.col("seg_order") == 6), F.col("text")).when((F.col("doc_id") % 7 == 1) & (F.col("seg_order") == 8), F.regexp_extract("text", r"ОКПО (\d+)", 1))
    return planning.leaks(masked.withColumn("masked", F.coalesce(raw, "masked")), replacements).filter("NOT in_number").drop("in_number")


EMAIL_RE2 = r"[\w.+-]+@[\w-]+\.\w+(?:\.\w+)*"


@query(f"""
WITH d AS (SELECT doc_id, lang, text, regexp_extract_all(text, '{EMAIL_RE2}') AS ms FROM documents),
u AS (SELECT doc_id, lang, lower(unnest(ms)) AS value FROM d),
g AS (SELECT lang, count(*) AS n_values, count(DISTINCT doc_id || ':' || value) AS n_groups FROM u GROUP BY lang)
SELECT lang, n_values, n_groups, CAST(0 AS BIGINT) AS n_left FROM g""")
def m0_mask_email_by_lang(spark, sf_dir):
    """The flagship: e-mails of the documents get stable markers; how many values, groups, and values left, by language."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    # only texts with an @ can hold a value: a cheap test before the spans
    found = docs.filter(F.col("text").contains("@")).withColumn("x", F.expr(span_sql("text", rules.EMAIL)))
    one = found.select("doc_id", "lang", F.explode_outer("x").alias("x")).filter("x IS NOT NULL").select("doc_id", "lang", "x.*", F.lower("x.text").alias("key"))
    numbered = one.groupBy("doc_id", "key").agg(F.min("start").alias("first"))
    from pyspark.sql.window import Window

    numbered = numbered.withColumn("marker", F.concat(F.lit("[ПОЧТА-"), F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).cast("string"), F.lit("]")))
    repl = one.join(numbered.drop("first"), ["doc_id", "key"]).withColumn("seg_order", F.lit(0))
    masked = planning.masked(docs.select("doc_id", F.lit(0).alias("seg_order"), "text").join(one.select("doc_id").distinct(), "doc_id", "left_semi"), repl)
    left = masked.select("doc_id", F.expr(f"size({span_sql('masked', rules.EMAIL)})").alias("left"))
    per = one.groupBy("lang", "doc_id").agg(F.count(F.lit(1)).alias("v"), F.countDistinct("key").alias("g")).join(left, "doc_id")
    return per.groupBy("lang").agg(F.sum("v").alias("n_values"), F.sum("g").alias("n_groups"), F.sum("left").cast("long").alias("n_left"))


#: Answers of customers to a question with the options mask and keep.
_questions = "SELECT o_orderkey AS run_id, 'TYPE-' || o_orderpriority AS question_id, 'mask' AS dflt FROM orders WHERE o_orderkey % 3 <> 0"
_answers = "SELECT o_orderkey AS run_id, 'TYPE-' || CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' ELSE o_orderpriority END AS question_id, CASE o_orderkey % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'mask' ELSE 'maybe' END AS option FROM orders WHERE o_orderkey % 5 <> 0"


@query(f"""SELECT coalesce(q.run_id, a.run_id) AS run_id, coalesce(q.question_id, a.question_id) AS question_id,
CASE WHEN q.run_id IS NOT NULL THEN CASE WHEN a.option IN ('mask', 'keep') THEN a.option ELSE q.dflt END END AS option,
CASE WHEN q.run_id IS NULL THEN 'ignored' WHEN a.option IS NULL THEN 'unanswered' WHEN a.option IN ('mask', 'keep') THEN 'human' ELSE 'invalid' END AS status
FROM ({_questions}) q FULL JOIN ({_answers}) a ON q.run_id = a.run_id AND q.question_id = a.question_id""")
def j12_g7_answers(spark, sf_dir):
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    q = spark.sql(_questions).withColumnRenamed("dflt", "default").withColumn("options", F.array(F.lit("mask"), F.lit("keep")))
    return planning.resolve_answers(q, spark.sql(_answers))


_candidates = """SELECT l_orderkey AS doc_id, l_partkey AS ref, CASE l_returnflag WHEN 'A' THEN 'inn' WHEN 'N' THEN 'person' ELSE 'money' END AS type,
CASE l_linenumber WHEN 1 THEN 'default' WHEN 2 THEN 'judge' WHEN 3 THEN 'type' WHEN 4 THEN 'profile' ELSE 'entity' END AS decided_by,
CASE WHEN l_linenumber <= 2 OR l_suppkey % 3 = 0 THEN 'mask' ELSE 'keep' END AS action, l_suppkey % 7 = 0 AS confirmed FROM lineitem"""


@query(f"""
WITH c AS (SELECT DISTINCT doc_id, ref % 3 AS ref, type, decided_by, action, confirmed, CASE decided_by WHEN 'entity' THEN 2 WHEN 'profile' THEN 3 WHEN 'type' THEN 4 WHEN 'judge' THEN 5 ELSE 6 END AS rank FROM ({_candidates})),
o AS (SELECT doc_id, ref, type, list((rank, decided_by, action, confirmed) ORDER BY rank, decided_by, action, confirmed) AS a FROM c GROUP BY 1, 2, 3),
w AS (SELECT *, type = 'inn' AND NOT (a[1][3] = 'keep' AND a[1][4]) AS guard FROM o)
SELECT doc_id, ref, type, CASE WHEN guard THEN 'mask' ELSE a[1][3] END AS action, CASE WHEN guard THEN 'critical_guard' ELSE a[1][2] END AS decided_by,
array_to_string(list_transform(CASE WHEN guard THEN a ELSE a[2:] END, lambda x: x[2]), ',') AS overridden FROM w""")
def g9_w11_decisions(spark, sf_dir):
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    c = spark.sql(f"SELECT DISTINCT doc_id, ref % 3 AS ref, type, decided_by, action, confirmed FROM ({_candidates})")
    return planning.decide(c)


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'иванов иван иванович' WHEN 1 THEN 'иванова' ELSE 'атараев б.м.' END AS raw, CASE c_custkey % 4 WHEN 0 THEN 'иванов иван иванович' WHEN 1 THEN 'иванов' ELSE 'атараев б.м.' END AS key FROM customer")
def p3_person_key(spark, sf_dir):
    raw = "CASE c_custkey % 4 WHEN 0 THEN 'Иванова Ивана Ивановича' WHEN 1 THEN 'Иванова' WHEN 2 THEN 'Б.М. Атараев' ELSE 'Атараев  Б. М.' END"
    shown = "CASE c_custkey % 4 WHEN 0 THEN 'иванов иван иванович' WHEN 1 THEN 'иванова' ELSE 'атараев б.м.' END"
    return read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{shown} AS raw", f"{nz.person(raw)} AS key")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'альфа ' || CAST(c_custkey AS VARCHAR) END AS key, 'postavsik-o-' || CAST(c_custkey AS VARCHAR) AS slug FROM customer")
def p3_p7_org_key_and_slug(spark, sf_dir):
    raw = "CASE c_custkey % 3 WHEN 0 THEN concat('ООО «Альфа ', c_custkey, '»') WHEN 1 THEN concat('Акционерное общество \"Альфа  ', c_custkey, '\"') ELSE 'ООО' END"
    return read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{nz.org(raw)} AS key", f"{nz.slug('concat(' + quote('Поставщик № ') + ', c_custkey)')} AS slug")
