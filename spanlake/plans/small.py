"""Queries of the smaller operators: filters, lookups, scalar forms, edits, coverage and search, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlake.functions import checksums as cs
from spanlake.functions import normalize as nz
from spanlake.functions.spans import greedy
from spanlake.operators import filters, planning, quality, rules, texts
from spanlake.sources import documents, sinks

from . import contracts
from .analysis import RUNS, SPANS, runs, spans, sql
from .detection import contract_segments
from .registry import query, read

S = f"({SPANS})"
TYPES_SQL = "(VALUES " + ", ".join(f"('{t[0]}', '{t[1]}', '{t[2]}', {str(t[4]).lower()})" for t in nz.TYPES) + ")"


def types(spark):
    return spark.createDataFrame([(t[0], t[1], t[2], t[4]) for t in nz.TYPES], "type string, title string, label string, critical boolean")


F_TYPES = ("inn", "email", "federal_law")


@query(f"SELECT doc_id, seg_order, \"start\", type FROM ({contracts.expected_sql(F_TYPES[:2])})")
def f1_f2_type_filter(spark, sf_dir):
    """Requested types of the contracts' spans, without references to laws."""
    found = rules.detect_rules(contract_segments(spark, sf_dir))
    return filters.without_public_law(filters.of_types(found, F_TYPES, tuple(t[0] for t in nz.TYPES))).select("doc_id", "seg_order", "start", "type")


_person = "CASE c_custkey % 4 WHEN 0 THEN 'Иванов' WHEN 1 THEN 'ИВАНОВ И.И.' WHEN 2 THEN 'ЕГРЮЛ' ELSE ' Российская Федерация' END"


@query(f"SELECT c_custkey AS doc_id, {_person} AS text FROM customer WHERE c_custkey % 4 <= 1")
def f3_f4_person_filters(spark, sf_dir):
    s = read(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"{_person} AS text", "'person' AS type")
    return filters.real_persons(s).select("doc_id", "text")


_nouns = "SELECT l_orderkey % 40 AS doc_id, CAST(l_linenumber AS INT) AS seg_order, CAST(l_suppkey % 50 AS INT) AS \"start\", CAST(l_suppkey % 50 + 7 AS INT) AS \"end\", CASE l_partkey % 40 WHEN 0 THEN 'Абонент' WHEN 1 THEN 'Абонента' WHEN 2 THEN 'Жилец' ELSE 'Иванов' END AS text, CASE WHEN l_partkey % 11 = 0 THEN 'org_name' ELSE 'person' END AS type FROM lineitem"


@query(f"""WITH s AS (SELECT *, CASE WHEN text LIKE 'Абонент%' THEN 'абонент' ELSE lower(text) END AS key FROM ({_nouns})),
n AS (SELECT doc_id, key FROM (SELECT DISTINCT doc_id, key, seg_order, "start", "end" FROM s WHERE type = 'person' AND text <> 'Иванов') GROUP BY 1, 2 HAVING count(*) >= 8),
gone AS (SELECT DISTINCT s.doc_id, seg_order, "start", "end" FROM s JOIN n USING (doc_id, key) WHERE type = 'person' AND text <> 'Иванов')
SELECT s.doc_id, s.seg_order, s."start", s.text, s.type FROM s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.seg_order = s.seg_order AND g."start" = s."start" AND g."end" = s."end" AND s.type = 'person' WHERE g.doc_id IS NULL""")
def f6_frequent_nouns(spark, sf_dir):
    s = sql(spark, sf_dir, _nouns)
    return filters.without_frequent_nouns(s, F.col("text") == "Иванов").select("doc_id", "seg_order", "start", "text", "type")


@query("SELECT p_partkey, regexp_matches(p_name, '(^|\\s)(bl[a-z]{0,4}|larg[a-z]{0,3})($|\\s)') AS hit FROM part")
def f7_stems(spark, sf_dir):
    """Words that begin with a stem and go on for a few letters."""
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", (filters.has_stem(name, ("bl",), 4) | filters.has_stem(name, ("larg",), 3)).alias("hit"))


@query(f"SELECT doc_id, n, CASE type WHEN 'inn' THEN \"end\" - \"start\" IN (10, 12) ELSE true END AS complete FROM {S}")
def f5_v7_complete_requisites(spark, sf_dir):
    return spans(spark, sf_dir).withColumn("text", F.expr("repeat('1', end - start)")).select("doc_id", "n", F.expr(cs.complete("type", "text")).alias("complete"))


@query("SELECT p_partkey, len(list_filter(string_split(lower(p_name), ' '), lambda w: w NOT IN ('red', 'blue', 'small', 'large'))) = 0 AS listed FROM part")
def f8_whitelist(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", filters.is_listed(F.col("p_name"), ("Red", "blue", "small", "LARGE")).alias("listed"))


@query(f"SELECT doc_id, n, CASE WHEN o_orderkey IS NULL THEN 'no_anchor' ELSE o_orderstatus END AS anchor FROM {S} LEFT JOIN (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0) ON o_orderkey = doc_id")
def j1_entity_segment(spark, sf_dir):
    o = read(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus")
    return spans(spark, sf_dir).join(o, "doc_id", "left").select("doc_id", "n", F.coalesce("o_orderstatus", F.lit("no_anchor")).alias("anchor"))


@query(f"SELECT doc_id, n, t.title, t.label, t.critical FROM {S} s JOIN {TYPES_SQL} t(type, title, label, critical) USING (type)")
def j2_type_dimension(spark, sf_dir):
    return spans(spark, sf_dir).join(F.broadcast(types(spark)), "type").select("doc_id", "n", "title", "label", "critical")


@query(f"SELECT s.doc_id, s.n, o_orderstatus AS status, c_mktsegment AS role, n_name AS place FROM {S} s LEFT JOIN orders ON o_orderkey = s.doc_id LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def j3_j4_lookups(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey", F.col("o_orderstatus").alias("status"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", F.col("c_mktsegment").alias("role"))
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place"))
    return spans(spark, sf_dir).join(o, "doc_id", "left").join(c, "o_custkey", "left").join(n, "c_nationkey", "left").select("doc_id", "n", "status", "role", "place")


@query("SELECT c_custkey AS doc_id, 0 AS page, 'ИНН ' || CAST(c_custkey AS VARCHAR) AS value, CAST(c_custkey % 4 - 1 AS BIGINT) AS extra FROM customer WHERE c_custkey % 4 > 1")
def j16_page_accounting(spark, sf_dir):
    """Three places of a value of which two are planned, and pages that keep none to three of them."""
    c = read(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", "0 AS page", "concat('ИНН ', c_custkey) AS v")
    source = c.select("doc_id", "page", F.concat_ws("; ", "v", "v", "v", F.lit("")).alias("text"))
    left = c.select("doc_id", "page", F.expr("concat(repeat(concat(v, '; '), CAST(doc_id % 4 AS INT)), repeat('[ИНН]; ', CAST(3 - doc_id % 4 AS INT)))").alias("text"))
    planned = c.select("doc_id", "page", F.col("v").alias("text"))
    return planning.page_accounting(source, left, planned.unionByName(planned))


@query(f"SELECT a.doc_id, a.n, count(DISTINCT b.doc_id) AS peers FROM {S} a JOIN {S} b ON a.supp = b.supp AND a.type = b.type AND a.\"start\" = b.\"start\" AND a.\"end\" = b.\"end\" AND a.seg_order = b.seg_order AND a.n = b.n GROUP BY a.doc_id, a.n")
def j20_label_peers(spark, sf_dir):
    keys = ["supp", "type", "start", "end", "seg_order", "n"]
    s = spans(spark, sf_dir)
    return _peers(s, keys)


def _peers(s, keys):
    docs = s.select(*keys, F.col("doc_id").alias("other")).distinct()
    return s.select("doc_id", *keys).distinct().join(docs, keys).groupBy("doc_id", "n").agg(F.countDistinct("other").alias("peers"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 59) || '…' ELSE text END AS sample, substring(text, greatest(0, 100 - 40) + 1, least(length(text), 120 + 40) - greatest(0, 100 - 40)) AS around FROM documents WHERE length(text) > 120")
def p5_p6_samples(spark, sf_dir):
    """A sample of 60 characters, and a window of 40 characters around a span at 100 to 120."""
    d = read(spark, sf_dir, "documents").filter(F.length("text") > 120)
    return d.select("doc_id", texts.sample(F.col("text")).alias("sample"), texts.clamped(F.col("text"), F.lit(100), F.lit(120), 40).alias("around"))


#: What Python's str.split() parts words by.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"SELECT doc_id, trim(regexp_replace(text, '{SPACE}', ' ', 'g')) AS collapsed FROM documents")
def p4_collapsed_texts(spark, sf_dir):
    """The white-space collapse over the whole text."""
    return read(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace("text", SPACE, " ")).alias("collapsed"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / 612.0, 6) AS x0, round(l_tax, 6) AS y0, round((l_quantity + 12) / 612.0, 6) AS x1, l_quantity >= 0 AND l_quantity < l_quantity + 12 AND (l_quantity + 12) / 612.0 <= 1 AS valid FROM lineitem")
def p12_v12_boxes(spark, sf_dir):
    q = F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(q / 612.0, 6).alias("x0"), F.round("l_tax", 6).alias("y0"), F.round((q + 12) / 612.0, 6).alias("x1"), ((q >= 0) & ((q + 12) / 612.0 <= 1)).alias("valid"))


@query("SELECT doc_id, substring(sha256('1|' || sha256(text) || '|{\"lang\":\"' || lang || '\"}'), 1, 16) AS run_id FROM documents")
def p13_run_id(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.concat(F.lit("1|"), F.sha2("text", 256), F.lit("|"), F.to_json(F.struct("lang"))), 256), 1, 16).alias("run_id"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey * 97 % 16777216 END AS colour FROM customer")
def p14_colours(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 5 == 0, "none").otherwise(F.concat(F.lit("#"), F.lpad(F.hex(F.col("c_custkey") * 97 % 16777216), 6, "0")))
    return read(spark, sf_dir, "customer").select("c_custkey", F.when(text.rlike("^#[0-9A-F]{6}$"), F.conv(F.substring(text, 2, 6), 16, 10).cast("long")).alias("colour"))


@query(f"SELECT doc_id, n, least(1.0, 0.5 + n / 20.0 + CASE WHEN supp % 3 = 0 THEN 0.1 ELSE 0 END) AS score, least(1.0, 0.5 + n / 20.0 + CASE WHEN supp % 3 = 0 THEN 0.1 ELSE 0 END) < 0.75 AND type <> 'inn' AS ask FROM {S}")
def g5_g6_judge(spark, sf_dir):
    s = spans(spark, sf_dir).withColumn("confidence", F.lit(0.5) + F.col("n") / 20.0).withColumn("profile_bonus", F.when(F.col("supp") % 3 == 0, 0.1))
    s = s.withColumn("key", F.col("supp").cast("string")).withColumn("ref_n", F.col("n"))
    return planning.judge(s).select("doc_id", "n", "score", "ask")


@query(f"SELECT doc_id, 'TYPE-' || type AS question_id, count(*) AS found, array_to_string(list_sort(list(DISTINCT CAST(supp AS VARCHAR)))[1:5], ',') AS samples FROM {S} WHERE type <> 'inn' GROUP BY doc_id, type UNION ALL SELECT doc_id, 'PROFILE-P' || seg_order, count(*), array_to_string(list_sort(list(DISTINCT CAST(supp AS VARCHAR)))[1:5], ',') FROM {S} GROUP BY doc_id, seg_order HAVING count(*) FILTER (type <> 'inn') > 0")
def g8_policy_questions(spark, sf_dir):
    s = spans(spark, sf_dir).select("doc_id", "type", F.col("supp").cast("string").alias("text"), F.concat_ws("-", "n", "supp", "seg_order", "start", "end").alias("ref"), F.concat(F.lit("P"), "seg_order").alias("profile_id"))
    q = planning.policy_questions(s.drop("profile_id"), s.select("doc_id", "ref", "profile_id"))
    return q.select("doc_id", "question_id", "found", F.array_join("samples", ",").alias("samples"))


KIND_ROWS = (("Договор поставки № 1",), ("Поставщик и ", contracts.Value("side", "CASE WHEN c_custkey % 2 = 0 THEN 'Заказчик' ELSE 'никто' END")), ("ИНН 1",))
@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'contract' WHEN c_custkey % 6 = 1 THEN 'non_contract' ELSE 'unknown' END AS kind FROM customer")
def g15_document_kind(spark, sf_dir):
    """A contract by its title and sides; of the others some have a recorded answer, sure or not."""
    c = read(spark, sf_dir, "customer").select("c_custkey")
    answers = c.filter("c_custkey % 6 IN (1, 3)").selectExpr("c_custkey AS doc_id", "'non_contract' AS kind", "CASE WHEN c_custkey % 6 = 1 THEN 0.9D ELSE 0.5D END AS confidence")
    return texts.document_kind(contracts.segments(c, KIND_ROWS), answers)


_reviewed = "SELECT o_custkey AS doc_id, CAST(o_orderkey AS INT) AS seg_order, 0 AS \"start\", 5 AS \"end\", 'value' AS text, CASE o_orderkey % 3 WHEN 0 THEN 'inn' WHEN 1 THEN 'person' ELSE 'money' END AS type FROM orders"


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_order) AS r FROM ({_reviewed})),
e AS (SELECT doc_id, seg_order, CASE WHEN r = 2 THEN 'address' ELSE type END AS type, CASE WHEN r = 1 THEN 'keep' WHEN r = 4 THEN 'mask' END AS asked FROM s),
u AS (SELECT doc_id, seg_order, type, CASE WHEN asked = 'keep' AND type <> 'inn' THEN 'keep' ELSE 'mask' END AS action, CASE WHEN asked = 'keep' AND type = 'inn' THEN 'critical_guard' WHEN asked IS NOT NULL THEN 'entity' ELSE 'default' END AS decided_by FROM e
      UNION ALL SELECT DISTINCT doc_id, -1, 'person', 'mask', 'entity' FROM s WHERE doc_id % 5 = 0)
SELECT doc_id, 'E' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seg_order) AS VARCHAR) AS ref, seg_order, type, action, decided_by, 2 AS revision FROM u""")
def g16_f13_review_edits(spark, sf_dir):
    """The first span is to be kept, the second gets another type, the third an unknown action, the fourth is confirmed, and some
    documents get a span of their own before all others."""
    s = planning.with_refs(sql(spark, sf_dir, _reviewed))
    e = s.filter("ref_n <= 4").selectExpr("doc_id", "ref", "CASE ref_n WHEN 1 THEN 'keep' WHEN 3 THEN 'odd' WHEN 4 THEN 'mask' END AS action", "CASE ref_n WHEN 2 THEN 'address' WHEN 3 THEN 'no_type' END AS new_type")
    added = s.filter("doc_id % 5 = 0").select("doc_id").distinct().selectExpr("doc_id", "-1 AS seg_order", "0 AS start", "5 AS end", "'value' AS text", "'person' AS type")
    out = planning.review(s, e, added, tuple(t[0] for t in nz.TYPES), 2)
    return out.select("doc_id", "ref", "seg_order", "type", "action", "decided_by", "revision")


@query("SELECT doc_id, seg_order, line FROM (SELECT doc_id, i AS seg_order, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE contains(line, ' of ')) WHERE r <= 3")
def t7_s_preview(spark, sf_dir):
    s = documents.text_segments(read(spark, sf_dir, "documents")).filter(F.col("text").contains(" of "))
    w = Window.partitionBy("doc_id").orderBy("seg_order")
    return s.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("doc_id", F.col("seg_order").cast("long").alias("seg_order"), F.col("text").alias("line"))


@query("SELECT count(*) AS segments, count(DISTINCT doc_id) AS docs, max(length(line)) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\\s]')")
def a23_coverage(spark, sf_dir):
    s = documents.text_segments(read(spark, sf_dir, "documents"))
    return s.agg(F.count(F.lit(1)).alias("segments"), F.countDistinct("doc_id").alias("docs"), F.max(F.length("text")).cast("long").alias("longest"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_filter(['inn', 'money', 'passport', 'person'], lambda t: NOT list_contains(list(DISTINCT type), t))), ',') AS missing FROM {S} GROUP BY doc_id")
def a24_u4_missing_types(spark, sf_dir):
    wanted = F.array(*map(F.lit, ("inn", "money", "passport", "person")))
    return spans(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.array_sort(F.array_except(wanted, F.collect_set("type"))), ",").alias("missing"))


@query(f"SELECT type, count(*) AS asked, count(*) FILTER (detector = 'F') AS accepted, round(count(*) FILTER (detector = 'F') / count(*), 9) AS r_filter FROM {S} WHERE n = 1 GROUP BY type")
def a25_verifier_summary(spark, sf_dir):
    return quality.verifier_summary(spans(spark, sf_dir).filter("n = 1").withColumn("accepted", F.col("detector") == "F"))


@query(f"SELECT id AS doc_id, CAST(CASE WHEN finished_at IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN duration IS NOT NULL THEN 1 ELSE 0 END + 1 AS INT) AS filled FROM ({RUNS})")
def a28_filled_fields(spark, sf_dir):
    cards = runs(spark, sf_dir).withColumnRenamed("id", "doc_id").withColumn("empty", F.lit("  "))
    return quality.filled_fields(cards, ("finished_at", "duration", "status", "empty"))


@query(f"SELECT DISTINCT doc_id, type, supp FROM {S} WHERE detector = 'F'")
def u3_distinct_leaks(spark, sf_dir):
    return spans(spark, sf_dir).filter("detector = 'F'").select("doc_id", "type", "supp").distinct()


@query(f"WITH a AS (SELECT type, title, 0 AS rev FROM {TYPES_SQL} t(type, title, label, critical) UNION ALL SELECT type, 'own ' || type, 1 FROM {TYPES_SQL} t(type, title, label, critical) WHERE critical) SELECT type, arg_max(title, rev) AS title FROM a GROUP BY type")
def u5_registry_extend(spark, sf_dir):
    t = types(spark)
    both = t.select("type", "title", F.lit(0).alias("rev")).unionByName(t.filter("critical").select("type", F.concat(F.lit("own "), F.col("type")).alias("title"), F.lit(1).alias("rev")))
    return both.groupBy("type").agg(F.max_by("title", "rev").alias("title"))


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, seg_order, "start", "end", row_number() OVER (PARTITION BY doc_id, seg_order ORDER BY "start", "end", n) AS r, count(*) OVER (PARTITION BY doc_id, seg_order) AS found FROM {S}),
g AS (SELECT doc_id, seg_order, r, "end" AS last, 1 AS kept, found FROM s WHERE r = 1
      UNION ALL SELECT g.doc_id, g.seg_order, s.r, CASE WHEN s."start" >= g.last THEN s."end" ELSE g.last END, g.kept + CASE WHEN s."start" >= g.last THEN 1 ELSE 0 END, g.found
      FROM g JOIN s ON s.doc_id = g.doc_id AND s.seg_order = g.seg_order AND s.r = g.r + 1)
SELECT doc_id, seg_order, CAST(found AS INT) AS found, CAST(kept AS INT) AS kept FROM g WHERE r = found""")
def o4_o5_greedy_spans(spark, sf_dir):
    kind = "array<struct<start:int,end:int,n:int>>"
    per = spans(spark, sf_dir).groupBy("doc_id", "seg_order").agg(F.array_sort(F.collect_list(F.struct("start", "end", "n"))).alias("raw"))
    return per.withColumn("kept", F.expr(greedy(f"CAST(raw AS {kind})", kind))).select("doc_id", "seg_order", F.size("raw").alias("found"), F.size("kept").alias("kept"))


@query("""WITH b AS (SELECT item_id, text AS passage FROM benchmark), d AS (SELECT doc_id, text FROM documents)
SELECT doc_id, item_id, CAST((length(text) - length(replace(text, passage, ''))) / length(passage) AS BIGINT) AS n FROM d JOIN b ON contains(text, passage)""")
def o14_multi_pattern_search(spark, sf_dir):
    """Passages in texts: candidates by the hash of a passage's inner words, eight at most, at every place of the text, then
    the exact test; a passage without an inner word is tested on every text."""
    split = "split({}, '[ \\\\n]+')"
    # the end words of a passage can be parts of longer words of the text, so only those between are a key
    b = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    b = b.withColumn("len", F.least(F.expr(f"size({split.format('passage')})") - 2, F.lit(8)))
    keyed = b.filter("len > 0").withColumn("h", F.expr(f"xxhash64(array_join(slice({split.format('passage')}, 2, len), ' '))"))
    lengths = sorted(r["len"] for r in keyed.select("len").distinct().collect())  # eight values at most
    # the words are bound once per text: a column of them would be split again for each place
    heads = [f"transform(sequence(1, greatest(1, size(w) - {n - 1})), i -> xxhash64(array_join(slice(w, i, {n}), ' ')))" for n in lengths]
    heads = f"array_distinct(concat({', '.join(heads) or 'cast(array() as array<bigint>)'}))"
    texts = read(spark, sf_dir, "documents").select("doc_id", "text")
    d = texts.withColumn("h", F.explode(F.expr(f"element_at(transform(array({split.format('text')}), w -> {heads}), 1)")))
    found = F.expr("contains(text, passage)")
    hits = d.join(keyed, "h").filter(found).select("doc_id", "item_id", "text", "passage")
    hits = hits.unionByName(texts.join(b.filter("len <= 0"), found).select("doc_id", "item_id", "text", "passage"))
    n = F.try_divide(F.length("text") - F.length(F.replace("text", F.col("passage"), F.lit(""))), F.length("passage")).cast("long")
    return hits.select("doc_id", "item_id", n.alias("n")).distinct()


@query("SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n_text, regexp_matches(html, 'https?://') AS has_link FROM pages")
def s_page_lengths(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("n_text"), F.col("html").rlike("https?://").alias("has_link"))


@query("SELECT conv_id, count(*) AS segments, arg_min(role, turn) AS first_role, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def s_conversation_segments(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("segments"), F.min_by("role", "turn").alias("first_role"), F.max("turn").alias("last_turn"))


@query(f"""WITH g AS (SELECT doc_id, type, min(n) AS first_n, count(*) AS n_refs FROM {S} GROUP BY 1, 2),
gs AS (SELECT doc_id, list({{'first_n': first_n, 'group_id': 'G' || first_n, 'type': type, 'marker': '[' || type || ']', 'n_refs': n_refs}} ORDER BY first_n, type) AS groups FROM g GROUP BY 1),
ss AS (SELECT doc_id, list({{'ref': 'E' || n, 'type': type, 'reason': 'kept'}} ORDER BY n, type) AS skipped FROM {S} WHERE n = 7 GROUP BY 1)
SELECT doc_id, CASE WHEN skipped IS NULL THEN CAST(to_json({{'groups': groups}}) AS VARCHAR) ELSE CAST(to_json({{'groups': groups, 'skipped': skipped}}) AS VARCHAR) END AS report FROM gs LEFT JOIN ss USING (doc_id)""")
def k6_report_json(spark, sf_dir):
    s = spans(spark, sf_dir)
    groups = s.groupBy("doc_id", "type").agg(F.min("n").alias("first_n"), F.count(F.lit(1)).alias("n_refs")).withColumn("group_id", F.concat(F.lit("G"), F.col("first_n").cast("string"))).withColumn("marker", F.concat(F.lit("["), F.col("type"), F.lit("]")))
    skipped = s.filter("n = 7").select("doc_id", F.concat(F.lit("E"), F.col("n").cast("string")).alias("ref"), "type", F.lit("kept").alias("reason"))
    return sinks.report(s, groups, skipped)


@query("SELECT event_id AS doc_id, CASE WHEN event_id % 2 = 0 THEN replace(replace(props, '\"k\"', '\"[A]\"'), '{', '[B]') ELSE props END AS text, false AS leaked FROM events")
def r3_recursive_values(spark, sf_dir):
    """Values of a document replaced at any depth of its JSON."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("text"))
    pairs = F.array(*(F.struct(F.lit(v).alias("value"), F.lit(m).alias("marker")) for v, m in (('"k"', '"[A]"'), ("{", "[B]"))))
    return quality.masked_values(e, e.filter("doc_id % 2 = 0").select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.*"))


