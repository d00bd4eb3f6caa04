"""Queries of run analytics, joins, windows, ranking and quality, over the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlake.operators import analytics as an
from spanlake.operators import planning, quality

from .registry import query, read

#: Orders as runs, customers as users, events as sessions and stage events.
RUNS = "SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'running' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' WHEN 2 THEN 'xlsx' ELSE 'image' END AS document_format, o_orderpriority AS node_hint, 'error ' || CAST(o_orderkey % 7 AS STRING) AS error, o_orderdate AS created_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS finished_at, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS duration FROM orders"
USERS = "SELECT c_custkey AS user_id, c_name AS name, c_acctbal > 0 AS active, CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'user' END AS role, CASE WHEN c_custkey % 6 <> 0 THEN CAST('2024-01-31' AS DATE) - CAST(c_custkey % 60 AS INT) END AS last_login FROM customer"
SESSIONS = "SELECT event_id, user_id, event_type AS device, CASE WHEN event_id % 5 = 0 THEN ts END AS revoked_at, ts AS expires_at, event_id % 3 = 0 AS active FROM events"
#: Order lines as spans of a document: the order is the document, the part's last digit the segment.
SPANS = "SELECT l_orderkey AS doc_id, CAST(l_partkey % 4 AS INT) AS seg_order, CAST(l_suppkey % 40 AS INT) AS \"start\", CAST(l_suppkey % 40 + 1 + l_quantity % 9 AS INT) AS \"end\", CASE l_returnflag WHEN 'A' THEN 'inn' WHEN 'N' THEN 'person' ELSE 'money' END AS type, l_linenumber AS n, l_linestatus AS detector, l_suppkey AS supp FROM lineitem"


def sql(spark, sf_dir, text: str) -> DataFrame:
    for t in ("orders", "customer", "events", "lineitem", "documents", "labels"):
        if f"FROM {t}" in text or f"JOIN {t}" in text:
            read(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text.replace('"', "`"))


def runs(spark, sf_dir):
    return sql(spark, sf_dir, RUNS)


def spans(spark, sf_dir):
    return sql(spark, sf_dir, SPANS)


_summary = "count(*) AS n, round(CASE WHEN count(*) FILTER (status IN ('done', 'failed')) > 0 THEN count(*) FILTER (status = 'done') / count(*) FILTER (status IN ('done', 'failed')) END, 9) AS success_rate, round(avg(duration), 6) AS mean_s, round(median(duration), 6) AS median_s"


@query(f"SELECT status, {_summary} FROM ({RUNS}) GROUP BY status")
def a15_runs_by_status(spark, sf_dir):
    return an.run_summary(runs(spark, sf_dir), "status")


@query(f"SELECT document_format, {_summary} FROM ({RUNS}) GROUP BY document_format")
def a15_runs_by_format(spark, sf_dir):
    return an.run_summary(runs(spark, sf_dir), "document_format")


@query(f"SELECT count(*) AS total, count(*) FILTER (active) AS active, count(*) FILTER (role = 'admin') AS admins, count(*) FILTER (last_login IS NULL) AS never, count(*) FILTER (last_login >= DATE '2024-01-24') AS active_7d, count(*) FILTER (last_login >= DATE '2024-01-01') AS active_30d FROM ({USERS})")
def a14_user_summary(spark, sf_dir):
    return an.user_summary(sql(spark, sf_dir, USERS).withColumn("roles", F.array("role")), F.lit("2024-01-31").cast("date"))


@query(f"SELECT node_hint, count(*) AS n, arg_max(error, (finished_at, id)) AS last_error, max(finished_at) AS last_at FROM ({RUNS}) WHERE status = 'failed' GROUP BY node_hint ORDER BY n DESC, node_hint LIMIT 10")
def a17_t6_failures_by_node(spark, sf_dir):
    return an.failures_by_node(runs(spark, sf_dir))


@query(f"SELECT device, CASE WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN expires_at <= TIMESTAMP '2024-01-20' THEN 'expired' ELSE 'active' END AS state, count(*) AS n FROM ({SESSIONS}) GROUP BY 1, 2")
def a18_session_states(spark, sf_dir):
    return an.session_states(sql(spark, sf_dir, SESSIONS), F.lit("2024-01-20").cast("timestamp_ntz"))


@query(f"WITH r AS (SELECT user_id, count(*) AS a, count(*) FILTER (status = 'failed') AS b, max(created_at) AS c FROM ({RUNS}) GROUP BY 1), s AS (SELECT user_id, count(*) FILTER (active) AS d FROM ({SESSIONS}) GROUP BY 1) SELECT u.user_id, name, coalesce(a, 0) AS runs_total, coalesce(b, 0) AS runs_failed, c AS last_run, coalesce(d, 0) AS active_sessions FROM ({USERS}) u LEFT JOIN r USING (user_id) LEFT JOIN s USING (user_id)")
def a19_j15_per_user(spark, sf_dir):
    return an.per_user(sql(spark, sf_dir, USERS), runs(spark, sf_dir), sql(spark, sf_dir, SESSIONS))


@query("SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, coalesce(n, 0) AS n FROM range(DATE '2023-12-25', DATE '2024-02-06', INTERVAL 1 DAY) t(d) LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) e ON e.day = CAST(d AS DATE)")
def a20_daily_series(spark, sf_dir):
    return an.daily_series(read(spark, sf_dir, "events"), F.col("ts"), "2023-12-25", "2024-02-05").withColumn("day", F.col("day").cast("string"))


@query("SELECT event_type, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INT) >= 50) AS n_high, count(*) FILTER (json_extract_string(props, '$.missing') IS NULL) AS n_missing FROM events GROUP BY event_type")
def a16_option_usage(spark, sf_dir):
    v = F.parse_json("props")
    k, missing = F.try_variant_get(v, "$.k", "int"), F.try_variant_get(v, "$.missing", "string")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(k >= 50).alias("n_high"), F.count_if(missing.isNull()).alias("n_missing"))


@query("SELECT event_type AS node, count(*) AS calls, count(*) FILTER (event_id % 4 <> 0) AS known_calls, CAST(sum(CASE WHEN event_id % 4 <> 0 THEN event_id % 1000 END) AS BIGINT) AS tokens, CAST(round(CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE), 4) AS DOUBLE) AS cost, CASE WHEN count(*) FILTER (event_id % 4 = 0) = 0 THEN 'known' ELSE 'lower_bound' END AS status FROM events GROUP BY event_type")
def a21_usage(spark, sf_dir):
    known = F.col("event_id") % 4 != 0
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("node")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(known).alias("known_calls"), F.sum(F.when(known, F.col("event_id") % 1000)).alias("tokens"), F.round(F.sum(F.col("value").cast("decimal(18,6)")).cast("double"), 4).alias("cost"), F.when(F.count_if(~known) == 0, "known").otherwise("lower_bound").alias("status"))


@query("SELECT user_id, event_type, round(sum(value), 4) AS total, round(median(value), 6) AS median FROM events GROUP BY 1, 2")
def a22_stage_timings(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.median("value"), 6).alias("median"))


@query(f"SELECT doc_id, count(*) FILTER (type = 'inn') AS inn, count(*) FILTER (type = 'money') AS money, count(*) FILTER (type = 'person') AS person FROM ({SPANS}) GROUP BY doc_id")
def a26_label_counts_pivot(spark, sf_dir):
    out = spans(spark, sf_dir).groupBy("doc_id").pivot("type", ["inn", "money", "person"]).count()
    return out.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("inn", "money", "person")))


@query(f"SELECT type, detector, grouping(type) AS g_type, grouping(detector) AS g_detector, count(*) AS n, CAST(min(\"end\" - \"start\") AS INT) AS shortest FROM ({SPANS}) GROUP BY GROUPING SETS ((type), (detector), ())")
def a1_counts_grouping_sets(spark, sf_dir):
    out = spans(spark, sf_dir).groupingSets([["type"], ["detector"], []], "type", "detector")
    return out.agg(F.grouping("type").cast("long").alias("g_type"), F.grouping("detector").cast("long").alias("g_detector"), F.count(F.lit(1)).alias("n"), F.min(F.col("end") - F.col("start")).alias("shortest"))


@query(f"WITH s AS ({SPANS}) SELECT a.doc_id, a.seg_order, a.\"start\", a.\"end\", a.type, a.detector, count(DISTINCT b.detector) AS signals FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.seg_order = b.seg_order AND a.type = b.type AND a.\"start\" < b.\"end\" AND b.\"start\" < a.\"end\" GROUP BY ALL")
def a2_j8_signal_counts(spark, sf_dir):
    return planning.signal_counts(spans(spark, sf_dir))


@query(f"WITH s AS ({SPANS}) SELECT doc_id, seg_order, \"start\", \"end\", n FROM s a WHERE type = 'person' AND NOT EXISTS (SELECT 1 FROM s b WHERE b.type <> 'person' AND a.doc_id = b.doc_id AND a.seg_order = b.seg_order AND a.\"start\" < b.\"end\" AND b.\"start\" < a.\"end\")")
def j10_not_covered(spark, sf_dir):
    s = spans(spark, sf_dir)
    a, b = s.filter("type = 'person'").alias("a"), s.filter("type <> 'person'").alias("b")
    return a.join(b, F.expr("a.doc_id = b.doc_id AND a.seg_order = b.seg_order AND a.start < b.end AND b.start < a.end"), "left_anti").select("doc_id", "seg_order", "start", "end", "n")


@query(f"WITH s AS ({SPANS}) SELECT a.doc_id, a.n AS inner_n, b.n AS outer_n FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.seg_order = b.seg_order AND b.\"start\" <= a.\"start\" AND a.\"end\" <= b.\"end\" AND a.n <> b.n")
def j9_containment(spark, sf_dir):
    a, b = spans(spark, sf_dir).alias("a"), spans(spark, sf_dir).alias("b")
    return a.join(b, F.expr("a.doc_id = b.doc_id AND a.seg_order = b.seg_order AND b.start <= a.start AND a.end <= b.end AND a.n <> b.n")).select("a.doc_id", F.col("a.n").alias("inner_n"), F.col("b.n").alias("outer_n"))


@query(f"WITH s AS ({SPANS}) SELECT a.doc_id, a.n, count(b.n) AS near, max(b.\"end\") AS furthest FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.seg_order BETWEEN a.seg_order - 1 AND a.seg_order + 1 AND b.type = 'money' WHERE a.type = 'inn' GROUP BY a.doc_id, a.n")
def j5_j6_band_join(spark, sf_dir):
    s = spans(spark, sf_dir)
    left = s.filter("type = 'inn'").select("doc_id", "seg_order", "n")
    right = s.filter("type = 'money'").select("doc_id", F.col("seg_order").alias("there"), F.col("end"), F.col("n").alias("n2"))
    return an.band_join(left, right, ["doc_id"], "seg_order", "there", 1).groupBy("doc_id", "n").agg(F.count("n2").alias("near"), F.max("end").alias("furthest"))


@query(f"WITH s AS ({SPANS}) SELECT DISTINCT a.doc_id, a.n, a.seg_order, a.\"start\", a.\"end\", (SELECT arg_min(b.n, (b.\"start\", b.n)) FROM s b WHERE b.doc_id = a.doc_id AND b.seg_order = a.seg_order AND b.type = 'inn' AND b.\"start\" >= a.\"end\") AS next_n FROM s a WHERE a.type = 'money'")
def j17_next_span(spark, sf_dir):
    s = spans(spark, sf_dir)
    a, b = s.filter("type = 'money'").alias("a"), s.filter("type = 'inn'").alias("b")
    j = a.join(b, F.expr("a.doc_id = b.doc_id AND a.seg_order = b.seg_order AND b.start >= a.end"), "left")
    return j.groupBy("a.doc_id", "a.n", "a.seg_order", "a.start", "a.end").agg(F.min_by(F.col("b.n"), F.struct(F.col("b.start"), F.col("b.n"))).alias("next_n"))


#: Customers as rows of sheets: a label and, to its right, a code; some labels are others, some codes have a digit too few.
CELLS = "SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(c_custkey * 2 + col AS INT) AS seg_order, 'Лист' || c_custkey % 2 AS sheet, CAST(c_custkey AS INT) AS row, col, CASE WHEN col = 1 THEN CASE WHEN c_custkey % 3 = 0 THEN 'БИК:' WHEN c_custkey % 3 = 1 THEN ' бик ' ELSE 'БИК банка' END ELSE ' ' || CAST(40000000 + c_custkey AS STRING) || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '1' END END AS text FROM customer, (SELECT 1 AS col UNION ALL SELECT 2 AS col) t"


@query(f"SELECT doc_id, seg_order, 1 AS \"start\", 10 AS \"end\", trim(text) AS text, 'bik' AS type, 1.0::DOUBLE AS confidence FROM ({CELLS.replace('AS STRING', 'AS VARCHAR')}) WHERE col = 2 AND row % 3 <> 2 AND row % 5 <> 0")
def j7_d1n_labelled_biks(spark, sf_dir):
    from spanlake.operators import cells

    return cells.labelled_biks(sql(spark, sf_dir, CELLS))


@query(f"SELECT doc_id, n, 'E' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seg_order, \"start\", \"end\", type, n) AS STRING) AS ref FROM ({SPANS})")
def w1_t1_refs(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("seg_order", "start", "end", "type", "n")
    return spans(spark, sf_dir).select("doc_id", "n", F.concat(F.lit("E"), F.row_number().over(w).cast("string")).alias("ref"))


@query(f"WITH g AS (SELECT doc_id, type, supp, min((seg_order, \"start\", n)) AS first FROM ({SPANS}) GROUP BY 1, 2, 3) SELECT doc_id, type, supp, row_number() OVER (PARTITION BY doc_id, type ORDER BY first, supp) AS number, count(*) OVER (PARTITION BY doc_id, type) > 1 AS shown FROM g")
def w2_w3_group_numbers(spark, sf_dir):
    g = spans(spark, sf_dir).groupBy("doc_id", "type", "supp").agg(F.min(F.struct("seg_order", "start", "n")).alias("first"))
    pair = Window.partitionBy("doc_id", "type")
    return g.select("doc_id", "type", "supp", F.row_number().over(pair.orderBy("first", "supp")).cast("long").alias("number"), (F.count(F.lit(1)).over(pair) > 1).alias("shown"))


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY 'P' || CAST(c_custkey AS STRING)) AS number FROM customer")
def w4_profile_numbers(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.concat(F.lit("P"), F.col("c_custkey").cast("string")))
    return read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.row_number().over(w).cast("long").alias("number"))


@query(f"SELECT doc_id, supp, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, supp ORDER BY seg_order, \"start\", n) AS r FROM ({SPANS})) WHERE r = 1")
def w6_first_occurrence(spark, sf_dir):
    w = Window.partitionBy("doc_id", "supp").orderBy("seg_order", "start", "n")
    return spans(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter("r = 1").select("doc_id", "supp", "n")


@query("SELECT user_id, event_id, lag(event_type) OVER w AS before, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS elapsed, row_number() OVER w AS seq FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w7_w8_w10_event_windows(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("user_id", "event_id", F.lag("event_type").over(w).alias("before"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("elapsed"), F.row_number().over(w).cast("long").alias("seq"))


@query(f"SELECT doc_id, n, count(*) OVER (PARTITION BY doc_id ORDER BY seg_order RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM ({SPANS})")
def w9_neighbourhood(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("seg_order").rangeBetween(-1, 1)
    return spans(spark, sf_dir).select("doc_id", "n", F.count(F.lit(1)).over(w).alias("near"))


@query(f"WITH m AS (SELECT *, max(\"end\") OVER (PARTITION BY doc_id, seg_order ORDER BY \"start\", \"end\", n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM ({SPANS})), i AS (SELECT *, sum(CASE WHEN far IS NULL OR \"start\" - far > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, seg_order ORDER BY \"start\", \"end\", n ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT doc_id, seg_order, CAST(island AS BIGINT) AS island, min(\"start\") AS \"start\", max(\"end\") AS \"end\", count(*) AS n FROM i GROUP BY 1, 2, 3")
def o10_islands(spark, sf_dir):
    return an.gaps_and_islands(spans(spark, sf_dir).drop("n"), ["doc_id", "seg_order"], 2)


@query(f"SELECT user_id, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY duration DESC NULLS LAST, id) AS r FROM ({RUNS})) WHERE r <= 3")
def t2_top3_per_user(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("duration"), "id")
    return runs(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter("r <= 3").select("user_id", "id", "created_at")


@query(f"WITH r AS (SELECT doc_id, n, rank() OVER (PARTITION BY doc_id ORDER BY \"end\" - \"start\" DESC) AS r FROM ({SPANS})) SELECT doc_id, min(n) AS best_n, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'found' END AS status FROM r WHERE r = 1 GROUP BY doc_id")
def t3_best_or_ambiguous(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.col("end") - F.col("start")))
    r = spans(spark, sf_dir).withColumn("r", F.rank().over(w)).filter("r = 1")
    return r.groupBy("doc_id").agg(F.min("n").alias("best_n"), F.when(F.count(F.lit(1)) > 1, "ambiguous").otherwise("found").alias("status"))


@query(f"SELECT doc_id, array_to_string(list_sort(list(DISTINCT supp))[1:5], ',') AS samples FROM ({SPANS}) GROUP BY doc_id")
def t4_samples(spark, sf_dir):
    return spans(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("supp")), 1, 5), ",").alias("samples"))


@query(f"SELECT id, created_at, (SELECT count(*) FROM orders) AS total FROM ({RUNS}) ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def t5_page(spark, sf_dir):
    return an.page(runs(spark, sf_dir).select("id", "created_at"), [F.desc("created_at"), F.col("id")], 40, 20)


@query(f"SELECT doc_id, n, CAST(floor((row_number() OVER (PARTITION BY doc_id ORDER BY seg_order, \"start\", n) - 1) / 3) AS INT) AS batch FROM ({SPANS})")
def t8_batches(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("seg_order", "start", "n")
    return spans(spark, sf_dir).select("doc_id", "n", F.floor((F.row_number().over(w) - 1) / 3).cast("int").alias("batch"))


@query("WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) SELECT user_id, event_id, seq FROM s WHERE seq > 60")
def t9_read_after_cursor(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").withColumn("seq", F.row_number().over(w).cast("long")).filter("seq > 60").select("user_id", "event_id", "seq")


GOLD = f"SELECT DISTINCT doc_id, type, supp FROM ({SPANS}) WHERE n % 5 <> 0"
FOUND = f"SELECT DISTINCT doc_id, type, supp FROM ({SPANS}) WHERE n % 3 <> 0"
_both = f"(SELECT coalesce(g.type, f.type) AS type, g.doc_id IS NOT NULL AS g, f.doc_id IS NOT NULL AS f FROM ({GOLD}) g FULL JOIN ({FOUND}) f ON g.doc_id = f.doc_id AND g.type = f.type AND g.supp = f.supp)"
_ratio = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END, 9) AS \"precision\", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END, 9) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1"
_counts = "count(*) FILTER (g AND f) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT f) AS fn"


@query(f"SELECT type, tp, fp, fn, {_ratio} FROM (SELECT type, {_counts} FROM {_both} GROUP BY type)")
def a7_j13_u2_scores(spark, sf_dir):
    return an.scores(sql(spark, sf_dir, GOLD), sql(spark, sf_dir, FOUND), ["doc_id", "type", "supp"], "type")


@query(f"SELECT critical, type, tp, fp, fn, {_ratio} FROM (SELECT type = 'inn' AS critical, type, {_counts} FROM {_both} GROUP BY ROLLUP (type = 'inn', type))")
def a8_a11_rollup(spark, sf_dir):
    keys = ["doc_id", "type", "supp"]
    by_type = an.scores(sql(spark, sf_dir, GOLD), sql(spark, sf_dir, FOUND), keys, "type").withColumn("critical", F.col("type") == "inn")
    return an.with_ratios(by_type.rollup("critical", "type").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


@query(f"SELECT doc_id, type, supp FROM ({GOLD}) EXCEPT SELECT doc_id, type, supp FROM ({FOUND})")
def u2_missed(spark, sf_dir):
    return sql(spark, sf_dir, GOLD).exceptAll(sql(spark, sf_dir, FOUND))


@query(f"SELECT doc_id, type, supp FROM ({GOLD}) INTERSECT SELECT doc_id, type, supp FROM ({FOUND})")
def u2_hits(spark, sf_dir):
    return sql(spark, sf_dir, GOLD).intersect(sql(spark, sf_dir, FOUND))


@query(f"SELECT doc_id, type, supp FROM ({GOLD}) UNION ALL SELECT doc_id, type, supp FROM ({FOUND})")
def u1_u6_union(spark, sf_dir):
    return sql(spark, sf_dir, GOLD).unionByName(sql(spark, sf_dir, FOUND))


@query(f"WITH p AS (SELECT doc_id, seg_order AS cluster, type AS party, count(*) AS n FROM ({SPANS}) GROUP BY 1, 2, 3), b AS (SELECT doc_id, cluster, max(n) AS best, sum(n) AS n FROM p GROUP BY 1, 2) SELECT doc_id, round(sum(best) / sum(n), 9) AS purity FROM b GROUP BY doc_id")
def a10_purity(spark, sf_dir):
    return an.purity(spans(spark, sf_dir).select("doc_id", F.col("seg_order").alias("cluster"), F.col("type").alias("party")))


@query("SELECT c_custkey AS doc_id, '[ИНН]' AS marker, CAST(c_custkey % 5 - 2 AS BIGINT) AS extra FROM customer WHERE c_custkey % 5 > 2")
def a12_duplicate_markers(spark, sf_dir):
    """Two groups with one marker and a replacement each, and texts that show it none to four times."""
    c = read(spark, sf_dir, "customer")
    groups = c.selectExpr("c_custkey AS doc_id", "'[ИНН]' AS marker", "1L AS n_refs")
    return quality.duplicate_markers(groups.unionByName(groups), c.selectExpr("c_custkey AS doc_id", "repeat('x [ИНН] ', CAST(c_custkey % 5 AS INT)) AS text"))


@query("SELECT c_custkey AS doc_id, 'G1' AS group_id, CASE WHEN c_custkey % 4 = 2 THEN '[А],[Б]' ELSE '[А],[Б],[ИНН 1]' END AS labels FROM customer WHERE c_custkey % 4 IN (2, 3) UNION ALL SELECT c_custkey, 'G1', '[А],[ИНН 1]' FROM customer WHERE c_custkey % 4 = 1")
def a12_inconsistent_markers(spark, sf_dir):
    """Groups of two or three replacements of which none, one or two show another label than the group's."""
    c = read(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", "'G1' AS group_id", "'[ИНН 1]' AS canonical_label", "CASE WHEN c_custkey % 4 = 3 THEN 3L ELSE 2L END AS n_refs")
    shown = c.filter("doc_id % 4 > 0").selectExpr("doc_id", "group_id", "explode(IF(doc_id % 4 = 1, array('[А]'), array('[А]', '[Б]'))) AS label")
    return quality.inconsistent_markers(c, shown).withColumn("labels", F.array_join("labels", ","))


@query(f"SELECT doc_id, 'G' || supp AS group_id, CASE max(n % 3) WHEN 0 THEN 'possible' WHEN 1 THEN 'probable' ELSE 'confirmed' END AS level FROM ({SPANS}) GROUP BY doc_id, supp")
def a5_best_levels(spark, sf_dir):
    level = F.element_at(F.array(*map(F.lit, planning.LEVELS)), F.col("n") % 3 + 1)
    return planning.best_levels(spans(spark, sf_dir).select("doc_id", F.concat(F.lit("G"), F.col("supp").cast("string")).alias("group_id"), level.alias("level")))


@query(f"SELECT doc_id, CASE WHEN n > 4 THEN 'type_not_requested' ELSE 'visible_contract_term' END AS reason, count(*) AS n FROM ({SPANS}) GROUP BY 1, 2")
def a6_skipped_by_reason(spark, sf_dir):
    return planning.skipped_by_reason(spans(spark, sf_dir).select("doc_id", F.when(F.col("n") > 4, "type_not_requested").otherwise("visible_contract_term").alias("reason")))


@query(f"SELECT o_orderkey AS doc_id, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({SPANS}) WHERE type = 'person' GROUP BY 1) s ON doc_id = o_orderkey WHERE o_orderkey % 50 = 0")
def a9_negative_finds(spark, sf_dir):
    clean = read(spark, sf_dir, "orders").filter("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("doc_id"))
    return quality.negative_finds(spans(spark, sf_dir).filter("type = 'person'"), clean)


@query("""WITH m AS (SELECT c_nationkey AS doc_id, c_custkey, c_mktsegment AS party, 'P' || c_custkey % 5 AS profile_id, CASE WHEN c_custkey % 7 < 4 THEN lower(c_mktsegment) WHEN c_custkey % 7 < 6 THEN 'other' END AS role FROM customer WHERE c_custkey % 3 <> 0)
SELECT 1.0::DOUBLE AS cluster_purity, round(count(role) / count(*), 9) AS role_coverage, round(count(*) FILTER (role <> 'other') / count(role), 9) AS role_accuracy FROM m""")
def a10_role_measures(spark, sf_dir):
    c = read(spark, sf_dir, "customer").selectExpr("CAST(c_nationkey AS BIGINT) AS doc_id", "'inn' AS type", "CAST(c_custkey AS STRING) AS value", "c_mktsegment AS party", "array(lower(c_mktsegment)) AS roles", "c_custkey")
    members = c.filter("c_custkey % 3 <> 0").selectExpr("doc_id", "concat('P', c_custkey % 5) AS profile_id", "type", "value", "CASE WHEN c_custkey % 7 < 4 THEN lower(party) WHEN c_custkey % 7 < 6 THEN 'other' END AS role")
    return quality.role_measures(c.drop("c_custkey"), members)


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the ', ''))) / 4 AS BIGINT) AS n FROM documents")
def a13_occurrences(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", an.occurrences(F.col("text"), F.lit("the ")).alias("n"))


@query(f"SELECT doc_id, type, array_to_string(list_transform(list_sort(list(DISTINCT seg_order + 1)), lambda x: CAST(x AS STRING)), ',') AS pages FROM ({SPANS}) GROUP BY 1, 2")
def a27_marker_legend(spark, sf_dir):
    return spans(spark, sf_dir).groupBy("doc_id", "type").agg(F.array_join(F.array_sort(F.collect_set(F.col("seg_order") + 1)), ",").alias("pages"))


@query(f"SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS base_n, coalesce(b.n, 0) AS other_n, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM (SELECT user_id, count(*) AS n FROM ({RUNS}) WHERE status = 'done' GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS n FROM ({RUNS}) WHERE status = 'failed' GROUP BY 1) b ON a.user_id = b.user_id")
def j14_run_comparison(spark, sf_dir):
    r = runs(spark, sf_dir)
    return quality.compare_runs(r.filter("status = 'done'"), r.filter("status = 'failed'"), "user_id")


@query(f"SELECT user_id, id FROM ({RUNS}) r WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = r.user_id AND c.c_acctbal < 0) AND lower(node_hint) LIKE '%high%'")
def j11_f12_semi(spark, sf_dir):
    c = read(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return runs(spark, sf_dir).filter(F.col("node_hint").ilike("%high%")).join(c, "user_id", "left_semi").select("user_id", "id")


@query("SELECT round(sum(quality * n) / sum(n), 9) AS q, CAST(sum(n) AS BIGINT) AS n FROM (SELECT quality, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY quality)")
def j2_label_share(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.agg(F.round(F.sum("quality") / F.count(F.lit(1)), 9).alias("q"), F.count(F.lit(1)).alias("n"))


EDGES = "SELECT o_orderkey AS src, CAST(floor(o_orderkey / 3) AS BIGINT) AS dst FROM orders"


@query("WITH RECURSIVE e AS (" + EDGES + "), r AS (SELECT CAST(o_orderkey AS BIGINT) AS node FROM orders WHERE o_orderkey % 50 = 1 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def o11_taint_closure(spark, sf_dir):
    seeds = read(spark, sf_dir, "orders").filter("o_orderkey % 50 = 1").select(F.col("o_orderkey").alias("node"))
    return an.taint(seeds, sql(spark, sf_dir, EDGES))
