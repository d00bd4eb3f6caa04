"""Run analytics and quality measures as DataFrame operators over runs, users, sessions, spans and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def run_summary(runs: DataFrame, by: str) -> DataFrame:
    """Runs by a column: number, success rate of the finished ones (null if none), mean and median duration."""
    done, failed = F.count_if(F.col("status") == "done"), F.count_if(F.col("status") == "failed")
    rate = F.when(done + failed > 0, done / (done + failed))
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(rate, 9).alias("success_rate"), F.round(F.avg("duration"), 6).alias("mean_s"), F.round(F.median("duration"), 6).alias("median_s"))


def user_summary(users: DataFrame, now: Column) -> DataFrame:
    """Totals in one row: all, active, admins, never logged in, active in 7 and 30 days."""
    since = lambda d: F.count_if(F.col("last_login") >= now - F.expr(f"INTERVAL {d} DAYS"))
    return users.agg(F.count(F.lit(1)).alias("total"), F.count_if("active").alias("active"), F.count_if(F.array_contains("roles", "admin")).alias("admins"), F.count_if(F.col("last_login").isNull()).alias("never"), since(7).alias("active_7d"), since(30).alias("active_30d"))


def failures_by_node(runs: DataFrame, top: int = 10) -> DataFrame:
    """Failed runs by node: number, last error and its time; the nodes with most failures."""
    return runs.filter("status = 'failed'").groupBy("node_hint").agg(F.count(F.lit(1)).alias("n"), F.max_by("error", F.struct("finished_at", "id")).alias("last_error"), F.max("finished_at").alias("last_at")).orderBy(F.desc("n"), "node_hint").limit(top)


def session_states(sessions: DataFrame, now: Column) -> DataFrame:
    state = F.when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("expires_at") <= now, "expired").otherwise("active")
    return sessions.groupBy("device", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def per_user(users: DataFrame, runs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Users with their runs, failures, last run and active sessions: both sides aggregated before the joins."""
    r = runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs_total"), F.count_if(F.col("status") == "failed").alias("runs_failed"), F.max("created_at").alias("last_run"))
    s = sessions.groupBy("user_id").agg(F.count_if("active").alias("active_sessions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return users.join(r, "user_id", "left").join(s, "user_id", "left").select("user_id", "name", zero("runs_total"), zero("runs_failed"), "last_run", zero("active_sessions"))


def daily_series(rows: DataFrame, day: Column, first: str, last: str) -> DataFrame:
    """One row per day from first to last with the number of rows, zeros filled in."""
    counts = rows.groupBy(day.cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n0"))
    days = rows.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n0", F.lit(0)).alias("n"))


def scores(gold: DataFrame, found: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Precision, recall and F1 by a key column from distinct gold and found rows (a full outer join)."""
    g = gold.select(*keys).distinct().withColumn("g", F.lit(1))
    f = found.select(*keys).distinct().withColumn("f", F.lit(1))
    both = g.join(f, keys, "full")
    tp, fp, fn = F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()), F.count_if(F.col("g").isNull()), F.count_if(F.col("f").isNull())
    counts = both.groupBy(by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return with_ratios(counts)


def with_ratios(counts: DataFrame) -> DataFrame:
    """precision, recall (1 where nothing was asked) and f1 of columns tp, fp, fn."""
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)
    return counts.withColumn("precision", F.round(p, 9)).withColumn("recall", F.round(r, 9)).withColumn("f1", F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 9))


def gate(metrics: DataFrame, thresholds: dict[str, tuple[str, float]]) -> DataFrame:
    """(metric, value, op, threshold, ok) of a metrics table (metric, value)."""
    rows = metrics.sparkSession.createDataFrame([(k, op, float(t)) for k, (op, t) in thresholds.items()], "metric string, op string, threshold double")
    ok = F.when(F.col("value").isNull(), False).when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return rows.join(metrics, "metric", "left").select("metric", "value", "op", "threshold", ok.alias("ok"))


def purity(members: DataFrame) -> DataFrame:
    """Clusters' purity per document: members of the commonest party in each cluster over all members."""
    n = members.groupBy("doc_id", "cluster", "party").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("doc_id", "cluster").agg(F.max("n").alias("best"), F.sum("n").alias("all"))
    return best.groupBy("doc_id").agg(F.round(F.sum("best") / F.sum("all"), 9).alias("purity"))


def occurrences(text: Column, value: Column) -> Column:
    """How often value stands in text, without overlaps; 0 for an empty value."""
    rest = F.length(text) - F.length(F.replace(text, value, F.lit("")))
    return F.when(F.length(value) > 0, (rest / F.length(value)).cast("long")).otherwise(F.lit(0).cast("long"))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows and the number of all rows beside it."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def gaps_and_islands(spans: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Spans grouped where the next one starts at most `gap` after the furthest end so far."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (far.isNull() | (F.col("start") - far > gap)).cast("int")
    marked = spans.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, width: int, how: str = "inner") -> DataFrame:
    """Rows of right within `width` positions of a row of left: each right row is dealt to its 2 * width + 1 positions, so the join is an equi join."""
    spread = right.withColumn(left_pos, F.explode(F.sequence(F.col(right_pos) - width, F.col(right_pos) + width)))
    return left.join(spread, [*keys, left_pos], how)


def taint(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes (node) that depend on a seed over edges (src -> dst): semi-naive rounds until nothing is new."""
    from spanlake.operators.frontier import grow

    return grow(seeds, edges)
