"""Writers: versioned tables and report JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(df: DataFrame, path: str, run_id: str, revision: int) -> str:
    """A complete set of artifacts under a run and a revision, in a fresh folder; a pointer row names it when it is whole, so a
    reader of `published` sees the old set or the new one, never a part."""
    spark = df.sparkSession
    root = f"{path.rstrip('/')}/run_id={run_id}/revision={revision}"
    target = f"{root}/set={uuid.uuid4().hex}"
    df.write.parquet(target)
    now = spark.createDataFrame([(target,)], "target string").select("target", F.current_timestamp().alias("at"))
    now.coalesce(1).write.mode("append").json(f"{root}/_pointer")
    return target


def published(spark: SparkSession, path: str, run_id: str, revision: int) -> DataFrame:
    """The set that was published last."""
    root = f"{path.rstrip('/')}/run_id={run_id}/revision={revision}"
    last = spark.read.schema("target string, at timestamp").json(f"{root}/_pointer").orderBy(F.desc("at"), "target").first()
    return spark.read.parquet(last["target"])


def metrics_companion(events: DataFrame) -> DataFrame:
    """What differs between equal runs, kept out of the report: one JSON row per run with the milliseconds of its stages."""
    stages = events.groupBy("run_id", "stage").agg(F.sum("ms").alias("ms"), F.count(F.lit(1)).alias("n"))
    per = stages.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("stage", "ms", "n"))).alias("stages"), F.sum("ms").alias("total_ms"))
    return per.select("run_id", F.to_json(F.struct("total_ms", "stages")).alias("metrics"))


def write_traces(calls: DataFrame, path: str) -> None:
    """Calls of a model (run_id, n, node, request, response) as JSON lines and as readable Markdown, a folder per run."""
    calls.write.mode("overwrite").partitionBy("run_id").json(f"{path.rstrip('/')}/jsonl")
    text = F.concat(F.lit("## "), F.col("n").cast("string"), F.lit(". "), "node", F.lit("\n\n### Request\n\n"), "request", F.lit("\n\n### Response\n\n"), "response", F.lit("\n"))
    whole = calls.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))).alias("parts"))
    whole.select("run_id", F.array_join(F.col("parts.t"), "\n").alias("value")).write.mode("overwrite").partitionBy("run_id").text(f"{path.rstrip('/')}/md")


def records(spans: DataFrame) -> DataFrame:
    """Spans as flat report records: reference, type with its names, place, value and how it was found."""
    from spanlake.functions import normalize as nz

    cols = [F.expr(nz.lookup("type", 1)).alias("title"), F.expr(nz.is_critical("type")).alias("critical")]
    return spans.select("doc_id", "ref", "type", *cols, "seg_order", "start", "end", "text", F.length("text").alias("length"), F.round("confidence", 4).alias("confidence"), F.expr(nz.group_key("type", "text")).alias("key"))


def report(doc: DataFrame, groups: DataFrame, skipped: DataFrame) -> DataFrame:
    """One JSON document per document: its groups and its skipped references, ordered, so equal inputs give equal bytes."""
    g = groups.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first_n", "group_id", "type", "marker", "n_refs"))).alias("groups"))
    s = skipped.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ref", "type", "reason"))).alias("skipped"))
    out = doc.select("doc_id").distinct().join(g, "doc_id", "left").join(s, "doc_id", "left")
    return out.select("doc_id", F.to_json(F.struct("groups", "skipped")).alias("report"))


def write_report(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)
