"""From segments, or files, to masked text in one call: detection, resolution, sweep, parties, plan, masking and proof.

    result = mask(segments)                      # doc_id long, seg_order int, text string
    result = mask_files(spark, "/contracts")     # office and text files
    result.masked, result.groups, result.leaks, result.report

Every step is a DataFrame operator; spans that later steps read several times are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlake.functions import normalize as nz
from spanlake.operators import filters, folds, planning, rules, texts
from spanlake.operators.store import written
from spanlake.sources import documents, redact, sinks

COLUMNS = ("doc_id", "seg_order", "start", "end", "text", "type", "confidence")


@dataclass(frozen=True)
class Detector:
    """A function from segments to spans; priority decides between overlapping spans of several detectors, source is `rule` or
    what else found them (a model's spans may be cut where a rule's may not)."""

    name: str
    detect: Callable[[DataFrame], DataFrame]
    priority: int
    source: str = "rule"


#: Priorities of the built-in detectors.
DETECTORS = (
    Detector("rules", rules.detect_rules, 100),
    Detector("dates", rules.detect_dates, 94),
    Detector("organisations", texts.detect_orgs, 91),
    Detector("addresses", texts.detect_addresses, 90),
    Detector("amounts", lambda s: rules.detect_money(s).filter("type = 'contract_amount'"), 85),
    Detector("terms", rules.detect_terms, 85),
    Detector("money", lambda s: rules.detect_money(s).filter("type = 'money'"), 84),
)
#: With rules only, what reads amounts and names is left out.
RULES_ONLY = ("rules", "dates", "addresses", "amounts", "terms")


@dataclass(frozen=True)
class Result:
    segments: DataFrame
    spans: DataFrame
    profiles: DataFrame
    replacements: DataFrame
    groups: DataFrame
    skipped: DataFrame
    masked: DataFrame
    leaks: DataFrame
    report: DataFrame


def detect(segments: DataFrame, custom: tuple[rules.CustomType, ...] = (), extra: tuple[Detector, ...] = (), rules_only: bool = False) -> DataFrame:
    """Resolved spans of all detectors, and further places of their values: doc_id, seg_order, start, end, text, type, confidence,
    source, detector, priority, signals."""
    used = [d for d in DETECTORS if not rules_only or d.name in RULES_ONLY]
    if custom:
        used.append(Detector("custom", lambda s: rules.detect_custom(s, custom), 95))
    found = None
    for d in (*used, *extra):
        own = d.detect(segments).select(*COLUMNS, F.lit(d.source).alias("source"), F.lit(d.name).alias("detector"), F.lit(d.priority).alias("priority"))
        found = own if found is None else found.unionByName(own)
    found = written(filters.real_persons(filters.complete_requisites(filters.without_public_law(found))))
    kept = written(folds.cross_resolve(found))
    more = texts.sweep(segments, kept).unionByName(texts.propagate(segments, kept.filter("type = 'address'")))
    more = folds.cross_resolve(more.select(*COLUMNS, F.lit("rule").alias("source"), F.lit("sweep").alias("detector"), F.lit(10).alias("priority")))
    spans = kept.unionByName(more)
    signals = planning.signal_counts(found).groupBy("doc_id", "seg_order", "start", "end", "type").agg(F.max("signals").alias("signals"))
    return written(spans.join(signals, ["doc_id", "seg_order", "start", "end", "type"], "left").withColumn("signals", F.coalesce("signals", F.lit(1))))


def parties(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, ref, profile_id, label, confidence of spans with refs: a block's label is the first role that its segment names."""
    roles = texts.role_labels(segments).groupBy("doc_id", "seg_order").agg(F.min_by("role", "start").alias("label"))
    own = spans.filter(~F.col("type").isin(*nz.DOCUMENT_OWNED)).join(roles, ["doc_id", "seg_order"], "left")
    own = own.select("doc_id", "ref", "seg_order", "start", "end", "type", F.expr(nz.group_key("type", "text")).alias("normalized"), "label", F.lit("body").alias("kind"))
    return folds.profiles(own)


def mask(segments: DataFrame, types: tuple[str, ...] | None = None, custom: tuple[rules.CustomType, ...] = (), manual: DataFrame | None = None, extra: tuple[Detector, ...] = (), rules_only: bool = False) -> Result:
    """Masked segments of all documents and what led to them. types: the types to mask (all but delivery and payment terms by
    default); custom: types of the user's own; manual: values that an operator added (doc_id, type, value)."""
    known = (*(t[0] for t in nz.TYPES), *(c.id for c in custom))
    if types is not None:
        filters.of_types(segments.limit(0).withColumn("type", F.lit("")), types, known)
    spans = detect(segments, custom, extra, rules_only)
    if manual is not None:
        own = rules.manual_spans(segments, manual, known).select(*COLUMNS, F.lit("user").alias("source"), F.lit("manual").alias("detector"), F.lit(1000).alias("priority"), F.lit(1).alias("signals"))
        on = "a.doc_id = b.doc_id AND a.seg_order = b.seg_order AND a.start < b.end AND b.start < a.end"
        spans = spans.alias("a").join(own.alias("b"), F.expr(on), "left_anti").unionByName(own)
    spans = written(planning.with_level(planning.with_refs(spans), F.col("signals")))
    profiles = written(parties(segments, spans))
    replacements, groups, skipped = planning.plan(spans.drop("ref", "ref_n"), None if types in (None, ("all",)) else types, profiles)
    replacements, groups = written(replacements), written(groups)
    masked = written(planning.masked(segments, replacements))
    leaks = planning.leaks(masked, replacements).withColumn("kind", F.lit("raw"))
    again = rules.detect_rules(masked.select("doc_id", "seg_order", F.regexp_replace("masked", r"\[[^\[\]]*\]", "\u0000").alias("text")))
    asked = replacements.select("doc_id", "type").distinct()
    again = again.filter(F.expr(nz.is_critical("type"))).join(asked, ["doc_id", "type"], "left_semi")
    leaks = leaks.unionByName(again.select("doc_id", "seg_order", F.col("text").alias("value"), F.lit(False).alias("in_number"), F.lit("detector").alias("kind")))
    return Result(segments, spans, profiles, replacements, groups, skipped, masked, leaks, sinks.report(segments.select("doc_id"), groups, skipped))


def file_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of files with doc_id (a hash of the path), dense seg_order, and the reader's anchors."""
    raw = documents.read_documents(spark, path).withColumn("doc_id", F.xxhash64("path"))
    return raw.withColumn("seg_order", F.row_number().over(Window.partitionBy("doc_id").orderBy("seg_order")) - 1)


def mask_files(spark: SparkSession, path: str, **options) -> tuple[Result, DataFrame]:
    """The result for all files below a path, and the office files with their values replaced (path, content, error)."""
    segments = written(file_segments(spark, path))
    result = mask(segments.select("doc_id", "seg_order", "text"), **options)
    place = result.replacements.select("doc_id", "seg_order", "start", "end", "marker").join(segments, ["doc_id", "seg_order"])
    files = None
    for kind in documents.READERS:
        own = redact.redacted_files(spark, path, kind, place.filter(F.lower("path").endswith(f".{kind}")))
        files = own if files is None else files.unionByName(own)
    return result, files
