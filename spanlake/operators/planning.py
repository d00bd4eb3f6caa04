"""From spans to a mask plan: references, groups, markers, replacements, masked text, and decisions.

Spans are (doc_id, seg_order, start, end, text, type, confidence). All windows and groups are
per document; a document is the largest unit that one task gathers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlake.functions import normalize as nz
from spanlake.functions.spans import greedy, replace_spans
from spanlake.operators.folds import by_group
from spanlake.operators.rules import iso_date

TEXT_ORDER = ("seg_order", "start", "end", "type")
#: Decisions from the strongest to the weakest.
PRECEDENCE = ("critical_guard", "entity", "profile", "type", "judge", "default")


def with_refs(spans: DataFrame) -> DataFrame:
    """ref E1.. in text order within the document."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*TEXT_ORDER))
    return spans.withColumn("ref", F.concat(F.lit("E"), n.cast("string"))).withColumn("ref_n", n)


def with_level(spans: DataFrame, signals: Column | None = None) -> DataFrame:
    """confirmed, probable or possible: critical types and checked values are confirmed, two signals confirm, open names alone are possible."""
    checked = F.expr("type IN ('inn','ogrn','snils','kpp','registry_key','power_of_attorney_number','ip_address') OR (type = 'bank_account' AND confidence >= 1)")
    many = (signals if signals is not None else F.lit(1)) >= 2
    name = F.col("type").isin("person", "org_name") & F.col("text").rlike(r"(?U)^\P{L}*\p{Lu}\w*(\s+\P{L}*\p{Lu}\w*)*\P{L}*$")
    return spans.withColumn("level", F.when(F.expr(nz.is_critical("type")) | checked | many, "confirmed").when(name, "possible").otherwise("probable"))


def signal_counts(spans: DataFrame) -> DataFrame:
    """Each span with the number of distinct detectors whose spans of its type overlap it (an equi join on segment and type)."""
    a, b = spans.alias("a"), spans.alias("b")
    on = "a.doc_id = b.doc_id AND a.seg_order = b.seg_order AND a.type = b.type AND a.start < b.end AND b.start < a.end"
    keys = [F.col(f"a.{c}") for c in ("doc_id", "seg_order", "start", "end", "type", "detector")]
    return a.join(b, F.expr(on)).groupBy(*keys).agg(F.countDistinct("b.detector").alias("signals"))


def with_party_numbers(profiles: DataFrame) -> DataFrame:
    """doc_id, profile_id, label, party_n: profiles of a role numbered in the string order of their ids."""
    one = profiles.select("doc_id", "profile_id", "label").distinct()
    return one.withColumn("party_n", F.when(F.col("label").isNotNull(), F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("profile_id"))))


def apart(groups: list[dict]) -> list[dict]:
    """Markers of a document's groups, in the order of their first place: a marker that another subject has already gets the first
    free number from 2 on."""
    owner: dict[str, str] = {}
    out = []
    for g in sorted(groups, key=lambda g: g["first_n"]):
        marker, canonical, n = g["marker"], g["canonical_label"], 2
        while owner.get(marker, g["subject"]) != g["subject"]:
            marker, canonical = (f"[{x}{sep}{n}]" for x, sep in ((g["stem"], "-"), (g["title"], " ")))
            n += 1
        owner[marker] = g["subject"]
        out.append({"doc_id": g["doc_id"], "group_id": g["group_id"], "marker": marker, "canonical_label": canonical})
    return out


def plan(spans: DataFrame, requested: tuple[str, ...] | None = None, profiles: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(replacements, groups, skipped) of a mask plan.

    Without requested types all types are masked but delivery and payment terms; with them only
    those. Where an amount is also the contract's amount, one replacement of the latter stays.
    Groups are values by key and profile in the order of their first place. A value of a party with a role (profiles: doc_id, ref,
    profile_id, label) has the role and the party's number in its marker; others carry a number where their type has several
    groups in the document. Different subjects never share a marker.
    """
    named = with_refs(spans).withColumn("key", F.expr(nz.group_key("type", "text", f"CASE WHEN type IN ('date', 'birth_date') THEN {iso_date('x')} END".replace("x.text", "text"))))
    named = named.withColumn("subject", F.expr(nz.subject("type", "text")))
    if profiles is None:
        named = named.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("profile_id", "string"), ("role", "string"), ("party_n", "int"))))
    else:
        numbers = with_party_numbers(profiles).select("doc_id", "profile_id", F.expr(nz.marker_role("label")).alias("role"), "party_n")
        own = profiles.select("doc_id", "ref", "profile_id").distinct().join(numbers, ["doc_id", "profile_id"])
        named = named.join(own, ["doc_id", "ref"], "left")
    # what belongs to the document and not to a party is one value in all profiles
    owned = F.col("type").isin(*nz.DOCUMENT_OWNED)
    for c in ("profile_id", "role", "party_n"):
        named = named.withColumn(c, F.when(~owned, F.col(c)))
    if requested is None:
        reason = F.when(F.col("type").isin(*nz.VISIBLE_TERMS), F.lit("visible_contract_term"))
    else:
        reason = F.when(~F.col("type").isin(*requested), F.lit("type_not_requested"))
    named = named.withColumn("reason", reason)
    skipped = named.filter("reason IS NOT NULL").select("doc_id", "ref", "type", "reason")
    place = Window.partitionBy("doc_id", "seg_order", "start", "end")
    pending = named.filter("reason IS NULL").withColumn("both", F.max((F.col("type") == "contract_amount").cast("int")).over(place)).filter("NOT (type = 'money' AND both = 1)")
    pending = pending.withColumn("party", F.coalesce("profile_id", F.lit("")))
    first = lambda c: F.min_by(c, "ref_n").alias(c)
    groups = pending.groupBy("doc_id", "type", "key", "party").agg(F.min("ref_n").alias("first_n"), F.min_by("text", "ref_n").alias("sample"), F.count(F.lit(1)).alias("n_refs"), first("subject"), first("role"), first("party_n"))
    pair = Window.partitionBy("doc_id", "type", "role")
    groups = groups.withColumn("number", F.row_number().over(pair.orderBy("first_n"))).withColumn("in_type", F.count(F.lit(1)).over(pair))
    groups = groups.withColumn("group_id", F.concat(F.lit("G"), F.row_number().over(Window.partitionBy("doc_id").orderBy("first_n")).cast("string")))
    shown = "CASE WHEN role IS NOT NULL THEN party_n WHEN in_type > 1 THEN number END"
    role_word = "concat(left(role, 1), lower(replace(substring(role, 2), '-', ' ')))"
    groups = groups.withColumn("stem", F.expr(f"concat_ws('-', role, {nz.lookup('type', 2)})")).withColumn("title", F.expr(f"concat_ws(' ', {role_word}, {nz.lookup('type', 3)})"))
    groups = groups.withColumn("marker", F.expr(nz.marker("role", nz.lookup("type", 2), shown))).withColumn("canonical_label", F.expr(f"'[' || concat_ws(' ', title, CAST({shown} AS STRING)) || ']'"))
    # only markers of several subjects of a document need to be told apart, one after another
    subjects = groups.groupBy("doc_id", "marker").agg(F.countDistinct("subject").alias("n")).filter("n > 1").select("doc_id").distinct()
    clashing = groups.join(subjects, "doc_id", "left_semi").select("doc_id", "group_id", "first_n", "subject", "marker", "canonical_label", "stem", "title")
    renamed = by_group(clashing, ["doc_id"], apart, "doc_id long, group_id string, marker string, canonical_label string").withColumnRenamed("marker", "marker2").withColumnRenamed("canonical_label", "label2")
    groups = groups.join(renamed, ["doc_id", "group_id"], "left").withColumn("marker", F.coalesce("marker2", "marker")).withColumn("canonical_label", F.coalesce("label2", "canonical_label")).drop("marker2", "label2", "stem", "title")
    replacements = pending.join(groups.select("doc_id", "type", "key", "party", "group_id", "marker"), ["doc_id", "type", "key", "party"])
    return replacements, groups, skipped


#: Levels from the weakest to the strongest.
LEVELS = ("possible", "probable", "confirmed")


def best_levels(replacements: DataFrame) -> DataFrame:
    """doc_id, group_id, level: the strongest level of a group's spans."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    return replacements.groupBy("doc_id", "group_id").agg(F.max_by("level", rank).alias("level"))


def skipped_by_reason(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def masked(segments: DataFrame, replacements: DataFrame) -> DataFrame:
    """Segments with the markers put in: doc_id, seg_order, text, masked."""
    per = replacements.groupBy("doc_id", "seg_order").agg(F.array_sort(F.collect_list(F.struct("start", "end", "marker"))).alias("repl"))
    out = segments.join(per, ["doc_id", "seg_order"], "left")
    return out.select("doc_id", "seg_order", "text", F.expr(f"IF(repl IS NULL, text, {replace_spans('text', 'repl')})").alias("masked"))


def annotated(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """Segments with each span shown as ⟦TYPE:value⟧."""
    shown = spans.withColumn("marker", F.concat(F.lit("⟦"), F.upper("type"), F.lit(":"), F.col("text"), F.lit("⟧")))
    return masked(segments, shown).withColumnRenamed("masked", "annotated")


def leaks(masked_segments: DataFrame, replacements: DataFrame) -> DataFrame:
    """Accepted values that still occur in their document's masked text outside markers: doc_id, seg_order, value, in_number.

    in_number: the value is nowhere there but inside a longer run of digits, so it may be a part of another number.
    A value is looked for as it is and with its white space collapsed, in the text and in the collapsed text. Values meet only
    segments that hold their first word, outside markers.
    """
    bare = masked_segments.withColumn("bare", F.regexp_replace("masked", r"\[[^\[\]]*\]", "\u0000"))
    bare = bare.withColumn("flat", F.trim(F.regexp_replace("bare", r"(?U)\s+", " ")))
    # the first word may stand inside a longer word of the text, so its letters or digits are looked for as parts of words
    values = replacements.select("doc_id", F.col("text").alias("value")).distinct().withColumn("flat_value", F.trim(F.regexp_replace("value", r"(?U)\s+", " ")))
    head = lambda c: F.xxhash64(F.lower(F.substring(F.regexp_extract(c, r"(?U)([\p{L}\p{N}]+)", 1), 1, 2)))
    values = values.withColumn("h", head(F.col("value")))
    pairs = "array_distinct(flatten(transform(regexp_extract_all(lower(bare), '(?U)[\\\\p{L}\\\\p{N}]+', 0), w -> transform(sequence(1, length(w)), i -> xxhash64(substring(w, i, 2))))))"
    spread = bare.withColumn("h", F.explode(F.concat(F.expr(pairs), F.array(F.xxhash64(F.lit(""))))))
    found = F.expr("instr(bare, value) > 0 OR instr(flat, flat_value) > 0")
    whole = lambda v: f"concat(IF({v} RLIKE '^[0-9]', '(?<![0-9])', ''), '\\\\Q', replace({v}, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E', IF({v} RLIKE '[0-9]$', '(?![0-9])', ''))"
    columns = ("doc_id", "seg_order", "value", F.expr(f"NOT (bare RLIKE {whole('value')} OR flat RLIKE {whole('flat_value')})").alias("in_number"))
    # a one-letter first word is the beginning of any pair, so such values are tested on every segment of their document
    short = F.length(F.regexp_extract("value", r"(?U)([\p{L}\p{N}]*)", 1)) < 2
    hits = spread.join(values.filter(~short), ["doc_id", "h"]).filter(found).select(*columns)
    return hits.unionByName(bare.join(values.filter(short), "doc_id").filter(found).select(*columns)).distinct()


def page_accounting(source: DataFrame, artifact: DataFrame, replacements: DataFrame) -> DataFrame:
    """Where an artifact keeps more places of a value than its source less the planned replacements: doc_id, page, value, extra.

    source and artifact: doc_id, page, text; replacements: doc_id, page, text. Counts of the planned values are joined by page.
    """
    planned = replacements.filter(F.length("text") > 0).groupBy("doc_id", "page", F.col("text").alias("value")).agg(F.count(F.lit(1)).alias("planned"))
    count = lambda c: (F.length(c) - F.length(F.replace(c, F.col("value"), F.lit("")))) / F.length("value")
    both = planned.join(source.select("doc_id", "page", F.col("text").alias("was")), ["doc_id", "page"]).join(artifact.select("doc_id", "page", F.col("text").alias("now")), ["doc_id", "page"])
    extra = (count(F.col("now")) - F.greatest(F.lit(0), count(F.col("was")) - F.col("planned"))).cast("long")
    return both.select("doc_id", "page", "value", F.least(extra, "planned").alias("extra")).filter("extra > 0")


def accepted_candidates(candidates: DataFrame, segments: DataFrame, known: DataFrame, types: tuple[str, ...], most: float = 0.6) -> DataFrame:
    """A model's candidates (doc_id, n, seg_order, type, text, confidence) that stand verbatim in their segment, at their first place,
    over no known span and no candidate before them; their confidence is at most `most`."""
    placed = candidates.filter(F.col("type").isin(*types) & (F.length("text") > 0)).join(segments.select("doc_id", "seg_order", F.col("text").alias("whole")), ["doc_id", "seg_order"])
    placed = placed.withColumn("start", F.instr("whole", F.col("text")) - 1).filter("start >= 0").withColumn("end", F.col("start") + F.length("text")).drop("whole")
    on = "a.doc_id = b.doc_id AND a.seg_order = b.seg_order AND a.start < b.end AND b.start < a.end"
    free = placed.alias("a").join(known.alias("b"), F.expr(on), "left_anti")
    kind = "array<struct<n:int,start:int,end:int,text:string,type:string,confidence:double>>"
    raw = F.array_sort(F.collect_list(F.struct(F.col("n").cast("int").alias("n"), "start", "end", "text", "type", F.coalesce(F.col("confidence").cast("double"), F.lit(most)).alias("confidence"))))
    kept = free.groupBy("doc_id", "seg_order").agg(raw.alias("raw")).withColumn("x", F.explode(F.expr(greedy(f"CAST(raw AS {kind})", kind))))
    return kept.select("doc_id", "seg_order", "x.start", "x.end", "x.text", "x.type", F.least("x.confidence", F.lit(most)).alias("confidence"))


#: Types that are never asked about, and types by which profiles are linked.
SILENT_TYPES = ("ip_address", "registry_key")
LINK_TYPES = ("inn", "ogrn", "snils", "person")


def policy_questions(spans: DataFrame, profiles: DataFrame | None = None, allow_critical: bool = False) -> DataFrame:
    """doc_id, question_id, kind, target, found, samples (five at most), linked: a question per type, per profile and for spans
    of no profile. Critical types are masked without asking unless allowed; a profile of critical types only is not asked about.
    spans: with ref, type, text and critical or not by type; profiles: doc_id, ref, profile_id."""
    s = spans.withColumn("critical", F.expr(nz.is_critical("type")))
    open_ = F.lit(True) if allow_critical else ~F.col("critical")
    samples = F.slice(F.array_sort(F.collect_set("text")), 1, 5).alias("samples")
    found = F.count(F.lit(1)).alias("found")
    none = F.lit(None).cast("array<string>")
    out = s.filter(open_ & ~F.col("type").isin(*SILENT_TYPES)).groupBy("doc_id", F.col("type").alias("target")).agg(found, samples)
    out = out.select("doc_id", F.concat(F.lit("TYPE-"), "target").alias("question_id"), F.lit("type").alias("kind"), "target", "found", "samples", none.alias("linked"))
    if profiles is None:
        return out
    m = s.join(profiles.select("doc_id", "ref", "profile_id").distinct(), ["doc_id", "ref"], "left").withColumn("target", F.coalesce("profile_id", F.lit("UNASSIGNED")))
    asked = m.groupBy("doc_id", "target").agg(found, samples, F.max(open_.cast("int")).alias("open")).filter("open = 1")
    keys = m.filter(F.col("profile_id").isNotNull() & F.col("type").isin(*LINK_TYPES)).select("doc_id", "target", F.expr(nz.group_key("type", "text")).alias("key")).distinct()
    links = keys.join(keys.withColumnRenamed("target", "other"), ["doc_id", "key"]).filter("target <> other").groupBy("doc_id", "target").agg(F.array_sort(F.collect_set("other")).alias("linked"))
    asked = asked.join(links, ["doc_id", "target"], "left")
    return out.unionByName(asked.select("doc_id", F.concat(F.lit("PROFILE-"), "target").alias("question_id"), F.lit("profile").alias("kind"), "target", "found", "samples", "linked"))


def review(spans: DataFrame, edits: DataFrame, added: DataFrame, types: tuple[str, ...], revision: int) -> DataFrame:
    """The next revision of a document's spans after an operator's edits (doc_id, ref, action, new_type): unknown references, types
    and actions change nothing, keeping a critical type is refused, added spans come in, and references are numbered anew."""
    e = edits.groupBy("doc_id", "ref").agg(F.max(F.when(F.col("action").isin("mask", "keep"), F.col("action"))).alias("action"), F.max(F.when(F.col("new_type").isin(*types), F.col("new_type"))).alias("new_type"))
    s = spans.drop("ref_n").withColumnRenamed("ref", "old_ref").join(e.withColumnRenamed("ref", "old_ref"), ["doc_id", "old_ref"], "left")
    s = s.withColumn("type", F.coalesce("new_type", "type")).withColumn("refused", (F.col("action") == "keep") & F.expr(nz.is_critical("type")))
    decided = F.when(F.col("refused"), "critical_guard").when(F.col("action").isNotNull(), "entity").otherwise("default")
    s = s.withColumn("decided_by", decided).withColumn("action", F.when(F.col("refused"), "mask").otherwise(F.coalesce("action", F.lit("mask")))).drop("new_type", "refused")
    more = added.filter(F.col("type").isin(*types)).withColumn("decided_by", F.lit("entity")).withColumn("action", F.lit("mask"))
    return with_refs(s.unionByName(more, allowMissingColumns=True)).withColumn("revision", F.lit(revision))


def judge(spans: DataFrame) -> DataFrame:
    """score, ask and question Q1.. per (type, key) group below 0.75; critical types are never asked about."""
    score = F.least(F.lit(1.0), F.col("confidence") + F.coalesce(F.col("profile_bonus"), F.lit(0.0)))
    s = spans.withColumn("score", score).withColumn("ask", (F.col("score") < 0.75) & ~F.expr(nz.is_critical("type")))
    first = Window.partitionBy("doc_id").orderBy("first_n")
    asked = s.filter("ask").groupBy("doc_id", "type", "key").agg(F.min("ref_n").alias("first_n")).withColumn("question_id", F.concat(F.lit("Q"), F.row_number().over(first).cast("string")))
    return s.join(asked.drop("first_n"), ["doc_id", "type", "key"], "left").withColumn("action", F.when(F.col("ask"), "ask").otherwise("mask"))


def resolve_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Each question's option: the answer if it is one of the options, else the default; unknown answers are listed as ignored."""
    q, a = questions.alias("q"), answers.alias("a")
    out = q.join(a, F.expr("q.run_id = a.run_id AND q.question_id = a.question_id"), "full")
    known = F.col("q.question_id").isNotNull()
    valid = F.coalesce(F.array_contains("q.options", F.col("a.option")), F.lit(False))
    status = F.when(~known, "ignored").when(F.col("a.option").isNull(), "unanswered").when(valid, "human").otherwise("invalid")
    return out.select(F.coalesce("q.run_id", "a.run_id").alias("run_id"), F.coalesce("q.question_id", "a.question_id").alias("question_id"), F.when(known, F.when(valid, F.col("a.option")).otherwise(F.col("q.default"))).alias("option"), status.alias("status"))


def decide(candidates: DataFrame) -> DataFrame:
    """One decision per reference out of candidates (doc_id, ref, type, decided_by, action, confirmed): the strongest source
    wins, but a critical type stays masked unless its release is confirmed; the losers are kept as a list."""
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("decided_by"))
    ordered = F.array_sort(F.collect_list(F.named_struct(F.lit("rank"), rank.cast("int"), F.lit("decided_by"), F.col("decided_by"), F.lit("action"), F.col("action"), F.lit("confirmed"), F.col("confirmed"))))
    per = candidates.groupBy("doc_id", "ref", "type").agg(ordered.alias("all"))
    per = per.withColumn("first", F.expr("all[0]"))
    guard = F.expr(nz.is_critical("type")) & ~((F.col("first.action") == "keep") & F.col("first.confirmed"))
    return per.select("doc_id", "ref", "type", F.when(guard, "mask").otherwise(F.col("first.action")).alias("action"), F.when(guard, "critical_guard").otherwise(F.col("first.decided_by")).alias("decided_by"), F.expr(f"array_join(transform(IF({nz.is_critical('type')} AND NOT (first.action = 'keep' AND first.confirmed), all, slice(all, 2, size(all))), x -> x.decided_by), ',')").alias("overridden"))
