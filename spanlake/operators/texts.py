"""Detectors and normalisers that read words: organisations, addresses, role labels, sweep, layout repair, contract facts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlake.functions import checksums
from spanlake.functions import normalize as nz
from spanlake.functions.normalize import ORG_FORMS
from spanlake.functions.spans import greedy, quote, spans
from spanlake.operators.rules import AMOUNT_WORDS, L, UI, exploded

#: Types that are looked for again, and the least length of their values.
SWEEP_TYPES = ("contract_number", "inn", "ogrn", "snils", "bik", "kpp", "bank_account", "person", "org_name")
SWEEP_LENGTH = 6
#: Latin letters that look like Cyrillic ones.
LOOK_ALIKE = {
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "K": "К", "M": "М", "O": "О", "P": "Р", "T": "Т", "X": "Х",
    "a": "а", "c": "с", "e": "е", "k": "к", "o": "о", "p": "р", "x": "х", "y": "у",
}
_form = "|".join(re.escape(f).replace(r"\ ", r"\s+") for f in sorted(ORG_FORMS, key=len, reverse=True))
ORG = UI + rf"{L}(?:{_form})\s*(?:«[^»\n]{{1,120}}»|\"[^\"\n]{{1,120}}\"|“[^”\n]{{1,120}}”)"
SOLE = r"(?U)" + rf"{L}(?:ИП|Индивидуальный предприниматель)\s+[А-ЯЁ][а-яё-]+\s+(?:[А-ЯЁ]\.\s?[А-ЯЁ]\.|[А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+)"
PUBLIC_BODY = UI + r"министерств|казначейств|налогов\w+\s+служб|администраци\w+\s+президента"
#: Parts of an address.
INDEX = r"(?<!\d)\d{6}(?!\d)"
SETTLEMENT = r"(?:г\.|город|пос\.|посёлок|с\.|село|дер\.|деревня|пгт)\s*[А-ЯЁ][\w-]+"
REGION = r"[А-ЯЁ][\w-]+\s+(?:обл\.|область|край|республика|район|р-н)"
STREET = r"(?:ул\.|улица|пр-т|проспект|пер\.|переулок|ш\.|шоссе|пл\.|площадь|наб\.|бульвар|б-р)\s*[А-ЯЁ0-9][\w. -]*"
BUILDING = r"(?:д\.|дом|влад\.|корп\.|корпус|стр\.|строение)\s*\d+[А-Яа-я]?"
PREMISES = r"(?:кв\.|квартира|оф\.|офис|пом\.|помещение|комн\.|каб\.)\s*\d+[А-Яа-я]?"
_part = f"(?:{INDEX}|{REGION}|{SETTLEMENT}|{STREET}|{BUILDING}|{PREMISES})"
ADDRESS = rf"(?U){_part}(?:\s*[,;]\s*{_part})+"
ADDRESS_WORDS = UI + r"адрес|место\s+нахождения|проживающ|зарегистрирован"
ROLES = "поставщик|заказчик|исполнитель|подрядчик|покупатель|продавец|арендатор|арендодатель|лицензиар|лицензиат"
PREAMBLE = UI + rf"именуем\w+\s+в\s+дальнейшем\s+[«\"“]?(?:{ROLES})"
ROLE_HEAD = UI + rf"^\s*[«\"“]?(?:{ROLES})[»\"”]?\s*:"


def detect_orgs(segments: DataFrame) -> DataFrame:
    """Legal form with a quoted name, or a sole trader with a full name; public bodies are left out."""
    keep = f"filter(concat({spans('text', ORG)}, {spans('text', SOLE)}), x -> NOT x.text RLIKE {quote(PUBLIC_BODY)})"
    return exploded(segments.withColumn("orgs", F.expr(f"transform({keep}, x -> named_struct('start', x.start, 'end', x.end, 'text', x.text, 'type', 'org_name', 'confidence', 0.9D))")), "orgs")


def detect_addresses(segments: DataFrame) -> DataFrame:
    """Runs of address parts. A settlement with a street or building, or an index with a settlement, is enough; else a
    word of address must stand within 60 characters before. Confidence 0.9, 0.7 or 0.5 by what is there."""
    has = lambda p: f"x.text RLIKE {quote('(?U)' + p)}"
    full = f"(({has(SETTLEMENT)}) AND ({has(STREET)} OR {has(BUILDING)}))"
    near = f"substring(text, greatest(0, x.start - 60) + 1, least(60, x.start)) RLIKE {quote(ADDRESS_WORDS)}"
    score = f"CASE WHEN {full} AND {has(STREET)} AND {has(BUILDING)} THEN 0.9D WHEN {full} OR ({has(INDEX)} AND {has(SETTLEMENT)}) THEN 0.7D WHEN {near} THEN 0.5D END"
    sql = f"filter(transform({spans('text', ADDRESS)}, x -> named_struct('start', x.start, 'end', x.end, 'text', x.text, 'type', 'address', 'confidence', {score})), x -> x.confidence IS NOT NULL)"
    return exploded(segments.withColumn("found", F.expr(sql)), "found")


#: What a part of an address that goes on after a paragraph begins with.
GOES_ON = rf"(?U)^\s*(?:{STREET}|{BUILDING}|{PREMISES})"


def link_split_addresses(segments: DataFrame, found: DataFrame) -> DataFrame:
    """Addresses with `normalized`; the last of a segment that ends in a comma and the first of the next segment, if that goes on
    with a street, a building or premises, are one value and get one key. A window over a document's addresses."""
    s = segments.select("doc_id", "seg_order", F.col("text").alias("whole"))
    own = found.join(s, ["doc_id", "seg_order"]).withColumn("key", F.expr(nz.base("text")))
    w = Window.partitionBy("doc_id").orderBy("seg_order", "start")
    ends = F.trim(F.expr("substring(whole, end + 1)")).startswith(",")
    goes_on = F.expr("substring(whole, start + 1)").rlike(GOES_ON)
    after = lambda c: F.lead(c).over(w)
    before = lambda c: F.lag(c).over(w)
    own = own.withColumn("ends", ends).withColumn("goes_on", goes_on)
    tail = F.col("ends") & (after("seg_order") == F.col("seg_order") + 1) & after("goes_on")
    own = own.withColumn("next_key", F.when(tail, after("key")))
    own = own.withColumn("last_key", F.when(before("next_key").isNotNull(), before("key")))
    return own.withColumn("normalized", F.concat_ws(" ", "last_key", "key", "next_key")).drop("whole", "key", "ends", "goes_on", "next_key", "last_key")


def propagate(segments: DataFrame, found: DataFrame, confidence: float = 0.7) -> DataFrame:
    """Further places of found texts in their own document that no found span covers; of places of several texts that overlap the
    first, then longest, stays. Values meet only segments that hold their first word. Found spans grow with the segments, so
    neither side of a join is broadcast, however small its files are."""
    word = lambda c: F.regexp_extract(c, r"(?U)(\w+)", 1)
    values = found.select("doc_id", "type", F.col("text").alias("value")).distinct().withColumn("word", word(F.col("value"))).filter("word <> ''")
    words = segments.select("doc_id", "seg_order", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)))).alias("word"))
    hits = words.join(values.hint("merge"), ["doc_id", "word"]).filter(F.expr("contains(text, value)"))
    parts = F.expr("split(text, concat('\\\\Q', value, '\\\\E'), -1)")
    places = hits.withColumn("parts", parts).withColumn("start", F.explode(F.expr("transform(sequence(1, size(parts) - 1), i -> length(array_join(slice(parts, 1, i), value)))")))
    places = places.select("doc_id", "seg_order", "start", (F.col("start") + F.length("value")).alias("end"), F.col("value").alias("text"), "type")
    on = "a.doc_id = b.doc_id AND a.seg_order = b.seg_order AND a.start < b.end AND b.start < a.end"
    free = places.alias("a").join(found.alias("b").hint("merge"), F.expr(on), "left_anti")
    kind = "array<struct<start:int,end:int,text:string,type:string>>"
    per = free.groupBy("doc_id", "seg_order").agg(F.collect_list(F.struct("start", "end", "text", "type")).alias("raw"))
    order = "array_sort(raw, (x, y) -> CASE WHEN x.start <> y.start THEN x.start - y.start ELSE y.end - x.end END)"
    kept = per.withColumn("kept", F.explode(F.expr(greedy(f"CAST({order} AS {kind})", kind))))
    return kept.select("doc_id", "seg_order", "kept.*", F.lit(confidence).alias("confidence"))


#: A supply contract's title, and who and what it names.
CONTRACT_TITLE = UI + r"^\s*(?:проект\s+)?договор\s+поставки\s+№"
CONTRACT_SIDES = (UI + r"\b(?:заказчик|покупатель)\b", UI + r"\b(?:поставщик|исполнитель|продавец)\b", UI + r"\bинн\b")
FIRST_PAGE = 6000


def document_kind(segments: DataFrame, answers: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, kind: `contract` by a title with both sides and a taxpayer number on the first page; else what a model's recorded
    answer (doc_id, kind, confidence) says with enough confidence, else `unknown`."""
    w = Window.partitionBy("doc_id").orderBy("seg_order")
    page = segments.withColumn("before", F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("before") < FIRST_PAGE)
    text = F.expr(f"left(text, {FIRST_PAGE} - CAST(before AS INT))")
    has = [F.max(text.rlike(p)) for p in CONTRACT_SIDES]
    rule = page.groupBy("doc_id").agg((F.max(F.col("text").rlike(CONTRACT_TITLE)) & has[0] & has[1] & has[2]).alias("contract"))
    if answers is None:
        answers = segments.sparkSession.createDataFrame([], "doc_id long, kind string, confidence double")
    out = rule.join(answers.select("doc_id", "kind", "confidence"), "doc_id", "left")
    return out.select("doc_id", F.when(F.col("contract"), "contract").when(F.col("confidence") >= least, F.col("kind")).otherwise("unknown").alias("kind"))


#: What words before an amount say that it is for, and how that counts for the contract's price.
PURPOSES = (("vat", -100, ("ндс",)), ("advance", -90, ("аванс", "предоплат")), ("security", -80, ("обеспечени",)), ("penalty", -70, ("пени", "пеня", "штраф", "неустойк")))


def amount_purposes(amounts: DataFrame, segments: DataFrame) -> DataFrame:
    """Amounts with purpose and score: the nearest word to the left within 80 characters says what it is for; else the nearer the
    words of a price in the segment, the higher its score; an amount of a condition on the price is no candidate."""
    s = amounts.join(segments.select("doc_id", "seg_order", F.lower("text").alias("whole")), ["doc_id", "seg_order"])
    left = F.expr("substring(whole, greatest(0, start - 80) + 1, least(80, start))")
    s = s.withColumn("left", left).withColumn("near", F.expr("substring(whole, greatest(0, start - 80) + 1, least(80, start) + end - start + 180)"))
    last = lambda w: F.when(F.contains("left", F.lit(w)), F.length("left") - F.locate(w[::-1], F.reverse("left"))).otherwise(-1)
    found = [F.struct(last(w).alias("at"), F.lit(score).alias("score"), F.lit(name).alias("purpose")) for name, score, words in PURPOSES for w in words]
    s = s.withColumn("mark", F.array_max(F.array(*found)))
    price = [F.when(F.contains("whole", F.lit(w)), F.abs(F.instr("whole", w) - 1 + F.lit(len(w) // 2) - F.col("start"))) for w in AMOUNT_WORDS.split("|")]
    s = s.withColumn("distance", F.least(*price))
    threshold = F.col("near").rlike(UI + r"если\s+цен[аы]\s+контракт\w*\s+превыша\w*")
    purpose = F.when(threshold, "penalty_condition").when(F.col("mark.at") >= 0, F.col("mark.purpose")).when(F.col("distance").isNotNull(), "contract_price").otherwise("unspecified")
    score = F.when(threshold, -1000).when(F.col("mark.at") >= 0, F.col("mark.score")).when(F.col("distance").isNotNull(), 100 - F.col("distance")).otherwise(0)
    return s.withColumn("purpose", purpose).withColumn("score", score.cast("int")).drop("whole", "left", "near", "mark", "distance")


def best_price(rated: DataFrame) -> DataFrame:
    """doc_id, price, purpose, status: the amount of highest score, ambiguous where several share it."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"))
    top = rated.filter("purpose <> 'penalty_condition'").withColumn("r", F.rank().over(w)).filter("r = 1")
    one = F.count(F.lit(1)) == 1
    return top.groupBy("doc_id").agg(F.when(one, F.max("text")).alias("price"), F.when(one, F.max("purpose")).alias("purpose"), F.when(one, "found").otherwise("ambiguous").alias("status"))


def contextual_label(kind: str = "type", text: str = "whole") -> str:
    """SQL: what a date or a registry key is, by the words within 100 characters; other types by their own name. Columns start, end."""
    before = f"lower(substring({text}, greatest(0, start - 100) + 1, least(100, start)))"
    after = f"lower(substring({text}, end + 1, 100))"
    near = f"concat({before}, ' ', {after})"
    licence = quote(UI + r"Л\d{3}-\d{5}-\d{2}/\d{8}")
    date = (
        f"CASE WHEN {before} RLIKE {quote(UI + r'срок\s+лицензи|лицензи\w*\s*[—-]?\s*до\s*$')} THEN 'Срок действия лицензии' WHEN contains({before}, 'доверенност') THEN 'Дата доверенности' "
        f"WHEN contains({before}, 'переоформлен') THEN 'Дата переоформления лицензии' WHEN contains({before}, 'регистрационн') THEN 'Дата регистрации лицензии' "
        f"WHEN {before} RLIKE {licence} THEN 'Дата выдачи лицензии' "
        f"WHEN contains({near}, 'лицензи') THEN 'Дата выдачи лицензии' WHEN contains({near}, 'договор') OR contains({near}, 'контракт') THEN 'Дата договора' ELSE 'Дата' END"
    )
    codes = {"икз": "Идентификационный код закупки", "кбк": "КБК", "окпо": "ОКПО", "октмо": "ОКТМО", "окато": "ОКАТО"}
    at = ", ".join(f"named_struct('at', IF(contains({before}, '{w}'), length({before}) - locate('{w[::-1]}', reverse({before})), -1), 'title', '{t}')" for w, t in codes.items())
    nearest = f"array_max(array({at}))"
    key = (
        f"CASE WHEN {nearest}.at >= 0 THEN {nearest}.title WHEN contains({before}, 'идентификационн') AND contains({before}, 'закупк') THEN 'Идентификационный код закупки' "
        f"WHEN contains({near}, 'лицензи') OR substring({text}, start + 1, end - start) RLIKE {licence} OR {before} RLIKE {licence} THEN 'Номер лицензии' ELSE {nz.lookup(kind, 3)} END"
    )
    return f"CASE {kind} WHEN 'date' THEN {date} WHEN 'registry_key' THEN {key} ELSE {nz.lookup(kind, 3)} END"


#: Characters that measures of recognition take for one another.
OCR_SPACES = "\u00a0\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u205f\u3000"
OCR_DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63\uff0d"
OCR_QUOTES = "«»“”„‟‘’ʼʻ"


def ocr_text(text: Column) -> Column:
    """Text for measures of recognition: without soft hyphens, one kind of space, dash and quote, three points for an ellipsis."""
    one = F.translate(F.replace(text, F.lit("\u00ad"), F.lit("")), OCR_SPACES + OCR_DASHES + OCR_QUOTES, " " * len(OCR_SPACES) + "-" * len(OCR_DASHES) + '"' * len(OCR_QUOTES))
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(one, r"[\r\n]+", " "), F.lit("…"), F.lit("...")), " {2,}", " "))


def with_error_rates(pairs: DataFrame) -> DataFrame:
    """Pairs (hypothesis, reference) with cer and wer: 1 minus the ratio of matching blocks, of characters and of words."""

    @F.pandas_udf("struct<cer:double,wer:double>")
    def run(hypothesis: pd.Series, reference: pd.Series) -> pd.DataFrame:
        from difflib import SequenceMatcher

        def rate(a, b) -> float:
            return round(1 - SequenceMatcher(None, a, b, autojunk=False).ratio(), 4) if b else float(bool(a))

        got = [(rate(a or "", b or ""), rate((a or "").split(), (b or "").split()) if (b or "").split() else float(bool((a or "").split()))) for a, b in zip(hypothesis, reference)]
        return pd.DataFrame(got, columns=["cer", "wer"])

    return pairs.withColumn("rates", run("hypothesis", "reference")).select("*", "rates.cer", "rates.wer").drop("rates")


def role_labels(segments: DataFrame) -> DataFrame:
    """doc_id, seg_order, start, role: places that name a party's role (in the preamble, or as the head of a block)."""
    found = segments.withColumn("found", F.expr(f"concat({spans('text', PREAMBLE)}, {spans('text', ROLE_HEAD)})"))
    return exploded(found, "found").select("doc_id", "seg_order", "start", F.lower(F.regexp_extract("text", UI + f"({ROLES})", 1)).alias("role"))


def sweep(segments: DataFrame, accepted: DataFrame) -> DataFrame:
    """Further whole-word places of accepted values in their own document that no accepted span covers. Accepted spans grow with
    the segments, so neither side of a join is broadcast, however small its files are."""
    values = accepted.filter(F.col("type").isin(*SWEEP_TYPES) & (F.length("text") >= SWEEP_LENGTH)).groupBy("doc_id", "type", F.col("text").alias("value")).agg(F.max("confidence").alias("confidence"))
    hits = segments.join(values.hint("merge"), "doc_id").filter(F.expr("contains(text, value)"))
    places = "transform(filter(sequence(1, size(split(text, value_re, -1)) - 1), i -> true), i -> length(array_join(slice(split(text, value_re, -1), 1, i), value)))"
    hits = hits.withColumn("value_re", F.expr("concat('\\\\Q', value, '\\\\E')")).withColumn("start", F.explode_outer(F.expr(places))).filter("start IS NOT NULL")
    edge = r"(?U)\w"
    hits = hits.withColumn("end", F.col("start") + F.length("value")).filter(~F.expr(f"substring(text, start, IF(start > 0, 1, 0)) RLIKE {quote(edge)}") & ~F.expr(f"substring(text, end + 1, 1) RLIKE {quote(edge)}"))
    new = hits.select("doc_id", "seg_order", "start", "end", F.col("value").alias("text"), "type", "confidence").alias("a")
    on = "a.doc_id = b.doc_id AND a.seg_order = b.seg_order AND a.start < b.end AND b.start < a.end"
    return new.join(accepted.alias("b").hint("merge"), F.expr(on), "left_anti")


#: A character of the repaired text and the place of the source that it comes from.
Chars = list[tuple[str, int]]
#: Short labels that are known although they have few letters, and names of account labels without spaces.
SPACED_LABELS = ("расчетныйсчет", "расчётныйсчёт", "корр.счет", "корр.счёт", "телефоны", "гбпоурд")
ACCOUNT_LABELS = r"расч[её]тныйсч[её]т|корр\s*\.?\s*счет|корр\s*\.\s*счёт|корреспондентскийсчет"
#: From how many words with letters on, and above what share of single letters, a segment is spaced out.
SPARSE_WORDS, SPARSE_SHARE = 12, 0.8


def _text(chars: Chars) -> str:
    return "".join(c for c, _ in chars)


def _rewritten(chars: Chars, pattern: str, change) -> Chars:
    """Each match replaced by change(match, its characters)."""
    out, at = [], 0
    for m in re.finditer(pattern, _text(chars), re.IGNORECASE):
        out += chars[at : m.start()] + change(m, chars[m.start() : m.end()])
        at = m.end()
    return out + chars[at:]


def _inserted(chars: Chars, what: dict[int, str]) -> Chars:
    """Text put in before places; it comes from the place that it stands before."""
    out = []
    for i, (c, place) in enumerate(chars):
        out += [(x, place) for x in what.get(i, "")]
        out.append((c, place))
    return out


def is_sparse(text: str) -> bool:
    """Is the whole segment spaced out, letter by letter?"""
    for label in SPACED_LABELS:
        if any(m[0].count(" ") >= 4 for m in re.finditer(r"\s*".join(map(re.escape, label)), text, re.IGNORECASE)):
            return True
    words = [w for w in re.findall(r"\w+", text) if any(map(str.isalpha, w))]
    return bool(re.search(r"[А-ЯЁ](?:\s+[а-яё]){4,}", text)) or len(words) >= SPARSE_WORDS and sum(len(w) == 1 for w in words) > SPARSE_SHARE * len(words)


def collapsed(chars: Chars) -> Chars:
    """Without the spaces between letters or digits, but at the ends of words that can still be told: a digit beside a letter, a
    capital after a small letter, and a name after an abbreviation."""
    text = _text(chars)

    def ends_word(i: int) -> bool:
        a, b = text[i - 1], text[i + 1]
        if a.isdigit() != b.isdigit() or a.islower() and b.isupper():
            return True
        before = re.search(r"[^\W\d_]*$", text[:i])[0]
        capitals = len(before) - len(before.rstrip("".join({c for c in before if c.isupper()})))
        return a.isupper() and b.isupper() and capitals >= 2 and text[i + 2 :].lstrip(" ")[:1].islower()

    def spacing(i: int) -> bool:
        return text[i] == " " and 0 < i < len(text) - 1 and text[i - 1].isalnum() and text[i + 1].isalnum() and not ends_word(i)

    return [x for i, x in enumerate(chars) if not spacing(i)]


def split_accounts(chars: Chars) -> Chars:
    """Account numbers written as one, after their label: the first run of digits there is cut every 20, and from the label."""
    text = _text(chars)
    label = re.search(ACCOUNT_LABELS, text, re.IGNORECASE)
    run = label and re.compile(r"\d+").search(text, label.end())
    if not run or len(run[0]) <= 20 or len(run[0]) % 20:
        return chars
    cuts = {i: " " for i in range(run.start() + 20, run.end(), 20)}
    if run.start() == label.end() and text[run.start() - 1].isalnum():
        cuts[run.start()] = " "
    return _inserted(chars, cuts)


def repair_phones(chars: Chars) -> Chars:
    """In a segment that speaks of phones: no spaces around hyphens, f before a hyphen is 1, and numbers of eleven digits that
    follow each other directly are parted by a comma."""
    if "телефон" not in _text(chars).casefold():
        return chars
    chars = _rewritten(chars, r" *- *|(?<=\d) +(?=f)", lambda m, part: [x for x in part if x[0] != " "])
    chars = _rewritten(chars, r"(?<=\d)f(?=-)", lambda m, part: [("1", part[0][1])] if m[0] == "f" else part)
    cuts, text, at = {}, _text(chars), 0
    number = re.compile(r"(?<!\d)[78](?:[ -]*\d){10}")
    while m := number.search(text, at):
        at = m.end()
        if text[at : at + 1].isdigit():
            cuts[at] = ","
            # what follows is a number of its own, though a digit stands before it
            text = text[:at - 1] + "," + text[at:] if text[at] in "78" else text
    return _inserted(chars, cuts)


def split_kpp_inn(chars: Chars) -> Chars:
    """A register code and a taxpayer number written as one: 19 digits with a label at most 40 characters before, and a valid tail."""
    text = _text(chars)
    hits = (m for m in re.finditer(r"\d{19}(?!\d)", text) if re.search("инн|кпп", text[max(0, m.start() - 40) : m.start()], re.IGNORECASE))
    return _inserted(chars, {m.start() + 9: " " for m in hits if checksums.is_inn(m[0][9:])})


def split_biks(chars: Chars) -> Chars:
    """Bank codes written as one after their label, all of them valid: the label is repeated between them."""
    text = _text(chars)
    label = re.search(r"\bбик\b", text, re.IGNORECASE)
    run = label and re.compile(r"\d{18,}(?!\d)").search(text, label.end())
    if not run or len(run[0]) % 9 or not all(re.fullmatch(r"0[124]\d{7}", run[0][i : i + 9]) for i in range(0, len(run[0]), 9)):
        return chars
    return _inserted(chars, {i: " БИК " for i in range(run.start() + 9, run.end(), 9)})


def repair_emails(chars: Chars) -> Chars:
    """In a segment with the sign ® for @: no spaces inside addresses, no point or comma behind the sign, a space behind the label
    and between addresses."""
    if "®" not in _text(chars):
        return chars
    chars = _rewritten(chars, r"(?<=[®.,\-]) | (?=[®.,\-])|(?<=[^\W_]) (?=[^\W_])", lambda m, part: [])
    chars = _rewritten(chars, r"®[.,]*", lambda m, part: [("@", part[0][1])])
    text = _text(chars)
    cuts = {m.end(): " " for m in re.finditer(r"[еe]-mail(?=[a-z0-9])", text, re.IGNORECASE)}
    return _inserted(chars, cuts | {m.start(): " " for m in re.finditer(r"(?<=\.ru)(?=[a-z0-9._+-]+@)", text, re.IGNORECASE)})


def repair_org(chars: Chars) -> Chars:
    """A college's abbreviation and its region written as one: a legal form in front, a space between, and the opening quote back."""
    text = _text(chars)
    m = re.search("гбпоу(?=рд)", text, re.IGNORECASE)
    if not m:
        return chars
    quote_at = m.end() + 2
    chars = [("«", p) if c == "я" else (c, p) for c, p in chars]
    cuts = {m.start(): "ООО «", m.end(): " "}
    if text[quote_at : quote_at + 1] in ("я", "«"):
        cuts[quote_at] = " "
    return _inserted(chars, cuts)


def repair_layout(text: str) -> tuple[str, list[int]]:
    """(repaired text, mapping): look-alike letters in mixed words, soft hyphens, runs of white space, spaced-out tokens and
    segments, requisites written as one, glued labels, broken addresses and initials. mapping[i] is the source place of repaired
    place i, and its last entry the source's length."""
    out: Chars = []
    for m in re.finditer(r"\w+|\W+", "".join(c for c in text if c not in "\u00ad\u200b")):
        # Latin look-alikes inside words with Cyrillic letters
        mixed = re.search("[А-Яа-яЁё]", m[0]) and re.search("[A-Za-z]", m[0])
        out += [(LOOK_ALIKE.get(c, c) if mixed else c, 0) for c in m[0]]
    out = [(c, i) for (c, _), i in zip(out, (i for i, c in enumerate(text) if c not in "\u00ad\u200b"))]
    unspaced = lambda m, part: [x for x in part if x[0] != " "] if m[0].upper() == m[0] else part
    out = _rewritten(out, "(?<=\\d)[\u00a0\u2009\u202f](?=\\d)", lambda m, part: [])
    out = _rewritten(out, r"(?<=\w)-?\n(?=\w)", lambda m, part: [] if m[0].startswith("-") else [(" ", part[0][1])])
    out = _rewritten(out, r"\s+", lambda m, part: [(" ", part[0][1])])
    out = _rewritten(out, r"(?<!\w)(?:[А-ЯЁA-Z0-9] ){2,}[А-ЯЁA-Z0-9](?!\w)", unspaced)
    if is_sparse(_text(out)) or "®" in _text(out):
        out = repair_phones(split_accounts(collapsed(out)))
    out = split_kpp_inn(out)
    out = _rewritten(out, r"(?<![а-яёa-z])(?:огрнип|огрн|инн|кпп|снилс|бик|октмо)(?=\d)", lambda m, part: [*part, (" ", part[-1][1] + 1)])
    out = repair_org(repair_emails(split_biks(out)))
    out = _rewritten(out, r"(?<!\w)[А-ЯЁ]\s?\.\s?[А-ЯЁ]\s?\.", unspaced)
    return _text(out), [i for _, i in out] + [len(text)]


def repaired(segments: DataFrame) -> DataFrame:
    """segments with `norm` and the mapping `map` back to the source text."""

    @F.pandas_udf("struct<norm:string,map:array<int>>")
    def run(s: pd.Series) -> pd.DataFrame:
        got = [repair_layout(t or "") for t in s]
        return pd.DataFrame({"norm": [g[0] for g in got], "map": [g[1] for g in got]})

    return segments.withColumn("n", run("text")).select("*", "n.norm", "n.map").drop("n")


def remap(spans_df: DataFrame, mapped: DataFrame) -> DataFrame:
    """Spans of the repaired text as spans of the source text."""
    out = spans_df.join(mapped.select("doc_id", "seg_order", "map", F.col("text").alias("source")), ["doc_id", "seg_order"])
    out = out.withColumn("s", F.expr("element_at(map, start + 1)")).withColumn("e", F.expr("element_at(map, end) + 1"))
    return out.select("doc_id", "seg_order", F.col("s").alias("start"), F.col("e").alias("end"), F.expr("substring(source, s + 1, e - s)").alias("text"), "type", "confidence")


def contract_card(segments: DataFrame, found: DataFrame) -> DataFrame:
    """One row per document: number, price (and whether several compete), laws, delivery, roles."""
    first = lambda t: F.min_by(F.when(F.col("type") == t, F.col("text")), F.when(F.col("type") == t, F.struct("seg_order", "start")))
    prices = F.collect_set(F.when(F.col("type") == "contract_amount", F.col("text")))
    card = found.groupBy("doc_id").agg(first("contract_number").alias("number"), first("contract_amount").alias("price"), F.when(F.size(prices) > 1, "ambiguous").when(F.size(prices) == 1, "found").otherwise("not_found").alias("price_status"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("type") == "federal_law", F.col("text")))), ", ").alias("laws"), first("delivery_period").alias("delivery"))
    roles = role_labels(segments).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ", ").alias("roles"))
    return segments.select("doc_id").distinct().join(card, "doc_id", "left").join(roles, "doc_id", "left")


#: The ways a value may be written otherwise without changing it.
VARIANTS = (("plain", "value"), ("spaced", "regexp_replace(value, '(.)', '$1 ')"), ("nbsp", "replace(value, ' ', '\\u00a0')"), ("soft_hyphen", "concat(substring(value, 1, 3), '\\u00ad', substring(value, 4))"), ("line_break", "concat(substring(value, 1, 4), '\\n', substring(value, 5))"), ("parens", "concat('(', value, ')')"))


def variants(values: DataFrame) -> DataFrame:
    """Every value in every way of writing: category and variant beside the value's columns."""
    array = ", ".join(f"named_struct('category', '{n}', 'variant', {e})" for n, e in VARIANTS)
    return values.select("*", F.explode(F.expr(f"array({array})")).alias("v")).select("*", "v.*").drop("v")


def sample(text: Column, most: int = 60) -> Column:
    """A text of at most `most` characters, the last of them an ellipsis where something is left out."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def clamped(text: Column, start: Column, end: Column, around: int) -> Column:
    """The text of a window `around` characters wider than a span on both sides, within the text."""
    low = F.greatest(F.lit(0), start - around)
    return F.substring(text, low + 1, F.least(F.length(text), end + around) - low)
