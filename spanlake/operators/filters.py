"""Filters over spans: requested types, public law, persons that are none, incomplete requisites, frequency, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlake.functions import checksums as cs
from spanlake.functions import normalize as nz

#: A person detector's finds that name a state, and from how many places on a common noun is no name.
GENERIC_PERSONS = ("российская федерация",)
FREQUENT = 8


def of_types(spans: DataFrame, requested: tuple[str, ...], known: tuple[str, ...]) -> DataFrame:
    """Spans of the requested types; ("all",) keeps all. An unknown type is an error that lists the known ones."""
    if requested == ("all",):
        return spans
    if unknown := sorted(set(requested) - set(known)):
        raise ValueError(f"unknown types {unknown}; known are {sorted(known)}")
    return spans.filter(F.col("type").isin(*requested))


def without_public_law(spans: DataFrame) -> DataFrame:
    """References to laws are no one's data."""
    return spans.filter(F.col("type") != "federal_law")


def is_generic_person(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(*GENERIC_PERSONS)


def is_all_caps(text: Column) -> Column:
    """One word of two or more letters, all large, without a point: an abbreviation."""
    return text.rlike(r"(?U)^[^\s.]*$") & text.rlike(r"(?U)^(?:\P{L}*\p{Lu}){2}") & ~text.rlike(r"(?U)\p{Ll}")


def real_persons(spans: DataFrame) -> DataFrame:
    """Spans without persons that are a state's name or an abbreviation."""
    return spans.filter((F.col("type") != "person") | ~(is_generic_person(F.col("text")) | is_all_caps(F.col("text"))))


def complete_requisites(spans: DataFrame) -> DataFrame:
    """Requisites of their full length only."""
    return spans.filter(F.expr(cs.complete("type", cs.digits("text"))))


def without_frequent_nouns(spans: DataFrame, is_name: Column, least: int = FREQUENT) -> DataFrame:
    """Spans without persons of one word, no name in it, whose key stands at `least` different places of the document.

    is_name: whether the word can be a first, middle or last name. What else names a person at such a place goes with it.
    """
    trimmed = F.trim(F.regexp_replace("text", r"(?U)^[\s\p{P}]+|[\s\p{P}]+$", ""))
    noun = (F.col("type") == "person") & ~F.contains(trimmed, F.lit(" ")) & (trimmed != "") & ~is_name
    place = ["seg_order", "start", "end"]
    one = spans.filter(noun).withColumn("key", F.expr(nz.person("text"))).filter("key <> ''").select("doc_id", "key", *place).distinct()
    many = one.withColumn("places", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "key"))).filter(F.col("places") >= least).select("doc_id", *place).distinct()
    return spans.filter("type = 'person'").join(many, ["doc_id", *place], "left_anti").unionByName(spans.filter("type <> 'person'"))


def has_stem(text: Column, stems: tuple[str, ...], tail: int = 3) -> Column:
    """Does a word begin with a stem and go on for at most `tail` letters?"""
    words = F.split(F.lower(text), r"(?U)[^\w-]+")
    return F.exists(words, lambda w: F.exists(F.array(*map(F.lit, stems)), lambda s: F.startswith(w, s) & (F.length(w) - F.length(s) <= tail)))


def is_listed(text: Column, words: tuple[str, ...]) -> Column:
    """The whole phrase or every word of it is on the list."""
    own = F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))
    listed = tuple(w.lower() for w in words)
    return own.isin(*listed) | ((own != "") & F.forall(F.split(own, " "), lambda w: w.isin(*listed)))
