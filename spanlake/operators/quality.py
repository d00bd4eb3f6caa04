"""Quality of masking against labels: false finds, roles, markers, filled cards, comparison of runs."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def negative_finds(spans: DataFrame, clean: DataFrame) -> DataFrame:
    """doc_id, n: finds in documents that hold nothing to find, those without a find too."""
    n = spans.join(clean.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n0"))
    return clean.select("doc_id").distinct().join(n, "doc_id", "left").select("doc_id", F.coalesce("n0", F.lit(0)).alias("n"))


def role_measures(gold: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_purity, role_coverage and role_accuracy in one row; 1 where nothing was asked.

    gold: doc_id, type, value, party, roles (the names that the party may have); members: doc_id, profile_id, type, value, role.
    A found label counts as pure if its profile has a member that the labels give to the same party.
    """
    key = ["doc_id", "type", "value"]
    found = gold.join(members.groupBy(*key).agg(F.max("profile_id").alias("profile_id"), F.max("role").alias("role")), key)
    peers = members.join(gold.filter("party IS NOT NULL").select(*key, "party").distinct(), key).select("doc_id", "profile_id", "party").distinct().withColumn("pure", F.lit(1))
    found = found.join(peers, ["doc_id", "profile_id", "party"], "left")
    asked = F.col("roles").isNotNull() & (F.size("roles") > 0) & F.col("role").isNotNull()
    ratio = lambda hit, of: F.round(F.when(F.count_if(of) > 0, F.count_if(of & hit) / F.count_if(of)).otherwise(1.0), 9)
    return found.agg(
        ratio(F.col("pure").isNotNull(), F.col("party").isNotNull()).alias("cluster_purity"), ratio(F.col("role").isNotNull(), F.lit(True)).alias("role_coverage"),
        ratio(F.array_contains("roles", F.lower("role")), asked).alias("role_accuracy"),
    )


def duplicate_markers(groups: DataFrame, artifacts: DataFrame) -> DataFrame:
    """doc_id, marker, extra: places of a marker in the artifact's text beyond the replacements of all groups that have it."""
    planned = groups.groupBy("doc_id", "marker").agg(F.sum("n_refs").alias("planned"))
    both = planned.join(artifacts.select("doc_id", "text"), "doc_id")
    n = ((F.length("text") - F.length(F.replace("text", F.col("marker"), F.lit("")))) / F.length("marker")).cast("long")
    return both.withColumn("n", n).groupBy("doc_id", "marker").agg((F.sum("n") - F.max("planned")).alias("extra")).filter("extra > 0")


def inconsistent_markers(groups: DataFrame, shown: DataFrame) -> DataFrame:
    """doc_id, group_id, labels: groups that an artifact shows under several labels. shown: doc_id, group_id, label of replacements
    that did not get the group's own label; the others show canonical_label."""
    other = shown.groupBy("doc_id", "group_id").agg(F.collect_set("label").alias("other"), F.count(F.lit(1)).alias("n"))
    out = groups.join(other, ["doc_id", "group_id"]).withColumn("own", F.when(F.col("n_refs") > F.col("n"), F.array("canonical_label")).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("labels", F.array_sort(F.array_distinct(F.concat("own", "other"))))
    return out.filter(F.size("labels") > 1).select("doc_id", "group_id", "labels")


def filled_fields(cards: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """doc_id, filled: how many of a card's fields have a value that is not empty."""
    has = [F.coalesce((F.length(F.trim(F.col(c).cast("string"))) > 0).cast("int"), F.lit(0)) for c in fields]
    return cards.select("doc_id", sum(has[1:], has[0]).alias("filled"))


def compare_runs(base: DataFrame, other: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, base_n, other_n, delta: finds of two runs; a document that one run lacks has 0 there."""
    count = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    both = count(base, "base_n").join(count(other, "other_n"), key, "full").select(key, zero("base_n"), zero("other_n"))
    return both.withColumn("delta", F.col("other_n") - F.col("base_n"))


def verifier_summary(claims: DataFrame) -> DataFrame:
    """type, asked, accepted, r_filter: what a second reader claimed, and the share of its claims that stood."""
    asked, kept = F.count(F.lit(1)), F.count_if("accepted")
    return claims.groupBy("type").agg(asked.alias("asked"), kept.alias("accepted"), F.round(kept / asked, 9).alias("r_filter"))


def masked_values(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, text, leaked: JSON texts (doc_id, text) with their document's values (doc_id, value, marker) replaced at every depth,
    longer values first; leaked where one is still there."""
    own = pairs.filter(F.length("value") > 0).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct((-F.length("value")).alias("n"), "value", "marker"))).alias("pairs"))
    out = texts.join(own, "doc_id", "left").withColumn("new", F.reduce(F.coalesce("pairs", F.array().cast("array<struct<n:int,value:string,marker:string>>")), F.col("text"), lambda t, p: F.replace(t, p["value"], p["marker"])))
    return out.select("doc_id", F.col("new").alias("text"), F.coalesce(F.exists("pairs", lambda p: F.contains(F.col("new"), p["value"])), F.lit(False)).alias("leaked"))


def hamming(a: str, b: str):
    """Bits in which two perceptual hashes (64-bit numbers) differ."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def bands(varying: int, n: int, most: int) -> tuple[list[int], int]:
    """(masks, reach): the bits in which hashes differ at all, dealt to bands, such that any two of the n hashes within `most` bits
    differ in at most `reach` bits of some band. Few wide bands with a reach cost more keys a hash, many narrow ones more
    comparisons; the split of least keys and comparisons is taken."""
    bits = [i for i in range(64) if varying >> i & 1]

    def cost(parts: int) -> float:
        width, reach = -(-len(bits) // parts), most // parts
        keys = parts * sum(comb(width, k) for k in range(reach + 1))
        return keys * (1 + n / 2 ** (len(bits) // parts))

    parts = min(range(1, most + 2), key=cost)
    return [sum(1 << i for i in bits[k::parts]) for k in range(parts)], most // parts


def similar_images(hashes: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (a, b) of images whose hashes (image, h) differ in at most `most` bits, with bits.

    Each different hash asks, in each band, for the hashes that have its bits there or those with up to `reach` of them turned
    over: an equi join that finds every such pair. Bits that all hashes share are in no band, so they fill no bucket.
    """
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    images = written(hashes.select("image", F.col("h").cast("long").alias("h")).filter("h IS NOT NULL").distinct())
    one = images.select("h").distinct()
    some, every, n = one.agg(F.bit_or("h"), F.bit_and("h"), F.count(F.lit(1))).first()
    if not n:
        return images.select(F.col("image").alias("a"), F.col("image").alias("b"), F.lit(0).alias("bits"))
    masks, reach = bands((some ^ every) & (1 << 64) - 1, n, most)
    far = lambda mask: F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")).bitwiseAND(F.lit(signed(mask))))
    near = one.select(F.col("h").alias("ha"), F.col("h").alias("hb"))
    for k, mask in enumerate(masks):
        bits = [1 << i for i in range(64) if mask >> i & 1]
        flips = [signed(sum(c)) for r in range(reach + 1) for c in combinations(bits, r)]
        own = F.col("h").bitwiseAND(F.lit(signed(mask)))
        asking = one.select(F.col("h").alias("ha"), F.explode(F.transform(F.lit(flips), lambda f: own.bitwiseXOR(f))).alias("key"))
        found = asking.join(one.select(F.col("h").alias("hb"), own.alias("key")), "key").filter("ha < hb").filter(hamming("ha", "hb") <= most)
        for before in masks[:k]:  # a pair counts in the first band that has it
            found = found.filter(far(before) > reach)
        near = near.unionByName(found.select("ha", "hb"))
    x, y = images.select(F.col("image").alias("i"), F.col("h").alias("ha")), images.select(F.col("image").alias("j"), F.col("h").alias("hb"))
    pairs = near.join(x, "ha").join(y, "hb").filter("i <> j AND (ha <> hb OR i < j)")
    return pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), hamming("ha", "hb").alias("bits")).distinct()
