"""Mixing sources to target weights by Poisson replication.

Each row of a source is repeated a Poisson-distributed number of times whose mean is the rate
that brings the source to its target share. The number is the inverse of the Poisson
distribution at a uniform number hashed from the seed and the row's identity, so a lost task
gives the same copies again. The copies are then shuffled globally by a hash key.

Defined results: a null source is a source of its own; a source without a weight gets weight 0
and loses its rows; rows equal in id draw the same number unless they differ in text (their
text is hashed too); a null id or text is hashed as a mark of its own; a very long text is hashed
whole and carried as it is; an empty table gives an empty table; the input's columns come back unchanged, helper columns never clash with them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, unit_hash


def poisson_cdf(rate: Column, max_rate: float) -> Column:
    """P(X <= 0), P(X <= 1), ... for X ~ Poisson(rate), rate <= max_rate, until the tail is below 2**-60."""
    terms = int(max_rate + 12 * math.sqrt(max_rate + 1) + 30)
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i.cast("double")
        return F.struct(p.alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda s: s["cdf"])


def poisson_inverse(u: Column, cdf: Column) -> Column:
    """The smallest k with P(X <= k) > u."""
    return F.size(F.filter(cdf, lambda c: c <= u))


#: The tables of at most so many sources (about 800 bytes each, 4 MB in all) are broadcast; those of more sources are joined by a
#: shuffle, in which adaptive execution deals the rows of a large source to several tasks.
BROADCAST_SOURCES = 5_000
#: Above this mean a rate is split into equal parts whose independent draws are added.
PART_RATE = 16.0


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, *, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", epochs: float = 1.0, seed: str = "mix", partitions: int | None = None, copy_cols: bool = False) -> DataFrame:
    """Rows of docs, replicated to the target weights and shuffled globally.

    weights: share of each source in the result, in any scale; None: equal shares. epochs: rows
    of the result over rows of docs, in expectation. copy_cols adds the number of the copy and
    the shuffle key. The driver gets three totals; the counts are aggregated per source and
    joined back, by broadcast only below BROADCAST_SOURCES; a source's rows are never gathered.
    """
    names = {k: fresh(docs, f"__mix_{k}") for k in ("source", "n", "rate", "parts", "cdf", "copies", "copy", "key", "text")}
    src = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("-"))
    own = docs.withColumn(names["source"], src)
    counts = Workspace(docs.sparkSession, "mixing").write(own.groupBy(names["source"]).agg(F.count(F.lit(1)).alias(names["n"])), "counts")
    target = F.lit(1.0)
    if weights is not None:
        given = docs.sparkSession.createDataFrame([("-" if k is None else f"={k}", float(w)) for k, w in weights.items()], f"{names['source']} string, {names['rate']} double")
        counts = counts.join(given, names["source"], "left")
        target = F.coalesce(F.col(names["rate"]), F.lit(0.0))
    n_sources, total, weight_sum = counts.agg(F.count(F.lit(1)), F.sum(names["n"]), F.sum(target)).first()
    rates = counts.select(names["source"], (target / F.lit(float(weight_sum or 1)) * F.lit(float((total or 0) * epochs)) / F.col(names["n"])).alias(names["rate"]))
    # one table of the distribution per source, looked up by every row; a rate over PART_RATE is the sum of equal parts' draws
    rate = F.col(names["rate"])
    rates = rates.filter(rate > 0).withColumn(names["parts"], F.greatest(F.lit(1), F.ceil(rate / F.lit(PART_RATE))).cast("int"))
    rates = rates.withColumn(names["cdf"], poisson_cdf(rate / F.col(names["parts"]), PART_RATE))
    if n_sources <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = own.join(rates, names["source"]).withColumn(names["text"], F.coalesce(F.sha2(F.col(text_col), 256), F.lit("-")))
    ident = [F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-")), F.col(names["text"])]
    # the uniform numbers are an array of their own: inside the look-up they would be hashed again for each of its steps
    uniform = F.transform(F.sequence(F.lit(1), F.col(names["parts"])), lambda i: unit_hash(*ident, i, seed=seed))
    draws = F.transform(uniform, lambda u: poisson_inverse(u, F.col(names["cdf"])))
    copies = F.aggregate(draws, F.lit(0), lambda s, x: s + x)
    out = joined.withColumn(names["copies"], copies).filter(F.col(names["copies"]) > 0)
    out = out.withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(names["copies"])))).drop(names["cdf"])
    key = F.xxhash64(F.lit(seed), *ident, F.col(names["copy"]))
    out = out.withColumn(names["key"], key)
    # the key is a hash, so dealing rows by it and sorting each part is a shuffle of the whole
    out = out.repartition(partitions, names["key"]) if partitions else out.repartition(names["key"])
    out = out.sortWithinPartitions(names["key"])
    extra = [F.col(names["copy"]).alias("copy"), F.col(names["key"]).alias("shuffle_key")] if copy_cols else []
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *extra)


def copies_oracle(columns: str, seed: str = "mix", terms: int = 100) -> str:
    """The copies of each row for equal weights, in DuckDB's SQL, for rates up to PART_RATE."""
    return f"""
WITH c AS (SELECT source, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS k FROM documents GROUP BY source),
u AS (SELECT d.*, CAST('0x' || substr(sha256('{seed}' || ':' || coalesce('=' || d.doc_id::VARCHAR, '-') || ':' || coalesce(sha256(d.text), '-') || ':1'), 1, 13) AS BIGINT) / 4503599627370496.0 AS u,
      1.0::DOUBLE / c.k * c.total / c.n AS rate
      FROM documents d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
p AS (SELECT r.source, i, exp(-rate) * pow(rate, i) / gamma(i + 1) AS p FROM (SELECT DISTINCT source, rate FROM u) r, range(0, {terms}) t(i)),
f AS (SELECT source, i, sum(p) OVER (PARTITION BY source ORDER BY i) AS cdf FROM p),
n AS (SELECT u.doc_id, u.source, u.n_chars, u.text, coalesce((SELECT min(i) FROM f WHERE f.source IS NOT DISTINCT FROM u.source AND f.cdf > u.u), 0) AS copies FROM u)
SELECT {columns} FROM n, unnest(range(1, copies + 1)) AS t(copy)
"""
