"""Embedding near-duplicates: random-hyperplane sign codes in several tables, exact cosine check, components.

Vectors with equal components form one class with a multiplicity, so a vector repeated any
number of times is compared once. Each class gets one code of k bits per table. A bucket (table,
code) is dealt in blocks of bounded size, and pairs of blocks are multiplied as matrices in
double precision. A pair that meets in several tables counts in the first of them, so the links
of a vector are summed without listing pairs: each block gives a vector's number of links and
one edge of a spanning forest of the block's links.

k grows with the logarithm of the number of classes, the number of tables follows from the
wanted probability `miss` of not meeting at exactly the threshold angle.

Defined results: a null or zero vector and one with null or non-finite components link with
nothing; vectors link with vectors of their own length only; a null id takes part in no link
and gets a null component; rows with equal id and vector count once each as links of others
but an id is one node; a cosine equal to the threshold links; other columns of the input, whatever
their names, are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .components import connected_components


@dataclass(frozen=True)
class SignTables:
    """bucket: aimed-at classes of a bucket; block: most rows of a block; miss: chance to miss a pair at the threshold."""

    cosine: float = 0.9
    miss: float = 1e-4
    bucket: int = 2048
    block: int = 4096
    seed: int = 11

    def sizes(self, n: int) -> tuple[int, int]:
        """Bits of a code and number of tables for n classes."""
        bits = min(30, max(4, math.ceil(math.log2(max(n, 1) / self.bucket)) if n > self.bucket else 4))
        meet = (1 - math.acos(self.cosine) / math.pi) ** bits
        return bits, math.ceil(math.log(self.miss) / math.log(1 - meet))


def codes(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Sign codes (rows, tables) of vectors x."""
    planes = np.random.default_rng(seed).normal(size=(x.shape[1], tables * bits))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(2).astype(np.int32)


def block_links(reps: np.ndarray, x: np.ndarray, mult: np.ndarray, code: np.ndarray, table: int, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) by row: links counts rows of the other side (or, in a diagonal block, of the same), each with its
    multiplicity, that pass the exact test and meet in no earlier table; root is the smallest linked id of the row's tree."""
    n = len(reps)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    links, parent = np.zeros(n, np.int64), np.arange(n)
    other = np.where(side == 1)[0]
    diagonal = not len(other)
    first = np.arange(n) if diagonal else np.where(side == 0)[0]
    second = first if diagonal else other
    hit_i, hit_j = [], []
    for at in range(0, len(first), 256):
        part = first[at : at + 256]
        i, j = np.nonzero(x[part] @ x[second].T >= cosine * np.outer(norm[part], norm[second]) * (1 - 1e-12))
        i, j = part[i], second[j]
        if diagonal:
            i, j = i[i < j], j[i < j]
        if len(i):
            # the test itself, pair by pair, in a fixed order of summation
            sure = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= cosine
            i, j = i[sure], j[sure]
            hit_i.append(i)
            hit_j.append(j)
    if not hit_i:
        return links, reps
    i, j = np.concatenate(hit_i), np.concatenate(hit_j)
    new = np.ones(len(i), bool)
    for t in range(table):
        new &= code[i, t] != code[j, t]
    i, j = i[new], j[new]
    np.add.at(links, i, mult[j])
    np.add.at(links, j, mult[i])
    label = reps.copy()  # smallest id reachable within the block
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        open_ = label[i] != label[j]
        if not open_.any():
            break
    return links, label



def near_vectors(vectors: DataFrame, p: SignTables = SignTables(), *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id, kept."""
    ws = Workspace(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False))
    text = F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")))
    keyed = rows.withColumn("ok", usable).select("vec_id", "v", F.when(F.col("ok"), F.sha2(text, 256)).alias("key"))
    classes, seen = ws.write(keyed.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v")), "classes", n=F.count(F.lit(1)))
    own = keyed.select("vec_id", "key").join(classes.select("key", "rep", "mult"), "key", "left")
    linked = comp = None
    if seen["n"] > 1:
        linked, comp = _link_classes(ws, classes, seen["n"], p)
    if linked is None:
        out = own.select("vec_id", (F.coalesce("mult", F.lit(1)) - 1).alias("n_links"), F.coalesce("rep", "vec_id").alias("component_id"))
    else:
        out = own.join(linked, "rep", "left").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
        out = out.select("vec_id", (F.coalesce("mult", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _link_classes(ws: Workspace, classes: DataFrame, n: int, p: SignTables) -> tuple[DataFrame | None, DataFrame | None]:
    bits, tables = p.sizes(n)
    schema = pa.schema([("rep", pa.int64()), ("mult", pa.int64()), ("v", pa.list_(pa.float64())), ("code", pa.list_(pa.int32()))])

    def sign(batches):
        for b in batches:
            vectors = b.column("v").to_pylist()
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_length.setdefault(len(v), []).append(i)
            got: list = [None] * len(vectors)
            for at in by_length.values():
                for i, code in zip(at, codes(np.array([vectors[i] for i in at], float), bits, tables, p.seed)):
                    got[i] = code
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("mult"), b.column("v"), pa.array(got, pa.list_(pa.int32()))], schema=schema)

    coded = ws.write(classes.select("rep", "mult", "v").mapInArrow(sign, "rep long, mult long, v array<double>, code array<int>"), "codes")
    # vectors of different lengths never share a bucket
    dim = F.size("v").alias("dim")
    ids = coded.select(dim, "rep", F.posexplode("code").alias("t", "c"))
    # classes of a bucket are dealt to its blocks by hash; every pair of blocks is one task's unit
    blocks = ids.groupBy("dim", "t", "c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("dim", "t", "c", F.ceil(F.col("n") / F.lit(float(p.block))).cast("int").alias("nb"))
    at = F.pmod(F.xxhash64("rep", "t"), F.col("nb")).cast("int")
    units = coded.select("*", dim, F.posexplode("code").alias("t", "c")).join(blocks, ["dim", "t", "c"]).withColumn("blk", at)
    units = units.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("lo", F.least("blk", "o")).withColumn("hi", F.greatest("blk", "o"))
    units = units.select("dim", "t", "c", "lo", "hi", (F.col("blk") != F.col("lo")).cast("int").alias("side"), "rep", "mult", "v", "code")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        reps = pdf["rep"].to_numpy()
        side = pdf["side"].to_numpy()
        if key[3] != key[4] and (side.min() == side.max()):
            return pd.DataFrame({"rep": reps[:0], "links": reps[:0], "root": reps[:0]})
        links, root = block_links(reps, np.stack(pdf["v"]).astype(float), pdf["mult"].to_numpy(), np.stack(pdf["code"]), int(key[1]), side, p.cosine)
        hit = links > 0
        return pd.DataFrame({"rep": reps[hit], "links": links[hit], "root": root[hit]})

    found, seen = ws.write(units.groupBy("dim", "t", "c", "lo", "hi").applyInPandas(run, "rep long, links long, root long").groupBy("rep", "root").agg(F.sum("links").alias("links")), "found", n=F.count(F.lit(1)))
    if not seen["n"]:
        return None, None
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(ws, found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    return linked, comp


def oracle(cosine: float = 0.9) -> str:
    """All pairs by brute force, in DuckDB's SQL; for small tables of usable vectors."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM v WHERE list_dot_product(v, v) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= {cosine}),
r AS (SELECT vec_id AS node, vec_id AS reach FROM v UNION SELECT e.y, r.reach FROM r JOIN e ON e.x = r.node),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
k AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT v.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN k ON k.x = v.vec_id
"""
