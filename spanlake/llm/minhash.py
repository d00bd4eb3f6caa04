"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard verification, components.

Signatures take two permutations of the 32-bit universe: the first scatters the shingles, the
second, applied after a circular shift by k, gives coordinate k.

Candidates come from bands in three steps, none of which lists the pairs of a bucket:
1. in each bucket every member is compared with one centre, chosen by a hash per bucket, so a
   large group meets as many centres as there are bands;
2. buckets that still hold several components compare the members outside with the member that
   has most links;
3. the members of buckets that are still split are joined exactly: a prefix-filter join with
   length and position filters on their full shingle sets, tokens ordered from rare to common.
   It finds every pair over the threshold between different components, so no cap is needed.
Every link is confirmed on the full sets of 64-bit shingle hashes.

Defined results: a null or empty text, or one of white space, has no shingle and is linked with
nothing (its component is its own id); documents with equal word sequences form one class, compared once, however many there
are; rows that share an id are one document: all of their texts' classes are linked; repeated rows get equal results; a row with
a null id gets a null component and is kept; a very long text is one row of one task and is read whole; of equally good centres
the smallest class number counts, which decides no link; other columns of the input, whatever their names, are not read (keep_one
keeps them); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, fresh, mix64, small_slices, text_rows
from .components import connected_components, extended_components


@dataclass(frozen=True)
class NearDup:
    """Words of a shingle, least similarity in percent, bands and rows of a band.

    24 bands of 5 rows miss a pair of similarity 0.8 once in 14,000 times, of 0.85 once in 500,000.
    """

    words: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 5
    seed: int = 20


def _permute32(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D ^ (seed << 1))
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


#: Words whose hashes a task remembers.
KNOWN = 150_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z as a-z."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], size: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; the whole sequence where it is shorter."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if len(known) > KNOWN:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    size = min(size, n)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = mix64(out * _ODD[i % 8]) + h[i : n - size + 1 + i]
    return np.unique(mix64(out))


def signatures(sets: list[np.ndarray], p: NearDup) -> np.ndarray:
    """Circulant MinHash of non-empty sets: (sets, bands * rows) 32-bit minima."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    scattered = _permute32((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32), p.seed)
    out = np.empty((len(sets), p.bands * p.rows), np.uint32)
    for k in range(out.shape[1]):
        out[:, k] = np.minimum.reduceat(_permute32(scattered + np.uint32(k), p.seed + 1), starts)
    return out


def band_keys(sig: np.ndarray, p: NearDup) -> np.ndarray:
    """One 64-bit key per set and band."""
    out = np.empty((len(sig), p.bands), np.uint64)
    for b in range(p.bands):
        key = np.full(len(sig), b + 1, np.uint64)
        for r in range(p.rows):
            key = mix64(key + sig[:, b * p.rows + r].astype(np.uint64) * _ODD[r % 8])
        out[:, b] = key
    return out.view(np.int64)


def _class_key(words: list[bytes]) -> tuple[int, int]:
    d = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def sketch(texts: DataFrame, p: NearDup) -> DataFrame:
    """doc_id, th (hash of the text), k1, k2 (class of equal word sequences), n (shingles), keys (one per band). A map, one batch at a time."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        known: dict[bytes, int] = {}
        done: OrderedDict = OrderedDict()  # classes met lately: copies are not signed again
        for whole in small_slices(batches):
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = [split_words(t) for t in b.column("text").to_pylist()]
                ids = [_class_key(w) for w in rows]
                new = {k: w for k, w in zip(ids, rows) if k not in done}
                sets = {k: shingle_hashes(w, p.words, known) for k, w in new.items()}
                full = [k for k, s in sets.items() if len(s)]
                done.update((k, (0, [])) for k, s in sets.items() if not len(s))
                if full:
                    keys = band_keys(signatures([sets[k] for k in full], p), p).tolist()
                    done.update((k, (len(sets[k]), x)) for k, x in zip(full, keys))
                got = [done[k] for k in ids]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *(pa.array([k[i] for k in ids], pa.int64()) for i in (0, 1)), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], schema=schema)
                while len(done) > 20_000:
                    done.popitem(last=False)

    return texts.mapInArrow(run, "doc_id long, th long, k1 long, k2 long, n long, keys array<long>")


def _full_sets(texts: DataFrame, wanted: DataFrame, p: NearDup) -> DataFrame:
    """rep, s (all shingle hashes, sorted) of the wanted classes (rep, doc_id, th, k1, k2): of one text of each."""
    schema = pa.schema([("rep", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches):
        known: dict[bytes, int] = {}
        for whole in small_slices(batches):
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids, sets = [], []
                for rep, text, k1, k2 in zip(*(b.column(c).to_pylist() for c in ("rep", "text", "k1", "k2"))):
                    words = split_words(text)
                    if _class_key(words) == (k1, k2):
                        ids.append(rep)
                        sets.append(shingle_hashes(words, p.words, known).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    # by id and text, as an id may have many texts
    return texts.join(wanted, ["doc_id", "th"]).select("rep", "text", "k1", "k2").mapInArrow(run, "rep long, s array<long>").dropDuplicates(["rep"])


def _linked(pairs: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """The pairs (a, b) over the threshold by their full sets."""
    left = sets.select(F.col("rep").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= p.percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def _prefix_pairs(sets: DataFrame, comp: DataFrame, p: NearDup, ws: Workspace | None = None) -> DataFrame:
    """Candidate pairs, exact: all pairs over the threshold between different components of comp are among them."""
    t = p.percent / 100
    size = F.size("s").alias("size")
    tokens = sets.join(comp, "rep").select("rep", "c", size, F.explode("s").alias("token"))
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    ranked = tokens.join(df, "token", "left").withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy(F.coalesce("df", F.lit(1)), "token")))
    # the smaller set of a pair shares a token within its first n - ceil(2t/(1+t) n) + 1, the larger within n - ceil(t n) + 1
    eps = 1e-9
    high = ranked.filter(F.col("df").isNotNull() & (F.col("i") <= F.col("size") - F.ceil(t * F.col("size") - eps) + 1)).drop("df")
    if ws:
        high = ws.write(high, "prefixes")  # both sides of the join read it
    low = high.filter(F.col("i") <= F.col("size") - F.ceil(2 * t / (1 + t) * F.col("size") - eps) + 1)
    x = low.select("token", *(F.col(c).alias(f"x{c}") for c in ("rep", "c", "size", "i")))
    y = high.select("token", *(F.col(c).alias(f"y{c}") for c in ("rep", "c", "size", "i")))
    sx, sy = F.col("xsize"), F.col("ysize")
    on = (
        (x["token"] == y["token"]) & (F.col("xc") != F.col("yc")) & ((sx < sy) | ((sx == sy) & (F.col("xrep") < F.col("yrep")))) & (sx >= t * sy - eps)
        & (1 + F.least(sx - F.col("xi"), sy - F.col("yi")) >= t / (1 + t) * (sx + sy) - eps)
    )
    return x.join(y, on).select(*_pair(F.col("xrep"), F.col("yrep"))).distinct()


def near_duplicates(docs: DataFrame, p: NearDup = NearDup(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (doc_id is the smallest of its component)."""
    spark = docs.sparkSession
    ws = Workspace(spark, "neardup")
    texts = text_rows(docs, id_col, text_col)
    texts = texts.withColumn("th", F.xxhash64("text"))
    sk = ws.write(sketch(texts, p), "sketch")
    named = sk.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # a class is numbered by its place in the written table; its smallest id and one text with it stand for it
    one = named.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "th", "keys")).alias("m")).select("k1", "k2", "m.*")
    classes = ws.write(one.withColumn("rep", F.monotonically_increasing_id()), "classes")
    placed = ws.write(sk.select("doc_id", "n", "k1", "k2").join(classes.select("k1", "k2", "rep", F.col("doc_id").alias("least")), ["k1", "k2"], "left").select("doc_id", "n", "rep", "least"), "placed")
    exploded = classes.select("rep", "k1", F.explode("keys").alias("bucket"))
    hashed = F.xxhash64("k1", "bucket")
    centre = exploded.groupBy("bucket").agg(F.min(F.struct(hashed.alias("h"), F.col("rep").alias("rep"))).alias("m"), F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1).select("bucket", F.col("m.rep").alias("centre"))
    members, seen = ws.write(exploded.join(centre, "bucket").select("bucket", "rep", "centre"), "members", n=F.count(F.lit(1)))
    comp = _link_members(ws, texts, classes, members, p) if seen["n"] else None
    # the classes of an id with several texts are linked, and its rows without words go with them
    several = placed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("rep").alias("full"), F.count(F.lit(1)).alias("all"))
    several, found = ws.write(several.filter("full > 0 AND (lo < hi OR full < all)"), "several", n=F.count(F.lit(1)))
    if found["n"]:
        shared, links = ws.write(placed.join(several, "doc_id").select(F.col("rep").alias("a"), F.col("lo").alias("b")).filter("a <> b").distinct(), "shared", n=F.count(F.lit(1)))
        comp = extended_components(ws, comp, shared) if links["n"] else comp
    own = F.col("least")
    if comp is not None:
        comp = ws.write(comp, "classes-components")
        low = comp.join(classes.select(F.col("rep").alias("node"), "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("lowest"))
        placed = placed.join(comp.join(low, "component").select(F.col("node").alias("rep"), "lowest"), "rep", "left")
        own = F.coalesce("lowest", "least")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, own), F.col("doc_id")))
    out = placed.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    if found["n"]:
        ids = several.join(placed.filter("rep IS NOT NULL").select(F.col("rep").alias("lo"), own.alias("c")).dropDuplicates(["lo"]), "lo").select("doc_id", "c")
        out = out.join(ids, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "component_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _link_members(ws: Workspace, texts: DataFrame, classes: DataFrame, members: DataFrame, p: NearDup) -> DataFrame | None:
    one = members.filter(F.col("rep") != F.col("centre")).select(*_pair(F.col("rep"), F.col("centre"))).distinct()
    wanted = members.select("rep").distinct().join(classes.select("rep", "doc_id", "th", "k1", "k2"), "rep")
    sets = ws.write(_full_sets(texts, wanted, p), "sets")
    edges, found = ws.write(_linked(one, sets, p), "links", n=F.count(F.lit(1)))
    degree = edges.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("degree"))
    comp = connected_components(ws, edges) if found["n"] else None

    def labelled(comp: DataFrame | None) -> DataFrame:
        """members with their component c."""
        if comp is None:
            return members.select("bucket", "rep", F.col("rep").alias("c"))
        return members.select("bucket", "rep").join(comp.select(F.col("node").alias("rep"), F.col("component").alias("c0")), "rep", "left").select("bucket", "rep", F.coalesce("c0", "rep").alias("c"))

    # buckets that hold several components: compare the others with the best linked member
    own = labelled(comp).join(degree, "rep", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = F.max(F.struct("degree", "rep", "c")).alias("best")
    split = own.groupBy("bucket").agg(best, F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("bucket", F.col("best.rep").alias("hub"), F.col("best.c").alias("hub_c"))
    two, left = ws.write(own.join(split, "bucket").filter(F.col("c") != F.col("hub_c")).select(*_pair(F.col("rep"), F.col("hub"))).distinct().join(one, ["a", "b"], "left_anti"), "pairs", n=F.count(F.lit(1)))
    if left["n"]:
        more, new = ws.write(_linked(two, sets, p), "links", n=F.count(F.lit(1)))
        if new["n"]:
            comp = extended_components(ws, comp, more)
    # what is still split is joined exactly
    own = labelled(comp)
    split = own.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("bucket")
    rest, left = ws.write(own.join(split, "bucket").select("rep", "c").distinct(), "rest", n=F.count(F.lit(1)))
    if left["n"]:
        three, left = ws.write(_prefix_pairs(sets, rest, p, ws), "pairs", n=F.count(F.lit(1)))
        if left["n"]:
            more, new = ws.write(_linked(three, sets, p), "links", n=F.count(F.lit(1)))
            if new["n"]:
                comp = extended_components(ws, comp, more)
    return comp


def oracle(p: NearDup) -> str:
    """All pairs by brute force and their components, in DuckDB's SQL; for small tables."""
    k = p.words
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {k} THEN array_to_string(w, ' ') ELSE {gram} END AS g
      FROM d, unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS t(i) WHERE len(w) > 0),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * i.n >= {p.percent} * (zx.n + zy.n - i.n)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT b.y, r.reach FROM r JOIN b ON b.x = r.node)
SELECT d.doc_id, coalesce(max(z.n), 0)::BIGINT AS n_shingles, min(r.reach) AS component_id, d.doc_id = min(r.reach) AS kept
FROM d LEFT JOIN z USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
"""


def keep_one(docs: DataFrame, p: NearDup = NearDup(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, columns unchanged: of each component the document with the smallest id, once.

    Rows with a null id stay. Of rows that share the id that stays, the one with the smallest text hash does.
    """
    ids = near_duplicates(docs, p, id_col=id_col, text_col=text_col).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct()
    name, rank = fresh(docs, "__id"), fresh(docs, "__rank")
    ids = ids.withColumnRenamed("__id", name)
    named = docs.join(ids, docs[id_col].cast("long") == ids[name], "left_semi")
    named = named.withColumn(rank, F.row_number().over(Window.partitionBy(F.col(id_col)).orderBy(F.xxhash64(F.col(text_col))))).filter(F.col(rank) == 1).drop(rank)
    return named.unionByName(docs.filter(F.col(id_col).isNull()))
