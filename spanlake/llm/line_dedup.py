"""Line dedup by winnowing over line hashes.

A document is its sequence of lines with a word. A gram is the shortest run of lines from a line
on that has at least `gram_words` words; over every shortest run of lines with at least
`window_words` words the gram of least hash among those inside is selected (the rightmost of
equals), so any repeated run of window_words words holds a selected fingerprint in all its
occurrences. Fingerprints are joined by hash to the first place (document id, position) where
the gram was selected, each match is extended both ways as long as the lines are equal, and the runs
so found are deleted: every deleted line has an equal line at an earlier place, and the first
occurrence of each run stays. A line of window_words words or more is a window of its own, so
such a line is deleted whenever it occurs earlier.

Shorter repeated runs, and what a first place in other surroundings leaves of a run, are left to a second round, the same over the
lines that remain, with grams and windows of one word: every line with a word is a fingerprint, its first place is joined, and a
match needs no extension, as its neighbours are matches themselves. As a line's first place is never deleted, both rounds
together delete each line with a word that occurs at an earlier place, whatever its length and whatever stands around it, and
each distinct line stays once.

Lines are compared without white space at their ends. Each fingerprint meets the first place
only, never all pairs of places; minima are aggregated before the shuffle, and lines that hold
over 1 / HOT of all places meet their first place by a broadcast of at most HOT rows. With wide windows alone
the extension runs at the first place only, so of a run whose surroundings differ there a part can stay.

Defined results: a null text stays null and an empty one empty; lines without a word are kept
and don't end a run; a document that loses lines has the other lines joined as they were; rows
with equal id and text are one document and get the same result; of rows with equal id and
different texts the smaller text hash is the earlier; a null id is later than all ids; a text
all of whose lines go becomes an empty text; a very long text is one row of one task and is read whole; an empty table gives an
empty table. Extra columns are kept whatever their names, the added count column takes the name that it is given.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, mix64, small_slices, text_rows


@dataclass(frozen=True)
class Winnow:
    gram_words: int = 1
    window_words: int = 1

    @property
    def single(self) -> bool:
        """Each line is a gram and a window of its own."""
        return self.gram_words <= 1 and self.window_words <= 1


#: The rounds: runs of twenty words by windows and extension, then single lines among those that remain.
ROUNDS = (Winnow(10, 20), Winnow())
#: Lines with more than this share (1 / HOT) of all places are at most HOT.
HOT = 2000


def content_lines(text: str | None) -> list[tuple[int, str, int]]:
    """(index among all lines, stripped line, words) of the lines with a word."""
    out = []
    for i, line in enumerate((text or "").split("\n")):
        if own := line.strip():
            out.append((i, own, len(own.split())))
    return out


def line_hashes(lines: list[tuple[int, str, int]]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for _, x, _ in lines), np.uint64, len(lines))


def _reach(words: np.ndarray, least: int) -> np.ndarray:
    """For each line the end (exclusive) of the shortest run from it with `least` words; n + 1 if there is none."""
    total = np.concatenate([[0], np.cumsum(words)])
    return np.searchsorted(total, total[:-1] + least, "left")


def grams(hashes: np.ndarray, words: np.ndarray, p: Winnow) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all grams, in order of position."""
    ends = _reach(words, p.gram_words)
    at = np.nonzero(ends <= len(words))[0]
    size = ends[at] - at
    out = size.astype(np.uint64)
    for k in range(int(size.max(initial=0))):
        more = size > k
        out[more] = mix64(out[more] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[more] + k])
    return at, out


def fingerprints(hashes: np.ndarray, words: np.ndarray, p: Winnow) -> list[tuple[int, int]]:
    """(position, gram hash as a signed number) of the window minima."""
    if not len(hashes):
        return []
    at, gram = grams(hashes, words, p)
    gram_end = dict(zip(at.tolist(), _reach(words, p.gram_words)[at].tolist()))
    by_place = dict(zip(at.tolist(), gram.tolist()))
    chosen = set()
    for i, end in enumerate(_reach(words, p.window_words).tolist()):
        if end <= len(words):
            inside = [j for j in range(i, end) if gram_end.get(j, end + 1) <= end]
            if inside:
                chosen.add(min(inside, key=lambda j: (by_place[j], -j)))
    return [(j, int(np.uint64(by_place[j]).view(np.int64))) for j in sorted(chosen)]


def deleted_positions(own: list[int], other: list[int], matches: list[tuple[int, int]]) -> list[int]:
    """Positions of own's lines that lie in a run around a match (position, position in other).

    Each diagonal (difference of the positions) is compared once as a whole; there is nothing to do after all lines are gone.
    """
    x, y = np.array(own), np.array(other)
    gone = np.zeros(len(x), bool)
    by_shift: dict[int, list[int]] = {}
    for at, there in matches:
        by_shift.setdefault(at - there, []).append(at)
    for shift, places in sorted(by_shift.items()):
        if gone.all():
            break
        lo, hi = max(0, shift), min(len(x), len(y) + shift)
        unlike = np.nonzero(x[lo:hi] != y[lo - shift : hi - shift])[0] + lo
        stops = np.concatenate([[lo - 1], unlike, [hi]])
        for k in set(np.searchsorted(stops, places, "left").tolist()):
            gone[stops[k - 1] + 1 : stops[k]] = True
    return np.nonzero(gone)[0].tolist()


def _extended(sk: DataFrame, matches: DataFrame, place: Column) -> DataFrame:
    """last, d, t, gone: the deleted lines of a document by each document whose runs it repeats."""
    matches = matches.select("doc", F.col("first.doc").alias("doc2"), F.named_struct(F.lit("pos"), F.col("pos"), F.lit("pos2"), F.col("first.pos")).alias("m"))
    # a document's hashes go once to each document whose runs it repeats
    pairs = matches.groupBy("doc", "doc2").agg(F.collect_set("m").alias("at"))
    arrays = sk.select(place.alias("doc"), "lines", "raw").dropDuplicates(["doc"])
    both = pairs.join(arrays, "doc").join(arrays.select(F.col("doc").alias("doc2"), F.col("lines").alias("lines2")), "doc2")
    found_schema = pa.schema([("last", pa.bool_()), ("d", pa.int64()), ("t", pa.int64()), ("gone", pa.list_(pa.int32()))])

    def extend(batches):
        for b in small_slices(batches, "lines2"):
            last, d, t, raw, lines, lines2, at = (b.column(c).to_pylist() for c in ("last", "d", "t", "raw", "lines", "lines2", "at"))
            gone = [[r[i] for i in deleted_positions(x, y, [(m["pos"], m["pos2"]) for m in ms])] for r, x, y, ms in zip(raw, lines, lines2, at)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((last, d, t, gone), found_schema)], schema=found_schema)

    return both.select("doc.last", "doc.d", "doc.t", "raw", "lines", "lines2", "at").mapInArrow(extend, "last boolean, d long, t long, gone array<int>")


def _round(ws: Workspace, sk: DataFrame, place: Column, p: Winnow, n_lines: int) -> DataFrame:
    """last, d, t, gone: the lines that one round deletes, of documents sk (doc_id, th, raw, lines, pos, gram)."""
    at, gram = ("raw", "lines") if p.single else ("pos", "gram")
    prints = sk.select(place.alias("doc"), F.explode(F.arrays_zip(F.col(at).alias("pos"), F.col(gram).alias("gram"))).alias("f")).select("doc", F.col("f.pos").alias("pos"), F.col("f.gram").alias("gram"))
    first = prints.groupBy("gram").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = ws.write(first, "first")
    most = n_lines / HOT
    hot, rest = first.filter(F.col("n") > most).select("gram", "first"), first.filter(F.col("n") <= most).select("gram", "first")
    matches = prints.join(F.broadcast(hot), "gram").unionByName(prints.join(F.broadcast(hot.select("gram")), "gram", "left_anti").join(rest, "gram"))
    matches = matches.filter((F.col("first.doc") != F.col("doc")) | (F.col("first.pos") != F.col("pos")))
    if p.single:
        return matches.select("doc.last", "doc.d", "doc.t", F.array("pos").alias("gone"))
    return _extended(sk, matches, place)


def _remaining(sk: DataFrame, gone: DataFrame, place: Column) -> DataFrame:
    """sk without the lines that are gone (last, d, t, gone)."""
    gone = gone.select(F.struct("last", "d", "t").alias("doc"), "gone")
    rest = sk.select("*", place.alias("doc")).join(gone, "doc", "left").drop("doc")
    kept = F.filter(F.arrays_zip("raw", "lines"), lambda x: ~F.array_contains("gone", x["raw"]))
    rest = rest.withColumn("kept", F.when(F.col("gone").isNull(), F.arrays_zip("raw", "lines")).otherwise(kept))
    return rest.select("doc_id", "th", F.col("kept.raw").alias("raw"), F.col("kept.lines").alias("lines"))


def dedup_lines(docs: DataFrame, p: Winnow | tuple[Winnow, ...] = ROUNDS, *, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs, all columns as they are, but the text without later repeated runs; count_col adds the number of lines deleted.

    Steps: a map makes each document's line hashes and fingerprints; the first place of each
    fingerprint is a minimum by hash; matches with an earlier place get the line hashes of both documents
    (no texts) and are extended to the deleted lines; with windows of one word the matches are those;
    the texts are joined once with the lines that all rounds delete. Only the first of several rounds may have windows of several words.
    """
    rounds = p if isinstance(p, tuple) else (p,)
    if not all(r.single for r in rounds[1:]):
        raise ValueError("only the first round may have windows of several words")
    p = rounds[0]
    ws = Workspace(docs.sparkSession, "lines")
    texts = text_rows(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("raw", pa.list_(pa.int32())), ("lines", pa.list_(pa.int64())), ("pos", pa.list_(pa.int32())), ("gram", pa.list_(pa.int64()))])

    def read(batches):
        for b in small_slices(batches):
            out = []
            for doc, t, th in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "th"))):
                if lines := content_lines(t):
                    hashes = line_hashes(lines)
                    found = [] if p.single else fingerprints(hashes, np.array([n for _, _, n in lines], np.int64), p)
                    out.append((doc, th, [i for i, _, _ in lines], hashes.view(np.int64), [f[0] for f in found], [f[1] for f in found]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    sk, seen = ws.write(texts.mapInArrow(read, "doc_id long, th long, raw array<int>, lines array<long>, pos array<int>, gram array<long>"), "lines", n=F.sum(F.size("lines")))
    # a null id counts as the largest
    place = F.named_struct(F.lit("last"), F.col("doc_id").isNull(), F.lit("d"), F.coalesce("doc_id", F.lit(0)), F.lit("t"), F.col("th"))
    per_doc = lambda x: x.groupBy("last", "d", "t").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    gone = per_doc(_round(ws, sk, place, p, seen["n"] or 0))
    for r in rounds[1:]:
        gone = ws.write(gone, "gone")
        rest = _remaining(sk, gone, place)
        gone = per_doc(gone.unionByName(_round(ws, rest, place, r, seen["n"] or 0)))
    names = {k: fresh(docs, f"__line_{k}") for k in ("last", "d", "t", "gone")}
    gone = gone.toDF(*names.values())
    ident = F.col(id_col).cast("long")
    text = F.col(text_col).cast("string")
    on = (ident.isNull() == F.col(names["last"])) & (F.coalesce(ident, F.lit(0)) == F.col(names["d"])) & (F.xxhash64(text) == F.col(names["t"]))
    out = docs.join(gone, on, "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(names["gone"]))
    cut = F.when(F.col(names["gone"]).isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    extra = [F.coalesce(F.size(names["gone"]), F.lit(0)).cast("long").alias(count_col)] if count_col else []
    return out.select(*[cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *extra)
