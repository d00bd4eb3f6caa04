"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: in each round every feature in turn gets one shallow tree (at most `leaves`
leaves over the feature's bins) fitted to the current residual, added to the feature's lookup
table with a small rate. Then the pairs of features whose 2-d tables explain most of the
residual get trees of their own. A document's score is the logistic function of the sum of its
bins' table entries, so scoring is vectorised bin lookup and addition.

Defined results: a null text counts as empty; an empty text has all features 0 and still gets a
score; equal texts get equal scores; rows without a usable label (null, or an id with
contradicting labels) don't train; an empty training set gives score 0.5 everywhere; of splits with equal gain the last cut counts,
of equal pairs the first; a null id is carried through; repeated rows get equal scores; a very long text is one row of one task and is
read whole; labels, lang, source and the id are never features, other columns of the input are not read; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, small_slices, text_rows

FEATURES = ("log_words", "word_len", "upper", "digits", "symbols", "exclaims", "pipes", "other_punct", "end_punct", "line_words", "dup_lines", "distinct_words", "top_word", "adjacent_same", "short_words", "capital_words", "bad_line_ends", "letters")
_upper = bytes(range(65, 91))
_lower = bytes(range(97, 123))
_digit = bytes(range(48, 58))
_punct = b".,;:?'\"()-"
_symbol = b"#*$%&<>@^~=+_{}[]\\/"


def features(text: str) -> list[float]:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = len(raw)

    def share(kinds: bytes) -> float:
        return (chars - len(raw.translate(None, kinds))) / chars

    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, digits, symbols, punct = share(_upper), share(_digit), share(_symbol), share(_punct)
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, upper, digits, symbols, raw.count(b"!") / n, raw.count(b"|") / n, punct,
        (raw.count(b".") + raw.count(b"?")) / n, n / len(lines), 1 - len(set(lines)) / len(lines), len(counts) / n, max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, sum(len(w) < 4 for w in words) / n, sum(w[:1].isupper() for w in words) / n,
        sum(not x.rstrip().endswith((b".", b"?", b"!", b'"', b")")) for x in lines) / len(lines), share(_lower) + upper,
    ]


@dataclass
class Gam:
    """edges: per feature, the inner bin edges. tables: per feature, one entry per bin. pairs: (i, j, table)."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        if len(x) and self.tables:
            for i, (e, t) in enumerate(zip(self.edges, self.tables)):
                out += t[np.searchsorted(e, x[:, i], "right")]
            for i, j, t in self.pairs:
                out += t[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _cut(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """A tree over ordered bins with sums grad and hess: the best splits one after another; the leaf values by bin."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    cuts = [0, len(grad)]

    def gain(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        m = np.arange(a + 1, b)
        value = (g[m] - g[a]) ** 2 / (h[m] - h[a] + smooth) + (g[b] - g[m]) ** 2 / (h[b] - h[m] + smooth) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + smooth)
        k = int(np.argmax(value))
        return float(value[k]), int(m[k])

    for _ in range(leaves - 1):
        best, at = max(gain(a, b) for a, b in zip(cuts, cuts[1:]))
        if best <= 1e-12:
            break
        cuts = sorted({*cuts, at})
    out = np.zeros(len(grad))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + smooth)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
    """A tree of depth two over cells: the cut of the rows whose parts gain most from a cut of their own columns."""
    best, out = -1.0, np.zeros_like(g)
    for cut in range(1, max(2, len(g))):
        step, gain = np.zeros_like(g), 0.0
        for rows in (slice(0, cut), slice(cut, len(g))):
            sums, weights = g[rows].sum(0), h[rows].sum(0)
            leaf = _tree(sums, weights, 2, smooth)
            step[rows] = leaf
            gain += float((leaf * sums).sum())
        if gain > best:
            best, out = gain, step
    return out


def fit_gam(x: np.ndarray, y: np.ndarray, *, bins: int = 64, pair_bins: int = 8, rounds: int = 120, rate: float = 0.1, leaves: int = 3, n_pairs: int = 6, pair_rounds: int = 40, smooth: float = 2.0) -> Gam:
    """Fits on features x and labels y (0 or 1); constant labels give a constant model."""
    if not len(y) or y.min() == y.max():
        return Gam(bias=0.0 if not len(y) else (3.0 if y[0] else -3.0))
    m = Gam(bias=float(np.log(y.mean() / (1 - y.mean()))))
    d = x.shape[1]
    m.edges = [_cut(x[:, i], bins) for i in range(d)]
    m.pair_edges = [_cut(x[:, i], pair_bins) for i in range(d)]
    where = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(m.edges)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    f = np.full(len(y), m.bias)
    for _ in range(rounds):
        for i in range(d):
            p = 1 / (1 + np.exp(-f))
            size = len(m.tables[i])
            step = rate * _tree(np.bincount(where[i], y - p, size), np.bincount(where[i], p * (1 - p), size), leaves, smooth)
            m.tables[i] += step
            f += step[where[i]]
    coarse = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(m.pair_edges)]
    sizes = [len(e) + 1 for e in m.pair_edges]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, at = 1 / (1 + np.exp(-f)), coarse[i] * sizes[j] + coarse[j]
        n = sizes[i] * sizes[j]
        return np.bincount(at, y - p, n), np.bincount(at, p * (1 - p), n), at

    def worth(i: int, j: int) -> float:
        g, h, _ = cells(i, j)
        return float((g**2 / (h + smooth)).sum())

    ranked = sorted(((worth(i, j), i, j) for i in range(d) for j in range(i)), reverse=True)[:n_pairs]
    tables = {(i, j): np.zeros(sizes[i] * sizes[j]) for _, i, j in ranked}
    for _ in range(pair_rounds):
        for (i, j), t in tables.items():
            g, h, at = cells(i, j)
            step = _pair_tree(g.reshape(sizes[i], sizes[j]), h.reshape(sizes[i], sizes[j]), smooth)
            t += rate * step.ravel()
            f += (rate * step.ravel())[at]
    m.pairs = [(i, j, t.reshape(sizes[i], sizes[j])) for (i, j), t in tables.items()]
    return m


def training_rows(docs: DataFrame, labels: DataFrame, *, max_rows: int, fold: int | None = 1, folds: int = 3, label: str = "quality") -> DataFrame:
    """(x, y) of labelled documents outside the fold: a bounded sample, chosen by hash of the id.

    Only the chosen labels (at most about 1.3 * max_rows, a few bytes each) are joined to the texts.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    if fold is not None:
        own = own.filter(crc_mod("doc_id", folds) != fold)
    n = own.count()
    if n > max_rows:
        own = own.filter(F.pmod(F.xxhash64(F.lit("gam"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    own = own.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("__top")).filter(F.col("y") == F.col("__top")).select("doc_id", "y")
    return text_rows(docs).join(F.broadcast(own), "doc_id").select("text", "y")


def _map_features(texts: DataFrame, keep: str, kind: pa.DataType, ddl: str) -> DataFrame:
    schema = pa.schema([(keep, kind), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for b in small_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array([features(t or "") for t in b.column("text").to_pylist()], pa.list_(pa.float64()))], schema=schema)

    return texts.mapInArrow(run, f"{keep} {ddl}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, fold: int | None = 1, folds: int = 3, **params) -> Gam:
    """max_rows bounds the sample that the driver fits on (20,000 rows of 18 numbers by default)."""
    rows = training_rows(docs, labels, max_rows=max_rows, fold=fold, folds=folds)
    got = _map_features(rows, "y", pa.int32(), "int").toPandas()
    if not len(got):
        return Gam()
    order = np.lexsort(np.array(got["x"].tolist()).T)  # the same order of rows in every run
    return fit_gam(np.array(got["x"].tolist())[order], got["y"].to_numpy(float)[order], **params)


def score(docs: DataFrame, model: Gam, *, folds: int = 3, fold: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out (null for a null id), score, predicted. One map, no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for b in small_slices(batches):
            x = np.array([features(t or "") for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            p = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype("int32"))], schema=schema)

    out = text_rows(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", (crc_mod("doc_id", folds) == fold).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Gam, *, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at least `least`, all columns unchanged; a map over the rows."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        kept = []
        for b in small_slices([pa.RecordBatch.from_arrays([texts], ["text"])]):
            x = np.array([features(t or "") for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            kept.extend((model.score(x) >= least).tolist())
        return pa.array(kept, pa.bool_())

    return docs.filter(good(F.col("text").cast("string")))
