"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads the bytes of the whole text (a-z for A-Z) forwards and backwards, its state carried from the first byte to
the last, and gives every byte position a distribution over the languages; a document's probabilities are the mean over all its
positions. It is trained by backpropagation through time with Adam on windows of a bounded sample of rows.

Texts are worked on in chunks of CHUNK bytes, side by side in one matrix. A chunk starts from the state at the end of its
neighbour: a first guess comes from the neighbour's last WARM bytes; after a pass every chunk whose start differs from the
state that its neighbour really ended with is computed again from that one, until none does. So the states are those of one
pass over the text (up to TOLERANCE), whatever its length.

Defined results: `und` and score 0 for a null or empty text and one without a letter; ties go to the language first in
alphabetical order; equal texts get equal results, so repeated rows do; with no training rows everything is `und`; rows with a
null lang or text don't train; lang, source and the id are never inputs of a prediction; a null id is carried through; a very
long text is one row of one task; other columns of the input, whatever their names, are not read; an empty table gives an empty
table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, slices, text_rows

CHUNK, WARM, TOLERANCE = 2048, 512, 1e-3
#: Positions that are computed in one matrix.
BLOCK = 1_000_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


@dataclass
class BiGru:
    """w: parameters by name; f and b stand for the two directions, z, r, h gates side by side."""

    langs: list[str]
    w: dict[str, np.ndarray]

    @classmethod
    def new(cls, langs: list[str], embed: int = 8, hidden: int = 8, seed: int = 7) -> BiGru:
        rng = np.random.default_rng(seed)
        make = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        w = {"E": rng.normal(0, 0.3, (256, embed)), "O": make(2 * hidden, len(langs)), "o": np.zeros(len(langs))}
        for d in "fb":
            w |= {f"{d}W": make(embed, 3 * hidden), f"{d}U": make(hidden, 2 * hidden), f"{d}V": make(hidden, hidden), f"{d}c": np.zeros(3 * hidden)}
        return cls(langs, w)

    def _pass(self, x: np.ndarray, d: str, steps, keep: list | None) -> np.ndarray:
        """States (length, rows, hidden) of one direction over bytes x (rows, length)."""
        w, u, v = self.w, self.w[f"{d}U"], self.w[f"{d}V"]
        n = v.shape[0]
        table = w["E"] @ w[f"{d}W"] + w[f"{d}c"]  # every byte's input to the gates
        h = np.zeros((len(x), n), table.dtype)
        out = np.empty((x.shape[1], len(x), n), table.dtype)
        for t in steps:
            a = table.take(x[:, t], 0)
            zr = _sigmoid(a[:, : 2 * n] + h @ u)
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(a[:, 2 * n :] + (r * h) @ v)
            if keep is not None:
                keep.append((t, h, z, r, c))
            h = h + z * (c - h)
            out[t] = h
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (length, rows, languages) of every byte position of rows x of equal length, in one plain pass."""
        h = np.concatenate([self._pass(x, "f", range(x.shape[1]), None), self._pass(x, "b", range(x.shape[1] - 1, -1, -1), None)], 2)
        s = h @ self.w["O"] + self.w["o"]
        s = np.exp(s - s.max(2, keepdims=True))
        return s / s.sum(2, keepdims=True)

    def states(self, x: np.ndarray, sizes: np.ndarray, start: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray | None, np.ndarray]:
        """One direction over chunks: x (length, rows), rows in descending order of their sizes, from the start states.

        Returns the states (length, rows, hidden) if they are to be kept, and the last state of each row.
        """
        w, u, v = self.w, self.w[f"{d}U"], self.w[f"{d}V"]
        n = v.shape[0]
        table = w["E"] @ w[f"{d}W"] + w[f"{d}c"]
        # a logistic function is half of a hyperbolic tangent of half its argument
        z_in, r_in, c_in = (np.ascontiguousarray(t) for t in (table[:, :n] / 2, table[:, n : 2 * n] / 2, table[:, 2 * n :]))
        u_z, u_r = np.ascontiguousarray(u[:, :n] / 2), np.ascontiguousarray(u[:, n:] / 2)
        live = np.searchsorted(-sizes, -np.arange(1, len(x) + 1), "right")  # rows that have a byte at each place
        h = start.copy()
        out = np.zeros((len(x), x.shape[1], n), h.dtype) if keep else None
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            k = live[t]
            at, before = x[t, :k], h[:k]
            z = before @ u_z
            z += z_in.take(at, 0)
            np.tanh(z, out=z)
            r = before @ u_r
            r += r_in.take(at, 0)
            np.tanh(r, out=r)
            r += 1
            r *= before
            r *= 0.5
            c = r @ v
            c += c_in.take(at, 0)
            np.tanh(c, out=c)
            c -= before
            z += 1
            z *= 0.5
            z *= c
            before += z  # h + z (c - h), in place
            if keep:
                out[t, :k] = before
        return out, h

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions of runs x with labels y, and its gradients."""
        w, n, length = self.w, self.w["fV"].shape[0], x.shape[1]
        kept = {"f": [], "b": []}
        h = np.concatenate([self._pass(x, "f", range(length), kept["f"]), self._pass(x, "b", range(length - 1, -1, -1), kept["b"])], 2)
        s = h @ w["O"] + w["o"]
        p = np.exp(s - s.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        rows = np.arange(len(x))
        loss = -np.log(p[:, rows, y] + 1e-12).mean()
        p[:, rows, y] -= 1
        p /= length * len(x)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["O"], g["o"] = np.einsum("tbh,tbk->hk", h, p), p.sum((0, 1))
        dh_all = p @ w["O"].T
        for d, part in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            carry, u, v, win = np.zeros((len(x), n)), w[f"{d}U"], w[f"{d}V"], w[f"{d}W"]
            for t, before, z, r, c in reversed(kept[d]):
                dh = dh_all[t][:, part] + carry
                dc = dh * z * (1 - c * c)
                drh = dc @ v.T
                dz, dr = dh * (c - before) * z * (1 - z), drh * before * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                carry = dh * (1 - z) + drh * r + dzr @ u.T
                g[f"{d}U"] += before.T @ dzr
                g[f"{d}V"] += (r * before).T @ dc
                da = np.concatenate([dzr, dc], 1)
                e = w["E"][x[:, t]]
                g[f"{d}W"] += e.T @ da
                g[f"{d}c"] += da.sum(0)
                np.add.at(g["E"], x[:, t], da @ win.T)
        return float(loss), g

    def single(self) -> BiGru:
        return BiGru(self.langs, {k: v.astype(np.float32) for k, v in self.w.items()})


def letters(text: str) -> bytes:
    """The text's bytes, a-z for A-Z; as many as the text has."""
    return text.encode().lower()


def fit_windows(xs: list[bytes], langs: list[str], *, steps: int = 300, batch: int = 64, rate: float = 0.02, seed: int = 7, size: int = 64) -> BiGru:
    """Trains on labelled windows of texts; a longer one is read from a drawn place on, in batches of equal length."""
    names = sorted(set(langs))
    if not names:
        return BiGru([], {})
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    # each language counts alike: windows are drawn by the inverse of its frequency
    odds = np.cumsum(1 / np.bincount(y, minlength=len(names))[y])
    model = BiGru.new(names, seed=seed)
    m, v = ({k: np.zeros_like(a) for k, a in model.w.items()} for _ in range(2))
    for i in range(1, steps + 1):
        at = np.searchsorted(odds, rng.random(batch) * odds[-1])
        n = min(size, max(1, int(np.median([len(xs[k]) for k in at]))))
        at = [k for k in at if len(xs[k]) >= n]
        x = np.stack([np.frombuffer(xs[k], np.uint8, n, int(rng.integers(len(xs[k]) - n + 1))) for k in at])
        _, g = model.gradients(x, y[at])
        step = rate * (1 - i / (steps + 1)) * np.sqrt(1 - 0.999**i) / (1 - 0.9**i)
        for name, grad in g.items():
            grad = np.clip(grad, -1, 1)
            m[name] = 0.9 * m[name] + 0.1 * grad
            v[name] = 0.999 * v[name] + 0.001 * grad * grad
            model.w[name] = model.w[name] - step * m[name] / (np.sqrt(v[name]) + 1e-8)
    return model


def _filled(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(length, rows) bytes of parts in descending order of their sizes, and the sizes."""
    sizes = np.array([len(p) for p in parts])
    x = np.zeros((len(parts), int(sizes.max(initial=0))), np.uint8)
    for i, p in enumerate(parts):
        x[i, : len(p)] = np.frombuffer(p, np.uint8)
    return np.ascontiguousarray(x.T), sizes


class Pooler:
    """Pools whole texts; memory is bounded by BLOCK positions beside the texts themselves."""

    def __init__(self, model: BiGru, chunk: int = CHUNK, warm: int = WARM):
        self.model, self.chunk, self.warm = model.single(), chunk, warm
        self.hidden = self.model.w["fV"].shape[0]

    def _blocks(self, parts: list[bytes], rows: np.ndarray):
        """Rows of parts, the longest first, in blocks of BLOCK positions."""
        rows = rows[np.argsort([-len(parts[r]) for r in rows], kind="stable")]
        at = 0
        while at < len(rows):
            n = max(1, BLOCK // max(1, len(parts[rows[at]])))
            yield rows[at : at + n]
            at += n

    def _ends(self, parts: list[bytes], d: str) -> np.ndarray:
        """The last states of parts read from a zero state."""
        out = np.zeros((len(parts), self.hidden), np.float32)
        for rows in self._blocks(parts, np.arange(len(parts))):
            x, sizes = _filled([parts[r] for r in rows])
            out[rows] = self.model.states(x, sizes, np.zeros((len(rows), self.hidden), np.float32), d, False)[1]
        return out

    def sums(self, raws: list[bytes]) -> np.ndarray:
        """The sum of the probabilities over all positions of each text."""
        parts, doc = [], []
        for i, raw in enumerate(raws):
            for at in range(0, len(raw), self.chunk):
                parts.append(raw[at : at + self.chunk])
                doc.append(i)
        doc = np.array(doc, np.int64)
        out = np.zeros((len(parts), len(self.model.langs)))
        # chunks that go on from the one before them, and those that another one goes on from
        later = np.nonzero(doc[1:] == doc[:-1])[0] + 1
        start = {d: np.zeros((len(parts), self.hidden), np.float32) for d in "fb"}
        end = {d: np.zeros((len(parts), self.hidden), np.float32) for d in "fb"}
        start["f"][later] = self._ends([parts[k - 1][-self.warm :] for k in later], "f")
        start["b"][later - 1] = self._ends([parts[k][: self.warm] for k in later], "b")
        todo = np.arange(len(parts))
        while len(todo):
            for rows in self._blocks(parts, todo):
                x, sizes = _filled([parts[r] for r in rows])
                f, end["f"][rows] = self.model.states(x, sizes, start["f"][rows], "f", True)
                b, end["b"][rows] = self.model.states(x, sizes, start["b"][rows], "b", True)
                out[rows] = self._pooled(f, b, sizes)
            wrong_f = later[np.abs(end["f"][later - 1] - start["f"][later]).max(1, initial=0) > TOLERANCE]
            wrong_b = later[np.abs(end["b"][later] - start["b"][later - 1]).max(1, initial=0) > TOLERANCE] - 1
            start["f"][wrong_f], start["b"][wrong_b] = end["f"][wrong_f - 1], end["b"][wrong_b + 1]
            todo = np.union1d(wrong_f, wrong_b)
        total = np.zeros((len(raws), out.shape[1]))
        np.add.at(total, doc, out)
        return total

    def _pooled(self, f: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        w, n, total = self.model.w, self.hidden, np.zeros((f.shape[1], len(self.model.langs)))
        for at in range(0, len(f), 64):
            k = int((sizes > at).sum())
            s = f[at : at + 64, :k] @ w["O"][:n]
            s += b[at : at + 64, :k] @ w["O"][n:]
            s += w["o"]
            s -= s.max(2, keepdims=True)
            np.exp(s, out=s)
            s /= s.sum(2, keepdims=True)
            s *= (np.arange(at, at + len(s))[:, None] < sizes[:k])[:, :, None]
            total[:k] += s.sum(0, dtype=np.float64)
        return total

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Mean over all positions of each text; zeros for an empty one."""
        raws = [letters(t) for t in texts]
        return self.sums(raws) / np.maximum(1, [[len(r)] for r in raws]) if raws else np.zeros((0, len(self.model.langs)))


def has_letter(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


def label_positions(text: str, model: BiGru) -> list[str]:
    """The language of each of the text's bytes."""
    raw = letters(text)
    return [model.langs[k] for k in model.positions(np.frombuffer(raw, np.uint8)[None]).argmax(2)[:, 0]] if raw else []


def sample_windows(text: str, n: int, size: int) -> list[bytes]:
    """n windows of the whole text's bytes, at places drawn by a generator seeded with the text; a shorter text is one window."""
    raw = letters(text)
    if len(raw) <= size:
        return [raw] if raw else []
    rng = np.random.default_rng(zlib.crc32(raw))
    return [raw[at : at + size] for at in rng.integers(0, len(raw) - size + 1, n).tolist()]


def train(docs: DataFrame, *, per_lang: int = 400, max_rows: int = 40_000, per_text: int = 4, window: int = 96, fold: int | None = 2, folds: int = 4, lang_col: str = "lang", **params) -> BiGru:
    """Fits on per_text windows of `window` bytes of each of about per_lang rows of each language, at most about max_rows rows in
    all: the bound of the sample (over max_rows languages, the commonest are learned).

    Rows are chosen by a hash of id and text; the driver gets the sampled windows only.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if fold is not None:
        own = own.filter(crc_mod("doc_id", folds) != fold)
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows).collect()
    if not counts:
        return BiGru([], {})
    per_lang = min(per_lang, max(1, max_rows // len(counts)))
    bounds = docs.sparkSession.createDataFrame([(r["lang"], int((1 << 30) * min(1.0, per_lang / r["n"]))) for r in counts], "lang string, bound long")
    chosen = own.join(F.broadcast(bounds), "lang").filter(F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 30)) < F.col("bound"))

    def pick(batches):
        for b in batches:
            got = [(x, lang) for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()) for x in sample_windows(t, per_text, window)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.binary()), pa.array([x for _, x in got], pa.string())], names=["window", "lang"])

    got = sorted((bytes(r["window"]), r["lang"]) for r in chosen.select("text", "lang").mapInArrow(pick, "window binary, lang string").collect())
    return fit_windows([x for x, _ in got], [x for _, x in got], **params)


def identify(docs: DataFrame, model: BiGru, *, fold: int = 2, folds: int = 4) -> DataFrame:
    """One row per document: doc_id, held_out (null for a null id), lang_pred, score. One map, no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        pooler = Pooler(model) if model.langs else None
        for b in batches:
            for part in slices(b, "text"):
                texts = part.column("text").to_pylist()
                ok = [pooler is not None and has_letter(t) for t in texts]
                p = pooler.probabilities([t if k else "" for t, k in zip(texts, ok)]) if pooler else np.zeros((len(texts), 1))
                best = p.argmax(1)
                langs = [model.langs[i] if k else "und" for i, k in zip(best, ok)]
                score = [min(1.0, float(p[j, i])) if k else 0.0 for j, (i, k) in enumerate(zip(best, ok))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], schema=schema)

    out = text_rows(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (crc_mod("doc_id", folds) == fold).alias("held_out"), "lang_pred", "score")
