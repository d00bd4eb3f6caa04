"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

A text is cut into pieces by the tokenizer's pattern. Each batch hands its distinct new pieces to
DuckDB as rows (piece, tokens), the tokens being single bytes first. A recursive query joins all
neighbouring tokens with the merge table and contracts each piece's pairs of least rank, until no
piece has a pair left; pieces of all lengths go the same way. The ids of a bounded number of
recent pieces are remembered by the worker. Decoding is an ordered aggregation of the tokens'
bytes over each document's ids.

Ids equal those of the tiktoken library without special tokens: a piece that is a token itself
is that token.

Defined results: a null or empty text has no token (its digests are those of empty strings);
equal texts have equal results, so repeated rows do; a null id is carried through; a very long text is one row of one task,
and a very long piece takes rounds by its ranks; a piece is one row, so one that outgrows the memory of DuckDB ends the run (4 million
letters without a break pass, 10 million do not); other columns of the input, whatever their names, are not read; an empty table
gives an empty table. One map, no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import KEPT, small_slices, text_rows

#: Rounds of one query; a piece that has pairs left after them goes on in the next query from its last rows.
ROUNDS = 64
#: The character of id 0. Tokens of a piece are a string with one character for each, four bytes in UTF-8.
FIRST = 0x10000
#: A row is a piece. A round takes the leftmost pair of least rank and replaces that pair everywhere, from the left, by the merged
#: token's character, so rounds grow with the number of ranks, not with the length. That is the same as one leftmost place after
#: another unless a pair that arises meanwhile has a lower rank or another pair of that rank shares a token with it: in a piece
#: where any of this can be (odd) the round contracts the leftmost place only. A piece's last row has its tokens.
STEP = f"""
CREATE OR REPLACE TABLE last AS
WITH RECURSIVE t(step, w, s) AS (
  SELECT 0, w, s FROM start
  UNION ALL
  (WITH least AS (SELECT w, min((m << 32) | i) AS low
                  FROM (SELECT w, unnest(c) || unnest(c[2:]) AS p, unnest(range(1, len(c))) AS i FROM (SELECT w, string_split(s, '') AS c FROM t WHERE step < {ROUNDS}))
                  JOIN merges USING (p) GROUP BY w),
   hit AS (SELECT step, w, s, low >> 32 AS m, low & 4294967295 AS i, chr(({FIRST} + (low >> 32))::INT) AS token FROM t JOIN least USING (w)),
   every AS MATERIALIZED (SELECT *, replace(s, s[i : i + 1], token) AS shorter FROM hit),
   one AS (SELECT DISTINCT w FROM every JOIN odd USING (m) WHERE strlen(s) - strlen(shorter) > 4 AND contains(s, part))
   SELECT step + 1, w, CASE WHEN one.w IS NULL THEN shorter ELSE s[: i - 1] || token || s[i + 2 :] END FROM every LEFT JOIN one USING (w)))
SELECT w, arg_max(s, step) AS s, max(step) AS n FROM t GROUP BY w
"""
#: Tokens in a row, by the rank m of a pair, beside which a round may not contract all places of m at once: the merged token forms
#: a pair of a lower rank with the token after it, before it or another of its kind; or two pairs of rank m share a token.
ODD = """
CREATE TABLE odd AS
SELECT a.m, a.p || e.p[2:] AS part FROM merges a JOIN merges e ON e.l = a.m WHERE e.m < a.m
UNION SELECT a.m, e.p[:1] || a.p FROM merges a JOIN merges e ON e.r = a.m WHERE e.m < a.m
UNION SELECT a.m, a.p || b.p FROM merges a JOIN merges e ON e.l = a.m AND e.r = a.m JOIN merges b ON b.m = a.m WHERE e.m < a.m
UNION SELECT a.m, a.p || b.p[2:] FROM merges a JOIN merges b ON b.m = a.m AND b.l = a.r WHERE a.l <> a.r
"""
DONE = f"SELECT w, array_to_string(list_transform(string_split(s, ''), lambda c: unicode(c) - {FIRST}), ',') FROM last WHERE n < {ROUNDS}"
REST = f"CREATE OR REPLACE TABLE start AS SELECT w, s FROM last WHERE n = {ROUNDS}"

#: The bytes of each document's ids, one character of the first 256 for a byte.
DECODE = "SELECT d, string_agg(chars, '' ORDER BY pos) AS chars FROM (SELECT d, pos, chars FROM given JOIN vocab USING (id)) GROUP BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PieceCoder:
    """Encodes distinct pieces and decodes documents' ids; remembers the ids of at most about `keep` pieces, those met lately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 700_000, chunk: int = 20_000, memory: str = "300MB"):
        import duckdb
        import regex

        self.ranks, self.keep, self.chunk = ranks, keep, chunk
        self.findall = regex.compile(pattern).findall
        self.known: dict[str, str] = {}  # piece to ids
        self.older: dict[str, str] = {}
        self.single = np.frombuffer("".join(chr(FIRST + ranks[bytes([i])]) for i in range(256)).encode(), np.uint32)  # a byte's character
        # what does not fit in memory goes to the worker's own temporary folder, never to its current one
        self.spill = tempfile.TemporaryDirectory(prefix="spanlake-bpe-")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": self.spill.name})
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self._put("merges", {k: np.array([m[j] for m in merges], np.int64) for j, k in enumerate("lrm")} | {"p": [chr(FIRST + l) + chr(FIRST + r) for l, r, _ in merges]})
        self.db.execute(ODD)
        self._put("vocab", {"id": np.fromiter(ranks.values(), np.int32, len(ranks)), "chars": [t.decode("latin-1") for t in ranks]})

    def _put(self, name: str, columns: dict) -> None:
        self.db.register("arrow_in", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM arrow_in")
        self.db.unregister("arrow_in")

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), self.chunk):
            part = new[at : at + self.chunk]
            raw = [p.encode() for p in part]
            self.known.update((piece, str(self.ranks[b])) for piece, b in zip(part, raw) if b in self.ranks)
            cut = [(i, b) for i, b in enumerate(raw) if b not in self.ranks]
            self._put("start", self._rows(cut))
            done = 0
            while done < len(cut):
                self.db.execute(STEP)
                got = self.db.execute(DONE).fetchall()
                self.known.update((part[w], ids) for w, ids in got)
                done += len(got)
                if done < len(cut):
                    self.db.execute(REST)

    def _rows(self, cut: list[tuple[int, bytes]]) -> dict:
        """Pieces as rows (w, s): a piece's number and its single bytes' characters."""
        ends = np.cumsum([0] + [4 * len(b) for _, b in cut])
        chars = self.single[np.frombuffer(b"".join(b for _, b in cut), np.uint8)]
        return {"w": pa.array([i for i, _ in cut], pa.int64()), "s": pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(chars))}

    def encoded(self, texts: list[str]) -> list[str]:
        """Every text's ids, joined by commas."""
        if 2 * len(self.known) > self.keep:
            self.older, self.known = self.known, {}
        pieces = [self.findall(t) for t in texts]
        new = set().union(*pieces).difference(self.known)
        met = new.intersection(self.older)
        self.known.update((p, self.older[p]) for p in met)
        self._learn(list(new - met))
        return [",".join(map(self.known.__getitem__, ps)) for ps in pieces]

    def decoded(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each document's ids, by one ordered aggregation."""
        n = np.array([len(x) for x in ids], np.int64)
        ends = np.cumsum(n)
        self._put("given", {"d": np.repeat(np.arange(len(ids), dtype=np.int32), n), "pos": (np.arange(n.sum()) - np.repeat(ends - n, n)).astype(np.int32), "id": np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)})
        got = dict(self.db.execute(DECODE).fetchall())
        return [got.get(d, "").encode("latin-1") for d in range(len(ids))]

    def encode(self, text: str) -> list[int]:
        return numbers(self.encoded([text])[0]).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return self.decoded([np.array(ids, np.int32)])[0]


def numbers(ids: str) -> np.ndarray:
    """The ids of a string of decimals joined by commas."""
    return np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32)


def _worker_coder(path: str, pattern: str, shared) -> PieceCoder:
    """One coder for all tasks of a Python worker, until the worker takes tasks of another operator."""
    if KEPT.get("bpe", ())[:2] != (path, pattern):
        KEPT["bpe"] = (path, pattern, PieceCoder(shared.value, pattern))
    return KEPT["bpe"][2]


def tokens(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, the ids.

    The ranks (a file of about a megabyte) are read once on the driver and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields, ddl = [*fields, ("ids", pa.list_(pa.int32()))], f"{ddl}, ids array<int>"
    schema = pa.schema(fields)

    def run(batches):
        coder = _worker_coder(ranks_path, pattern, shared)

        def coded(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = coder.encoded([t or "" for t in b.column("text").to_pylist()])
            ids = [numbers(t) for t in texts]
            columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]), pa.array([hashlib.sha256(t).hexdigest() for t in coder.decoded(ids)])]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], schema=schema)

        yield from map(coded, small_slices(batches, "text", 4_000_000, "bpe"))

    return text_rows(docs, id_col, text_col).mapInArrow(run, ddl)
