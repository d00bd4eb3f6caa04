"""Shared pieces: the shared folder, written intermediate tables, stable hashes, table readers."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where none is set and all runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spanlake-")
        spark.conf.set("spark.checkpoint.dir", f"file://{found}")
    found = spark.conf.get("spark.checkpoint.dir", None) or found
    return found.rstrip("/")


class Workspace:
    """Intermediate tables, written as Parquet to the shared folder.

    A written table cuts the lineage, survives the loss of executors and is read as often as
    needed. ``drop`` frees a table that later steps no longer read; the rest goes at exit.
    """

    #: All workspaces of this process whose tables may still be read.
    made: ClassVar[list[Workspace]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        Workspace.made.append(self)
        self.root = f"{shared_dir(spark)}/spanlake/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        try:
            hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            hadoop_path.getFileSystem(conf).delete(hadoop_path, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return

    def write(self, df: DataFrame, name: str, **metrics: Column):
        """Writes df; returns the table read back, and the metrics of its rows where any are asked for."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:6]}"
        observed = Observation() if metrics else None
        if observed:
            df = df.observe(observed, *(c.alias(k) for k, c in metrics.items()))
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._spanlake_path = path
        return (back, observed.get) if observed else back

    def clear(self) -> None:
        """Removes all tables, when no later step reads any."""
        self._remove(self.root)
        Workspace.made.remove(self)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._remove(t._spanlake_path)


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under those two names, whatever else the table holds."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts (or lists, of eight bytes an item) have at most about `most` bytes; a longer one is a run of its own."""
    own = batch.column(column)
    sizes = pc.multiply(pc.list_value_length(own), 8) if pa.types.is_list(own.type) else pc.binary_length(own)
    sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def small_slices(batches, column: str = "text", most: int = 1_000_000, own: str = "") -> Iterator[pa.RecordBatch]:
    """All rows of the batches in runs as of `slices`; what the worker freed goes back to the system between batches and at the end,
    as a worker that waits for its next task keeps its memory."""
    for whole in batches:
        yield from slices(whole, column, most)
        del whole
        give_back(own)


#: What operators keep in a Python worker from task to task, by the operator's name.
KEPT: dict[str, tuple] = {}


def give_back(own: str = "") -> None:
    """Freed memory of this process, of Arrow's pool and of the allocator, goes back to the system; so does what operators other
    than `own` keep, as the worker has turned to another stage."""
    for name in KEPT.keys() - {own}:
        del KEPT[name]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        return


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    names = {c.lower() for c in df.columns}
    while name.lower() in names:
        name = f"_{name}"
    return name


def crc_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % mod


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit_hash(*parts: Column | str, seed: str) -> Column:
    """A number in [0, 1) from SHA-256 of the parts: 52 bits, the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(seed), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
