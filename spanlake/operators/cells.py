"""Tables: a value found by the label in the cell to its left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The whole of a label's cell, and of a bank code's.
BIK_LABEL = r"(?iU)^\s*бик\s*[:№]?\s*$"
BIK_VALUE = r"^\s*(\d{9})\s*$"


def labelled_cells(cells: DataFrame, label: Column, value: str) -> DataFrame:
    """Spans in cells right of a cell that fulfils `label`, in the same row of the same sheet; value: a pattern for the whole cell
    whose group is the span. cells: doc_id, seg_order, sheet, row, col, text. One equi join; a cell has one neighbour."""
    place = ["doc_id", "sheet", "row", "col"]
    named = cells.filter(label).select("doc_id", "sheet", "row", (F.col("col") + 1).alias("col")).distinct()
    hits = cells.join(named, place, "left_semi").filter(F.col("text").rlike(value))
    own = F.regexp_extract("text", value, 1)
    start = F.instr("text", own) - 1
    return hits.select("doc_id", "seg_order", start.alias("start"), (start + F.length(own)).alias("end"), own.alias("text"))


def labelled_biks(cells: DataFrame) -> DataFrame:
    """Bank codes by an exact label to their left."""
    found = labelled_cells(cells, F.col("text").rlike(BIK_LABEL), BIK_VALUE)
    return found.select("*", F.lit("bik").alias("type"), F.lit(1.0).alias("confidence"))
